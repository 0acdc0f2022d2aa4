"""The quality classifier against a plain interpolated modified Kneser-Ney model and plain quantiles."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality_lm as lm
from graphloom.llm.thresholds import STEPS, with_limit
from graphloom.llm.trusted import held_out


def plain(train):
    """log p of a text in the same model, by dictionaries."""
    closed = lambda t: ["<e>", *t.split(), "<e>"]
    c = collections.Counter(b for t in train for s in [closed(t)] for b in zip(s, s[1:]))
    follow = collections.Counter(w for _, w in c)
    d2 = lm.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    d1 = lm.discounts([sum(x == k for x in follow.values()) for k in (1, 2, 3, 4)])
    cut = lambda n, d: d[min(n, 3) - 1] if n else 0.0
    total, mass = collections.Counter(), collections.Counter()
    for (v, _), n in c.items():
        total[v] += n
        mass[v] += cut(n, d2)
    every = sum(follow.values()) or 1
    rest = sum(cut(n, d1) for n in follow.values()) / every if follow else 1.0
    p1 = lambda w: (follow[w] - cut(follow[w], d1)) / every + rest / (len(follow) + 1)

    def p(v, w):
        return (max(c[v, w] - cut(c[v, w], d2), 0) + mass[v] * p1(w)) / total[v] if total[v] else p1(w)

    return lambda t: sum(math.log(p(v, w)) for s in [closed(t)] for v, w in zip(s, s[1:]))


def repeats(t):
    s = ["<e>", *t.split(), "<e>"]
    return 1 - len(set(zip(s, s[1:]))) / (len(s) - 1)


def _texts(rng, n, words):
    return [" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(1, 60))) for _ in range(n)]


def test_scores_match_whatever_the_layout(spark):
    rng = random.Random(4)
    texts = _texts(rng, 80, [f"w{i}" for i in range(60)]) + ["zzz qqq zzz", "", "  ", None, "w1 " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    trusted = spark.createDataFrame([(i,) for i in range(0, 80, 2)], "g long")
    score = plain([texts[i] for i in range(0, 80, 2)])
    runs = [
        {r["id"]: (r["n"], r["nats"], r["fresh"]) for r in lm.score(docs.repartition(n), trusted, hot=hot, parts=parts).collect()}
        for n, hot, parts in ((1, lm.HOT, 1), (16, lm.HOT, 2), (200, 0, 3), (5, 7, 2))
    ]
    assert all(r == runs[0] for r in runs)
    assert len(runs[0]) == len(texts)
    for i, t in enumerate(texts):
        n, nats, fresh = runs[0][i]
        assert n == len((t or "").split())
        assert abs(nats - score(t or "")) < 1e-3 * (2 + n), (i, nats, score(t or ""))
        assert abs(1 - fresh / (n + 1) - repeats(t or "")) < 1e-9


def test_all_trusted_words_are_known(spark):
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randint(0, 12000)}" for _ in range(300)) for _ in range(60)] + ["once qqq"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string").repartition(9)
    trusted = spark.createDataFrame([(i,) for i in range(0, 60, 2)], "g long")
    score = plain([texts[i] for i in range(0, 60, 2)])
    for r in lm.score(docs, trusted, hot=100).collect():
        assert abs(r["nats"] - score(texts[r["id"]])) < 1e-3 * (1 + r["n"]), r


def limits(of, seen, n, lang, quantile, least, tail=True):
    """For each document the limit, in steps, of its class among the seen ones, by sorting."""
    size = lambda i: int(math.log2(n[i] + 1))
    out = {}
    for i in of:
        for like in (lambda j: (size(j), lang[j]), lambda j: lang[j], size, lambda j: 0):
            some = sorted(round(of[j] * STEPS) for j in seen if j in of and like(j) == like(i))
            if len(some) >= (least if tail else max(least, math.ceil(1 / (1 - quantile) - 1e-9))):
                break
        at = lambda q: some[math.ceil(len(some) * q) - 1]
        out[i] = at(quantile) if some else None
        if some and tail and quantile > 0.9 and len(some) * (1 - quantile) < 1 - 1e-9:  # too few for the quantile
            out[i] = math.floor(at(0.9) + (at(0.9) - at(0.5)) * math.log(0.1 / (1 - quantile)) / math.log(5))
    return out


@pytest.mark.parametrize("quantile", [0.5, 0.998])
def test_verdicts_are_those_of_plain_quantiles(spark, quantile):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = _texts(rng, 900, words) + [" ".join(f"j{rng.randint(0, 99)}" for _ in range(20)) for _ in range(40)] + ["w3 " * 30] * 5
    lang = ["en" if i % 3 else "de" for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, lang))], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(900) if i % 10], "doc_id long, quality int, toxic int")
    held = {r["doc_id"] for r in labels.where(held_out("doc_id")).collect()}
    good = {i for i in range(900) if i % 10}
    score = plain([texts[i] for i in sorted(good - held)])
    n = [len(t.split()) for t in texts]
    loss, again = ({i: f(t) for i, t in enumerate(texts)} for f in (lambda t: -score(t) / (len(t.split()) + 1), repeats))
    most, worst = limits(loss, held, n, lang, quantile, lm.LEAST), limits(again, good, n, lang, quantile, lm.LEAST, False)
    got = {r["doc_id"]: r for r in lm.classify(docs.repartition(4), labels, quantile=quantile).collect()}
    assert len(got) == len(texts)
    differ = 0
    for i in range(len(texts)):
        a, b = most[i], worst[i]
        assert abs(math.log(got[i]["threshold"]) * STEPS - a) <= 2 and abs(got[i]["most_repeats"] * STEPS - b) < 0.1
        near = abs(loss[i] * STEPS - a) <= 2  # sums are rounded
        differ += not near and got[i]["kept"] != (loss[i] * STEPS <= a and round(again[i] * STEPS) <= b)
    assert differ == 0
    assert not any(got[i]["kept"] for i in range(900, len(texts)))


def test_classes_and_awkward_rows(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    good = [" ".join(rng.choices(words, k=40)) for _ in range(150)]
    bad = [" ".join(f"j{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(10)]
    rows = [(i, t, "en", 7) for i, t in enumerate(good + bad)] + [(900, None, "en", 7), (901, "", None, 7), (902, " \n", "en", 7), (None, good[0], "en", 7), (0, good[0], "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in lm.classify(docs, labels).collect()}
    assert len(got) == 163 and None not in got
    assert sum(got[i]["kept"] for i in range(150)) >= 147 and not any(got[i]["kept"] for i in range(150, 160))
    assert not any(got[i]["kept"] or got[i]["n_words"] for i in (900, 901, 902))
    assert lm.classify(docs.limit(0), labels).count() == 0
    free = lm.classify(docs, labels.limit(0)).where("n_words > 0")
    assert free.where(F.expr("not kept or threshold is not null")).count() == 0


def test_languages_of_like_length_have_limits_of_their_own(spark):
    """German here is spread more than English; each is held against its own, and one odd document makes no limit."""
    rng = random.Random(2)
    rows = [(i, "en" if i % 2 else "de", 100, 1.0 + rng.random() * (0.1 if i % 2 else 2.0)) for i in range(160)] + [(160, "en", 100, 9.0), (161, "fr", 7, 1.05)]
    df = spark.createDataFrame(rows, "id long, lang string, n long, loss double").repartition(3)
    got = {r["id"]: r["m"] for r in with_limit(df, df.where("lang <> 'fr'"), "loss", 0.998, 30, "m").collect()}
    want = limits({r[0]: r[3] for r in rows}, range(161), [r[2] for r in rows], [r[1] for r in rows], 0.998, 30)
    assert all(abs(got[i] * STEPS - want[i]) < 1e-6 for i in got)
    assert got[1] < 1.3 < 3 < got[0] < 9 and got[161] < 9 and len({got[i] for i in (0, 1, 161)}) == 3
