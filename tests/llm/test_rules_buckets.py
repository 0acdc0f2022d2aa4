"""The quality rules' weights against plain counts of words and pairs."""

import collections
import math
import random

import numpy as np
import xxhash

from graphloom.llm.common import mix
from graphloom.llm.quality_rules import BUCKET_BITS, LEAST, WORST_SHARE, apply_rules
from graphloom.llm.thresholds import STEPS
from graphloom.llm.trusted import held_out

from test_language_model import limits


def plain_scores(texts, target):
    """Score and worst share of each text with words, counted by bucket of words and pairs."""
    grams = {}
    for i, t in enumerate(texts):
        h = [xxhash.xxh3_64_intdigest(w.encode()) >> 32 for w in (t or "").split()]
        pair = [int(mix(np.array([(a << 32) + b], np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0]) >> (64 - BUCKET_BITS) for a, b in zip(h, h[1:])]
        grams[i] = [x >> (32 - BUCKET_BITS) for x in h], pair
    logs = []
    for some in (target, range(len(texts))):
        n = [sum((collections.Counter(grams[i][k]) for i in some), collections.Counter()) for k in (0, 1)]
        logs.append([lambda x, c=c: math.log((c[x] + 1) / (c.total() + 2**BUCKET_BITS)) for c in n])
    ratios = {i: [[logs[0][k](x) - logs[1][k](x) for x in g[k]] for k in (0, 1)] for i, g in grams.items() if g[0]}
    score = {i: sum(map(sum, r)) / sum(map(len, r)) for i, r in ratios.items()}
    few = {i: max(1, math.ceil(len(r[0]) * WORST_SHARE)) for i, r in ratios.items()}
    return score, {i: sum(sorted(r[0])[: few[i]]) / few[i] for i, r in ratios.items()}


def test_scores_are_those_of_whole_words(spark):
    """3000 words and their pairs meet in few buckets, so nearly every score is that of counts by word."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 3000)}" for _ in range(60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(7)
    labels = spark.createDataFrame([(i, 1, int(i >= 40)) for i in range(60)], "doc_id long, quality int, toxic int")
    grams = [(collections.Counter(w), collections.Counter(zip(w, w[1:]))) for w in map(str.split, texts)]
    held = {r["doc_id"] for r in labels.where(held_out("doc_id")).collect()}
    logs = []
    for some in ([g for i, g in enumerate(grams[:40]) if i not in held], grams):
        for k in (0, 1):
            n = sum((g[k] for g in some), collections.Counter())
            whole = sum(n.values()) + 2**BUCKET_BITS
            logs.append(lambda x, n=n, whole=whole: math.log((n[x] + 1) / whole))
    right = 0
    for r in apply_rules(docs, labels).collect():
        w = texts[r["doc_id"]].split()
        found = [logs[0](x) - logs[2](x) for x in w] + [logs[1](x) - logs[3](x) for x in zip(w, w[1:])]
        right += abs(r["score"] - sum(found) / len(found)) < 1e-6 and abs(r["worst"] - sum(sorted(found[: len(w)])[:3]) / 3) < 1e-6
    assert right > 40


def test_verdicts_are_those_of_plain_quantiles(spark):
    """Of documents that pass the base rules, those whose score reaches the quantile of held-out trusted ones of their class."""
    rng = random.Random(8)
    plain = [" ".join(f"w{int(rng.paretovariate(0.8)) % 500}" for _ in range(rng.randint(55, 140))) for _ in range(700)]
    odd = [" ".join(rng.choice([f"w{rng.randint(0, 499)}", f"bad{rng.randint(0, 9)}"]) for _ in range(80)) for _ in range(30)]
    texts = plain + odd + ["short text", "", None]
    lang = ["en" if i % 3 else None for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, lang))], "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(700) if i % 8], "doc_id long, quality int, toxic int")
    held = {r["doc_id"] for r in labels.where(held_out("doc_id")).collect()}
    quantile = 0.05
    rows = {r["doc_id"]: r for r in apply_rules(docs, labels, quantile=quantile).collect()}
    n = {i: len((t or "").split()) for i, t in enumerate(texts)}
    score, worst = plain_scores(texts, [i for i in range(700) if i % 8 and i not in held])
    assert all(abs(rows[i]["score"] - score[i]) < 1e-6 and abs(rows[i]["worst"] - worst[i]) < 1e-6 for i in score)
    assert {i for i, r in rows.items() if r["score"] is not None} == score.keys()
    loss, flaw = ({i: -x for i, x in of.items()} for of in (score, worst))
    seen = {i for i in held if not rows[i]["base_failed"]}
    most, flaws = limits(loss, seen, n, lang, 1 - quantile, LEAST), limits(flaw, seen, n, lang, 1 - quantile, LEAST)
    near = 0
    for i, r in rows.items():
        if i not in loss:
            assert r["base_failed"] and not r["kept"]
            continue
        close = min(abs(loss[i] * STEPS - most[i]), abs(flaw[i] * STEPS - flaws[i])) < 0.6
        near += close
        assert abs(-r["threshold"] * STEPS - most[i]) <= 1 and abs(-r["worst_threshold"] * STEPS - flaws[i]) <= 1
        if not close:
            assert r["kept"] == (not r["base_failed"] and loss[i] * STEPS <= most[i] and flaw[i] * STEPS <= flaws[i]), i
    assert near < 200 and not any(rows[i]["kept"] for i in range(700, 730)) and sum(rows[i]["kept"] for i in range(700)) > 200
