"""Count automata and collocations against plain counting."""

import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import collocations as module
from graphloom.llm.collocations import Ranges, collocations
from graphloom.llm.count_automata import CountAutomaton, Union


def pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in ".,;:!?\n\v\f\r":
        text = text.replace(c, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in text.split("\n")]


def plain(docs, least=10, top=2000, share=50):
    out = []
    by = {}
    for lang, text in docs:
        by.setdefault("und" if lang is None else lang, []).extend(pieces(text))
    for lang, found in by.items():
        f = Counter(tuple(p[i : i + k]) for p in found for k in (1, 2, 3) for i in range(len(p) - k + 1))
        n = sum(map(len, found))
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = {g[i : i + 2] for g, a in cand.items() if len(g) == 3 for i in (0, 1) if 100 * a >= share * f[g[i : i + 2]]}
        rows = []
        for g, a in cand.items():
            if g not in gone:
                score, k = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus(seed, n=300):
    r = random.Random(seed)
    words = ["the"] * 30 + [f"w{i}" for i in range(60)] + ["é", "日本", "\x00en", "x" * 200]
    phrases = [["new", "york", "city"], ["machine", "learning"], ["the", "same", "line"]]
    docs = []
    for _ in range(n):
        t = []
        for _ in range(r.randint(0, 60)):
            t += r.choice(phrases) if r.random() < 0.2 else [r.choice(words)]
            if r.random() < 0.1:
                t[-1] += r.choice(".,;:!?")
        docs.append((r.choice(["en", "de", None, ""]), r.choice([" ", "\t ", "\n"]).join(t).title() if r.random() < 0.3 else " ".join(t)))
    return docs


@pytest.mark.parametrize("size", [50, 10**6])
def test_against_plain_counts(spark, monkeypatch, size):
    """With ranges so small that the frequent word is cut by its second words, and with one range."""
    monkeypatch.setattr(module.Ranges.of, "__defaults__", (size,))
    docs = corpus(size)
    df = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, lang string, text string").repartition(5)
    assert sorted(map(tuple, collocations(df).collect())) == plain(docs)
    assert sorted(map(tuple, collocations(df, top=5, least=20).collect())) == plain(docs, 20, 5)


def test_stated_cases(spark):
    docs = [(None, "a b a b a b a b a b a b a b a b a b a b a b"), (None, None), ("en", ""), ("en", " .,;\n"), ("fr", "A B\tc, " * 30), ("fr", "a\x0bb " * 20_000)]
    df = spark.createDataFrame([(*d, 1, "x", "y") for d in docs], "lang string, text string, n int, phrase string, range string")
    assert sorted(map(tuple, collocations(df).collect())) == plain(docs)
    twice = df.union(df)
    assert sorted(map(tuple, collocations(twice).collect())) == plain(docs + docs)
    assert collocations(df.limit(0)).collect() == []
    assert collocations(df, least=10**6).collect() == []


def test_automata_round_trip_union_and_composition():
    r = np.random.default_rng(3)
    names = [f"w{i:03d}".encode() for i in range(40)]
    total, union = Counter(), Union(most=50)
    for _ in range(6):
        own = Counter(tuple(r.integers(0, 40, int(r.integers(1, 4))).tolist()) for _ in range(300))
        total += own
        levels = [(np.array([g for g in own if len(g) == k], np.int32).reshape(-1, k), np.array([n for g, n in own.items() if len(g) == k], np.int64)) for k in (1, 2, 3)]
        union.add(CountAutomaton.loads(CountAutomaton.build(names, levels).dumps()))
    whole = CountAutomaton.loads(union.result(2).dumps())
    spelt = {tuple(whole.words[i] for i in g): n for ids, w in whole.levels() for g, n in zip(ids.tolist(), w.tolist())}
    assert spelt == {tuple(names[i] for i in g): n for g, n in total.items() if n >= 2}
    asked = [g for g in total if len(g) > 1][::3] + [(1, 1, 1), (39,)]
    levels = [(np.array([g for g in asked if len(g) == k], np.int32).reshape(-1, k), np.ones(sum(len(g) == k for g in asked), np.int64)) for k in (1, 2, 3)]
    hits = {tuple(names[i] for i in g): n for g, n in CountAutomaton.build(names, levels).compose(whole)}
    assert hits == {k: n for k, n in spelt.items() if k in {tuple(names[i] for i in g) for g in asked}}
    same = CountAutomaton.build(names, [(np.array([(i, j, 7) for i in range(30) for j in range(30)], np.int32), np.full(900, 5, np.int64))])
    assert len(same.offsets) - 1 == 3  # all contexts go on alike: one state a depth


def test_ranges_hold_each_prefix_once():
    ranges = Ranges(sorted([(b"en", b"the", b""), (b"en", b"the", b"k"), (b"en", b"the\x00", b""), (b"fr", b"a", b"")]))
    assert list(ranges.all_of(b"en", b"the")) == [1, 2] and ranges.at(b"en", b"the", b"cat") == 1 and ranges.at(b"en", b"the", b"zoo") == 2
    assert list(ranges.all_of(b"en", b"thea")) == [3] and list(ranges.all_of(b"de", b"x")) == [0] and list(ranges.all_of(b"fr", b"b")) == [4]
