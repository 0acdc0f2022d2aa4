"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from graphloom.llm import jaccard_join
from graphloom.llm.jaccard_join import keys, levels, may_miss, similar_components, similar_pairs, smaller_may_miss


def grams(text, size=4):
    if text is None:
        return frozenset()
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split(" ") if x]
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def links(docs, percent=85, size=4):
    sets = [(k, grams(t, size)) for k, t in docs if k is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                yield a, b, x, y


def expected(docs, percent=85, size=4):
    up = {k: k for k, _ in docs if k is not None}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b, _, _ in links(docs, percent, size):
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return sorted(((k, len(grams(t, size)), None if k is None else top(k)) for k, t in docs), key=repr)


def corpus(seed, n=150):
    """Near copies by few edits of some originals, a passage that many share, short texts, and texts of their own."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda k: [r.choice(words) for _ in range(k)]
    heads, passage, out = [text(r.choice((9, 30, 120, 300))) for _ in range(6)], text(60), []
    for i in range(n):
        kind = r.random()
        if kind < 0.5:
            t = list(r.choice(heads))
            for _ in range(r.randint(0, max(1, len(t) // 20))):
                t[r.randrange(len(t))] = r.choice(words)
        elif kind < 0.8:
            t = passage + text(r.randint(0, 30))
        else:
            t = text(r.randint(1, 80))
        out.append((i, " ".join(t)))
    return out


@pytest.mark.parametrize("frequent,bits", [(1, 10), (3, 20), (1000, 4)])
def test_components_of_all_pairs(spark, frequent, bits):
    docs = corpus(frequent)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = similar_components(df, frequent=frequent, bits=bits)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(docs)


def test_exact_round_alone_and_pairs(spark):
    docs = corpus(11, 90)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = similar_components(df, frequent=2, bits=12, pivot_rounds=0)
    assert sorted(map(tuple, got.collect()), key=repr) == expected(docs)
    least = {}
    for k, t in docs:
        least.setdefault(grams(t), k)
    want = {(min(least[x], least[y]), max(least[x], least[y]), len(x & y), len(x | y)) for _, _, x, y in links(docs) if x != y}
    found = similar_pairs(df, frequent=2, bits=12).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 20


def test_stated_cases(spark):
    long_ = " ".join(f"t{i % 997}x{i % 31}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (6, "one two"), (7, "three four five six"), (7, "other words stand here too"), (8, long_), (9, long_ + " more"), (10, "other words stand here too"), (None, "one")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as N", "2 as set", "3 as node", "4 as component_id_", "5 as name")
    got = sorted(map(tuple, similar_components(df, bits=12).collect()), key=repr)
    n = len(grams(long_))
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (6, 1, 6), (7, 1, 7), (7, 2, 7), (8, n, 8), (9, n + 1, 8), (10, 2, 7), (None, 1, None)], key=repr)
    assert similar_components(df.limit(0), bits=12).collect() == []
    assert similar_components(df.selectExpr("doc_id as n_shingles", "text"), key="n_shingles", bits=12).columns == ["n_shingles", "n_shingles_", "component_id"]


@pytest.mark.parametrize("percent", [50, 85, 100])
def test_prefixes_keep_every_link(percent):
    """Any two sets that are similar enough share a key, the smaller one by its index prefix, with room enough."""
    r = np.random.default_rng(percent)
    for turn in range(300):
        n = int(r.integers(1, 200))
        x = np.unique(r.integers(1, 1 << 40, n).astype(np.uint64))
        n = len(x)
        m = int(r.integers(-(-percent * n // 100), n + 1))
        kept = r.choice(x, m, replace=False)
        y = np.unique(np.concatenate([kept, r.integers(1 << 41, 1 << 42, int(r.integers(0, n // 5 + 1))).astype(np.uint64)]))
        common = len(np.intersect1d(x, y))
        if 100 * common < percent * (len(x) + len(y) - common):
            continue
        often = set(r.choice(x, int(r.integers(0, n + 1)), replace=False).tolist())
        made = []
        for s in (x, y):
            size = len(s)
            s = s[np.argsort((s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50), kind="stable")][: may_miss(size, percent) + 1 + levels(size, percent)[-1]]
            hot = np.array([t in often for t in s.tolist()], bool)
            made.append((size, {k: (room, index) for ks, rooms, ix in keys(size, np.arange(len(s)), s, hot, percent) for k, room, index in zip(ks.tolist(), rooms.tolist(), ix.tolist())}))
        (n1, a), (n2, b) = sorted(made, key=lambda z: z[0])
        need = -(-percent * (n1 + n2) // (100 + percent))
        assert any(a[k][1] and min(a[k][0], b[k][0]) >= need for k in a.keys() & b.keys()), turn
    assert smaller_may_miss(100, 85) == 8 and may_miss(100, 85) == 15 and jaccard_join.subclasses(500, 85) == 32
