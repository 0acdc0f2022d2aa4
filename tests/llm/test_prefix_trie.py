"""The burst trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from graphloom.llm.prefix_trie import mixed_families, placed_turns, prefix_trie


def plain(convs):
    """Rows of the trie of {conv: [(role, text)]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            kids[key[:-1]] += 1
    for key, own in members.items():
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(own) - 1) * len(key[-1][1].encode()) if key else 0
    sha = lambda key: hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest()
    return sorted((min(own), len(k), min(members[k[:-1]]) if k else -1, len(own), kids[k], leaves[k], saved[k], sha(k)) for k, own in members.items())


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def rows_of(convs, seed):
    rows = [(c, i, r, t) for c, seq in convs.items() for i, (r, t) in enumerate(seq)]
    random.Random(seed).shuffle(rows)
    return rows


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def some(seed, n=60):
    r = random.Random(seed)
    turn = lambda: (r.choice(["user", "assistant"]), r.choice(["", "a", "bé", "ccc", "dddd"]))
    first = [("system", "hello")]
    convs = {}
    for c in r.sample(range(3 * n), n):
        kind = r.random()
        convs[c] = first + [turn() for _ in range(r.randint(0, 7))] if kind < 0.7 else first + [("user", "a")] * 6 if kind < 0.9 else [turn() for _ in range(r.randint(1, 3))]
    return convs


@pytest.mark.parametrize("limit", [7, 10**6])
def test_bursting_and_sweeping(spark, limit):
    convs = some(limit)
    df = spark.createDataFrame(rows_of(convs, 1), "conv_id long, turn int, role string, text string").repartition(4)
    assert got(prefix_trie(placed_turns(df), limit=limit)) == plain(convs)
    assert got(prefix_trie(*mixed_families(placed_turns(df)), limit=limit)) == plain(rebuilt(convs))


def test_long_chains_and_many_copies(spark):
    long_ = [("user", f"t{i % 50}") for i in range(9000)]
    convs = {7: long_, 11: long_, 12: long_[:1], 13: [("user", "other")], **{100 + i: [("user", "same"), ("user", "x")] for i in range(3000)}}
    df = spark.createDataFrame(rows_of(convs, 2), "conv_id long, turn int, role string, text string").repartition(4)
    rows = got(prefix_trie(placed_turns(df), limit=500))
    assert len(rows) == 9000 + 4
    deep = {r[:2]: r for r in rows}
    last = len("t49")
    assert deep[7, 9000] == (7, 9000, 7, 2, 0, 1, last, hashlib.sha256(b"7,11").hexdigest())
    below = sum(len(t) for _, t in long_[4999:])
    assert deep[7, 5000][2:7] == (7, 2, 1, 1, below)
    assert deep[7, 1][2:5] == (7, 3, 1) and deep[7, 1][7] == hashlib.sha256(b"12").hexdigest()
    assert deep[100, 2][3:] == (3000, 0, 1, 2999, hashlib.sha256(",".join(str(100 + i) for i in range(3000)).encode()).hexdigest())
    assert deep[7, 0][2:7] == (-1, 3004, 3, 3, sum(len(t) for _, t in long_) + 2 + 2999 * 5)


def test_stated_cases(spark):
    kind = "conv_id long, turn int, role string, text string, conv string, pos int, n_convs int"
    rows = [(1, 2, "user", "b"), (1, None, None, None), (2, 0, "", ""), (2, 5, "user", "b"), (None, 0, "user", "b"), (3, 0, "user", "x"), (3, 0, "user", "x"), (4, 0, "u", "ser"), (5, 0, "us", "er")]
    df = spark.createDataFrame([(*r, "q", 1, 2) for r in rows], kind)
    convs = {1: [("", ""), ("user", "b")], 2: [("", ""), ("user", "b")], 3: [("user", "x")] * 2, 4: [("u", "ser")], 5: [("us", "er")]}
    assert got(prefix_trie(placed_turns(df))) == plain(convs)
    more = spark.createDataFrame([(9,), (8,)], "conv long")
    assert got(prefix_trie(placed_turns(df), more, limit=1)) == plain(convs | {9: [], 8: []})
    assert got(prefix_trie(placed_turns(df.limit(0)))) == []
    assert got(prefix_trie(placed_turns(df.limit(0)), more)) == plain({9: [], 8: []})
    tied = spark.createDataFrame([(1, 0, "user", "x"), (1, 0, "user", "y"), (2, 0, "user", "y"), (2, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    assert [r[3] for r in got(prefix_trie(placed_turns(tied)))] == [2, 2, 2]
