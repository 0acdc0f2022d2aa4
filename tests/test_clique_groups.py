"""Cliques from packed lists of later neighbours: what is stored, parts, slices and large parts."""

import itertools
import random

import pytest

from graphloom.graph import Graph
from graphloom.operators import cliques
from graphloom.plans import durable

from test_large_graphs import graph, plain_cliques


def test_no_wedges_or_cliques_are_stored(spark, monkeypatch):
    n = 40
    pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if b != a + 1]
    rows, write = {}, durable.Stored.__init__

    def counted(self, df, name):
        write(self, df, name)
        rows[name] = max(rows.get(name, 0), self.df.count())

    monkeypatch.setattr(durable.Stored, "__init__", counted)
    g = graph(spark, pairs, n)
    found = cliques.peeled_cliques(g)
    assert rows and max(rows.values()) <= len(pairs)
    many = [1, 1, 2, 2]  # sets of 0, 1, 2, 3 numbers no two of which follow each other, to which none can be added
    while len(many) <= n:
        many.append(many[-2] + many[-3])
    assert found.count() == found.distinct().count() == many[n]


@pytest.mark.parametrize("entries, parallel", [(64_000_000, True), (60, False)])
def test_parts_slices_and_large_parts(spark, monkeypatch, entries, parallel):
    monkeypatch.setattr(cliques, "_ENTRIES", entries)
    rng = random.Random(3)
    # three parts: a dense one, a thin one, and one of pairs; vertices of no edge and of no part lie between
    of = {v: ["dense", "thin", "pairs", None][v % 4] for v in range(160)}
    members = {p: [v for v in of if of[v] == p] for p in ("dense", "thin", "pairs")}
    edges = [e for e in itertools.combinations(members["dense"], 2) if rng.random() < 0.6]
    edges += [tuple(sorted(rng.sample(members["thin"], 2))) for _ in range(60)]
    edges += list(zip(members["pairs"][::2], members["pairs"][1::2]))
    if parallel:
        edges += [(b, a) for a, b in edges[:50]] + [(0, 0), (3, 3)]
    else:
        edges = sorted(set(edges))
    e = spark.createDataFrame([(i, i, *x) for i, x in enumerate(edges)], "edge_id long, ord long, src long, dst long")
    v = spark.createDataFrame([(x, -x, of[x]) for x in of], "id long, ord long, kind string")
    g = Graph(v, e, directed=False, allow_parallel=parallel)
    want = plain_cliques(edges, 160)
    for by in ("kind", None):
        got = [tuple(r["clique"]) for r in cliques.peeled_cliques(g, by=by).collect()]
        assert all(list(c) == sorted(c, reverse=True) for c in got)  # in order, which goes down here
        assert sorted(tuple(sorted(c)) for c in got) == want


def test_names_of_any_type(spark):
    names = ["b", "a", "d", "c"]
    v = spark.createDataFrame([(x, k) for k, x in enumerate(names)], "id string, ord long")
    e = spark.createDataFrame([(0, 0, "a", "b"), (1, 1, "d", "a"), (2, 2, "b", "d")], "edge_id long, ord long, src string, dst string")
    assert sorted(r["clique"] for r in cliques.peeled_cliques(Graph.of(v, e)).collect()) == [["b", "a", "d"], ["c"]]


def test_steps_take_as_few_bytes_as_the_longest():
    for x, size in (([], 0), ([7], 8), ([1, 256], 9), ([1, 257], 10), ([0, 2**16, 2**17], 16), ([5, 2**33], 16)):
        packed = cliques._pack(x)
        assert len(packed) == size and cliques._unpack(packed, len(x)).tolist() == x


def test_sets_and_bits_of_many_rows():
    rng = random.Random(1)
    cells = {(rng.randrange(50), rng.randrange(2**20)) for _ in range(300)}
    row, col = (cliques.np.array(x) for x in zip(*cells))
    assert cliques._bits(row, col, 50, 2**20) == [sum(1 << c for r, c in cells if r == k) for k in range(50)]
