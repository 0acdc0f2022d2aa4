"""Cliques, trails and common ancestors by the plans that know no bound, against kernels and plain forms."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.graph import Graph
from graphloom.operators import euler, exact, order
from graphloom.operators.cliques import _grow, peeled_cliques


def graph(spark, edges, n, directed=True):
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(edges)], "edge_id long, src long, dst long")
    return Graph.of(spark.range(n).select("id"), e, directed=directed)


def plain_cliques(edges, n):
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    out = set()

    def grow(c, may, seen):
        if not may and not seen:
            out.add(tuple(sorted(c)))
        for v in sorted(may):
            grow(c | {v}, may & near[v], seen & near[v])
            may, seen = may - {v}, seen | {v}

    grow(set(), set(range(n)), set())
    return sorted(out)


def test_cliques(spark):
    r = random.Random(5)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(190)] + [(a, b) for a, b in itertools.combinations(range(30, 39), 2)] + [(41, i) for i in range(40)]
    g = graph(spark, edges, 44)
    got = sorted(tuple(r["clique"]) for r in peeled_cliques(g).collect())
    assert got == plain_cliques(edges, 44) and len(got) > 60
    assert sorted(r["clique"] for r in exact.maximal_cliques(graph(spark, [], 2), local_vertices=0).collect()) == [[0], [1]]
    assert exact.maximal_cliques(graph(spark, [], 0), local_vertices=0).collect() == []


def test_growing_leaves_what_earlier_neighbours_extend():
    assert sorted(map(sorted, _grow([1, 2, 3], [(1, 2), (2, 3)], []))) == [[1, 2], [2, 3]]
    assert list(map(sorted, _grow([1, 2, 3], [(1, 2), (2, 3)], [[1, 2]]))) == [[2, 3]]
    assert list(_grow([1, 2], [(1, 2)], [[1], [1, 2]])) == []


def check_trails(edges, rows, directed):
    """Every edge once, each trail going on where it was, as many trails as uneven vertices ask for."""
    assert sorted(r["edge_id"] for r in rows) == list(range(len(edges)))
    by = collections.defaultdict(list)
    for r in rows:
        ends = (r["src"], r["dst"])
        assert ends == edges[r["edge_id"]] or (not directed and ends == edges[r["edge_id"]][::-1])
        by[r["trail"]].append((r["position"], *ends))
    for steps in by.values():
        steps.sort()
        assert [s[0] for s in steps] == list(range(len(steps)))
        assert all(a[2] == b[1] for a, b in zip(steps, steps[1:]))
    up = list(range(1 + max(map(max, edges))))

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    uneven = collections.Counter()
    for a, b in edges:
        up[top(a)] = top(b)
        uneven[a] += 1
        uneven[b] += -1 if directed else 1
    odd = collections.Counter()
    for v, n in uneven.items():
        odd[top(v)] += max(n, 0) if directed else n % 2
    parts = {top(a) for a, _ in edges}
    assert len(by) == sum(max(1, odd[p] if directed else odd[p] // 2) for p in parts)
    return by


@pytest.mark.parametrize("directed", [True, False])
def test_trails(spark, directed):
    r = random.Random(3)
    walk = [r.randrange(9) for _ in range(40)]
    even = list(zip(walk, walk[1:] + walk[:1]))  # one closed walk: loops and parallel edges too
    edges = even + [(20, 21), (21, 22), (22, 20), (21, 23), (23, 21), (30, 31), (31, 32), (33, 31), (31, 34), (40, 40)]
    g = graph(spark, edges, 50, directed)
    by = check_trails(edges, euler.all_trails(g, 21).collect(), directed)
    assert any(t[0][1] == 21 == t[-1][2] for t in by.values())
    closed = euler.whole_circuit(graph(spark, even, 9, directed), walk[3]).collect()
    assert check_trails(even, [r.asDict() | {"trail": 0} for r in closed], directed)[0][0][1] == walk[3]
    with pytest.raises(GraphError):
        euler.whole_circuit(g)


def test_trails_of_nothing_and_temporary_edges(spark):
    assert euler.all_trails(graph(spark, [], 3)).collect() == []
    assert sorted(map(tuple, euler.temporary_edges(graph(spark, [(0, 1), (0, 2), (3, 4)], 5)).collect())) == [(1, 0), (2, 0), (4, 3)]
    assert sorted(map(tuple, euler.temporary_edges(graph(spark, [(0, 1), (0, 2), (0, 3), (4, 4)], 5, False)).collect())) == [(0, 1), (2, 3)]


def test_ancestors_by_lifting(spark):
    r = random.Random(8)
    up = {v: r.randrange(max(0, v - 3), v) for v in range(1, 60)}
    g = graph(spark, [(p, v) for v, p in up.items()] + [(70, 71)], 72)
    line = lambda v: [v] if v == 0 else [v, *line(up[v])]
    asked = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(5, 5), (0, 9), (71, 3)]
    want = {(a, b): None if 71 in (a, b) else next(x for x in line(a) if x in line(b)) for a, b in asked}
    got = order.common_ancestors(g, 0, spark.createDataFrame(sorted(set(asked)), "source long, target long")).collect()
    assert {(x["source"], x["target"]): x["ancestor"] for x in got} == want and len(got) == len(want)
