"""Tours by branch and bound, and orders by rank, against plain forms."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.graph import Graph
from graphloom.operators import exact, tours


def graph(spark, edges, n, directed=True):
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(edges)], "edge_id long, src long, dst long, weight double")
    return Graph.of(spark.range(n).select("id"), e, directed=directed)


def closed(edges, row, n):
    """The cost of a row's path, after checking that it is a tour along edges."""
    steps = [edges[i] for i in row["path"]]
    assert len({s[0] for s in steps}) == n and all(a[1] == b[0] for a, b in zip(steps, [*steps[1:], steps[0]]))
    return sum(s[2] for s in steps)


def test_more_vertices_than_a_table_of_subsets_takes(spark):
    n = 22
    at = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    order = random.Random(4).sample(range(n), n)
    edges = [(a, b, math.dist(at[order[a]], at[order[b]])) for a, b in itertools.permutations(range(n), 2)]
    row = exact.best_tour(graph(spark, edges, n), weight=F.col("weight")).first()
    assert row["cost"] == pytest.approx(n * 2 * math.sin(math.pi / n)) and closed(edges, row, n) == pytest.approx(row["cost"])


def test_random_tours_match_the_kernel(spark):
    r = random.Random(6)
    n = 9
    edges = [(a, b, float(r.randint(-3, 20))) for a in range(n) for b in range(n) if a != b and r.random() < 0.6] + [(0, 1, 99.0), (4, 4, -50.0)]
    g = graph(spark, edges, n)
    one, other = (exact.best_tour(g, weight=F.col("weight"), local_vertices=k).first() for k in (16, 0))
    assert other["cost"] == one["cost"] == closed(edges, other, n)


def test_no_tour_and_small_graphs(spark):
    solve = lambda edges, n: exact.best_tour(graph(spark, edges, n), weight=F.col("weight"), local_vertices=0).first()
    assert tuple(solve([(i, i + 1, 1.0) for i in range(5)], 6)) == (math.inf, None) == tuple(solve([], 0)) == tuple(solve([], 1))
    assert tuple(solve([(0, 0, 2.0), (0, 0, 1.0)], 1)) == (1.0, [1])
    with pytest.raises(GraphError):
        solve([(0, 1, math.inf), (1, 0, 1.0)], 2)


def test_orders(spark):
    g = graph(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0), (0, 2, 1.0)], 4)
    rows = sorted(map(tuple, tours.permutations(g).collect()))
    assert [tuple(p) for _, p in rows] == list(itertools.permutations(range(4))) and [r for r, _ in rows] == list(range(24))
    near = {frozenset(x) for x in [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2)]}
    want = [p for p in itertools.permutations(range(4)) if all(frozenset(x) in near for x in zip(p, [*p[1:], p[0]]))]
    assert [tuple(r["path"]) for r in tours.hamiltonian_orders(g).orderBy("rank").collect()] == want and want
    assert tours.permutations(graph(spark, [], 0)).count() == 1 and tours.permutations(graph(spark, [], 9)).agg(F.countDistinct("path")).first()[0] == 362880
