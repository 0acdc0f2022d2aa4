"""Orders of vertices against itertools, closed ways against brute force."""

import itertools

import pytest

from graphloom.errors import GraphTooLargeError
from graphloom.graph import Graph
from graphloom.operators.permutations import MOST, hamiltonian_paths, permutations, unranked
from pyspark.sql import functions as F


def _graph(spark, n, edges, directed=True):
    v = spark.createDataFrame([(f"v{i}", i) for i in range(n)], "id string, ord long")
    e = spark.createDataFrame([(i, i, f"v{a}", f"v{b}") for i, (a, b) in enumerate(edges)], "edge_id long, ord long, src string, dst string")
    return Graph(v, e, directed)


def test_all_orders(spark):
    for n in (0, 1, 2, 5):
        rows = permutations(_graph(spark, n, [])).orderBy("no").collect()
        assert [tuple(r["path"]) for r in rows] == list(itertools.permutations([f"v{i}" for i in range(n)]))
        assert [r["no"] for r in rows] == list(range(len(rows)))
    nine = permutations(_graph(spark, 9, [])).agg(F.count("*").alias("n"), F.countDistinct("path").alias("d"), F.max("no").alias("m")).first()
    assert tuple(nine) == (362_880, 362_880, 362_879)
    with pytest.raises(GraphTooLargeError):
        permutations(_graph(spark, MOST + 1, []))


def test_the_last_order_of_twenty():
    assert unranked(MOST, 2432902008176639998, 2432902008176639999).tolist()[1] == list(range(MOST - 1, -1, -1))
    assert unranked(MOST, 0, 0).tolist() == [list(range(MOST))] and unranked(0, 0, 0).shape == (1, 0)


def test_graphs_side_by_side(spark):
    v = spark.createDataFrame([("x", 1, 1), ("x", 2, 2), ("x", 3, 3), ("y", 1, 2), ("y", 2, 1), (None, 7, 1)], "g string, id long, ord long")
    e = spark.createDataFrame([("x", 0, 0, 1, 2), ("x", 1, 1, 2, 3), ("x", 2, 2, 3, 1), ("y", 3, 3, 2, 1)], "g string, edge_id long, ord long, src long, dst long")
    found = {(r["g"], r["no"]): r["path"] for r in permutations(Graph(v, e), by="g").collect()}
    assert len(found) == 6 + 2 + 1 and found[("y", 0)] == [2, 1] and found[(None, 0)] == [7]
    ways = {(r["g"], *r["path"]): r["closed"] for r in hamiltonian_paths(Graph(v, e), by="g").collect()}
    assert ways == {("x", 1, 2, 3): True, ("x", 2, 3, 1): True, ("x", 3, 1, 2): True, ("y", 2, 1): False, (None, 7): False}


def test_ways_along_edges(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 1), (3, 3), (0, 1)]
    for directed in (True, False):
        arcs = set(edges) | (set() if directed else {(b, a) for a, b in edges})
        want = {p: (p[-1], p[0]) in arcs for p in itertools.permutations(range(4)) if all(x in arcs for x in zip(p, p[1:]))}
        got = {tuple(int(x[1:]) for x in r["path"]): r["closed"] for r in hamiltonian_paths(_graph(spark, 4, edges, directed)).collect()}
        assert got == want and want
    assert hamiltonian_paths(_graph(spark, 0, [])).count() == 0
