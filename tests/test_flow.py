"""Flow by supersteps: feasible, and as large as its own cut."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from graphloom.errors import GraphError, NegativeCapacityError
from graphloom.graph import Graph
from graphloom.operators import exact, flow
from graphloom.plans import durable


def graph(spark, edges, n):
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(edges)], "edge_id long, src long, dst long, c double")
    return Graph.of(spark.range(n).select("id"), e)


def certified(edges, rows, s, t):
    """The value, after checking bounds, conservation and that the cut, which is the same for every largest flow, is full."""
    flow = {r["edge_id"]: r for r in rows}
    assert sorted(flow) == list(range(len(edges)))
    out = collections.Counter()
    for i, (a, b, c) in enumerate(edges):
        assert -1e-9 <= flow[i]["flow"] <= c + 1e-9 and (c == float("inf") or abs(flow[i]["flow"] + flow[i]["residual"] - c) < 1e-9)
        out[a] += flow[i]["flow"]
        out[b] -= flow[i]["flow"]
    assert all(abs(x) < 1e-9 for v, x in out.items() if v not in (s, t))
    cut = {i for i in flow if flow[i]["in_cut"]}
    reach, front = {s}, [s]
    while front:
        v = front.pop()
        for i, (a, b, _) in enumerate(edges):
            if a == v and i not in cut and b not in reach:
                reach.add(b)
                front.append(b)
    assert t not in reach and out[s] == pytest.approx(sum(edges[i][2] for i in cut))
    return out[s], cut


def test_random_graphs_match_the_kernel(spark):
    for seed, (n, m) in enumerate([(7, 18), (12, 30)]):
        r = random.Random(seed)
        edges = [(r.randrange(n), r.randrange(n), float(r.choice([0, 1, 2, 5, 9]))) for _ in range(m)]
        if seed:
            edges += [(0, i, float("inf")) for i in (1, 2)] + [(n - 2, n - 1, 4.0), (n - 3, n - 1, 3.0)]
        g = graph(spark, edges, n)
        ways = [certified(edges, exact.max_flow(g, 0, n - 1, capacity=F.col("c"), local_edges=k).collect(), 0, n - 1) for k in (0, 1000)]
        assert ways[0] == ways[1]


def test_excess_goes_back_and_errors(spark):
    edges = [(0, 1, 10.0), (1, 2, 4.0), (2, 3, 4.0), (1, 4, 9.0), (4, 5, 9.0), (5, 1, 2.0), (2, 4, 1.0), (3, 3, 7.0)]
    g = graph(spark, edges, 7)
    solve = lambda *ends, **k: exact.max_flow(g, *ends, capacity=F.col("c"), local_edges=0, **k)
    assert certified(edges, solve(0, 3).collect(), 0, 3) == (4.0, {1})
    assert {r["flow"] for r in solve(0, 6).collect()} == {0.0}
    with pytest.raises(GraphError):
        solve(0, 0)
    for bad in (-1.0, float("nan")):
        with pytest.raises(NegativeCapacityError):
            exact.max_flow(graph(spark, [(0, 1, bad)], 2), 0, 1, capacity=F.col("c"), local_edges=0)
    with pytest.raises(GraphError):
        exact.max_flow(graph(spark, [(0, 1, float("inf")), (1, 2, float("inf"))], 3), 0, 2, capacity=F.col("c"), local_edges=0)


def test_searches_end_where_nothing_farther_is_held(spark, monkeypatch):
    """A long way to the sink's neighbour that holds nothing costs no rounds."""
    stored, write = [], durable.Stored.__init__

    def counted(self, df, name):
        stored.append(name)
        write(self, df, name)

    monkeypatch.setattr(durable.Stored, "__init__", counted)
    edges = [(0, 1, 5.0), (1, 2, 3.0)] + [(i + 1, i if i > 3 else 1, 9.0) for i in range(3, 40)]
    rows = exact.max_flow(graph(spark, edges, 41), 0, 2, capacity=F.col("c"), local_edges=0).collect()
    assert certified(edges, rows, 0, 2) == (3.0, {1})
    assert len(stored) < 40


@pytest.mark.parametrize("sent, part", [(0, 2), (1000, 2)])
def test_dealt_tables_and_parts_of_hubs_match_the_kernel(spark, monkeypatch, sent, part):
    monkeypatch.setattr(flow, "SENT", sent)
    monkeypatch.setattr(flow, "PART", part)
    r = random.Random(5)
    edges = [(0, 1, 40.0), (0, 2, 9.0)] + [(1, v, float(r.randrange(1, 9))) for v in range(3, 11)] + [(2, 1, 4.0), (1, 5, 2.0), (1, 1, 3.0), (4, 5, 0.0)]
    edges += [(v, 11, float(r.randrange(1, 5))) for v in range(3, 11)] + [(5, 4, 2.0), (11, 3, 1.0), (3, 0, 2.0)]
    named = spark.createDataFrame([(f"e{i}", f"v{a}", f"v{b}", c) for i, (a, b, c) in enumerate(edges)], "edge_id string, src string, dst string, c double")
    g = Graph.of(spark.range(12).select(F.concat(F.lit("v"), "id").alias("id")), named)
    rows = exact.max_flow(g, "v0", "v11", capacity=F.col("c"), local_edges=0).collect()
    found = [x.asDict() | {"edge_id": int(x["edge_id"][1:])} for x in rows]
    whole = exact.max_flow(graph(spark, edges, 12), 0, 11, capacity=F.col("c"), local_edges=1000).collect()
    assert certified(edges, found, 0, 11) == certified(edges, whole, 0, 11)


@pytest.mark.parametrize("sent, banded, part", [(5, 1000, 1000), (1000, 0, 1000), (1000, 0, 3), (5, 0, 1000)])
def test_large_fronts_and_bands_match_the_kernel(spark, monkeypatch, sent, banded, part):
    """Where most vertices are at the front the others are sent; only ways near the end of what is held are put in order."""
    stored, write = [], durable.Stored.__init__

    def counted(self, df, name):
        stored.append(name)
        write(self, df, name)

    monkeypatch.setattr(durable.Stored, "__init__", counted)
    for name, x in (("SENT", sent), ("BANDED", banded), ("PART", part)):
        monkeypatch.setattr(flow, name, x)
    r = random.Random(7)
    # 0 asks for parts 3 to 26, suppliers 1 and 2 give less than comes to them
    edges = [(0, v, float(r.choice([1, 3, 30]))) for v in range(3, 27)] + [(v, s, float(r.choice([1, 1, 2, 40]))) for v in range(3, 27) for s in (1, 2)]
    edges += [(1, 27, 20.0), (2, 27, 17.0)]
    g = graph(spark, edges, 28)
    rows = exact.max_flow(g, 0, 27, capacity=F.col("c"), local_edges=0).collect()
    whole = exact.max_flow(g, 0, 27, capacity=F.col("c"), local_edges=1000).collect()
    assert certified(edges, rows, 0, 27) == certified(edges, whole, 0, 27)
    assert ("others" in stored) == (sent == 5) and ("bands" in stored) == (sent > 5)


def test_ends_that_are_no_vertices_lie_on_a_side_of_the_cut(spark):
    """An edge without capacity leads to an end that the table of vertices lacks."""
    edges = [(0, 1, 5.0), (1, 2, 5.0), (2, 3, 2.0), (2, 5, 0.0), (5, 3, 7.0)]
    found = flow.push_relabel(Graph(spark.range(4).select("id"), graph(spark, edges, 6).edges.withColumnRenamed("c", "weight")), 0, 3).collect()
    assert certified(edges, found, 0, 3) == (2.0, {2, 3})
