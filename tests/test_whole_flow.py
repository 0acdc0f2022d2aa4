"""The flow of the whole trade graph, which no SQL enumerates: by conservation and the capacity of its cut."""

import collections

import pytest
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.operators import exact
from graphloom.sources.star import Star

SF = "/root/testdata/sf0.001"


def test_max_flow_of_the_whole_trade_graph(spark):
    g = Star(spark, SF).trade()
    ids = sorted(r["id"] for r in g.vertices.collect())
    s, t = ids[0], ids[-1]
    assert len(ids) == 25
    flows = {r["edge_id"]: r["flow"] for r in exact.max_flow(g, s, t, capacity=F.col("n")).collect()}
    edges = [(r["edge_id"], r["src"], r["dst"], r["n"]) for r in g.edges.collect()]
    assert len(edges) == len(flows)
    out, open_ = collections.Counter(), collections.defaultdict(set)
    for e, a, b, n in edges:
        assert -1e-9 <= flows[e] <= n + 1e-9
        out[a] += flows[e]
        out[b] -= flows[e]
        if flows[e] < n - 1e-9:
            open_[a].add(b)
        if flows[e] > 1e-9:
            open_[b].add(a)
    assert all(abs(out[v]) < 1e-6 for v in ids if v not in (s, t))
    near, front = {s}, [s]
    while front:
        more = open_[front.pop()] - near
        near |= more
        front += more
    assert t not in near
    cut = sum(n for _, a, b, n in edges if a in near and b not in near)
    assert cut > 0 and out[s] == pytest.approx(cut)
    assert queries.QUERIES["max_flow_whole"](spark, SF).first()["value"] == pytest.approx(cut)
