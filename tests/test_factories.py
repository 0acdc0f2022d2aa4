"""Transition factories and searches over what they make."""

import pytest
from pyspark.sql import functions as F

from graphloom.errors import GraphError
from graphloom.operators.factories import Transitions
from graphloom.operators.walks import explore


def test_factories_and_lateral_expansion(spark):
    t = Transitions(double=lambda v: [2 * v], next=lambda v: [v + 1, v + 2] if v < 3 else [])
    ids = spark.range(1, 4).select("id")
    rows = sorted((r["src"], r["dst"], r["factory"], r["nth"]) for r in t.out_edges(ids).collect())
    assert rows == [(1, 2, "double", 0), (1, 2, "next", 0), (1, 3, "next", 1), (2, 3, "next", 0), (2, 4, "double", 0), (2, 4, "next", 1), (3, 6, "double", 0)]
    pairs = spark.createDataFrame([(1, 2), (1, 9), (3, 6)], "src long, dst long")
    assert {(r["src"], r["dst"]): r["found"] for r in t.contains_edges(pairs).collect()} == {(1, 2): True, (1, 9): False, (3, 6): True}
    with pytest.raises(GraphError):
        t.add("next", lambda v: [])
    assert "next" in t and t.remove("next") and not t.remove("next") and "next" not in t and t.names() == ["double"]
    seen, edges, whole = explore(spark.createDataFrame([(1,)], "id long"), t.expand, vertex=F.col("id") <= 32)
    assert whole and sorted(r["id"] for r in seen.collect()) == [1, 2, 4, 8, 16, 32]
    t.clear()
    assert t.out_edges(ids).count() == 0


def test_searches_expand_only_what_they_visit(spark):
    def children(v):
        if v > 40:
            raise ValueError("beyond what the search should visit")
        return [2 * v, 2 * v + 1]

    t = Transitions(children=children)
    root = spark.createDataFrame([(1,)], "id long")
    order = lambda **k: [r["id"] for r in t.search(root, **k).orderBy("order_no").collect()]
    assert order(until=lambda v: v == 32) == [1, 2, 4, 8, 16, 32]
    assert order(until=lambda v: v == 5, breadth_first=True) == [1, 2, 3, 4, 5]
    assert order(max_depth=2) == [1, 2, 4, 5, 3, 6, 7]
    loop = Transitions(round=lambda v: [(v + 1) % 4, (v + 2) % 4])
    assert [(r["id"], r["depth"], r["parent"]) for r in loop.search(root).orderBy("order_no").collect()] == [(1, 0, None), (2, 1, 1), (3, 2, 2), (0, 3, 3)]
    with pytest.raises(Exception, match="meets more than"):
        Transitions(up=lambda v: [v + 1]).search(root, most=50).collect()
