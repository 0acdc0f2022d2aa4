"""What a kernel does on small graphs and plans on large ones: both give the same rows."""

import random

import pytest

from graphloom.operators import components, exact, order
from tests.test_graph import graph


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("chain", ["uniform", "round_robin", "weighted", "vanishing"])
def test_walk_by_lookups_is_the_kernels(spark, chain):
    rng = random.Random(4)
    g = graph(spark, [(rng.randrange(4), rng.randrange(4), rng.randrange(1, 5)) for _ in range(60)])
    kernel = rows(exact.random_walk(g, 0, steps=12, chain=chain, seed=3))
    assert len(kernel) == 12 and rows(exact.random_walk(g, 0, steps=12, chain=chain, seed=3, local_edges=0)) == kernel
    stop = [kernel[5][1]]
    assert rows(exact.random_walk(g, 0, steps=12, chain=chain, seed=3, stop_at=stop, local_edges=0)) == rows(exact.random_walk(g, 0, steps=12, chain=chain, seed=3, stop_at=stop))


def test_walk_ends_where_nothing_leads_on(spark):
    g = graph(spark, [("a", "b"), ("b", "c")])
    assert [r[3] for r in rows(exact.random_walk(g, "a", steps=9, local_edges=0))] == ["b", "c"]


FORESTS = {
    "tree": [(5, 2), (5, 1), (2, 8), (2, 0), (1, 7), (8, 3)],
    "forest": [(5, 2), (2, 8), (1, 7), (7, 0), (7, 6)],
}


@pytest.mark.parametrize("directed", [True, False])
def test_depth_first_by_levels_is_the_kernels(spark, directed):
    # some vertices come before those above them, so that a search from all in order starts there
    g = graph(spark, FORESTS["forest"], vertices=[1, 8, 7, 5, 2, 0, 3, 6, 4], directed=directed)
    assert rows(exact.dfs_trace(g, local_edges=0)) == rows(exact.dfs_trace(g))
    assert rows(order.topological_order(g, local_edges=0)) == rows(order.topological_order(g))
    if directed:
        assert rows(components.strong_steps(g, local_edges=0)) == rows(components.strong_steps(g))
    g = graph(spark, FORESTS["tree"], directed=directed)
    for options in ({"root": 5}, {"root": 5, "max_depth": 1}, {"root": 2, "both_ways": True}):
        assert rows(exact.dfs_trace(g, local_edges=0, **options)) == rows(exact.dfs_trace(g, **options))
    assert rows(exact.dfs_edge_classes(g, 5, local_edges=0)) == rows(exact.dfs_edge_classes(g, 5))
    assert rows(exact.edge_dfs(g, 5, max_depth=1, local_edges=0)) == rows(exact.edge_dfs(g, 5, max_depth=1))


def test_traces_by_levels_take_forests_beyond_the_kernel(spark, monkeypatch):
    from graphloom.kernels import run

    def no(*_, **__):
        raise AssertionError("a kernel had the whole graph")

    monkeypatch.setattr(exact, "run", no)
    monkeypatch.setattr(run, "run", no)
    for directed in (True, False):
        g = graph(spark, FORESTS["tree"], directed=directed)
        assert exact.dfs_trace(g, 5, local_edges=0).count() == exact.dfs_trace(g, 5, both_ways=True, local_edges=0).count() == order.topological_order(g, local_edges=0).count() == 7
        assert exact.dfs_edge_classes(g, 5, local_edges=0).count() == exact.edge_dfs(g, 5, local_edges=0).count() == exact.bfs_edge_classes(g, 5, local_edges=0).select("edge_id").distinct().count() == 6
    assert components.strong_steps(graph(spark, FORESTS["tree"]), local_edges=0).count() == 14


@pytest.mark.parametrize("directed", [True, False])
def test_traces_of_other_graphs_are_the_kernels(spark, directed):
    for edges in ([(0, 1), (1, 2), (2, 0)], [(0, 1), (0, 1)], [(0, 0), (0, 1)], [(0, 1), (2, 1), (0, 2)]):
        g = graph(spark, edges, directed=directed)
        assert rows(exact.dfs_trace(g, local_edges=0)) == rows(exact.dfs_trace(g))
        assert rows(exact.dfs_edge_classes(g, 0, local_edges=0)) == rows(exact.dfs_edge_classes(g, 0))


@pytest.mark.parametrize("directed", [True, False])
def test_breadth_first_by_levels_is_the_kernels(spark, directed):
    rng = random.Random(6)
    for n, m in ((6, 9), (9, 30)):
        g = graph(spark, [(rng.randrange(n), rng.randrange(n)) for _ in range(m)], vertices=rng.sample(range(n), n), directed=directed)
        for root in (0, None):
            assert rows(exact.bfs_edge_classes(g, root, local_edges=0)) == rows(exact.bfs_edge_classes(g, root))


def test_least_degree_order_takes_no_pass_a_vertex():
    import time

    import pandas as pd

    from graphloom.kernels import structure
    from graphloom.kernels.run import Local

    n = 20_000
    v = pd.DataFrame({"id": range(n), "ord": range(n)})
    e = pd.DataFrame({"edge_id": range(1, n), "ord": range(1, n), "src": [0] * (n - 1), "dst": range(1, n)})
    began = time.process_time()
    got = list(structure.least_degree_order(Local(v, e, False)))
    assert time.process_time() - began < 5  # a scan of all that is left for each vertex took 15
    # the leaves in order; when one is left, the middle comes first among equals
    assert [i for i, _ in got] == [*range(1, n - 1), 0, n - 1] and [p for _, p in got] == list(range(n))


def test_roots_of_searches_are_dealt(spark):
    from graphloom.operators.factories import Transitions

    made = Transitions(half=lambda v: [v // 2] if v % 2 == 0 else [], up=lambda v: [3 * v + 1] if v % 2 else [])
    found = made.search(spark.range(2, 60, 1, 1), until=lambda v: v == 1)
    assert found.rdd.getNumPartitions() > 1
    assert {r["root"] for r in found.where("id = 1").collect()} == set(range(2, 60))
