"""Least degree first on forests by rounds, against the kernel."""

import random

import pandas as pd
import pytest

from graphloom.errors import NonAcyclicGraphError
from graphloom.kernels import run, structure
from graphloom.operators import order
from graphloom.plans import durable

from test_large_graphs import graph


def forest(rng):
    """A long way, a star, a caterpillar, a random tree and a pair, names dealt at random; edges either way round."""
    edges = [(i, i + 1) for i in range(100)]
    edges += [(101, i) for i in range(102, 110)]
    edges += [(i, i + 1) for i in range(110, 149)] + [(i, i + 40) for i in range(110, 150, 3)]
    edges += [(rng.randrange(200, i), i) for i in range(201, 240)]
    edges += [(240, 241)]
    names = list(range(245))
    rng.shuffle(names)
    return [(names[a], names[b]) if rng.random() < 0.5 else (names[b], names[a]) for a, b in edges], 245


def kernels(edges, n, **options):
    v = pd.DataFrame({"id": range(n), "ord": range(n)})
    e = pd.DataFrame([(i, i, *x) for i, x in enumerate(edges)], columns=["edge_id", "ord", "src", "dst"])
    return list(structure.least_degree_order(run.Local(v, e, False), **options))


def rows(df):
    return [(r["id"], r["position"]) for r in df.orderBy("position").collect()]


def test_forests_by_rounds_are_the_kernels(spark, monkeypatch):
    stored, write = [], durable.Stored.__init__

    def counted(self, df, name):
        write(self, df, name)
        stored.append(name)

    monkeypatch.setattr(durable.Stored, "__init__", counted)
    edges, n = forest(random.Random(1))
    assert rows(order.least_degree_order(graph(spark, edges, n, directed=False), local_edges=0)) == kernels(edges, n)
    assert stored.count("squeezed") > 2 and stored.count("raked") < 25  # the long way alone has 100 steps


def test_cycles_and_no_edges(spark):
    assert rows(order.least_degree_order(graph(spark, [], 3, directed=False), local_edges=0)) == [(0, 0), (1, 1), (2, 2)]
    for edges in ([(0, 1), (1, 2), (2, 0)], [(0, 1), (1, 0)], [(0, 1), (2, 2)]):
        g = graph(spark, edges, 4, directed=False)
        with pytest.raises(NonAcyclicGraphError):
            order.least_degree_order(g, local_edges=0)
    assert rows(order.least_degree_order(g, allow_cycles=True, local_edges=0)) == kernels(edges, 4, allow_cycles=True)


def test_forests_know_no_bound(spark, monkeypatch):
    """A forest beyond what a task takes raised."""
    monkeypatch.setattr(run.run, "__kwdefaults__", run.run.__kwdefaults__ | {"max_vertices": 3, "max_edges": 3})
    monkeypatch.setattr(order.least_degree_order, "__kwdefaults__", order.least_degree_order.__kwdefaults__ | {"local_edges": 3})
    edges = [(0, 4), (1, 4), (4, 2), (2, 5), (5, 3)]
    assert rows(order.least_degree_order(graph(spark, edges, 7, directed=False))) == kernels(edges, 7)
