"""Trails of many small components beside a large one, and components by names of names."""

import random

import pytest

from graphloom.operators import euler
from graphloom.operators.components import linked
from tests.test_large_graphs import check_trails, graph


@pytest.mark.parametrize("directed", [True, False])
def test_small_components_are_walked_in_tasks(spark, directed, monkeypatch):
    r = random.Random(9)
    edges = [(10 * c + r.randrange(5), 10 * c + r.randrange(5)) for c in range(12) for _ in range(r.randrange(1, 9))] + [(200, 201), (201, 202), (202, 200), (210, 210)]
    wide, kept = [], euler._wide_trails
    monkeypatch.setattr(euler, "_wide_trails", lambda g, start=None: wide.append(g.edges.count()) or kept(g, start))
    g = graph(spark, edges, 220, directed)
    few = euler.all_trails(g, 201)
    assert not wide
    by = check_trails(edges, few.collect(), directed)
    assert [t for t in by.values() if t[0][1] == t[-1][2] == 201]
    every = euler.all_trails(g, 201, local_edges=5).collect()
    assert wide and 0 < wide[0] < len(edges)
    check_trails(edges, every, directed)
    assert len({x["trail"] for x in every}) == len(by)


def test_names_of_names_are_components(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(200)] + [(300 + r.randrange(80), 300 + r.randrange(80)) for _ in range(50)] + [(500, 501), (501, 500), (600, 600)]
    top = {v: v for p in pairs for v in p}

    def find(v):
        return v if top[v] == v else find(top[v])

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    links = spark.createDataFrame(pairs, "a long, b long")
    want = {v: find(v) for p in pairs if p[0] != p[1] for v in p}
    for bound in (1, 40):
        got = linked(links, rounds_links=bound).df.collect()
        assert {x["v"]: x["c"] for x in got} == want and len(got) == len(want)
