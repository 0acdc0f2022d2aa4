"""Goldens and differential tests of graphs, paths, components, orders and kernels."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from graphloom.errors import GraphError, GraphTooLargeError, NegativeCycleError, NegativeWeightError, NoPathFoundError, NonAcyclicGraphError, VertexNotFoundError
from graphloom.graph import Graph
from graphloom.kernels import optimise
from graphloom.kernels.run import run
from graphloom.operators import augment, components, exact, order, paths, petri, trees, walks


def graph(spark, edges, vertices=None, directed=True):
    """Edges (src, dst[, weight]); vertices in the order given or of appearance."""
    rows = [(i, i, e[0], e[1], float(e[2]) if len(e) > 2 else 1.0) for i, e in enumerate(edges)]
    ids = list(dict.fromkeys(vertices if vertices is not None else [x for e in edges for x in e[:2]]))
    kind = "string" if any(isinstance(i, str) for i in ids) else "long"
    v = spark.createDataFrame([(x, k) for k, x in enumerate(ids)], f"id {kind}, ord long")
    return Graph.of(v, spark.createDataFrame(rows, f"edge_id long, ord long, src {kind}, dst {kind}, weight double"), directed=directed)


def values(df, key="id", value="distance"):
    return {r[key]: r[value] for r in df.collect()}




@pytest.mark.parametrize("local", [0, None])
def test_shortest_paths(spark, local):
    g = graph(spark, [(1, 2, 1), (2, 3, 1)])
    found = paths.shortest_paths(g, 1, weight=F.col("weight"), local_edges=local)
    assert values(found) == {1: 0, 2: 1, 3: 2}
    assert {r["id"]: r["path"] for r in paths.paths_to(found).collect()} == {2: [0], 3: [0, 1]}
    g = graph(spark, [("s", "a", 3), ("s", "b", 1), ("b", "a", 1), ("a", "t", 1), ("b", "t", 20)])
    assert values(paths.a_star(g, "s", weight=F.col("weight")))["t"] == 3
    g = graph(spark, [(0, 1, 3), (1, 2, 4), (0, 2, 10)], directed=False)
    assert values(paths.shortest_paths(g, 2, weight=F.col("weight"), local_edges=local)) == {2: 0, 1: 4, 0: 7}
    for edges in ([(1, 2, 1), (2, 3, -1), (3, 4, 2)], [(1, 2, 1), (2, 2, -1)], [(1, 2, 1), (2, 1, -3)]):
        for target in (None, 2):
            with pytest.raises(NegativeWeightError):
                paths.shortest_paths(graph(spark, edges), 1, weight=F.col("weight"), target=target, local_edges=local)
    assert values(paths.shortest_paths(graph(spark, [(1, 2, 1), (3, 1, -1)]), 1, weight=F.col("weight"), local_edges=local)) == {1: 0, 2: 1}
    for edges in ([(1, 2, 1), (2, 2, -1)], [(1, 2, 1), (2, 1, -3)]):
        with pytest.raises(NegativeCycleError):
            paths.bellman_ford(graph(spark, edges), 1, weight=F.col("weight"), local_edges=local)
        assert paths.has_negative_cycle(graph(spark, edges), 1, weight=F.col("weight"), local_edges=local)
    with pytest.raises(VertexNotFoundError):
        paths.shortest_paths(g, 99)


def test_dag_paths_and_negative_cycles(spark):
    g = graph(spark, [(0, 1, 2), (2, 1, -10)])
    assert values(paths.dag_shortest_paths(g, 0, weight=F.col("weight")))[1] == 2
    with pytest.raises(NonAcyclicGraphError):
        paths.dag_shortest_paths(graph(spark, [(0, 1, 2), (1, 0, 1)]), 0, weight=F.col("weight"))
    g = graph(spark, [(0, 1, 2), (0, 2, 1), (1, 3, 3), (2, 3, 1)])
    assert values(paths.dag_shortest_paths(g, 0, weight=F.col("weight"), longest=True))[3] == 5
    g = graph(spark, [(0, 1, 1), (1, 2, -3), (2, 1, 1), (3, 3, -1)], vertices=range(5))
    assert paths.has_negative_cycle(g, 0, weight=F.col("weight")) and not paths.has_negative_cycle(g, 4, weight=F.col("weight"))
    for edges in ([(0, 0, -1)], [(0, 1, -3), (1, 0, 1)]):
        with pytest.raises(NegativeCycleError):
            paths.all_pairs(graph(spark, edges), weight=F.col("weight"))
    pairs = {(r["src"], r["dst"]): r["distance"] for r in paths.all_pairs(graph(spark, [(0, 1, 8), (0, 1, 2), (1, 2, -1)], vertices=range(4)), weight=F.col("weight")).collect()}
    assert pairs[0, 2] == 1 and (0, 3) not in pairs and pairs[3, 3] == 0


def test_ranked_paths(spark):
    g = graph(spark, [(1, 2, 1), (1, 3, 12), (1, 4, 0.5), (2, 3, 3), (2, 4, 2), (3, 5, 1), (5, 2, 6)])
    assert [(r["cost"], r["path"]) for r in paths.k_shortest(g, 1, 5, 10, weight=F.col("weight")).orderBy("rank").collect()] == [(5, [0, 3, 5]), (13, [1, 5])]
    g = graph(spark, [("A", "B", 5), ("A", "C", 6), ("B", "C", 7), ("B", "D", 8), ("C", "D", 9)])
    assert [r["cost"] for r in paths.k_shortest(g, "A", "D", 5, weight=F.col("weight")).orderBy("rank").collect()] == [13, 15, 21]
    g = graph(spark, [("C", "D", 3), ("C", "E", 2), ("D", "F", 4), ("E", "D", 1), ("E", "F", 2), ("E", "G", 3), ("F", "G", 2), ("F", "H", 1), ("G", "H", 2)])
    for f in (paths.k_shortest, paths.ranked_deviations):
        assert [r["cost"] for r in f(g, "C", "H", 50, weight=F.col("weight")).orderBy("rank").collect()] == [5, 7, 8, 8, 8, 11, 11]
    lone = graph(spark, [(1, 1)], vertices=[1, 2])
    with pytest.raises(NoPathFoundError):
        paths.k_shortest(lone, 1, 2, 3)
    assert paths.ranked_deviations(lone, 1, 2).count() == 0
    with pytest.raises(GraphError):
        paths.ranked_deviations(lone, 1, 2, 1)


def test_random_paths_match_enumeration(spark):
    for seed in range(4):
        rng = random.Random(seed)
        n = rng.randint(3, 6)
        edges = [(a, b, rng.randint(0, 7)) for a in range(n) for b in range(n) if a != b and rng.random() < 0.4]
        g = graph(spark, edges, vertices=range(n))
        simple = {}

        def grow(v, seen, cost):
            simple.setdefault(v, []).append(cost)
            for a, b, w in edges:
                if a == v and b not in seen:
                    grow(b, seen | {b}, cost + w)

        grow(0, {0}, 0.0)
        want = {v: min(c) for v, c in simple.items()}
        for local in (0, None):
            assert values(paths.shortest_paths(g, 0, weight=F.col("weight"), local_edges=local)) == want
        assert values(paths.bellman_ford(g, 0, weight=F.col("weight"))) == want
        parents = [sorted(map(tuple, paths.shortest_paths(g, 0, weight=F.col("weight"), negative=n, local_edges=k).collect())) for n, k in (("raise", 0), ("raise", None), ("allow", None))]
        assert parents[0] == parents[1] == parents[2]
        for t in [v for v in simple if v]:
            got = [r["cost"] for r in paths.k_shortest(g, 0, t, 6, weight=F.col("weight")).orderBy("rank").collect()]
            assert got == sorted(simple[t])[:6]
            near = [r["cost"] for r in paths.ranked_deviations(g, 0, t, 6, weight=F.col("weight")).orderBy("rank").collect()]
            assert near == got


def test_a_star(spark):
    g = graph(spark, [("s", "a", 1), ("a", "t", 5), ("s", "b", 2), ("b", "t", 3), ("t", "far", 1)])
    ways = lambda h, target="t": values(paths.a_star(g, "s", weight=F.col("weight"), heuristic=h, target=target))
    assert ways(F.lit(0.0))["t"] == 5 and "far" not in ways(F.lit(0.0))
    assert ways(F.when(F.col("id") == "t", 0.0).when(F.col("id") == "b", 3.0).otherwise(4.0))["t"] == 5
    # whatever the estimate, consistent or not or too high, and whatever the size: the rows of shortest_paths
    golden = graph(spark, [("s", "a", 3), ("s", "b", 1), ("b", "a", 1), ("a", "t", 1), ("t", "far", 1), ("far", "s", 0)])
    small = graph(spark, [(0, 1, 1), (1, 2, 1), (0, 2, 5), (2, 3, 1)])
    for x, root, target in ((golden, "s", "t"), (small, 0, 2)):
        for h in (F.lit(0.0), F.when(F.col("id").cast("string").isin("b", "1"), 9.0).otherwise(0.0), F.hash("id").cast("double")):
            want = sorted(paths.shortest_paths(x, root, weight=F.col("weight"), target=target).collect())
            for local in (None, 0):
                assert sorted(paths.a_star(x, root, weight=F.col("weight"), heuristic=h, target=target, local_edges=local).collect()) == want
    assert {r["id"]: r["distance"] for r in paths.a_star(small, 0, weight=F.col("weight"), heuristic=F.when(F.col("id") == 1, 9.0).otherwise(0.0), target=2).collect()} == {0: 0, 1: 1, 2: 2}
    assert ways(F.lit(0.0), None) == {"s": 0, "a": 1, "b": 2, "t": 5, "far": 6}
    with pytest.raises(NegativeWeightError):
        paths.a_star(graph(spark, [(0, 1, -1)]), 0, weight=F.col("weight"), heuristic=F.lit(0.0))


def test_deep_paths_fold(spark):
    g = graph(spark, [(i, i + 1) for i in range(19)] + [(0, 5), (3, 17), (19, 20), (20, 19), (20, 21)])
    layers, left = order.peel(g, local_edges=0)
    assert values(layers, value="layer") == {i: i for i in range(19)} and {r["id"] for r in left.collect()} == {19, 20, 21}
    g = graph(spark, [(i, i + 1, 1) for i in range(21)] + [(0, 20, 25), (5, 12, 9)])
    want = {i: i for i in range(22)}
    assert values(paths.shortest_paths(g, 0, weight=F.col("weight"), local_edges=0)) == want


def test_orders(spark):
    g = graph(spark, [(1, 2), (2, 3), (2, 6), (2, 8), (4, 2), (4, 5), (5, 6), (7, 5), (7, 8)], vertices=range(1, 9))
    ordered = lambda df: [r["id"] for r in df.orderBy("position").collect()]
    assert ordered(order.topological_order(g)) == [7, 4, 5, 1, 2, 8, 6, 3]
    g = graph(spark, [(0, 1), (1, 2), (1, 3), (2, 3), (3, 4), (5, 6)], vertices=range(7))
    assert ordered(order.topological_order(g)) == [5, 6, 0, 1, 2, 3, 4]
    u = graph(spark, [(1, 2), (2, 3), (4, 2), (4, 5), (5, 6), (7, 5), (7, 8)], vertices=range(1, 9), directed=False)
    assert ordered(order.topological_order(u)) == [1, 2, 4, 5, 7, 8, 6, 3]
    assert sorted(ordered(order.least_degree_order(u))) == list(range(1, 9))
    cyclic = graph(spark, [(0, 1), (1, 2), (2, 0)])
    for local in (0, None):
        assert not order.is_dag(cyclic, local_edges=local) and order.is_dag(g, local_edges=local)
        assert values(order.layers(g, local_edges=local), value="layer") == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 0, 6: 1}
    with pytest.raises(NonAcyclicGraphError):
        order.layers(cyclic)
    with pytest.raises(NonAcyclicGraphError):
        order.transitive_closure(cyclic)
    with pytest.raises(NonAcyclicGraphError):
        order.topological_order(cyclic)
    assert order.is_forest(u) and not order.is_forest(graph(spark, [(1, 2), (1, 2)], directed=False))


def test_closure_and_reduction(spark):
    rng = random.Random(3)
    edges = [(a, b) for a in range(7) for b in range(a + 1, 7) if rng.random() < 0.5] + [(0, 1)]
    g = graph(spark, edges, vertices=range(7))
    reach = set(edges)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
        if more == reach:
            break
        reach = more
    assert {tuple(r) for r in order.transitive_closure(g).collect()} == reach
    want = [e for e in edges if not any((e[0], m) in set(edges) and (m, e[1]) in reach for m in range(7))]
    assert sorted((r["src"], r["dst"]) for r in order.transitive_reduction(g).collect()) == sorted(want)


def test_common_ancestors(spark):
    tree = graph(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("a", "d"), ("c", "e")], vertices=["r", "a", "b", "c", "d", "e", "x"])
    pairs = spark.createDataFrame([("e", "d"), ("e", "b"), ("c", "e"), ("x", "e")], "source string, target string")
    want = {("e", "d"): "a", ("e", "b"): "r", ("c", "e"): "c", ("x", "e"): None}
    assert {(r["source"], r["target"]): r["ancestor"] for r in order.common_ancestors(tree, "r", pairs).collect()} == want
    more = graph(spark, [("r", "a"), ("r", "b"), ("a", "c"), ("b", "c")])
    got = order.common_ancestors(more, "r", spark.createDataFrame([("c", "b")], "source string, target string")).collect()
    assert got[0]["ancestor"] == "r"


@pytest.mark.parametrize("local", [0, None])
def test_components(spark, local):
    stars = [(3 * i + 0, 3 * i + k) for i in range(3) for k in (1, 2)]
    g = graph(spark, stars, vertices=range(9))
    assert values(components.connected_components(g), value="component") == {v: v // 3 for v in range(9)}
    rng = random.Random(11)
    for n, p in ((6, 0.3), (9, 0.2)):
        edges = [(a, b) for a in range(n) for b in range(n) if rng.random() < p]
        g = graph(spark, edges, vertices=range(n))
        reach = {(a, a) for a in range(n)} | set(edges)
        for k, a, b in itertools.product(range(n), repeat=3):
            if (a, k) in reach and (k, b) in reach:
                reach.add((a, b))
        want = {a: min(b for b in range(n) if (a, b) in reach and (b, a) in reach) for a in range(n)}
        assert values(components.strong_labels(g, local_edges=local), value="label") == want
        near = {a: {b for b in range(n) if b != a and ((a, b) in edges or (b, a) in edges)} for a in range(n)}
        colour = {}
        for a in range(n):
            colour[a] = next(c for c in itertools.count() if c not in {colour.get(b) for b in near[a]})
        assert values(components.greedy_colouring(Graph(g.vertices, g.edges.where("src <> dst"), False), local_edges=local), value="colour") == colour


def test_condensations(spark):
    g = graph(spark, [(0, 1), (1, 0), (1, 2), (0, 2), (2, 3), (3, 2)])
    v, e = components.condensation(g)
    assert {tuple(r) for r in v.collect()} == {(0, 2, 2), (2, 2, 2)}
    assert [(r["src"], r["dst"], r["edge_ids"]) for r in e.collect()] == [(0, 2, [2, 3])]
    g = graph(spark, [(0, 1), (1, 2), (2, 3), (1, 3)])
    merged = {(r["src"], r["dst"], tuple(r["edge_ids"])) for r in components.edge_merge_condensation(g, ~F.col("id").isin(1, 2)).collect()}
    assert merged == {(0, 3, (0, 1, 2)), (0, 3, (0, 3))}


def test_spanning_forest_and_rank(spark):
    g = graph(spark, [(1, 2, 2), (3, 2, 3), (3, 4, 3), (1, 4, 5), (7, 7, 1)], directed=False)
    assert sum(r["w"] for r in trees.minimum_spanning_forest(g, weight=F.col("weight")).collect()) == 8
    ranks = values(trees.pagerank(graph(spark, [(1, 2)], vertices=[1, 2, 3])), value="rank")
    assert {k: round(v, 4) for k, v in ranks.items()} == {1: 0.15, 2: 0.2775, 3: 0.15}
    assert set(values(trees.pagerank(graph(spark, [(1, 2)], vertices=[1, 2, 3]), damping=0.0), value="rank").values()) == {1.0}


def test_euler(spark):
    count = lambda edges, v=None: components.euler_path_count(graph(spark, edges, vertices=v))
    assert (count([(1, 2)]), count([(1, 2), (2, 1)]), count([(1, 2), (2, 1), (1, 3)])) == (0, 1, 1)
    g = graph(spark, [(1, 2), (2, 1), (1, 3), (3, 1), (2, 4), (4, 2), (3, 4), (4, 3), (4, 4)])
    ids = [r["edge_id"] for r in exact.euler_circuit(g).orderBy("position").collect()]
    ends = {r["edge_id"]: (r["src"], r["dst"]) for r in g.edges.collect()}
    assert sorted(ids) == list(range(9)) and all(ends[a][1] == ends[b][0] for a, b in zip(ids, ids[1:] + ids[:1]))
    trails = exact.euler_trails(graph(spark, [(0, 1), (1, 2), (2, 3), (1, 3), (0, 2)], directed=False)).collect()
    assert sorted(r["edge_id"] for r in trails) == list(range(5)) and len({r["trail"] for r in trails}) == 1
    assert components.is_eulerian(graph(spark, [(0, 1), (1, 2), (2, 0)])) and not components.is_eulerian(graph(spark, [(0, 1)]))


def test_flow(spark):
    g = graph(spark, [("A", "D", 3), ("A", "B", 3), ("B", "C", 4), ("C", "A", 3), ("C", "D", 1), ("D", "E", 2), ("D", "F", 6), ("E", "B", 1), ("C", "E", 2), ("E", "G", 1), ("F", "G", 9)])
    flow = exact.max_flow(g, "A", "G", capacity=F.col("weight"))
    assert exact.flow_value(g, flow, "A").first()["value"] == 5
    cut = flow.where("in_cut").join(g.edges, "edge_id").agg(F.sum("weight")).first()[0]
    assert cut == 5
    with pytest.raises(Exception, match="same"):
        exact.max_flow(g, "A", "A").collect()
    with pytest.raises(Exception, match="capacities"):
        exact.max_flow(g, "A", "G", capacity=-F.col("weight")).collect()


def test_matching(spark):
    rng = random.Random(1)
    for _ in range(3):
        edges = [(a, b) for a in range(5) for b in range(10, 15) if rng.random() < 0.4]
        got = exact.bipartite_matching(graph(spark, edges, vertices=[*range(5), *range(10, 15)]), range(5)).collect()
        best = max(sum(p[a] in {b for x, b in edges if x == a} for a in range(5)) for p in itertools.permutations(range(10, 15)))
        assert len(got) == best and len({r["left"] for r in got}) == len({r["right"] for r in got}) == best


def test_assignment():
    assert optimise.assignment([[1, 2, 3], [3, 3, 3], [3, 3, 2]]) == [0, 1, 2]
    assert optimise.assignment([[82, 83, 69, 92], [77, 37, 49, 92], [11, 69, 5, 86], [8, 9, 98, 23]]) == [2, 1, 0, 3]
    rng = random.Random(0)
    for n in range(1, 6):
        for m in (n, n + 1):
            costs = [[rng.randint(-20, 19) for _ in range(m)] for _ in range(n)]
            got = optimise.assignment(costs)
            assert len(set(got)) == n and sum(costs[i][t] for i, t in enumerate(got)) == optimise.permutations_cost(costs)
    with pytest.raises(GraphError):
        optimise.assignment([[1], [2]])


def test_tours_cliques_bisection(spark):
    k5 = [(1, 2, 16), (1, 3, 9), (1, 4, 15), (1, 5, 3), (2, 3, 14), (2, 4, 4), (2, 5, 5), (3, 4, 4), (3, 5, 2), (4, 5, 1)]
    assert exact.best_tour(graph(spark, k5, directed=False), weight=F.col("weight")).first()["cost"] == 25
    sparse = [(1, 2, 10), (2, 3, 8), (3, 4, 11), (4, 5, 6), (5, 6, 9), (1, 6, 3), (2, 6, 5), (3, 6, 18), (3, 5, 21)]
    assert exact.best_tour(graph(spark, sparse, directed=False), weight=F.col("weight")).first()["cost"] == 47
    assert math.isinf(exact.best_tour(graph(spark, sparse), weight=F.col("weight")).first()["cost"])
    assert exact.best_tour(graph(spark, [*sparse, (6, 1, 1)]), weight=F.col("weight")).first()["cost"] == 45
    cut = exact.bisect(graph(spark, [(0, 1, 100), (1, 2, 20), (2, 3, 10), (1, 3, 50)], directed=False))
    assert cut.first()["cut"] == 70
    odd = exact.bisect(graph(spark, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 4), (1, 4)], vertices=range(5), directed=False)).collect()
    assert odd[0]["cut"] == 2 and {frozenset(r["id"] for r in odd if r["side"] == s) for s in (0, 1)} == {frozenset({2, 3}), frozenset({0, 1, 4})}
    cliques = exact.maximal_cliques(graph(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (4, 4)])).collect()
    assert sorted(r["clique"] for r in cliques) == [[0, 1, 2], [2, 3], [4]]
    ring = graph(spark, [(i, (i + 1) % 6) for i in range(6)])
    assert exact.is_hamiltonian(ring).first()[0] and not exact.is_hamiltonian(graph(spark, [(0, 1), (1, 2)])).first()[0]
    with pytest.raises(GraphTooLargeError):
        run(ring, lambda x: [], "n int", max_vertices=3)
    assert math.isinf(exact.best_tour(graph(spark, [(i, i + 1) for i in range(30)])).first()["cost"])


def test_traces(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 0)])
    assert values(exact.bfs_trace(g, 0), value="order_no") == {0: 0, 1: 1, 2: 2, 3: 3}
    assert values(exact.dfs_trace(g, 0), value="order_no") == {0: 0, 1: 1, 3: 2, 2: 3}
    assert {r["edge_id"]: r["class"] for r in exact.dfs_edge_classes(g, 0).collect()} == {0: "tree", 2: "tree", 4: "back", 1: "tree", 3: "forward_or_cross"}
    assert exact.bfs_trace(graph(spark, [(0, 1), (1, 0)])).count() == 0
    chain = graph(spark, [(i, i + 1) for i in range(3000)])
    assert exact.dfs_trace(chain, 0).agg(F.max("depth")).first()[0] == 3000
    assert exact.edge_dfs(chain, 0).count() == 3000


def test_walks_and_random_graphs(spark):
    g = graph(spark, [(0, 1), (0, 2), (1, 0), (2, 0)])
    steps = exact.random_walk(g, 0, steps=4, chain="round_robin").orderBy("step").collect()
    assert [r["edge_id"] for r in steps] == [0, 2, 1, 3]
    assert exact.random_walk(g, 0, steps=4, chain="round_robin", stop_at=[1]).count() == 2
    for chain in ("uniform", "weighted", "vanishing"):
        assert exact.random_walk(g, 0, steps=10, chain=chain, seed=1).count() == 10
    tree = values(exact.random_tree(g, 0, seed=2), value="successor")
    assert tree == {0: None, 1: 0, 2: 0}
    many = walks.walks(g, spark.range(50).select(F.col("id").alias("walk"), F.lit(0).cast("long").alias("id")), steps=3, seed=4)
    assert many.count() == 150 and 5 < many.where("step = 0 and dst = 1").count() < 45
    r = walks.random_graph(spark, 6, 10, seed=1, parallel=False, self_edges=False, directed=False)
    assert r.edges.count() == 10 and r.edges.where("src >= dst").count() == 0
    with pytest.raises(GraphError):
        walks.random_graph(spark, 3, 10, parallel=False, self_edges=False)


def test_augment(spark):
    g = graph(spark, [], vertices=[0])
    one = Graph(g.vertices, g.edges, True, False)
    whole, new = augment.augment_all(one, 10, 11)
    assert new.count() == 6 and whole.edges.count() == 5
    back = augment.reversed_edges(graph(spark, [(0, 1), (0, 1), (1, 0), (2, 2)])).collect()
    assert {r["edge_id"]: r["reverse_id"] for r in back if not r["added"]} == {0: 2, 2: 0}
    assert sum(r["added"] for r in back) == 2


def test_changes(spark):
    g = graph(spark, [(0, 1), (0, 1), (1, 2), (2, 2)])
    assert values(g.degrees(), value="degree") == {0: 2, 1: 3, 2: 3}
    assert g.remove_edges(spark.createDataFrame([(1,)], "edge_id long")).edges.count() == 3
    once = Graph(g.vertices, g.edges, identity="endpoints").remove_edges(spark.createDataFrame([(0, 1)], "src long, dst long"))
    assert [r["edge_id"] for r in once.edges.orderBy("edge_id").collect()] == [1, 2, 3]
    assert g.merge_vertex(1).edges.select("src", "dst").collect().count((0, 2)) == 2
    with pytest.raises(VertexNotFoundError):
        g.add_edges(spark.createDataFrame([(9, 9, 0, 77, 1.0)], "edge_id long, ord long, src long, dst long, weight double"))
    assert g.equals(g.reversed().reversed()) and not g.equals(g.reversed())
    assert not g.equals(g.undirected())


def test_petri(spark):
    places = spark.createDataFrame([("a",), ("b",), ("c",)], "place string")
    arcs = spark.createDataFrame([(0, "a", "t", True), (1, "b", "t", False), (2, "a", "u", True), (3, "c", "u", False)], "arc int, place string, transition string, is_input boolean")
    marking = spark.createDataFrame([("a", 1, 0), ("a", 2, 1)], "place string, token int, seq long")
    net = petri.PetriNet(places, spark.createDataFrame([("t",), ("u",)], "transition string"), arcs, marking)
    assert values(net.step().counts(), "place", "n_tokens") == {"a": 0, "b": 2, "c": 2}
    held = petri.PetriNet(places, net.transitions, arcs, marking, condition=F.col("n_tokens") > 5)
    assert values(held.step().counts(), "place", "n_tokens") == {"a": 2, "b": 0, "c": 0}


def test_errors_are_graph_errors():
    for e in (NegativeCycleError, NegativeWeightError, NoPathFoundError, NonAcyclicGraphError, VertexNotFoundError):
        assert issubclass(e, GraphError) and issubclass(e, ValueError)
