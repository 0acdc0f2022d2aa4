"""Pairs of near vectors in blocks, and forests of dense graphs from thinned edges."""

import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import cliques, trees
from graphloom.sources import star

ROWS = "vec_id long, label int, embedding array<float>"


def plain_pairs(rows, least):
    out = {}
    for a, la, va in rows:
        for b, lb, vb in rows:
            if la is None or la != lb or a >= b or None in (va, vb) or None in [*va, *vb] or len(va) != len(vb):
                continue
            dot = na = nb = 0.0
            for x, y in zip(va, vb):
                dot, na, nb = dot + x * y, na + x * x, nb + y * y
            m = math.sqrt(na) * math.sqrt(nb)
            c = dot / m if m else math.nan
            if c != c or c > least:
                out[a, b] = c
    return out


def test_pairs_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(star, "_BLOCK", 7)
    rng = random.Random(5)
    # small whole numbers, so that norms are exact in floats too; a zero vector has no cosine, which SQL puts above all numbers
    rows = [(i, rng.choice([0, 1, None]), [float(rng.randrange(-3, 4)) for _ in range(5)]) for i in range(60)]
    rows += [(100, 0, [0.0] * 5), (101, 0, None), (102, 1, [1.0, None, 0.0, 0.0, 0.0]), (103, 1, [1.0, 2.0])]
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["src"], r["dst"]): r["cosine"] for r in star.Star(spark, str(tmp_path)).knn(0.25).edges.collect()}
    want = plain_pairs(rows, 0.25)
    assert got.keys() == want.keys() and any(100 in pair for pair in got)
    assert all(got[k] == want[k] or (got[k] != got[k] and want[k] != want[k]) for k in want)


def test_forest_of_a_dense_graph(spark, monkeypatch):
    rng = random.Random(2)
    n = 40
    edges = [(i, rng.randrange(n), rng.randrange(n), rng.choice([1.0, 2.0, math.nan, -0.0, 0.0, None, 7.0])) for i in range(600)]
    top = list(range(n))

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    want = set()
    for i, a, b, _ in sorted((e for e in edges if e[1] != e[2]), key=lambda e: (e[3] is not None, e[3] is not None and math.isnan(e[3]), 0.0 if e[3] is None or math.isnan(e[3]) else e[3], e[0])):
        if find(a) != find(b):
            top[find(a)] = find(b)
            want.add(i)
    e = spark.createDataFrame(edges, "edge_id long, src long, dst long, weight double").repartition(3)
    g = Graph.of(spark.range(n).select("id"), e, directed=False)
    seen = []
    stored = trees.cut
    monkeypatch.setattr(trees, "cut", lambda df, name="step": seen.append((name, made := stored(df, name))) or made)
    assert {r["edge_id"] for r in trees.minimum_spanning_forest(g, weight=F.col("weight")).collect()} == want
    tables = dict(seen)
    assert tables["thinned"].count() < tables["weighted"].count() / 2
    # in small chunks, the whole forest stays too
    monkeypatch.setattr(trees, "_CHUNK", 50)
    parts = [pa.RecordBatch.from_pylist([{"edge_id": i, "ord": i, "src": a, "dst": b, "w": w} for i, a, b, w in edges[k : k + 30]], pa.schema([("edge_id", "int64"), ("ord", "int64"), ("src", "int64"), ("dst", "int64"), ("w", "float64")])) for k in range(0, 600, 30)]
    left = [i for b in trees._thinned(iter(parts)) for i in b["edge_id"].to_pylist()]
    assert want <= set(left) and len(left) == len(set(left)) < 600


def test_cliques_are_handed_on_together():
    pair = pa.struct([("p", pa.int64()), ("q", pa.int64())])
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3]), pa.array([[2, 3], [3], [4]]), pa.array([[{"p": 2, "q": 3}], None, None], pa.list_(pair)), pa.array([None, [[3]], None], pa.list_(pa.list_(pa.int64())))],
        names=["v", "later", "edges", "earlier"],
    )
    (whole,) = cliques._solve(iter([batch, batch]))
    assert whole["c"].to_pylist() == [[1, 2, 3], [3, 4]] * 2
