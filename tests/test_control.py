"""States, abort, array texts and clusters."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions.codecs import decode_array, encode_array
from graphloom.graph import Graph
from graphloom.operators.clusters import Clusters
from graphloom.plans.control import Computation, State


def test_states(spark):
    seen = []
    c = Computation(spark, lambda: spark.range(5).count())
    c.listeners.append(lambda a, b: seen.append(b))
    assert c.compute() == 5 and c.state is State.FINISHED and seen == [State.RUNNING, State.FINISHED]
    with pytest.raises(ZeroDivisionError):
        Computation(spark, lambda: 1 / 0).compute()


def test_abort(spark):
    def slow():
        return spark.range(0, 4, 1, 4).select(F.expr("java_method('java.lang.Thread', 'sleep', 20000L + id)")).collect()

    c = Computation(spark, slow)
    timer = threading.Timer(1.5, c.abort)
    timer.start()
    began = time.time()
    assert c.compute() is None and c.state is State.ABORTED and time.time() - began < 19


def test_array_texts(spark):
    df = spark.createDataFrame([([1, 2],), ([],), (None,)], "a array<int>")
    assert [r[0] for r in df.select(encode_array(F.col("a"))).collect()] == ["1 2", "", "null"]
    back = spark.createDataFrame([("1 2 ",), ("",), ("null",)], "t string").select(decode_array(F.col("t"), "int")).collect()
    assert [r[0] for r in back] == [[1, 2], [], None]


def test_clusters(spark):
    g = Graph.of(spark.range(3).select("id"), spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "edge_id long, src long, dst long"))
    tree = spark.createDataFrame([("top", None), ("mid", "top"), ("low", "mid")], "cluster string, parent string")
    c = Clusters(g, tree, spark.createDataFrame([], "cluster string, id long"))
    c = c.add(spark.createDataFrame([("low", 0), ("low", 1), ("top", 2)], "cluster string, id long"))
    counts = lambda x: {r["cluster"]: (r["n_vertices"], r["n_edges"]) for r in x.counts().collect()}
    assert counts(c) == {"top": (3, 2), "mid": (2, 1), "low": (2, 1)}
    assert counts(c.remove(spark.createDataFrame([("mid", 1)], "cluster string, id long"))) == {"top": (2, 0), "mid": (1, 0), "low": (1, 0)}


def test_only_a_local_master_may_do_without_a_shared_folder():
    from types import SimpleNamespace

    import pytest
    from graphloom.plans.durable import shared_dir

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("local[4]", None)).startswith("file:///") and shared_dir(session("spark://a:1", "hdfs://b/c/")) == "hdfs://b/c"
    for master in ("spark://a:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master, None))
