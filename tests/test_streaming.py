"""Components kept up to date from a stream."""

import signal
import subprocess
import sys
from pathlib import Path

import pytest

from graphloom.errors import GraphError
from graphloom.streaming.incremental import IncrementalComponents, Versions

EDGES = [(0, 1), (2, 3), (1, 2), (6, 7), (5, 9)]


def put(spark, folder, i):
    spark.createDataFrame([EDGES[i]], "src long, dst long").coalesce(1).write.parquet(str(folder / "in" / str(i)))


def stream(spark, folder):
    return spark.readStream.schema("src long, dst long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def labels(kept):
    return {r["id"]: r["label"] for r in kept.labels().collect()}


def test_batches_and_stream(spark, tmp_path):
    v = spark.range(8).select("id")
    kept = IncrementalComponents(v)
    assert kept.count() == 8
    for i in range(4):
        put(spark, tmp_path, i)
    kept.follow(stream(spark, tmp_path), str(tmp_path / "check")).awaitTermination()
    assert labels(kept) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6, 7: 6}
    again = spark.createDataFrame([(0, 3)], "src long, dst long")
    kept.add(again)
    assert kept.count() == 4
    with pytest.raises(GraphError):
        kept.add(spark.createDataFrame([(0, 3, "remove")], "src long, dst long, op string"))


def test_a_new_object_goes_on_from_the_checkpoint(spark, tmp_path):
    v = spark.range(8).select("id")
    for i in range(2):
        put(spark, tmp_path, i)
    first = IncrementalComponents(v)
    first.follow(stream(spark, tmp_path), str(tmp_path / "check")).awaitTermination()
    first.add(spark.createDataFrame([(4, 5)], "src long, dst long"))  # by hand, kept as well
    del first
    for i in range(2, 5):
        put(spark, tmp_path, i)
    kept = IncrementalComponents(v)
    kept.follow(stream(spark, tmp_path), str(tmp_path / "check")).awaitTermination()
    assert labels(kept) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 6, 9: 4}
    versions = Versions(kept.labels(), str(tmp_path / "check" / "labels"))
    assert [b for b, _ in versions.known()] == [3, 4]
    (tmp_path / "check" / "labels" / "batch=9.0").mkdir()  # half written
    assert IncrementalComponents(spark.range(12).select("id"), folder=versions.folder).count() == 3 + 3


LOST = """
import os, signal, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from graphloom.streaming.incremental import IncrementalComponents
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
class Lost(IncrementalComponents):
    def add(self, batch, batch_id=-1):
        super().add(batch, batch_id)
        if batch_id == 1:  # its labels are written, but the stream has not noted it
            os.kill(os.getpid(), signal.SIGKILL)
edges = spark.readStream.schema("src long, dst long").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet({folder!r} + "/in")
Lost(spark.range(8).select("id")).follow(edges, {folder!r} + "/check").awaitTermination()
"""


def test_a_lost_driver(spark, tmp_path):
    for i in range(5):
        put(spark, tmp_path, i)
    code = LOST.format(repo=str(Path(__file__).parents[1]), folder=str(tmp_path))
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, timeout=300).returncode == -signal.SIGKILL
    kept = IncrementalComponents(spark.range(8).select("id"))
    kept.follow(stream(spark, tmp_path), str(tmp_path / "check")).awaitTermination()
    assert labels(kept) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6, 7: 6, 9: 5}
