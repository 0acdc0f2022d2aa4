"""Connected components kept up to date from a stream of edges, insertions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import GraphError
from ..operators.components import linked
from ..plans.durable import Stored, replaced


class Versions:
    """Label tables in a folder, one a batch and named by it; a table counts once it is complete, and two are kept."""

    def __init__(self, like: DataFrame, folder: str):
        self.spark, self.schema, self.folder = like.sparkSession, like.schema, folder.rstrip("/")
        jvm = self.spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, version: tuple[int, int]) -> str:
        return f"{self.folder}/batch={version[0]}.{version[1]}"

    def known(self) -> list[tuple[int, int]]:
        """Complete versions (batch, changes by hand since), the oldest first; what a lost driver left half written is not one."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = []
        for f in self._fs.listStatus(self._path(self.folder)):
            kind, _, version = f.getPath().getName().partition("=")
            if kind == "batch" and self._fs.exists(self._path(f"{self.folder}/batch={version}/_SUCCESS")):
                found.append(tuple(map(int, version.split("."))))
        return sorted(found)

    def read(self, version: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self._at(version))

    def write(self, labels: DataFrame, version: tuple[int, int]) -> DataFrame:
        """The table, after which those before the one it was made from go."""
        labels.write.mode("overwrite").option("compression", "zstd").parquet(self._at(version))
        for old in self.known()[:-2]:
            self._fs.delete(self._path(self._at(old)), True)
        return self.read(version)


class IncrementalComponents:
    """Labels (id, label) after each micro-batch; a batch merges labels and leaves what it does not touch as it is.

    With a ``folder``, or once a stream is followed, labels live beside the stream's checkpoint, one version a batch: a
    driver that starts anew with the same folder goes on from the last complete one, and a batch that the stream gives
    again, because the driver was lost before it was noted, changes nothing. Vertices that are new are their own labels.
    Without a folder labels end with the driver.
    """

    def __init__(self, vertices: DataFrame, *, folder: str | None = None):
        self._now: Stored | None = Stored(vertices.select("id", F.col("id").alias("label")), "labels")
        self._labels = self._now.df
        self._versions: Versions | None = None
        self._batch, self._by_hand = -1, 0
        self._batches: set[int] = set()
        if folder is not None:
            self._keep_in(folder)

    def _keep_in(self, folder: str) -> None:
        versions = Versions(self._labels, folder)
        if known := versions.known():
            self._batch, self._by_hand = known[-1]
            before = versions.read(known[-1])
            new = self._labels.select("id").join(before.select("id"), "id", "left_anti")
            self._versions = versions
            if new.isEmpty():
                self._labels = before
            else:
                self._put(before.union(new.select("id", F.col("id").alias("label"))), -1)
        else:
            self._versions = versions
            self._labels = versions.write(self._labels, (self._batch, self._by_hand))
        if self._now is not None:
            self._now.drop()
            self._now = None

    def _put(self, labels: DataFrame, batch_id: int) -> None:
        if self._versions is None:
            self._now = replaced(self._now, labels, "labels")
            self._labels = self._now.df
            self._batches |= {batch_id} if batch_id >= 0 else set()
            return
        self._batch, self._by_hand = (batch_id, 0) if batch_id >= 0 else (self._batch, self._by_hand + 1)
        self._labels = self._versions.write(labels, (self._batch, self._by_hand))

    def _seen(self, batch_id: int) -> bool:
        return 0 <= batch_id <= self._batch if self._versions is not None else batch_id in self._batches

    def add(self, batch: DataFrame, batch_id: int = -1) -> None:
        """Rows (src, dst) and perhaps ``op``, of which only 'add' is allowed; a batch given again changes nothing."""
        if self._seen(batch_id):
            return
        if "op" in batch.columns and not batch.where("op <> 'add'").isEmpty():
            raise GraphError("removals cannot be followed incrementally")
        known = self._labels
        ends = batch.select(F.col("src").alias("id")).union(batch.select(F.col("dst").alias("id"))).distinct()
        every = known.union(ends.join(known, "id", "left_anti").select("id", F.col("id").alias("label")))
        a, b = (every.select(F.col("id").alias(f"{x}_i"), F.col("label").alias(x)) for x in "ab")
        links = batch.join(a, F.col("src") == F.col("a_i")).join(b, F.col("dst") == F.col("b_i")).select("a", "b").where("a <> b").distinct()
        merged = linked(links)
        joined = every.join(merged.df.select(F.col("v").alias("_old"), F.col("c").alias("_new")), F.col("label") == F.col("_old"), "left")
        self._put(joined.select("id", F.coalesce("_new", "label").alias("label")), batch_id)
        merged.drop()

    def labels(self) -> DataFrame:
        return self._labels

    def count(self) -> int:
        return self._labels.select("label").distinct().count()

    def follow(self, edges: DataFrame, checkpoint: str) -> StreamingQuery:
        """Starts a query over a stream of edges (src, dst) that runs while there is input.

        Labels are kept under the checkpoint; where some are there already, they are what the stream goes on from.
        """
        if self._versions is None:
            self._keep_in(f"{checkpoint.rstrip('/')}/labels")
        return edges.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
