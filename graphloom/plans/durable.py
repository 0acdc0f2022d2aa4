"""Tables that survive lost executors: written once to the shared folder, lineage ends there."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local master, as in tests, may do without one: all its tasks share a disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/graphloom-shared"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_end(spark: SparkSession):
    """What a query shuffles goes when it has ended, not only when the driver collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


_left: dict[str, tuple] = {}


def _delete(path: str) -> None:
    jvm, conf = _left.pop(path)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


@atexit.register
def _clear() -> None:
    """Tables are dropped with the driver; one that died leaves them in the shared folder."""
    for path in list(_left):
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is dropped with the driver."""
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    _left[path] = (spark._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return path


class Stored:
    """A table written once: recomputation after executor loss starts from it. It stays as long as the driver lives."""

    def __init__(self, df: DataFrame, name: str):
        spark = df.sparkSession
        self.path = scratch(spark, name)
        with _shuffles_end(spark):
            df.write.option("compression", "zstd").parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Only once nothing reads it any more."""
        _delete(self.path)


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows from a stored table."""
    return Stored(df, name).df


def replaced(old: Stored | None, df: DataFrame, name: str) -> Stored:
    """df stored, after which the table that it was made from goes."""
    new = Stored(df, name)
    if old is not None:
        old.drop()
    return new


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered densely from 0 in the given order, by a range sort and per-partition counts, not by one task."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = cut(ranged.withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part, local = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = at.groupBy(part.alias("_p")).agg(F.count("*").alias("_c"))
    from pyspark.sql import Window as W

    before = sizes.select("_p", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return at.join(F.broadcast(before), part == F.col("_p")).withColumn(name, local + F.col("_b")).drop("_m", "_p", "_b")
