"""Tables in the shared folder: what several parts of a plan read is written once, survives lost executors and cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
#: Spark's setting by which a write's shuffle files go when it ends, and not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share.

    Only where that is unset and driver and executors are one process, as in
    tests, a temporary folder takes its place; a cluster without it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "local-cluster" in spark.sparkContext.master:
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="foliary-")
    return shared_dir.own


def new_folder(spark: SparkSession, kind: str = "table") -> str:
    """A folder name of one use in the shared folder."""
    return f"{shared_dir(spark)}/foliary-{kind}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """`df` by these keys in as many parts as the session has shuffle partitions.

    Parts that Spark puts together by their compressed bytes would be few and huge: cells and the like compress to almost nothing, and what is made of them does not.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder. It stays until `forget` or the end of the session, as results may still read it."""
    spark, path = df.sparkSession, new_folder(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the table holds what its shuffles gave, so their files can go
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What `make` gives, written. Tables that it wrote on the way are deleted, as nothing reads them any more."""
    first = len(_made)
    out = written(make())
    _delete(first, len(_made) - 1)
    return out


def forget() -> None:
    """Deletes the tables that `written` made; results that read them end with that."""
    _delete(0, len(_made))


def _delete(first: int, end: int) -> None:
    gone = _made[first:end]
    del _made[first:end]
    for spark, path in gone:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; nothing can be reached through it
            return


atexit.register(forget)
