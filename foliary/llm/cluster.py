"""What the operators share about sessions: tables in the shared folder, Arrow batches, readers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may have; with BATCH_BYTES it bounds what a Python worker holds at once.
BATCH_ROWS = 1024
BATCH_BYTES = 8 << 20
_made: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, as texts may be long. Results are lazy, so the session keeps these settings until others are made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what spark.checkpoint.dir names. Only where that is unset and driver
    and executors are one process, as in tests, a temporary folder takes its
    place; a cluster without it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "local-cluster" in spark.sparkContext.master:
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not getattr(shared_dir, "own", None):
        shared_dir.own = tempfile.mkdtemp(prefix="foliary-")
    return shared_dir.own


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """`df` as a table in the shared folder: it survives lost executors and cuts lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foliary-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def forget_tables() -> None:
    """Deletes the tables that `written` made; results that read them end with that."""
    while _made:
        spark, path = _made.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; nothing can be reached through it
            return


atexit.register(forget_tables)


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow of a function from one batch to one; batches of no rows are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := f(batch)) is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Keys that split_join broadcasts, at most, and rows that a key has to have for that.
HOT_KEYS = 10_000
HOT_ROWS = 1_000


def _hot(counts: DataFrame, n: str, total: int) -> tuple[DataFrame, DataFrame]:
    """(rows of hot keys, others): a key is hot with over HOT_ROWS rows and over a HOT_KEYS-th of all `total`, so under HOT_KEYS keys are."""
    most = max(HOT_ROWS, total // HOT_KEYS)
    return F.broadcast(counts.where(F.col(n) > most)), counts.where(F.col(n) <= most)


def split_join(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """Inner join of `left` with `right`, which has a row for each key and in `n` how many rows of `left` have it.

    Rows of hot keys meet a broadcast table of bounded size where they are; only the others are shuffled.
    Keys must not be null; `left` is read twice.
    """
    hot, others = _hot(right, n, total)
    return left.join(hot, on).unionByName(left.join(hot.select(on), on, "left_anti").join(others, on))


def split_anti_join(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """The rows of `left` whose key `right` does not have; hot keys as in `split_join`."""
    hot, others = _hot(right, n, total)
    return left.join(hot.select(on), on, "left_anti").join(others.select(on), on, "left_anti")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
