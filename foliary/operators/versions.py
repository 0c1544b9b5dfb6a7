"""A durable table of the last row of each key, in buckets with versions.

A batch of changes reads and rewrites only the buckets that it meets, aside, and
then commits a new version: a small file that names the folder of every bucket.
Readers take one version as a whole. What was written without a commit is in no
version; of two writers that begin from one version the second fails and may
begin again. The table survives sessions.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer committed a version meanwhile."""


def _files(spark: SparkSession, folder: str) -> tuple:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _manifest(spark: SparkSession, folder: str) -> dict:
    """The last version: its number and, by bucket, the folder of its rows."""
    files, path = _files(spark, folder)
    found = [int(x.getPath().getName().partition(".")[0]) for x in files.listStatus(path) if x.getPath().getName().endswith(".json")] if files.exists(path) else []
    if not found:
        return {"version": 0, "buckets": {}}
    at = f"{folder}/versions/{max(found):012d}.json"
    return json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(at).collect()))


def _commit(spark: SparkSession, folder: str, manifest: dict) -> None:
    """Makes a version known by a file that must not be there yet, written aside and moved."""
    files, path = _files(spark, folder)
    files.mkdirs(path)
    new = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions/{name}")
    aside, at = new(f"{uuid.uuid4().hex}.tmp"), new(f"{manifest['version']:012d}.json")
    out = files.create(aside, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if files.exists(at) or not files.rename(aside, at):
        files.delete(aside, False)
        raise Conflict(f"version {manifest['version']} of {folder} is another writer's")


def current(spark: SparkSession, folder: str, schema, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the last version, or of some buckets of it."""
    held = _manifest(spark, folder)["buckets"]
    paths = [f"{folder}/{p}" for b, p in held.items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def prepared(folder: str, changes: DataFrame, key: list[str], order: list[str], buckets: int = BUCKETS) -> dict:
    """Writes the buckets that `changes` meet, each key with its row of greatest `order`, and gives the version to commit."""
    spark, base = changes.sparkSession, _manifest(changes.sparkSession, folder)
    placed = changes.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    met = sorted(r[0] for r in placed.select("__bucket").distinct().collect())  # at most `buckets` rows
    old = {b: p for b, p in base["buckets"].items() if int(b) in met}
    rows = changes
    if old:
        rows = rows.unionByName(spark.read.schema(changes.schema).parquet(*(f"{folder}/{p}" for p in old.values())))
    others = [c for c in changes.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("x")).select(*key, *(F.col(f"x.`{c}`").alias(c) for c in others)).select(changes.columns)
    at = f"data/{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    last.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{folder}/{at}")
    return {"version": base["version"] + 1, "buckets": base["buckets"] | {str(b): f"{at}/__bucket={b}" for b in met}}


def merge(folder: str, changes: DataFrame, key: list[str], order: list[str], buckets: int = BUCKETS) -> int:
    """Merges a batch of changes and commits; the number of the new version. Raises Conflict if another writer was first."""
    made = prepared(folder, changes, key, order, buckets)
    _commit(changes.sparkSession, folder, made)
    return made["version"]
