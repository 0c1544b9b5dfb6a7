"""State of conversion jobs from their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliary.functions import text as T


def latest(events: DataFrame) -> DataFrame:
    """job_id, ts, status, progress: of each job's last event (by ts, then event_id)."""
    last = F.max_by(F.struct("ts", "status", "progress"), F.struct("ts", "event_id"))
    return events.groupBy("job_id").agg(last.alias("x"), F.count("*").alias("n_events")).select("job_id", "x.*", "n_events")


def messages(state: DataFrame) -> DataFrame:
    """`state` with message: the job's own, else its status's."""
    return state.withColumn("message", T.message(F.col("status"), F.col("own_message")))


def enriched(state: DataFrame, jobs: DataFrame) -> DataFrame:
    return state.join(jobs, "job_id", "left")


def expired(state: DataFrame, as_of: Column, seconds: int = 86_400) -> DataFrame:
    """Jobs whose last event is longer ago than that."""
    return state.where(F.col("ts") < as_of - F.expr(f"INTERVAL {seconds} SECONDS"))


def totals(state: DataFrame, key: list[str]) -> DataFrame:
    return state.groupBy(*key).agg(F.count("*").alias("total"), F.count_if(F.col("status") != "error").alias("success"), F.count_if(F.col("status") == "error").alias("error"))


def stage_seconds(events: DataFrame) -> DataFrame:
    """job_id, status, seconds: from the first to the last event of a job in a stage."""
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return events.groupBy("job_id", "status").agg((span / 1_000_000).alias("seconds"), F.count("*").alias("n"))


def remapped(progress: Column) -> Column:
    """Progress of the inner conversion within a pipeline: from 15 on, 0.35 for each percent, rounded down."""
    return F.floor(F.lit(15) + progress * 0.35).cast("long")


def batch_metadata(batches: DataFrame) -> DataFrame:
    """batch_id, pos and title, author, publisher of each entry of a JSON array."""
    kind = "array<struct<title:string,author:string,publisher:string>>"
    rows = batches.select("batch_id", F.posexplode(F.from_json("metadata", kind)).alias("pos", "x"))
    return rows.select("batch_id", F.col("pos").cast("long").alias("pos"), "x.*")


def any_meta(rows: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """`rows` with shape (object, array, varchar ... or malformed), entries (how many, of an array) and `fields` (name: path and type) of JSON whose shape differs by row.

    A field that is not there, or is of a type that cannot be read as the one asked for, is null.
    """
    found = rows.withColumn("__v", F.try_parse_json(column))
    kind = F.regexp_extract(F.lower(F.schema_of_variant("__v")), "^[a-z]+", 0)
    shape = F.when(F.col("__v").isNull(), "malformed").otherwise(kind)
    entries = F.when(shape == "array", F.size(F.try_variant_get("__v", "$", "array<variant>")).cast("long"))
    values = {name: F.try_variant_get("__v", path, kind) for name, (path, kind) in fields.items()}
    return found.withColumns({"shape": shape, "entries": entries, **values}).drop("__v")


def with_metadata(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files with the entry at their position; entries without a file are left out."""
    return files.join(entries, ["batch_id", "pos"], "left")


def merged(old: Column, new: Column) -> Column:
    """Two maps as one; where both have a key, the second's value stands."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def upserted(state: DataFrame, changes: DataFrame, as_of: Column, seconds: int = 86_400) -> DataFrame:
    """job_id, ts, meta: `state` with the latest of `changes` (job_id, ts, event_id, meta) merged over it, without jobs that expired.

    Of each key the last value stands.
    """
    empty = F.create_map().cast("map<string,string>")
    # The last value of each key, combined in every task; then a map of as many entries as a job has keys.
    pairs = changes.select("job_id", "ts", "event_id", F.explode_outer("meta").alias("k", "v"))
    last = pairs.groupBy("job_id", "k").agg(F.max_by("v", F.struct("ts", "event_id")).alias("v"), F.max("ts").alias("ts"))
    entries = F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))
    one = last.groupBy("job_id").agg(F.max("ts").alias("new_ts"), F.map_from_entries(entries).alias("new_meta"))
    both = state.join(one, "job_id", "full_outer")
    both = both.select("job_id", F.greatest("ts", "new_ts").alias("ts"), merged(F.coalesce("meta", empty), F.coalesce("new_meta", empty)).alias("meta"))
    return both.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {seconds} SECONDS"))


def queue_counts(state: DataFrame) -> DataFrame:
    """waiting, running, failed: how many jobs are in each of these states (status queued, started, failed)."""
    return state.agg(*(F.count_if(F.col("status") == s).alias(n) for n, s in (("waiting", "queued"), ("running", "started"), ("failed", "failed"))))


def failed_jobs(state: DataFrame, k: int = 10) -> DataFrame:
    """The k failed jobs of least id, as a report shows."""
    return state.where("status = 'failed'").select("job_id").orderBy("job_id").limit(k)


def with_results(state: DataFrame, files: DataFrame) -> DataFrame:
    """job_id, format, path of finished jobs: the archive of both formats, else the e-book, else the talking book; null if there is none.

    `files` has job_id, kind (both, epub, zip) and path.
    """
    kinds = ("both", "epub", "zip")
    have = files.where(F.col("kind").isin(*kinds)).groupBy("job_id").agg(*(F.max(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in kinds))
    rows = state.where("status = 'finished'").select("job_id").join(have, "job_id", "left")
    return rows.select("job_id", F.coalesce(*(F.when(F.col(k).isNotNull(), F.lit(k)) for k in kinds)).alias("format"), F.coalesce(*kinds).alias("path"))


def accepted(uploads: DataFrame, extensions: tuple[str, ...], low: int = 1, high: int = 10, default: int = 5, most: int = 10) -> DataFrame:
    """Uploads whose name ends with one of the extensions, of a priority in range; batches of more than `most` files go as a whole."""
    ends = F.lit(False)
    for e in extensions:
        ends = ends | F.lower("name").endswith(e)
    small = uploads.groupBy("batch").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("batch")
    return uploads.where(ends & F.coalesce("priority", F.lit(default)).between(low, high)).join(small, "batch", "left_semi")


def first_distinct(rows: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """key, first, values: distinct values that are not null, in order of their first place, joined by |, and the first of them."""
    once = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(order).alias("at"))
    lists = F.array_sort(F.collect_list(F.struct("at", F.col(value).alias("v"))))
    out = once.groupBy(*key).agg(F.transform(lists, lambda x: x["v"]).alias("l"))
    return out.select(*key, F.element_at("l", 1).alias("first"), F.array_join("l", "|").alias("values"))
