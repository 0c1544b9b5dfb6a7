"""Job events as a stream: the last state of each job, sent on by job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from foliary.operators import jobs


def read(spark: SparkSession, path: str, like: DataFrame, files_a_batch: int | None = None) -> DataFrame:
    """A stream of event files that arrive under `path`, of the schema of `like`.

    A batch takes all files that are there, so that none of them is late against
    another, or `files_a_batch`, where files come in order of time.
    """
    rows = spark.readStream.schema(like.schema)
    return (rows.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else rows).parquet(path)


def from_channel(messages: DataFrame, prefix: str) -> DataFrame:
    """Key events (channel, event, others): those of `set` under a prefix, with job_id, the channel's last piece."""
    return messages.where((F.col("event") == "set") & F.col("channel").contains(prefix)).withColumn("job_id", F.substring_index("channel", ":", -1))


def last_states(events: DataFrame) -> DataFrame:
    """Last state by job; `events` has event_id, job_id, ts, status, progress. The state store holds one row a job.

    No watermark would drop any of it, as a job has no end in time; `expiring` is for jobs that have.
    """
    return jobs.latest(events)


def expiring(events: DataFrame, gap: str = "24 hours") -> DataFrame:
    """Last state by job and session of events at most `gap` apart. A session that is over leaves the state store, so jobs expire from it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", gap)
    last = F.max_by(F.struct("ts", "status", "progress"), F.struct("ts", "event_id"))
    rows = timed.groupBy("job_id", F.session_window("ts", gap).alias("w")).agg(last.alias("x"), F.count("*").alias("n_events"))
    return rows.select("job_id", F.col("w.end").alias("expires"), "x.*", "n_events")


def enriched(events: DataFrame, dim: DataFrame) -> DataFrame:
    """Stream-static join with what is known of jobs."""
    return events.join(dim, "job_id", "left")


def heard(messages: DataFrame, subscriptions: DataFrame, longest: str = "48 hours", late: str = "0 seconds") -> DataFrame:
    """Every message of a job with each subscriber that listens just then; null where none does.

    `messages` has event_id, job_id and ts; `subscriptions` subscriber, job_id,
    begins and ends, which is at most `longest` behind. Both sides keep state only
    as long as the other may still have a row that matches: messages until the
    watermark is past them, subscriptions for `longest`. A message that nobody
    hears is told once the watermark is past it.
    """
    said = messages.select("event_id", "job_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    held = subscriptions.select("subscriber", F.col("job_id").alias("of"), F.col("begins").cast("timestamp").alias("begins"), F.col("ends").cast("timestamp").alias("ends")).withWatermark("begins", late)
    listens = (F.col("job_id") == F.col("of")) & (F.col("ts") >= F.col("begins")) & (F.col("ts") <= F.col("begins") + F.expr(f"INTERVAL {longest}")) & (F.col("ts") < F.col("ends"))
    return said.join(held, listens, "left_outer").select("event_id", "job_id", "ts", "subscriber")


def by_window(events: DataFrame, length: str = "1 hour", watermark: str = "24 hours") -> DataFrame:
    """Events by window of `length` and status; windows leave the state store once the watermark is past them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", length), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def fan_out(states: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Sends each batch of changed states, exactly once if `send` is idempotent by batch number."""
    return states.writeStream.outputMode(mode).foreachBatch(send).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store(states: DataFrame, folder: str, key: list[str]) -> DataFrame:
    """Runs `states` over what is there, each batch's changes going to a folder of the batch's number, and reads back the last row of each key.

    A batch that is sent again after a failure overwrites its own folder.
    """
    def send(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    fan_out(states, send, f"{folder}/checkpoint").awaitTermination()
    rows = states.sparkSession.read.schema(StructType([*states.schema, StructField("batch", LongType())])).parquet(f"{folder}/rows")
    others = [c for c in states.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*others), "batch").alias("x")) if others else rows.select(*key).distinct()
    return last.select(*key, *(F.col(f"x.{c}").alias(c) for c in others)).select(states.columns)


def appended(rows: DataFrame, folder: str) -> DataFrame:
    """Runs `rows` over what is there into a table under `folder` and reads it; a file sink commits by batch, so a batch that is sent again counts once."""
    run = rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
