"""Streams of job events: expiry from state, windows, and batches that are sent again."""

from pyspark.sql import functions as F

from foliary.streaming import jobs as stream
from foliary.streaming import state

SCHEMA = "event_id long, job_id string, ts timestamp, status string, progress long"


def arriving(spark, path, batches):
    """A stream of one file for each batch of (event_id, job, hour, status)."""
    for n, rows in enumerate(batches):
        at = [(i, j, h, s, 0) for i, j, h, s in rows]
        df = spark.createDataFrame(at, "event_id long, job_id string, hour long, status string, progress long")
        df = df.select("event_id", "job_id", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("hour").cast("int"))).alias("ts"), "status", "progress")
        df.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return stream.read(spark, f"{path}/in", spark.createDataFrame([], SCHEMA), 1)


def test_last_states(spark, tmp_path):
    events = arriving(spark, tmp_path, [[(1, "a", 0, "queued"), (2, "b", 0, "queued")], [(3, "a", 5, "finished")]])
    rows = {r.job_id: (r.status, r.n_events) for r in stream.store(stream.last_states(events), f"{tmp_path}/out", ["job_id"]).collect()}
    assert rows == {"a": ("finished", 2), "b": ("queued", 1)}


def test_jobs_expire_from_state(spark, tmp_path):
    events = arriving(spark, tmp_path, [[(1, "a", 0, "queued")], [(2, "b", 60, "queued")], [(3, "b", 61, "started")], [(4, "c", 200, "queued")]])
    sent = []
    run = stream.expiring(events).writeStream.outputMode("append").foreachBatch(lambda df, n: sent.extend((r.job_id, r.status) for r in df.collect()))
    run.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(sent) == [("a", "queued"), ("b", "started")]  # sessions that are over leave the store; that of c is open


def test_fan_out_sends_each_change_once(spark, tmp_path):
    events, sent = arriving(spark, tmp_path, [[(1, "a", 0, "queued")], [(2, "a", 1, "finished"), (3, "b", 1, "queued")]]), {}
    for _ in range(2):  # a second run has nothing new to send
        stream.fan_out(stream.last_states(events), lambda df, n: sent.setdefault(n, []).extend(sorted((r.job_id, r.status) for r in df.collect())), f"{tmp_path}/cp").awaitTermination()
    assert list(sent.values()) == [[("a", "queued")], [("a", "finished"), ("b", "queued")]] or list(sent.values()) == [[("a", "finished"), ("b", "queued")], [("a", "finished")]]


def told(spark, path, batches, folder):
    """The last row that the state processor sent of each job, over batches of one file each."""
    rows = arriving(spark, path, batches)
    pairs = rows.select("event_id", "job_id", "ts", "status", F.lit("k").alias("k"), F.col("status").alias("v"))
    with state.state_store(spark):
        out = stream.store(state.job_states(pairs, "started", ("finished",), 6 * 3600, 24 * 3600), folder, ["job_id"])
        return {r.job_id: r for r in out.collect()}


def test_jobs_stall_end_and_expire_by_timers(spark, tmp_path):
    batches = [[(1, "a", 0, "started"), (2, "b", 0, "started"), (3, "c", 0, "queued")], [(4, "b", 2, "finished"), (5, "c", 3, "started")], [(6, "d", 12, "started")], [(7, "e", 25, "queued")]]
    got = told(spark, tmp_path, batches, f"{tmp_path}/out")
    hour = 3_600_000_000
    assert not got["a"].live and got["b"].live and (got["b"].elapsed, got["b"].stalled) == (2 * hour, False)
    assert (got["c"].elapsed, got["c"].stalled) == (6 * hour, True)  # silent from hour 3 on
    assert (got["d"].elapsed, got["d"].stalled) == (6 * hour, True) and not got["e"].stalled
    held = spark.read.format("statestore").option("stateVarName", "job").load(f"{tmp_path}/out/checkpoint")
    assert held.count() == 4  # a has left the store


def test_state_goes_on_after_a_restart(spark, tmp_path):
    first = told(spark, tmp_path, [[(1, "a", 0, "started")]], f"{tmp_path}/out")
    then = told(spark, tmp_path, [[(2, "a", 3, "finished"), (3, "b", 4, "started")]], f"{tmp_path}/out")
    assert first["a"].ended is None and then["a"].elapsed == 3 * 3_600_000_000 and then["b"].live
    again = told(spark, tmp_path, [[(4, "a", 40, "started")]], f"{tmp_path}/out")
    assert again["a"].elapsed == 0 and again["a"].meta == {"k": "started"} and not again["b"].live


def test_state_does_not_hang_on_batches(spark, tmp_path):
    events = [(1, "a", 0, "started"), (2, "a", 30, "queued"), (3, "a", 31, "started"), (4, "b", 32, "started"), (5, "a", 33, "finished"), (6, "b", 50, "queued")]
    one = told(spark, tmp_path / "one", [events], f"{tmp_path}/out1")
    many = told(spark, tmp_path / "many", [[e] for e in events], f"{tmp_path}/out2")
    assert {k: tuple(r) for k, r in one.items()} == {k: tuple(r) for k, r in many.items()}
