"""Sharding by balanced label propagation.

Documents of equal text are linked. Every linked document starts in a shard by
hash; then, in rounds of joins until none asks to move, each moves towards the
shard that most bytes of its group are in and that has room for it, admitted by
quota: for every target shard, in an order fixed by hash, only as many bytes as
it has left. Groups larger than a shard fill one after another. Documents without links then fill every
shard up to the same size: those of notable size, of which there can only be a
bounded number, into the emptiest, the others by cuts through their order.
The law that holds is `bytes`.

Scale: texts are read once for size and checksums and never shuffled. Groups
are counted before they are joined and move as counts by shard, loads and quotas
are tables of at most shards * bins rows, and slots come from counts by shard
and bucket.

Edge cases: a null text has size 16 and is linked to no empty text; repeated
rows are linked like any equal texts; null doc_ids are sharded like others; an
empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm import cluster

SHARDS = 40
OVERHEAD = 16
#: Bins of the order in which documents are admitted or dealt.
_BINS = 1024
_FINE = 1 << 16
#: A document is notable from this part of a shard on, so there are at most SHARDS * _NOTABLE of them.
_NOTABLE = 500
_SLOTTED = 10_000


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, key of equal texts, and rid, a number of its own for each row."""
    raw = F.col("text").cast("binary")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.coalesce(raw, F.lit(b""))).alias("text_crc32"),
        F.xxhash64(F.lit("key"), "text").alias("key"),
        F.col("text").isNull().alias("none"),
        F.monotonically_increasing_id().alias("rid"),
    )


_GROUP = ["key", "size", "text_crc32", "none"]


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = dict(rows.groupBy("shard").agg(F.sum("size")).collect())  # one row a shard
    return [int(found.get(s, 0)) for s in range(shards)]


def propagate(linked: DataFrame, shards: int, capacity: int) -> DataFrame:
    """`linked` (with _GROUP, rid) with a shard each; no shard gets over `capacity` bytes by a move.

    Documents of a group are alike, so rounds move counts by group and shard;
    which documents stand for them is settled at the end. Rounds go on until no
    piece of a group asks to move. Each moves at least one document to where
    more of its group is, so the sum of squared counts grows and they end.
    """
    spark = linked.sparkSession
    order = F.pmod(F.xxhash64(F.lit("order"), *_GROUP), F.lit(_BINS)).cast("int")
    start = F.pmod(F.xxhash64(F.lit("start"), "rid"), F.lit(shards)).cast("int")
    rows = cluster.written(linked.withColumn("shard", start).withColumn("bin", order))
    pieces = cluster.written(rows.groupBy(*_GROUP, "bin", "shard").agg(F.count("*").alias("n")))
    while True:
        loads = _loads(pieces.select("shard", (F.col("size") * F.col("n")).alias("size")), shards)
        free = spark.createDataFrame([(s, max(0, capacity - w)) for s, w in enumerate(loads)], "shard int, free long")
        # The shard that holds most of the group, of those with room for one more of its documents.
        open_ = pieces.join(F.broadcast(free), "shard").withColumn("open", F.when(F.col("free") >= F.col("size"), F.col("n")).otherwise(-1))
        best = F.max_by("shard", F.struct("open", -F.col("shard"))).alias("best")
        wish = open_.groupBy(*_GROUP).agg(best, F.max("open").alias("most")).where("most > 0")
        # A piece of a group moves only to where more of it is; of two equal ones to the lower shard.
        moving = pieces.join(wish, _GROUP).where((F.col("most") > F.col("n")) | (F.col("most") == F.col("n")) & (F.col("best") < F.col("shard")))
        moving = cluster.written(moving.select(*_GROUP, "bin", "shard", "best", "n"))
        asked = moving.groupBy("best", "bin").agg(F.sum(F.col("size") * F.col("n")).alias("asked")).collect()  # at most shards * _BINS rows
        if not asked:
            break
        # Whole bins are admitted while they fit; of the first that does not, as many documents in order as fit.
        part = []
        for target in range(shards):
            left = max(0, capacity - loads[target])
            for bin_, n in sorted((r["bin"], int(r["asked"])) for r in asked if r["best"] == target):
                if left > 0:
                    part.append((target, bin_, left))
                left -= n
        quota = spark.createDataFrame(part, "best int, bin int, left long")
        ahead = Window.partitionBy("best", "bin").orderBy(*_GROUP, "shard").rowsBetween(Window.unboundedPreceding, -1)
        room = F.col("left") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(ahead), F.lit(0))
        goes = F.least("n", F.greatest(F.floor(room / F.col("size")), F.lit(0))).cast("long")
        moved = moving.join(F.broadcast(quota), ["best", "bin"]).select(*_GROUP, "bin", "shard", "best", goes.alias("goes")).where("goes > 0")
        change = F.explode(F.array(F.struct("shard", (-F.col("goes")).alias("n")), F.struct(F.col("best").alias("shard"), F.col("goes").alias("n")))).alias("x")
        change = moved.select(*_GROUP, "bin", change).select(*_GROUP, "bin", "x.shard", "x.n")
        now = pieces.unionByName(change).groupBy(*_GROUP, "bin", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        pieces = cluster.written(now)
    return _dealt(rows.drop("shard", "bin"), pieces)


def _dealt(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    """`rows` with a shard each, as many of each group in a shard as `pieces` (_GROUP, shard, n) say."""
    buckets = max(1, math.ceil(rows.count() / _SLOTTED))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("deal"), "rid"), F.lit(buckets)))
    before = Window.partitionBy(*_GROUP).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*_GROUP, "bucket").agg(F.count("*").alias("n"))
    counts = counts.select(*_GROUP, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    end = F.sum("n").over(Window.partitionBy(*_GROUP).orderBy("shard")).alias("end")
    ends = pieces.select(*_GROUP, "shard", end).groupBy(*_GROUP).agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    place = F.row_number().over(Window.partitionBy(*_GROUP, "bucket").orderBy("rid")) - 1
    dealt = rows.withColumn("place", place).join(counts.join(ends, _GROUP), [*_GROUP, "bucket"])
    held = F.element_at(F.filter("ends", lambda e: e["end"] > F.col("place") + F.col("before")), 1)["shard"]
    return cluster.written(dealt.select(*rows.drop("bucket").columns, held.alias("shard")))


def _fill(single: DataFrame, loads: list[int], shards: int, total: int) -> DataFrame:
    """`single` with a shard each, so that all shards end at about total / shards bytes."""
    spark = single.sparkSession
    notable = max(1, total // shards // _NOTABLE)
    large = single.where(F.col("size") > notable).select("rid", "size").collect()  # under shards * _NOTABLE * 2 rows
    emptiest = [(w, s) for s, w in enumerate(loads)]
    heapq.heapify(emptiest)
    placed = []
    for rid, size in sorted(large, key=lambda r: (-r[1], r[0])):
        w, s = heapq.heappop(emptiest)
        heapq.heappush(emptiest, (w + size, s))
        placed.append((rid, s))
    loads = [w for w, s in sorted(emptiest, key=lambda x: x[1])]
    put = spark.createDataFrame(placed, "rid long, shard int")
    small = single.where(F.col("size") <= notable).withColumn("bin", F.pmod(F.xxhash64(F.lit("fill"), "rid"), F.lit(_FINE)).cast("int"))
    bins = np.zeros(_FINE, np.int64)
    for bin_, n in small.groupBy("bin").agg(F.sum("size")).collect():  # at most _FINE rows
        bins[bin_] = n
    # Water level: shards below it are filled up to it.
    level, rest = 0.0, int(bins.sum())
    ascending = sorted(loads)
    for i in range(1, shards + 1):
        level = (rest + sum(ascending[:i])) / i
        if i == shards or level <= ascending[i]:
            break
    wanted = np.cumsum([max(0.0, level - w) for w in loads])
    middle = np.cumsum(bins) - bins / 2
    of = np.minimum(np.searchsorted(wanted, middle, "right"), shards - 1)
    where = spark.createDataFrame([(b, int(s)) for b, s in enumerate(of.tolist()) if bins[b]], "bin int, shard int")
    filled = small.join(F.broadcast(where), "bin").drop("bin")
    return filled.unionByName(single.where(F.col("size") > notable).join(F.broadcast(put), "rid").select(filled.columns))


def slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """`rows` with `slot`, gapless from 0 within each shard, in order of hash bucket, then rid."""
    buckets = max(1, math.ceil(n_rows / _SLOTTED))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit("slot"), "rid"), F.lit(buckets)))
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("rid")) - 1
    return rows.withColumn("place", place).join(counts, ["shard", "bucket"]).withColumn("slot", F.col("place") + F.col("before"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    rows = cluster.written(nodes(docs))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    groups = rows.groupBy(*_GROUP).agg(F.count("*").alias("n")).where("n > 1")
    linked = cluster.split_join(rows, groups, _GROUP, "n", n).drop("n")
    placed = propagate(linked, shards, int(total / shards))
    single = cluster.split_anti_join(rows, groups, _GROUP, "n", n)
    single = cluster.written(single.select(*(c for c in placed.columns if c != "shard")))
    everything = placed.unionByName(_fill(single, _loads(placed, shards), shards, total).select(placed.columns))
    out = slots(cluster.written(everything), n)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
