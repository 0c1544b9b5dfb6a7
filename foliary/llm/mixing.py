"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words. Document rates stay as close to 1
as they can, in relative entropy, while each source's words come to its target
and no rate exceeds 2: the convex dual has one multiplier for each source, and
rates are exponentially tilted, min(2, exp(multiplier * size / mean size)).
Newton steps, kept within a bracket, find the multipliers; each is an
aggregation over how many documents of each size a source has. Rates are then
rounded into whole copies by a fixed hash of id and text, and a few passes give or take single
copies where the rounded words still miss the target.

Scale: one pass over the texts counts words; all else works on a narrow table,
aggregated before each shuffle, so that a source may hold any share of the
rows. Sums are exact decimals, so reruns agree. Multipliers and cuts are tables
joined by source; nothing about single documents reaches the driver.

Edge cases: null and empty texts have size 0 and are taken 0 words; null is a
source of its own, the last; a source with no words has target 0; an empty
table gives an empty result; other columns are ignored. Rows that share a doc_id
(null ids too) are documents of their own, rounded by their texts; rows that share
the text as well are numbered where they are read and rounded in even steps, so
that part of them turns and not all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.llm import cluster
from foliary.llm import textarrays as ta

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: How near to its target, as a part of it, each source's rates have to come, and steps after which that is an error.
TOLERANCE = 1e-6
MOST_STEPS = 200
_STEPS_A_JOB = 8
_FAR = 1e9
REPAIRS = 4
_BINS = 4096
_EXACT = "decimal(28,8)"
#: Sources up to which their table is broadcast.
_BROADCAST = 50_000


#: Of the golden ratio's part after the point, 40 bits: steps of it fall evenly.
_EVEN = 679_535_556_991


def _words_and_places(text: pa.Array, row: pa.Array, seen: dict[int, int]) -> tuple[pa.Array, pa.Array]:
    """Words of each text, and how many rows like it (by the hash `row`) the task has seen; `seen` counts them."""
    n = [np.diff(ta.words(ta.from_arrow(text[i:j]))[2]) for i, j in ta.slices(text)]
    places = []
    for x in row.to_pylist():
        places.append(seen.get(x, 0))
        seen[x] = places[-1] + 1
    return pa.array(np.concatenate(n), pa.int64()), pa.array(places, pa.int64())


def _row(doc_id: str = "doc_id", text: str = "text"):
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of each document, its words, with row (a hash of id and text) and nth (its place among rows alike in the task)."""
    seen: dict[int, int] = {}  # every task has its own

    def batch(b: pa.RecordBatch) -> pa.Table:
        size, nth = _words_and_places(b.column(2), b.column(3), seen)
        return pa.table({"doc_id": b.column(0), "source": b.column(1), "size": size, "row": b.column(3), "nth": nth})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cluster.map_batches(docs.select("doc_id", "source", "text", _row().alias("row")), batch, f"doc_id {kind}, source string, size long, row long, nth long")


def _before(rows: DataFrame, order: list, parts: int, **values) -> DataFrame:
    """`rows` with sums of `values` over all rows ahead in `order`, found within ranges of it and by sums over the ranges."""
    placed = rows.repartitionByRange(parts, *order).withColumns({f"own_{k}": v for k, v in values.items()} | {"part": F.spark_partition_id()})
    placed = cluster.written(placed)  # so that ranges are drawn once
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    sums = placed.groupBy("part").agg(*(F.sum(f"own_{k}").alias(k) for k in values))
    sums = sums.select("part", *(F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"part_{k}") for k in values))
    out = placed.withColumns({k: F.coalesce(F.sum(f"own_{k}").over(within), F.lit(0)) for k in values}).join(F.broadcast(sums), "part")
    return out.select(*rows.columns, *((F.col(k) + F.col(f"part_{k}")).alias(k) for k in values))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, parts: int = 1) -> DataFrame:
    """source_size and target of each source, from source and source_size; sorted in `parts` ranges.

    Weights repeat over the sources by code point, null last. A target is
    min(most * source_size, level * weight) with the level at which they come
    to `share` of all sizes: what resharing the excess again and again ends in.
    """
    name = F.col("source").asc_nulls_last()
    rows = _before(by_source.select("source", "source_size"), [name], parts, place=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.withColumns({"weight": weight.cast("double"), "cap": F.lit(float(most)) * F.col("source_size")}).drop("place").withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = _before(rows, [F.col("ratio"), name], parts, caps=F.col("cap"), weights=F.col("weight"))
    total = rows.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("all_weights"))  # one row, as are the levels below
    rows = rows.crossJoin(F.broadcast(total))
    # If the sources before this one are at their caps, the others' level is this.
    rows = rows.withColumn("level", (F.lit(share) * F.col("all") - F.col("caps")) / (F.col("all_weights") - F.col("weights")))
    level = rows.agg(F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).alias("found"))
    rows = rows.crossJoin(F.broadcast(level))
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("found") * F.col("weight"), F.col("cap"))).alias("target"))


def _by_source(rows: DataFrame, small: DataFrame, n_sources: int | None = None) -> DataFrame:
    """`rows` joined with a table of one row for each source, null included; broadcast if there are known to be few."""
    small = small.withColumnRenamed("source", "source_")
    small = F.broadcast(small) if n_sources is not None and n_sources <= _BROADCAST else small
    return rows.join(small, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def _rate(multiplier, size, mean):
    return F.least(F.lit(float(MOST)), F.exp(F.least(multiplier * size / mean, F.lit(50.0))))


def _newton(histogram: DataFrame, now: DataFrame, n_sources: int) -> DataFrame:
    """One step: `now` with the multipliers moved, and `missed`, by how much of its target each source missed before.

    The state travels through the aggregation, so that steps chain into one job.
    """
    state = [c for c in now.columns if c not in ("source", "missed")]
    rate = _rate(F.col("multiplier"), F.col("size"), F.col("mean"))
    joined = _by_source(histogram, now, n_sources)
    words = (F.col("size") * rate * F.col("n")).cast(_EXACT)
    slope = F.when(rate < MOST, F.col("size") * F.col("size") / F.col("mean") * rate * F.col("n")).otherwise(0.0).cast(_EXACT)
    both = joined.groupBy("source").agg(F.sum(words).cast("double").alias("words"), F.sum(slope).cast("double").alias("slope"), *(F.any_value(c).alias(c) for c in state))
    gap = F.col("target") - F.col("words")
    missed = F.when(F.col("full"), 0.0).otherwise(F.abs(gap) / F.greatest("target", F.lit(1.0)))
    both = both.withColumn("missed", missed)
    both = both.withColumns({"low": F.when(gap > 0, F.col("multiplier")).otherwise(F.col("low")), "high": F.when(gap > 0, F.col("high")).otherwise(F.col("multiplier"))})
    step = F.col("multiplier") + gap / F.greatest("slope", F.lit(1e-9))
    middle = (
        F.when(F.col("high") >= _FAR, F.greatest(F.col("low") * 2, F.lit(1.0))).when(F.col("low") <= -_FAR, F.least(F.col("high") * 2, F.lit(-1.0)))
        .otherwise((F.col("low") + F.col("high")) / 2)
    )
    moved = F.when((step > F.col("low")) & (step < F.col("high")), step).otherwise(middle)
    return both.withColumn("multiplier", F.when(F.col("missed") <= TOLERANCE, F.col("multiplier")).otherwise(F.round(moved, 12))).select(*now.columns)


def multipliers(histogram: DataFrame, goals: DataFrame, n_sources: int) -> DataFrame:
    """source, target, source_size, full, mean and multiplier; `histogram` has source, size, n.

    A step aggregates words and their slope at the present multipliers and
    moves each by Newton's rule, or within its bracket if that leaves it. Steps
    go on until every source is within TOLERANCE of its target; an error tells
    if MOST_STEPS are not enough.
    """
    about = histogram.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    now = _by_source(goals, about, n_sources).withColumn("mean", F.greatest("mean", F.lit(1.0)))
    # Sources at their cap take each document twice: the multiplier is without bound.
    full = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)
    now = now.withColumns({"full": full, "multiplier": F.lit(0.0), "low": F.lit(-_FAR), "high": F.lit(_FAR), "missed": F.lit(0.0)})
    now = cluster.written(now)
    for _ in range(0, MOST_STEPS, _STEPS_A_JOB):
        for _ in range(_STEPS_A_JOB):
            now = _newton(histogram, now, n_sources)
        now = cluster.written(now)
        missed = now.agg(F.max("missed")).first()[0]
        if (missed or 0.0) <= TOLERANCE:
            return now.drop("low", "high", "missed")
    raise RuntimeError(f"the rates of a source still miss its target by {missed} of it after {MOST_STEPS} steps")


def _choices(sized: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """`sized` (source, size, row, nth and others) with the columns of `plan`, and rate, reach, copies and `turned`.

    The repairs that the plan has so far are applied in turn.
    """
    rows = _by_source(sized, plan, n_sources)
    rate = F.when(F.col("full"), F.lit(float(MOST))).otherwise(_rate(F.col("multiplier"), F.col("size"), F.col("mean")))
    # A number from 0 to 1 that the document fixes; it decides which way a rate is rounded. Rows alike take even steps from it.
    step = F.pmod(F.col("nth"), F.lit(1 << 20)) * F.lit(_EVEN)
    draw = F.pmod(F.pmod(F.xxhash64(F.lit("copies"), "row", "size"), F.lit(1 << 40)) + step, F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = rows.withColumn("rate", F.round(rate, 9)).withColumn("reach", F.col("rate") + draw)
    start = F.struct(F.least(F.floor("reach"), F.lit(MOST)).cast("int").alias("copies"), F.lit(False).alias("turned"))

    def repair(now, x):
        able, place = _able(x["gap"], now["copies"], now["turned"])
        turns = able & (place <= x["cut"])
        return F.struct(
            (now["copies"] + F.when(turns, F.signum(x["gap"]).cast("int")).otherwise(F.lit(0))).alias("copies"), (now["turned"] | turns).alias("turned")
        )

    rows = rows.withColumn("state", F.aggregate("repairs", start, repair))
    return rows.withColumns({"copies": F.col("state.copies").cast("long"), "turned": F.col("state.turned")}).drop("state")


def _able(gap, copies, turned) -> tuple:
    """Whether a document may give or take a copy to close `gap`, and the bin of how near its rounding was to that."""
    up = gap > 0
    beyond = F.col("reach") - F.floor("reach")
    able = ~turned & (F.col("size") > 0) & (F.col("size") <= F.abs(gap))
    able = able & F.when(up, copies < MOST).otherwise(copies > 0)
    return able, F.floor(F.when(up, 1 - beyond).otherwise(beyond) * (_BINS - 1)).cast("int")


def plan_mix(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repairs: int = REPAIRS) -> tuple[DataFrame, int]:
    """What fixes the copies of every document: a row for each source, and how many there are.

    After Newton's steps come repairs: documents are put into bins by how near
    they were to rounding the other way, and whole bins turn, up to the first
    that would exceed what is missing. So the gap shrinks and keeps its sign;
    each later repair turns only documents that fit into what is left.
    """
    histogram = cluster.written(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    by_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    n = by_source.count()
    plan = multipliers(histogram, targets(by_source, weights, share, parts=1 + n // _BROADCAST), n)
    none = F.array().cast("array<struct<gap:double,cut:int>>")
    plan = plan.select("source", "source_size", "target", "multiplier", "mean", "full", none.alias("repairs"))
    for _ in range(repairs):
        gap = _choices(sized, plan, n).groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
        plan = cluster.written(_by_source(plan, gap, n))
        able, place = _able(F.col("gap"), F.col("copies"), F.col("turned"))
        bins = _choices(sized, plan, n).where(able).groupBy("source", "gap", place.alias("bin")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bin"))
        cut = bins.withColumn("run", run).where(F.col("run") <= F.abs("gap")).groupBy("source").agg(F.max("bin").alias("cut"))
        cut = cut.withColumnRenamed("source", "source_")
        plan = plan.join(cut, F.col("source").eqNullSafe(F.col("source_")), "left")
        step = F.struct(F.col("gap"), F.coalesce("cut", F.lit(-1)).alias("cut"))
        plan = plan.withColumn("repairs", F.concat("repairs", F.array(step))).drop("source_", "gap", "cut")
        plan = cluster.written(plan)
    return plan, n


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repairs: int = REPAIRS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies and rate of each document."""
    sized = cluster.written(sizes(docs))
    plan, n = plan_mix(sized, weights, share, repairs)
    rows = _choices(sized, plan, n)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repairs: int = REPAIRS) -> DataFrame:
    """The mix itself: each document with all its columns, as many times as it is taken. Texts are not shuffled.

    Documents of size 0 (null, empty or blank texts) may be taken once or twice, as they take no words; rows
    that share id and text may be taken unlike; columns keep their names, whatever these are; an empty table stays empty.
    """
    plan, n = plan_mix(cluster.written(sizes(docs)), weights, share, repairs)
    at, seen = docs.columns.index("text"), {}

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, *_words_and_places(b.column(at), b.column(len(b.columns) - 1), seen)], [*b.schema.names, "__size", "__nth"])

    inner = docs.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)))
    inner = inner.withColumn("__row", _row(f"__{docs.columns.index('doc_id')}", f"__{at}"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema)
    sized = cluster.map_batches(inner, batch, f"{kinds}, `__size` long, `__nth` long")
    sized = sized.withColumns({"source": F.col(f"__{docs.columns.index('source')}"), "size": F.col("__size"), "row": F.col("__row"), "nth": F.col("__nth")})
    rows = _choices(sized, plan, n).where("copies > 0")
    rows = rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)))
