"""Running values along an order, without one task for a key that holds most rows.

Rows are put into ranges of (key, order) of about equal size and written, so that
ranges are drawn once. Within a range, windows give the running values of its
rows; each range and key has one row of totals, whose running values by key are
what is carried into the next range; both are put together in place. Ranges are
small whatever the keys, and totals are a row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.sources import store

#: How two parts of a running value are put together, the earlier first.
_JOINED = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "last": lambda a, b: F.coalesce(b, a),
}


def _aggregate(kind: str, value: Column, order: Column) -> Column:
    """The value of many rows; `last` is that of the last row whose value is not null."""
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), order))
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def running(rows: DataFrame, key: list[str], order: list[str], ahead: dict[str, tuple[str, Column]], ranges: int | None = None) -> DataFrame:
    """`rows` with a column for each of `ahead`, named: (kind, value), over all rows of the key ahead of the row in `order`.

    Kinds are sum (0 if there are none ahead), max, min and last (of the values
    that are not null). `order` has to tell rows of a key apart. With no key all
    rows are one sequence. There are as many `ranges` as shuffle partitions if not given.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = {n: f"__v_{n}" for n in ahead}
    placed = rows.withColumns({named[n]: v for n, (_, v) in ahead.items()}).repartitionByRange(ranges, *key, *order)
    placed = store.written(placed.withColumn("__part", F.spark_partition_id()))
    at = F.struct(*order)
    before = Window.partitionBy("__part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def within(kind: str, value: Column) -> Column:
        if kind == "last":
            return F.last(value, ignorenulls=True).over(before)
        return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(before)

    own = placed.withColumns({f"__w_{n}": within(kind, F.col(named[n])) for n, (kind, _) in ahead.items()})
    totals = placed.groupBy("__part", *key).agg(*(_aggregate(kind, F.col(named[n]), at).alias(f"__t_{n}") for n, (kind, _) in ahead.items()))
    upto = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)

    def carried(kind: str, value: Column) -> Column:
        return F.last(value, ignorenulls=True).over(upto) if kind == "last" else {"sum": F.sum, "max": F.max, "min": F.min}[kind](value).over(upto)

    into = totals.select("__part", *key, *(carried(kind, F.col(f"__t_{n}")).alias(f"__c_{n}") for n, (kind, _) in ahead.items()))
    into = into.withColumnsRenamed({"__part": "__of", **{k: f"__k_{k}" for k in key}})
    same = F.col("__part") == F.col("__of")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    out = own.join(into, same)
    return out.select(*rows.columns, *(_JOINED[kind](F.col(f"__c_{n}"), F.col(f"__w_{n}")).alias(n) for n, (kind, _) in ahead.items()))
