"""Runs of neighbouring rows: repeated neighbours and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import scan


def without_repeats(rows: DataFrame, key: list[str], order: str, text: str = "text") -> DataFrame:
    """Rows whose text differs from that of the row ahead, found by a scan of ranges: a key may hold any share of the rows."""
    found = scan.running(rows, key, [order], {"__ahead": ("last", F.struct(F.col(text).alias("x")))})
    return found.where(F.col("__ahead.x").isNull() | (F.col("__ahead.x") != F.col(text))).drop("__ahead")


def islands(rows: DataFrame, key: list[str], order: str, kind) -> DataFrame:
    """Maximal runs of neighbours of one kind that is not null: key, kind, first, last, n."""
    w = Window.partitionBy(*key).orderBy(order)
    rows = rows.withColumn("kind", kind)
    changed = F.when(F.col("kind").eqNullSafe(F.lag("kind").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = rows.withColumn("__changed", changed).withColumn("run", F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("kind is not null").groupBy(*key, "run", "kind").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("run")


def lists(rows: DataFrame, key: list[str], order: str, text: str = "text") -> DataFrame:
    """Ordered and unordered lists: consecutive items of one kind; any other row closes a list."""
    return islands(rows, key, order, T.list_kind(F.col(text)))


def numbered_notes(rows: DataFrame, key: list[str], order: str, text: str = "text") -> DataFrame:
    """key, order column, k (running number in the document), note: note references in reading order."""
    found = rows.select(*key, order, F.posexplode(T.note_references(F.col(text), "각주")).alias("at", "note"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(order, "at")).cast("long")
    return found.select(*key, order, number.alias("k"), "note")


def notes(rows: DataFrame, key: list[str], order: str, text: str = "text") -> DataFrame:
    """key, order column, note_id, note, content: the first reference of each kind in each row, numbered over all kinds in reading order.

    Footnotes have a number of their own; the ids of other kinds go on from all notes so far.
    """
    kinds = F.array(*(
        F.struct(F.lit(k).alias("kind"), F.lit(prefix).alias("prefix"), F.regexp_extract(text, rf"\({word}\d+\)", 0).alias("note"), F.lit(says).alias("says"))
        for k, (word, prefix, says) in enumerate(T.NOTES)
    ))
    found = rows.select(*key, order, F.explode(kinds).alias("x")).select(*key, order, "x.*").where("note <> ''")
    w = Window.partitionBy(*key).orderBy(order, "kind")
    own = F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    number = F.when(F.col("kind") == 0, own).otherwise(F.row_number().over(w))
    return found.select(*key, order, F.concat_ws("_", "prefix", number.cast("string")).alias("note_id"), "note", F.concat("note", "says").alias("content"))


def numbered(rows: DataFrame, key: list[str], order: str, values, label: str) -> DataFrame:
    """key, order column, k, label: `values` (an array column) in reading order, each as `label`, its number and itself, cut at 50 characters."""
    found = rows.select(*key, order, F.posexplode(values).alias("at", "value"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy(order, "at")).cast("long")
    return found.select(*key, order, number.alias("k"), F.concat(F.lit(f"{label} "), number.cast("string"), F.lit(": "), F.left("value", F.lit(50))).alias("label"))
