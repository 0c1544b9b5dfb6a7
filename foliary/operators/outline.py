"""Hierarchy of headings from their order, as window maxima: no theta join, no group in Python.

`heads` has doc_id, ord (from 1) and level; one shuffle by doc_id serves all windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.operators import scan

LEVELS = range(1, 7)


def _before(key: list[str], order: str):
    return Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def nearest_parent(key: list[str] = ["doc_id"], order: str = "ord"):  # noqa: B006
    """The nearest earlier heading of a lesser level."""
    level, w = F.col("level"), _before(key, order)
    return F.coalesce(*(F.when(level == k, F.max(F.when(level < k, F.col(order))).over(w)) for k in LEVELS if k > 1))


def section_parent(key: list[str] = ["doc_id"], order: str = "ord"):  # noqa: B006
    """The open section of the level above, else the last of level 1; null where level 1 has to be made up."""
    level, w = F.col("level"), _before(key, order)
    top = F.max(F.when(level == 1, F.col(order))).over(w)

    def parent(k: int):
        last = F.max(F.when(level == k - 1, F.col(order))).over(w)
        below = F.max(F.when(level < k - 1, F.col(order))).over(w)
        return F.when(level == k, F.coalesce(F.when(last > F.coalesce(below, F.lit(0)), last), top))

    return F.coalesce(*(parent(k) for k in LEVELS if k > 1))


def outline(heads: DataFrame, key: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """`heads` with parent_ord, section_ord, play_order and needs_top (a level 1 is missing above)."""
    play = F.row_number().over(Window.partitionBy(*key).orderBy("ord"))
    out = heads.withColumns({"parent_ord": nearest_parent(key), "section_ord": section_parent(key), "play_order": play.cast("long")})
    return out.withColumn("needs_top", (F.col("level") > 1) & F.col("section_ord").isNull())


def long_outline(heads: DataFrame, key: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The same as `outline`, by a scan of ranges: for documents of which one may hold most headings, or a whole table as one."""
    level, order = F.col("level"), F.col("ord")
    last = {f"__last_{k}": ("max", F.when(level == k, order)) for k in LEVELS}
    found = scan.running(heads, key, ["ord"], {"__n": ("sum", F.lit(1)), **last})
    lasts = [F.col(f"__last_{k}") for k in LEVELS]
    latest = lambda upto: F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *(x.cast("long") for x in lasts[:upto]))

    def section(k: int):
        open_ = F.when(lasts[k - 2] > F.coalesce(latest(k - 2), F.lit(0)), lasts[k - 2])
        return F.when(level == k, F.coalesce(open_, lasts[0]))

    out = found.withColumns({
        "parent_ord": F.coalesce(*(F.when(level == k, latest(k - 1)) for k in LEVELS if k > 1)), "section_ord": F.coalesce(*(section(k) for k in LEVELS if k > 1)), "play_order": F.col("__n") + 1,
    })
    return out.withColumn("needs_top", (level > 1) & F.col("section_ord").isNull()).drop("__n", *last)


def depth(heads: DataFrame) -> DataFrame:
    """doc_id, depth: the greatest level, 1 at least and 6 at most."""
    return heads.groupBy("doc_id").agg(F.least(F.greatest(F.coalesce(F.max("level"), F.lit(0)), F.lit(1)), F.lit(6)).cast("long").alias("depth"))


def play_order(heads: DataFrame, pages: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Reading order over headings first, then pages, then notes: doc_id, kind, ord, play_order."""
    parts = [heads.select("doc_id", F.lit("heading").alias("kind"), F.lit(1).alias("rank"), "ord"), pages.select("doc_id", F.lit("page").alias("kind"), F.lit(2).alias("rank"), "ord")]
    if notes is not None:
        parts.append(notes.select("doc_id", F.lit("note").alias("kind"), F.lit(3).alias("rank"), "ord"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank", "ord")).cast("long")
    return rows.withColumn("play_order", order).drop("rank")


def open_levels(level, order: str, window) -> list:
    """Of each level from 1 to 6 whether a section of it is open ahead of the row: its last heading came after the last of any lesser level."""
    last = {k: F.max(F.when(level == k, F.col(order))).over(window) for k in LEVELS}
    return [
        F.coalesce(last[k] > F.coalesce(F.greatest(F.lit(0).cast("long"), F.lit(0).cast("long"), *(last[j] for j in LEVELS if j < k)), F.lit(0)), F.lit(False)) for k in LEVELS
    ]


def open_depth(level, before: list):
    """How many sections are open after a heading: itself and those of lesser levels that were open."""
    return F.lit(1).cast("long") + sum((F.when((level > k) & is_open, 1).otherwise(0) for k, is_open in zip(LEVELS, before, strict=True)), F.lit(0))


def section_closes(heads: DataFrame) -> DataFrame:
    """`heads` with parent_ord, open_depth (sections open after it) and closes (how many it closes first)."""
    out = heads.withColumns({"parent_ord": nearest_parent(), "open_depth": open_depth(F.col("level"), open_levels(F.col("level"), "ord", _before(["doc_id"], "ord")))})
    before = F.coalesce(F.lag("open_depth").over(Window.partitionBy("doc_id").orderBy("ord")), F.lit(0))
    return out.withColumn("closes", before - F.col("open_depth") + 1)


def content_files(heads: DataFrame) -> DataFrame:
    """Files of the level-1 headings, the title being file 1: doc_id, ord, file_index, filename."""
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).cast("long") + 1
    return heads.where("level = 1").select("doc_id", "ord", index.alias("file_index")).withColumn("filename", F.concat(F.lit("dtbook-"), F.col("file_index").cast("string"), F.lit(".xhtml")))
