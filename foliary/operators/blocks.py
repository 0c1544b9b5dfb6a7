"""Documents as ordered blocks, segments between breaks, and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions import text as T


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, i (from 0) and line of every line of every document."""
    return docs.select("doc_id", F.posexplode(F.split(text, "\n", -1)).alias("i", "line")).withColumn("i", F.col("i").cast("long"))


def segments(blocks: DataFrame, text: str = "text") -> DataFrame:
    """One row for each piece of a block between breaks that is not blank, and a blank one ahead of each but the first.

    Columns: those of `blocks` without the text, seg, is_blank, segment.
    """
    rest = [c for c in blocks.columns if c != text]
    parts = blocks.select(*rest, F.posexplode(T.segments(F.col(text))).alias("seg", "segment")).withColumn("seg", F.col("seg").cast("long"))
    both = F.when(F.col("seg") > 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    out = parts.withColumn("is_blank", F.explode(both)).withColumn("segment", F.when(F.col("is_blank"), "").otherwise(F.col("segment")))
    return out.where(F.col("is_blank") | (T.strip(F.col("segment")) != ""))


def markers(blocks: DataFrame, text: str = "text") -> DataFrame:
    """A row for each marker: the columns of `blocks` without the text, m (from 1, by place), type, value, original."""
    rest = [c for c in blocks.columns if c != text]
    found = blocks.select(*rest, F.posexplode(T.markers(F.col(text))).alias("m", "x"))
    return found.select(*rest, (F.col("m") + 1).cast("long").alias("m"), "x.type", "x.value", "x.original")
