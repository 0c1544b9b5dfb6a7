"""The content items of documents: images, paragraph pieces, pages and tables in one order."""

from __future__ import annotations

import functools
from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.sources import store


def paragraph_items(blocks: DataFrame, spoken: Collection[str] | None = None) -> DataFrame:
    """doc_id, para, seg, sub, type, text, position of blanks, pages and texts; texts of other types than `spoken` are not made (null), if it is given.

    A paragraph that holds only a page marker still gives an empty text item.
    """
    kind = T.heading_type(F.col("style")).alias("kind")
    parts = blocks.select("doc_id", F.col("i").alias("para"), kind, F.posexplode(T.segments(F.col("text"))).alias("seg", "segment"))
    parts = parts.withColumn("seg", F.col("seg").cast("long"))
    base = F.col("para") * 1000 + F.col("seg") * 100

    def item(sub, type_, text, position):
        return F.struct(sub.cast("long").alias("sub"), type_.alias("type"), text.alias("text"), position.alias("position"))

    blank = F.when(F.col("seg") > 0, F.array(item(F.lit(0), F.lit("p"), F.lit(""), base)))
    pages = F.transform(T.page_values(F.col("segment")), lambda v, k: item(k + 1, F.lit("pagenum"), v, base + 50))
    clean = T.cleaned(F.col("segment"))
    text = F.array(item(F.lit(1000), F.col("kind"), clean if spoken is None else F.when(F.col("kind").isin(*spoken), clean), base + 100))
    body = F.when(~T.is_blank(F.col("segment")), F.concat(pages, text))
    found = F.explode(F.flatten(F.array_compact(F.array(blank, body)))).alias("x")
    return parts.select("doc_id", "para", "seg", found).select("doc_id", "para", "seg", "x.*")


def table_items(anchors: DataFrame) -> DataFrame:
    """Items of tables: doc_id, table_no, after_para (the last paragraph ahead of it; -1 if none).

    A table's position is past the text of the paragraph that follows it; `body_idx` order would mend that.
    """
    return anchors.select(
        "doc_id", F.col("after_para").alias("para"), F.col("table_no").alias("seg"), F.lit(0).cast("long").alias("sub"), F.lit("table").alias("type"), F.lit("").alias("text"),
        ((F.col("after_para") + 1) * 1000 + 500).alias("position"),
    )


def image_items(refs: DataFrame) -> DataFrame:
    return refs.select(
        "doc_id", F.col("para_idx").alias("para"), F.col("run_idx").alias("seg"), F.lit(0).cast("long").alias("sub"), F.lit("image").alias("type"), F.lit("").alias("text"),
        (F.col("para_idx") * 1000 + F.col("run_idx")).alias("position"),
    )


def content_items(images: DataFrame, paragraphs: DataFrame | None, tables: DataFrame | None) -> DataFrame:
    """All items with id_no (numbered from 3 in the order images, paragraphs, tables), elem_id and sorted_no.

    The sort is by position, run of images, then id_no: what a stable sort of the appended list gives.
    Tables, or paragraphs and tables, may be left out where nobody asks for them: they come last, so the ids of others stay.
    """
    phases = [x.withColumn("phase", F.lit(n)) for n, x in enumerate((images, paragraphs, tables)) if x is not None]
    rows = store.dealt(functools.reduce(DataFrame.unionByName, phases), "doc_id")
    doc = Window.partitionBy("doc_id")
    rows = rows.withColumn("id_no", (F.row_number().over(doc.orderBy("phase", "para", "seg", "sub")) + 2).cast("long"))
    prefix = F.when(F.col("type") == "pagenum", "page_").when(F.col("type") == "image", "id_").when(F.col("type") == "table", "table_").otherwise("p_")
    run = F.when(F.col("type") == "image", F.col("seg")).otherwise(0)
    rows = rows.withColumn("elem_id", F.concat(prefix, F.col("id_no").cast("string")))
    return rows.withColumn("sorted_no", F.row_number().over(doc.orderBy("position", run, "id_no")).cast("long")).drop("phase")


def table_anchors(body: DataFrame) -> DataFrame:
    """From body children (doc_id, body_idx, kind): each table and the last paragraph ahead of it, by a running maximum."""
    by = Window.partitionBy("doc_id").orderBy("body_idx")
    para = F.sum(F.when(F.col("kind") == "p", 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = body.withColumn("after_para", para.cast("long")).where("kind = 'table'")
    return rows.withColumn("table_no", F.row_number().over(by).cast("long"))


def epub_ids(items: DataFrame) -> DataFrame:
    """`items` with epub_id and src: numbers start at 1 for e-books, which have no title and author among them, and images have a prefix and a file number of their own."""
    n = F.col("id_no") - 2
    prefix = F.when(F.col("type") == "pagenum", "page_").when(F.col("type") == "image", "img_").when(F.col("type") == "table", "table_").otherwise("p_")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.when(F.col("type") == "image", 0).otherwise(1), "id_no"))
    src = F.when(F.col("type") == "image", F.concat(F.lit("images/image"), nth.cast("string"), F.lit(".jpeg")))
    return items.withColumns({"epub_id": F.concat(prefix, n.cast("string")), "src": src})


def cell_images(cells: DataFrame, images: DataFrame) -> DataFrame:
    """doc_id, table_id, row, tc, k, src of images in cells, those of nested tables included: named by table, cell and number in the cell.

    `images` has doc_id, table_id, row, tc, rid and ext; only images of cells that exist are named.
    """
    k = (F.row_number().over(Window.partitionBy("doc_id", "table_id", "row", "tc").orderBy("rid")) - 1).cast("long")
    found = images.join(cells.select("doc_id", "table_id", "row", "tc").distinct(), ["doc_id", "table_id", "row", "tc"], "left_semi").withColumn("k", k)
    name = F.concat(F.lit("table_"), "table_id", F.lit("_cell_"), F.col("row").cast("string"), F.lit("_"), F.col("tc").cast("string"), F.lit("_img_"), F.col("k").cast("string"), F.lit("."), "ext")
    return found.select("doc_id", "table_id", "row", "tc", "k", name.alias("src"))
