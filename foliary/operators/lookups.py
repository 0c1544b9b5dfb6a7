"""Images and what surrounds them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import intervals


def with_parts(refs: DataFrame, parts: DataFrame) -> DataFrame:
    """References whose part exists, with its content; others are left out."""
    return refs.join(parts, ["doc_id", "rid"])


def with_extension(refs: DataFrame, rels: DataFrame, default: str = "jpeg") -> DataFrame:
    """`refs` with ext from the target of their relationship, or the default."""
    targets = rels.select("doc_id", "rid", F.nullif(T.extension(F.col("target")), F.lit("")).alias("ext"))
    return refs.join(targets, ["doc_id", "rid"], "left").withColumn("ext", F.coalesce("ext", F.lit(default)))


def nearest_ancestor(ancestors: DataFrame, kinds: tuple[str, ...] = ("cell", "table", "paragraph")) -> DataFrame:
    """From the closure (doc_id, node, ancestor, kind, distance): the nearest ancestor of one of the kinds."""
    return ancestors.where(F.col("kind").isin(*kinds)).groupBy("doc_id", "node").agg(F.min_by(F.struct("ancestor", "kind"), F.struct("distance", "ancestor")).alias("x")).select("doc_id", "node", "x.ancestor", "x.kind")


#: Elements that an image may stand in, and what they are called; fixed values.
OWNERS = {"tc": "cell", "tbl": "table", "p": "paragraph"}


def nearest_by_path(nodes: DataFrame, inner: DataFrame, tags: tuple[str, ...]) -> DataFrame:
    """`inner` (doc_id, node_id, ancestors, others) with near, the nearest element around each whose tag is the first of `tags` that any around it has, and its tag.

    The elements around a node are on its path, so this is an equi-join of paths
    with the elements of these tags, and a greatest node id by node.
    """
    around = inner.select("doc_id", "node_id", F.explode("ancestors").alias("near"))
    rank = F.array_position(F.array(*(F.lit(t) for t in tags)), F.col("tag"))
    found = around.join(nodes.where(F.col("tag").isin(*tags)).select("doc_id", F.col("node_id").alias("near"), "tag"), ["doc_id", "near"])
    best = found.groupBy("doc_id", "node_id").agg(F.max(F.struct((-rank).alias("rank"), "near", "tag")).alias("x")).select("doc_id", "node_id", "x.near", F.col("x.tag").alias("near_tag"))
    return inner.join(best, ["doc_id", "node_id"], "left")


def image_owners(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, rid, owner, owner_node, first: each image of a word-processor file's XML, the cell around it, else the table, else the paragraph, and the first text there."""
    rid = F.coalesce(F.when(F.col("tag") == "blip", F.col("attrs")["embed"]), F.when(F.col("tag") == "imagedata", F.col("attrs")["id"]))
    images = nodes.where("tag in ('blip', 'imagedata')").select("doc_id", "node_id", "ancestors", rid.alias("rid")).where("rid is not null")
    owned = nearest_by_path(nodes, images, tuple(OWNERS)).withColumnRenamed("near", "owner_node")
    texts = nodes.where("tag = 't' and text is not null").select("doc_id", F.col("node_id").alias("t"), "text", F.explode(intervals.on_path(F.col("ancestors"), F.col("around"), tuple(OWNERS))).alias("owner_node"))
    first = texts.join(owned.select("doc_id", "owner_node").distinct(), ["doc_id", "owner_node"], "left_semi").groupBy("doc_id", "owner_node").agg(F.min_by("text", "t").alias("first"))
    name = F.element_at(F.create_map(*(F.lit(x) for pair in OWNERS.items() for x in pair)), F.col("near_tag"))
    return owned.join(first, ["doc_id", "owner_node"], "left").select("doc_id", "node_id", "rid", name.alias("owner"), "owner_node", "first")


def by_owner(images: DataFrame, owners: DataFrame, key: list[str]) -> DataFrame:
    """`owners` with images: the list of theirs, empty if none."""
    lists = images.groupBy(*key).agg(F.sort_array(F.collect_list("rid")).alias("images"))
    return owners.join(lists, key, "left").withColumn("images", F.coalesce("images", F.array().cast("array<string>")))


def nearest_caption(images: DataFrame, paragraphs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, para_idx, run_idx, caption: bracketed text with a caption word, in a paragraph at most `width` away.

    The nearest counts; of equals the image's own paragraph, then the one ahead.
    In the own paragraph the distance is that of the bracket to the run. A band
    join within the document, expanded from the images so that it is an equi-join.
    """
    near = images.select("doc_id", "para_idx", "run_idx", F.explode(F.sequence(F.col("para_idx") - width, F.col("para_idx") + width)).alias("p"))
    inside = F.regexp_extract_all(F.col("text"), F.lit(T.BRACKET), F.lit(1))
    found = paragraphs.select("doc_id", F.col("para_idx").alias("p"), "text", F.posexplode(inside).alias("k", "caption"))
    found = found.where(F.col("caption").rlike("|".join(T.CAPTION_KEYWORDS)))
    found = found.withColumn("at", F.instr("text", F.concat(F.lit("["), "caption", F.lit("]"))) - 1)
    met = near.join(found, ["doc_id", "p"]).withColumn("d", F.abs(F.col("p") - F.col("para_idx")))
    own = F.col("d") == 0
    rank = F.struct(
        F.when(own, F.abs(F.col("at") - F.col("run_idx"))).otherwise(F.col("d")).alias("distance"),
        F.when(own, 0).when(F.col("p") < F.col("para_idx"), 1).otherwise(2).alias("side"), F.col("p"), F.col("k"),
    )
    return met.groupBy("doc_id", "para_idx", "run_idx").agg(F.min_by("caption", rank).alias("caption"))
