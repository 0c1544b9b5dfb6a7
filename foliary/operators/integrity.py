"""Validation rules: each gives finding rows (doc_id, category, severity, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions import text as T

#: Files that a talking book and an e-book must have, fixed values.
REQUIRED = ("dtbook.xml", "dtbook.opf", "dtbook.smil", "dtbook.ncx", "dtbook.res")
EPUB_REQUIRED = ("mimetype", "META-INF/container.xml", "EPUB/package.opf", "EPUB/nav.xhtml")
#: What each file's root is called and which children it must have, fixed values.
ROOTS = {
    "dtbook.xml": ("http://www.daisy.org/z3986/2005/dtbook/", "dtbook", ("head", "book")),
    "dtbook.opf": ("http://openebook.org/namespaces/oeb-package/1.0/", "package", ("metadata", "manifest", "spine")),
    "dtbook.smil": ("http://www.w3.org/2001/SMIL20/", "smil", ("head", "body")),
    "dtbook.ncx": ("http://www.daisy.org/z3986/2005/ncx/", "ncx", ("head", "navMap")),
}


def finding(rows: DataFrame, category: str, severity: str, message: Column) -> DataFrame:
    return rows.select("doc_id", F.lit(category).alias("category"), F.lit(severity).alias("severity"), message.alias("message"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def dangling_references(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """A warning for each reference whose fragment no element has; repeated references warn again."""
    named = refs.where(F.col("src").contains("#")).withColumn("id", T.fragment(F.col("src")))
    lost = named.join(ids.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_anti")
    return finding(lost, "content_integrity", "warning", F.concat(F.lit("no element for "), "src"))


def required_files(docs: DataFrame, entries: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Errors for required files that are missing or empty; `entries` has doc_id, path, size."""
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, required))).alias("path"))
    return _missing_or_empty(wanted, entries, "required file ")


def manifest_images(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Errors for images of the manifest that are missing or empty."""
    images = manifest.where(F.col("media_type").startswith("image/")).select("doc_id", F.col("href").alias("path"))
    return _missing_or_empty(images, entries, "image ")


def _missing_or_empty(wanted: DataFrame, entries: DataFrame, what: str) -> DataFrame:
    found = wanted.join(entries.select("doc_id", "path", "size"), ["doc_id", "path"], "left").where("size is null or size = 0")
    state = F.when(F.col("size").isNull(), " is missing").otherwise(" is empty")
    return finding(found, "file_structure", "error", F.concat(F.lit(what), "path", state))


def metadata_mismatch(book: DataFrame, package: DataFrame) -> DataFrame:
    """Warnings where title or author differ though both are given; each has doc_id, title, author."""
    both = book.join(package.select("doc_id", F.col("title").alias("p_title"), F.col("author").alias("p_author")), "doc_id")

    def differs(c: str) -> DataFrame:
        apart = both.where((F.col(c) != "") & (F.col(f"p_{c}") != "") & (F.col(c) != F.col(f"p_{c}")))
        return finding(apart, "metadata_consistency", "warning", F.lit(f"{c} differs"))

    return union(differs("title"), differs("author"))


def heading_rules(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """Warnings: no heading at all, else no level 1, or several."""
    counts = heads.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("level") == 1).alias("n1"))
    rows = docs.select("doc_id").join(counts, "doc_id", "left").fillna(0)
    said = F.when(F.col("n") == 0, "no heading").when(F.col("n1") == 0, "no level-1 heading").when(F.col("n1") > 1, "several level-1 headings")
    return finding(rows.withColumn("said", said).where("said is not null"), "accessibility", "warning", F.col("said"))


def missing_alternatives(images: DataFrame) -> DataFrame:
    """Warnings for images whose alternative text is missing or blank."""
    return finding(images.where(F.col("alt").isNull() | (F.trim("alt") == "")), "accessibility", "warning", F.concat(F.lit("no alternative text: "), "src"))


def duplicate_ids(ids: DataFrame) -> DataFrame:
    """Warnings for element ids that a document has more than once."""
    twice = ids.groupBy("doc_id", "id").agg(F.count("*").alias("n")).where("n > 1")
    return finding(twice, "content_integrity", "warning", F.concat(F.lit("id occurs "), F.col("n").cast("string"), F.lit(" times: "), "id"))


def xml_structure(nodes: DataFrame) -> DataFrame:
    """Errors where a root or a required child of it is missing; `nodes` has doc_id, file, depth, ns, tag, error."""
    def at(depth: int, ns: str | None, tag: str) -> Column:
        return F.coalesce(F.max((F.col("depth") == depth) & (F.lit(ns is None) | (F.col("ns") == ns)) & (F.col("tag") == tag)), F.lit(False))

    # The package's root goes by its local name alone.
    checks = [(f, f"{f}: the root is not {root}", at(0, None if f == "dtbook.opf" else ns, root)) for f, (ns, root, _) in ROOTS.items()]
    checks += [(f, f"{f}: {c} is missing", at(1, ns, c)) for f, (ns, _, children) in ROOTS.items() for c in children]
    # One sum for all rules; each file then tells what it lacks.
    sums = nodes.where(F.col("file").isin(*ROOTS)).groupBy("doc_id", "file").agg(
        F.max(F.col("error").isNotNull()).alias("broken"), *(held.alias(f"c{i}") for i, (_, _, held) in enumerate(checks))
    )
    lacks = F.array(*(F.when(~F.col("broken") & (F.col("file") == f) & ~F.col(f"c{i}"), F.lit(m)) for i, (f, m, _) in enumerate(checks)))
    broken = F.array(F.when(F.col("broken"), F.concat("file", F.lit(" is not well-formed"))))
    said = sums.select("doc_id", F.explode(F.array_compact(F.concat(broken, lacks))).alias("said"))
    return finding(said, "xml_schema", "error", F.col("said"))


def mandatory_metadata(book: DataFrame) -> DataFrame:
    """Errors for blank titles and authors."""
    blank = lambda c: finding(book.where(F.coalesce(T.strip(F.col(c)), F.lit("")) == ""), "metadata", "error", F.lit(f"{c} is mandatory"))
    return union(blank("title"), blank("author"))


def summary(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, error_count, warning_count, is_valid: only errors make a document invalid."""
    counts = findings.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count"))
    return docs.select("doc_id").join(counts, "doc_id", "left").fillna(0).withColumn("is_valid", F.col("error_count") == 0)


def last_meta(meta: DataFrame, names: dict[str, str]) -> DataFrame:
    """doc_id and a column for each of `names`: the content of the last element (by ord) of that name, which stands over earlier ones."""
    return meta.groupBy("doc_id").agg(*(F.max_by(F.when(F.col("name") == n, F.col("content")), F.when(F.col("name") == n, F.col("ord"))).alias(c) for c, n in names.items()))


def details(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """`summary` with errors and warnings (messages in order) and details: how many findings each category has."""
    said = lambda kind: F.sort_array(F.collect_list(F.when(F.col("severity") == kind, F.col("message"))))
    lists = findings.groupBy("doc_id").agg(said("error").alias("errors"), said("warning").alias("warnings"))
    by = findings.groupBy("doc_id", "category").agg(F.count("*").alias("n")).groupBy("doc_id")
    by = by.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("details"))
    none = F.array().cast("array<string>")
    rows = summary(docs, findings).join(lists, "doc_id", "left").join(by, "doc_id", "left")
    return rows.withColumns({"errors": F.coalesce("errors", none), "warnings": F.coalesce("warnings", none), "details": F.coalesce("details", F.create_map().cast("map<string,bigint>"))})


def crashed(states: DataFrame) -> DataFrame:
    """An error for each document whose validation ended with one: `states` has doc_id and failure, null where it went through."""
    return finding(states.where("failure is not null"), "system", "error", F.concat(F.lit("validation failed: "), "failure"))


def reading_errors(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Errors of books that cannot be read on: no navigation or book file, none of their maps and bodies; `nodes` has doc_id, file, tag."""
    asked = (("dtbook.ncx", None), ("dtbook.xml", None), ("dtbook.ncx", "navMap"), ("dtbook.xml", "bodymatter"))
    held = [F.coalesce(F.max((F.col("file") == f) & (F.lit(t is None) | (F.col("tag") == t))), F.lit(False)).alias(f"c{i}") for i, (f, t) in enumerate(asked)]
    rows = docs.select("doc_id").join(nodes.groupBy("doc_id").agg(*held), "doc_id", "left").fillna(False)
    said = [F.when(~F.col(f"c{i}"), F.lit(f"{f} is missing" if t is None else f"{f}: {t} is missing")) for i, (f, t) in enumerate(asked)]
    said[2], said[3] = F.when(F.col("c0"), said[2]), F.when(F.col("c1"), said[3])
    rows = rows.select("doc_id", F.explode(F.array_compact(F.array(*said))).alias("said"))
    return finding(rows, "file_structure", "error", F.col("said"))


def first_findings(findings: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, text: the first k errors in order, and how many more there are."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("message"))
    errors = findings.where("severity = 'error'").withColumn("place", place)
    rows = errors.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("place") <= k, F.struct("place", "message")))).alias("few"), F.count("*").alias("n"))
    joined = F.array_join(F.transform("few", lambda x: x["message"]), "; ")
    more = F.when(F.col("n") > k, F.concat(F.lit(" ("), (F.col("n") - k).cast("string"), F.lit(" more)"))).otherwise("")
    return rows.select("doc_id", F.concat(joined, more).alias("text"))
