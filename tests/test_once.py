"""What books are made of is made once, and files or rows that nobody asks for are not made at all."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliary import convert
from foliary.functions import text as T
from foliary.operators import tables
from foliary.plans import books
from foliary.sources import packages, writers

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_alone_equal_those_of_whole_books(spark):
    for made, names in ((books._daisy, ("dtbook.ncx", "dtbook.opf", "dtbook.smil", "dtbook.res")), (books._epub, ("EPUB/nav.xhtml", "EPUB/package.opf"))):
        whole = {(r.doc_id, r.path): bytes(r.content) for r in made(spark, SF).where("doc_id < 20").collect()}
        for name in names:
            alone = {(r.doc_id, r.path): bytes(r.content) for r in made(spark, SF, name).where("doc_id < 20").collect()}
            assert alone == {k: v for k, v in whole.items() if k[1] == name}


def test_a_file_without_tables_renders_none(spark, monkeypatch):
    monkeypatch.setattr(tables, "rendered", lambda *a, **k: pytest.fail("tables are rendered"))
    assert books._daisy(spark, SF, "dtbook.ncx").count() == books._epub(spark, SF, "EPUB/package.opf").count() == 200


def test_items_are_made_once(spark):
    """Items were made anew for texts, tables and images; now they are read."""
    assert "phase" not in plan(books._daisy(spark, SF, "dtbook.xml"))
    assert "phase" not in plan(books._epub(spark, SF))


def test_only_tables_and_images_are_joined(spark):
    items = books.content_items_sorted(spark, SF)
    rows = writers._with_parts(items, books._cells(spark, SF), books._images(items), None, None)
    assert rows.count() == items.count()
    found = rows.groupBy("type").agg(F.count("html").alias("h"), F.count_if(F.col("ext") == "png").alias("png"), F.count("*").alias("n")).collect()
    for r in found:
        assert (r.h == r.n) == (r.type == "table") and (r.png > 0) == (r.type == "image")


def test_images_of_word_files_are_unzipped_once(spark):
    content = convert.docx_content(books._docx(spark, SF).where("doc_id < 20"))
    assert all("MapInArrow" not in plan(df) for df in content.values())
    assert content["images"].count() > 0


def test_rows_of_tags_and_kinds_alone(spark):
    xml = b"<a><b id='1'>x<c/>y</b><b/><d><b/></d></a>"
    entries = spark.createDataFrame([(1, "a.xml", xml), (2, "b.xml", b"<")], "doc_id long, path string, content binary")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(packages.xml_nodes(entries, ("b", "d"))) == rows(packages.xml_nodes(entries).where("tag in ('b', 'd') or error is not null"))
    files = books._docx(spark, SF).where("doc_id < 5")
    assert rows(packages.docx_parts(files, ("cell", "rel"))) == rows(packages.docx_parts(files).where("kind in ('cell', 'rel')"))
    assert rows(packages.zip_entries(files, "word/media/")) == rows(packages.zip_entries(files).where("path like 'word/media/%'"))


def test_archives_of_parts_that_are_dealt_by_document(spark):
    """Spark left out the repartition by doc_id above a union of such parts, and a document's entries came apart in two archives."""
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))
    text = docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("entry_ord", n).select("doc_id", "entry_ord", F.concat(F.lit("f"), F.col("k").cast("string")).alias("path"), F.repeat(F.lit("x"), 2_000).cast("binary").alias("content"))
    image = docs.where("doc_id % 2 = 0").withColumn("k", F.lit(9)).withColumn("entry_ord", n + 10).select("doc_id", "entry_ord", F.lit("i").alias("path"), F.lit(b"i").alias("content"))
    made = writers.archives(text.unionByName(image))
    assert made.count() == 3_000 == made.select("doc_id").distinct().count()
    by = "xxhash64(doc_id"
    assert by in plan(made)


def test_texts_are_stripped_and_cleaned_as_by_patterns_alone(spark):
    odd = ["", " ", "a", " a", "a ", "　a ", "\x1ca b\x1f", "a\n", "\na\r\n", "\u0085", "\U0001f600 ", "a \U0001f600", "x $#3 y", "$#1", "#p4 $note{n}", "$no$#1te{a}", "$note{a $#1 b}", "$#{", "$line{5}#", None]
    df = spark.createDataFrame([(x,) for x in odd], "x string")
    space, x = r"[\s\x1c-\x1f]", F.col("x")
    clean = x
    for kind, pattern in T.MARKERS.items():
        clean = F.regexp_replace(clean, pattern, "$1" if kind in T.KEPT_MARKERS else "")
    stripped = F.regexp_replace(x, rf"(?U)^{space}+|{space}+$", "")
    got = df.select(
        T.strip(x).eqNullSafe(stripped).alias("s"), T.is_blank(x).eqNullSafe(stripped == "").alias("b"), T.cleaned(x).eqNullSafe(clean).alias("c"),
        T.page_values(x).eqNullSafe(F.regexp_extract_all(x, F.lit(T.PAGE), F.lit(1))).alias("p"),
    ).collect()
    assert [o for o, r in zip(odd, got, strict=True) if not all(r)] == []


def test_packages_are_made_of_images_alone(spark, monkeypatch):
    """All items were made, ordered and collected for a package file, which lists images only."""
    monkeypatch.setattr(books, "content_items_sorted", lambda *a: pytest.fail("all items are made"))
    for made, name in ((books._daisy, "dtbook.opf"), (books._epub, "EPUB/package.opf")):
        assert made(spark, SF, name).count() == 200


def test_contents_are_made_of_headings_and_pages(spark, monkeypatch):
    """Texts of paragraphs and tables were made, ordered and collected for files that speak of headings and pages only."""
    monkeypatch.setattr(books, "content_items_sorted", lambda *a: pytest.fail("all items are made"))
    for made, name in ((books._daisy, "dtbook.ncx"), (books._epub, "EPUB/nav.xhtml")):
        assert made(spark, SF, name).count() == 200
    monkeypatch.undo()
    found = books._items(spark, SF, "dtbook.ncx")
    whole = books.content_items_sorted(spark, SF).where("type rlike '^h[1-6]$' or type = 'pagenum'")
    of = lambda df: sorted(map(str, df.select("doc_id", "elem_id", "type", "text", "para", "seg", "sub").collect()))
    assert of(found) == of(whole)


def test_items_of_navigation_are_made_once(spark, monkeypatch):
    """nav_join made all items a second time for their order."""
    made, first = [], books.content_items_sorted
    monkeypatch.setattr(books, "content_items_sorted", lambda *a: made.append(a) or first(*a))
    assert books.nav_join(spark, SF).count() > 0 and len(made) == 1


def test_rows_of_tables_have_as_many_parts_as_the_session(spark):
    """Rows of cells compress to almost nothing, so Spark put them together into few parts by their bytes."""
    kept = tables.rendered(books._cells(spark, SF))
    assert "RepartitionByExpression" in plan(kept) and "Join" not in plan(kept)
