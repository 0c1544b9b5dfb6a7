"""What several results are made of is made once, and what is of no more use goes."""

import os

import pytest
from pyspark.sql import functions as F

from foliary import convert
from foliary.operators import books as elements
from foliary.plans import books, nested
from foliary.sources import packages, store, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture
def read(monkeypatch):
    """How often word-processor files are read."""
    made, first = [], packages.docx_parts
    monkeypatch.setattr(packages, "docx_parts", lambda *a, **k: made.append(a) or first(*a, **k))
    return made


def test_pictures_read_word_files_once(spark, read, monkeypatch):
    """files were read for each kind of book, a talking book unzipped for itself and for its e-book, and every element was made."""
    asked, first = [], packages.xml_nodes
    monkeypatch.setattr(packages, "xml_nodes", lambda entries, tags=None, columns=None: asked.append(tags) or first(entries, tags, columns))
    unzipped, unzip = [], packages.zip_entries
    monkeypatch.setattr(packages, "zip_entries", lambda *a: unzipped.append(a) or unzip(*a))
    nested.cell_pictures(spark, SF)
    assert len(read) == 1 and len(unzipped) == 4 and asked.count(None) == 1  # images of the files, and three kinds of books


def test_books_of_one_content(spark):
    """Books of content that is made already are those of their files."""
    files, book = nested._docx(spark, SF).where("doc_id < 12"), nested._book(spark, SF).where("doc_id < 12")
    content, of = convert.docx_content(files), lambda df: sorted((r.doc_id, bytes(r.content)) for r in df.collect())
    for made in (convert.word_to_talking_book, convert.word_to_ebook):
        assert of(made(files, book, content=content)) == of(made(files, book))


def test_deep_tables_read_word_files_once(spark, read):
    """files were read for each kind of book, and all elements of all columns were made and written."""
    made = len(store._made)
    nested.deep_tables(spark, SF)
    assert len(read) == 1 and len(store._made) - made < 8


def test_settled_tables_alone_stay(spark):
    """items, cells and books that archives were made of stayed on disk with their shuffle files."""
    made = len(store._made)
    entries = books._unzipped(spark, SF)
    assert len(store._made) == made + 1 and entries.count() > 1000


def test_shuffle_files_go_with_a_write(spark):
    """files of a shuffle stayed until the driver collected garbage."""
    store.written(spark.range(1000).repartition(3, "id"))
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    count = lambda: sum(f.endswith(".data") for d in dirs for _, _, names in os.walk(d) for f in names)
    before = count()
    store.written(spark.range(100_000).repartition(7, "id"))
    assert count() <= before and spark.conf.get(store._CLEANUP, "false") == "false"


def test_a_block_with_no_other_within_goes_through_no_shuffle(spark):
    """the text of every block was a row for each piece, grouped and joined to the block again."""
    xml = "<dtbook><book><bodymatter><level1><h1 id='h'>A</h1><p id='a'> x <em>y<pagenum>7</pagenum>z</em> w<p id='b'> v </p>u</p><p id='c'/>t</level1></bodymatter></book></dtbook>"
    nodes = packages.xml_nodes(spark.createDataFrame([(1, "dtbook.xml", xml.encode())], "doc_id long, path string, content binary"))
    targets, tags = nodes.where("tag in ('p', 'h1')"), ("p", "h1")
    of = lambda df: {r.node_id: r.text for r in df.collect()}
    found = of(elements.spoken(nodes, targets, tags))
    assert found == of(elements.texts(nodes, targets, tags)) and sorted(found.values()) == ["", "A", "v", "x y z w v u"]
    assert "Aggregate" not in elements.spoken(nodes, targets, tags).where("node_id = last_id")._jdf.queryExecution().optimizedPlan().toString()


def test_records_alone_equal_those_of_whole_books(spark, monkeypatch):
    """sections, tables and contents of e-books were made for their record and package."""
    entries = packages.zip_entries(writers.archives(books._daisy(spark, SF))).where("doc_id < 20")
    only = ("EPUB/zedai-mods.xml", "EPUB/package.opf")
    of = lambda df: {(r.doc_id, r.entry_ord, r.path): bytes(r.content) for r in df.collect()}
    whole = of(elements.epub_entries(entries))
    assert of(elements.epub_entries(entries, only=only)) == {k: v for k, v in whole.items() if k[2] in only}
    first, sections = elements._read, []
    monkeypatch.setattr(elements, "_read", lambda e, s: sections.append(s) or first(e, s))
    books.book_records(spark, SF)
    assert sections == [False]


def test_validation_keeps_what_rules_ask_for(spark, monkeypatch):
    """all elements of the books were written with all their columns."""
    tables, first = [], store.written
    monkeypatch.setattr(store, "written", lambda df: tables.append(df.columns) or first(df))
    assert books.daisy_validated(spark, SF).where("error_count > 0 or dangling > 0").count() == 0
    assert tables[-1] == ["doc_id", "file", "depth", "ns", "tag", "error", "id", "src"]
