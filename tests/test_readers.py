"""Readers and archives hand on the rows of many packages in one batch."""

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from foliary.sources import packages, writers


def raw(spark, n):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.xml", "<a><b c='1'>x</b>y</a>")
        z.writestr("d/e.bin", b"\x00\x01")
    return spark.range(n).coalesce(1).select(F.col("id").alias("doc_id"), F.lit(out.getvalue()).alias("content"))


def test_packages_share_batches(spark, monkeypatch):
    """300 packages: the code before gave 300 frames each of entries, of elements and of parts."""
    steps = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, f, schema: steps.append(f) or df)
    for step in (packages.zip_entries, packages.xml_nodes, packages.docx_parts):
        step(raw(spark, 0).withColumn("path", F.lit("a.xml")))
    content = raw(spark, 1).first().content
    given = pa.RecordBatch.from_pydict({"doc_id": range(100), "path": ["a.xml"] * 100, "content": [bytes(content)] * 100})
    xml = given.set_column(2, "content", pa.array([b"<a><b c='1'>x</b>y</a>"] * 100))
    made = [list(f([part] * 3)) for f, part in zip(steps, (given, xml, given), strict=True)]
    assert [(len(x), sum(b.num_rows for b in x)) for x in made] == [(1, 600), (1, 600), (1, 300)]


def test_large_packages_fill_several_batches(spark, monkeypatch):
    monkeypatch.setattr(packages, "_FULL", (50, 8 << 20))
    xml = ("<a>" + "<b>x</b>" * 500 + "</a>").encode()
    nodes = packages.xml_nodes(spark.createDataFrame([(1, "a.xml", xml), (None, "b.xml", None)], "doc_id long, path string, content binary"))
    rows = nodes.orderBy("file", "node_id").collect()
    assert [r.node_id for r in rows] == [*range(501), 0] and rows[0].last_id == 500 and rows[500].around == ["a"] and rows[500].ancestors == [0]
    assert rows[501].doc_id is None and rows[501].error


def test_archives_of_many_documents(spark):
    """Entries of a document lie in several partitions and out of order; a document without id has a package too."""
    rows = [(d, k, f"f{k}", f"{d} {k}".encode()) for k in (3, 1, 2) for d in [*range(40), None]]
    df = spark.createDataFrame(rows, "doc_id long, entry_ord int, path string, content binary").repartition(7)
    got = packages.zip_entries(writers.archives(df)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ord, r.path, bytes(r.content)) for r in got) == sorted((-1 if d is None else d, k - 1, p, c) for d, k, p, c in rows)


def test_elements_of_tags_are_those_of_a_whole_tree(spark, monkeypatch):
    """Elements not asked for were made into a tree and walked; now they are only counted. Odd documents: entities, comments, sections, prefixes, foreign encodings, defects."""
    odd = [
        b"<a><b>x<c/>y<!--z-->w</b>t&amp;u<b/><d xmlns='u:1' q='1'><b p:id='2' xmlns:p='u:2' id='3'><![CDATA[<k>]]><c>v</c>s</b>r</d></a>", b"<b> <b>1<b>2</b>3</b>4</b>\n",
        b"<!DOCTYPE a [<!ENTITY e 'xx'>]><a>&e;<b>&e;y&e;</b>&e;</a>", b"<!DOCTYPE a SYSTEM 'a.dtd'><a><b>&nbsp;</b></a>", b"<a><b>&nbsp;</b></a>", b"<a><b></a>", b"", b"<a/><b/>", None,
        "<?xml version='1.0' encoding='utf-16'?><a><b t='ä'>ü\r\nö</b></a>".encode("utf-16"), b"<a xml:lang='en'><b xml:lang='ko'>x<?pi y?>z</b></a>",
    ]
    entries = spark.createDataFrame([(i, "x.xml", x) for i, x in enumerate(odd)], "doc_id long, path string, content binary")
    rows = lambda df: sorted(map(str, df.collect()))
    whole = packages.xml_nodes(entries)
    assert rows(packages.xml_nodes(entries, ("b", "d"))) == rows(whole.where("tag in ('b', 'd') or error is not null"))
    few = packages.xml_nodes(entries, ("b",), ("tag", "doc_id", "text"))
    assert few.columns == ["doc_id", "tag", "text"] and rows(few) == rows(whole.where("tag = 'b' or error is not null").select("doc_id", "tag", "text"))
    monkeypatch.setattr(packages, "_walk", lambda root: 1 / 0)  # trees are not walked for a few tags
    step = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, f, schema: step.append(f) or df)
    packages.xml_nodes(entries, ("b",))
    given = pa.RecordBatch.from_pydict({"doc_id": [1], "path": ["a.xml"], "content": [odd[0]]})
    assert sum(b.num_rows for b in step[0]([given])) == 3


def test_a_word_file_is_read_for_what_is_asked(spark, monkeypatch):
    """Tables were read for paragraphs alone, paragraphs of the body for cells alone, and all columns were made for either."""
    from foliary.plans import books

    files = books._docx(spark, "/root/testdata/sf0.001").where("doc_id < 6").localCheckpoint()
    rows = lambda df: sorted(map(str, df.collect()))
    whole = packages.docx_parts(files).localCheckpoint()
    for kinds, columns in ((("block",), ("para_idx", "text")), (("cell",), ("row", "tc", "text", "path")), (("image", "rel"), ("kind", "rid"))):
        own = packages.docx_parts(files, kinds, columns)
        assert set(own.columns) == {"doc_id", *columns} and rows(own) == rows(whole.where(F.col("kind").isin(*kinds)).select(own.columns)) != []
    steps = []
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, f, schema: steps.append(f) or df)
    monkeypatch.setattr(packages, "_table", lambda *a: 1 / 0)
    packages.docx_parts(files, ("block",))
    given = pa.RecordBatch.from_pydict({"doc_id": [1], "content": [bytes(files.orderBy("doc_id").first().content)]})
    assert sum(b.num_rows for b in steps[0]([given])) > 0
