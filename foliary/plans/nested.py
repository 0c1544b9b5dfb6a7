"""Queries over word-processor files whose tables nest to several levels, with images and content controls in cells.

Each document becomes a file with two tables: the first nests 1 + doc_id % 5
levels deep, every cell holding a paragraph, the table of the next level, another
paragraph and an image in it; levels in turn stand in content controls, and in
controls of controls. The second has a merged cell, under which a cell with a
table is hidden, and one cell of mixed paragraphs, tables and controls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary import convert
from foliary.operators import books, lookups
from foliary.plans.books import _REL, _W, _book
from foliary.plans.queries import _read, query
from foliary.sources import packages, store, writers
from foliary.streaming import jobs

LEVELS = 5


def _id() -> Column:
    return F.col("doc_id").cast("string")


def _p(*text: str | Column, image: Column | str = "") -> Column:
    return F.concat(F.lit("<w:p><w:r><w:t>"), *(F.lit(t) if isinstance(t, str) else t for t in text), F.lit("</w:t></w:r>"), F.lit(image) if isinstance(image, str) else image, F.lit("</w:p>"))


def _control(x: Column) -> Column:
    return F.concat(F.lit("<w:sdt><w:sdtPr/><w:sdtContent>"), x, F.lit("</w:sdtContent></w:sdt>"))


def _picture(n: int) -> Column:
    return F.lit(f'<w:r><a:blip r:embed="rId{n}"/></w:r>')


def _nest(level: int) -> Column:
    """The table of a level, with those below it."""
    held = _p(_id(), f" above {level}")
    if level < LEVELS:
        inner = _nest(level + 1)
        wrapped = [inner, _control(inner), _control(_control(inner))][level % 3]
        held = F.concat(held, F.when(F.col("doc_id") % LEVELS + 1 > level, wrapped).otherwise(""))
    return F.concat(F.lit("<w:tbl><w:tr><w:tc><w:tcPr/>"), held, _p(_id(), f" below {level}", image=_picture(level)), F.lit("</w:tc></w:tr></w:tbl>"))


def _docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, content of the files."""
    small = lambda word, image="": F.concat(F.lit("<w:tbl><w:tr><w:tc>"), _p(_id(), word, image=image), F.lit("</w:tc></w:tr></w:tbl>"))
    merged = F.concat(
        F.lit('<w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr>'), _p("over"), F.lit("</w:tc><w:tc>"), _p("one"), small(" first"), _control(F.concat(_p("two"), small(" second"), _control(_p("three")))), _p("three"), _p("four"),
        F.lit("</w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>"), _p("under"), small(" hidden", _picture(7)), F.lit("</w:tc><w:tc>"), _p("", image=_picture(6)), _p("", image=_picture(7)), F.lit("</w:tc></w:tr>"),
    )
    body = F.concat(F.lit(f"<w:document {_W}><w:body>"), F.lit('<w:p><w:pPr><w:pStyle w:val="Heading 1"/></w:pPr><w:r><w:t>first</w:t></w:r></w:p>'), _nest(1), _p("between", image=_picture(8)), F.lit("<w:tbl>"), merged, F.lit("</w:tbl></w:body></w:document>"))
    rels = "".join(f'<Relationship Id="rId{n}" Type="{_REL}/image" Target="media/image{n}.{"png" if n % 2 else "gif"}"/>' for n in range(1, 9))
    docs = _read(spark, sf_dir, "documents").select("doc_id")
    media = [(f"word/media/image{n}.{'png' if n % 2 else 'gif'}", F.concat(F.lit(f"image {n} of "), _id())) for n in range(1, 9)]
    return store.written(writers.archives(writers._entries(docs, [("word/document.xml", body), ("word/_rels/document.xml.rels", F.lit(f"<Relationships>{rels}</Relationships>")), *media])))


# What the files hold, by rule: levels of the first table, and the cells of the second.
_LEVEL = f"SELECT doc_id, CAST(level AS BIGINT) AS level, 't1' || repeat('_cell_0_0_nested_0', level - 1) AS id, doc_id % {LEVELS} + 1 AS deepest FROM documents, range(1, {LEVELS + 1}) r(level) WHERE level <= doc_id % {LEVELS} + 1"
_MIXED = """(VALUES (1, 0, 't2_cell_0_0_p_0', 'over'), (2, 0, 't2_cell_0_1_p_0', 'one'), (3, 1, 't2_cell_0_1_nested_0_cell_0_0_p_0', ' first'), (4, 0, 't2_cell_0_1_p_1', 'two'), (5, 1, 't2_cell_0_1_nested_1_cell_0_0_p_0', ' second'),
  (6, 0, 't2_cell_0_1_p_2', 'three'), (7, 0, 't2_cell_0_1_p_3', 'four'), (8, 0, 't2_cell_1_1_p_0', '')) m(n, nested, id, word)"""
_PARAGRAPHS = f"""WITH lv AS ({_LEVEL}), p AS (SELECT doc_id, level AS place, id || '_cell_0_0_p_0' AS id, CAST(doc_id AS VARCHAR) || ' above ' || level AS text FROM lv
    UNION ALL SELECT doc_id, 100 - level, id || '_cell_0_0_p_1', CAST(doc_id AS VARCHAR) || ' below ' || level FROM lv
    UNION ALL SELECT doc_id, 100 + n, id, CASE WHEN nested = 1 THEN CAST(doc_id AS VARCHAR) ELSE '' END || word FROM documents, {_MIXED})"""


@query(f"""{_PARAGRAPHS}, d AS (SELECT doc_id, 'table_' || id AS id, text, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS k FROM p)
  SELECT 'book' AS kind, * FROM d UNION ALL SELECT 'e-book', * FROM d
  UNION ALL SELECT 'order', doc_id, 'dtbook.xml#table_' || id, NULL, row_number() OVER (PARTITION BY doc_id ORDER BY place) FROM p WHERE text <> ''""")
def deep_tables(spark, sf_dir):
    """Paragraphs of tables of any depth read back from talking book, reading order and e-book, in their order."""
    word, book = _docx(spark, sf_dir), _book(spark, sf_dir)
    content, parts = convert.docx_content(word), []
    for kind, made, prefix, files in (("book", convert.word_to_talking_book(word, book, content=content), "dtbook.", "path in ('dtbook.xml', 'dtbook.smil')"), ("e-book", convert.word_to_ebook(word, book, content=content), "EPUB/content", "path = 'EPUB/content.xhtml'")):
        nodes = packages.xml_nodes(packages.zip_entries(made, prefix).where(files), ("p", "text"), ("doc_id", "file", "node_id", "tag", "attrs", "text"))
        is_said, of = F.col("tag") == "p", lambda a: F.col("attrs")[a]
        asked = is_said & of("id").like("table%")
        if kind == "book":  # paragraphs and reading order in one pass
            asked = asked | (F.col("tag") == "text") & of("src").like("%#table%")
        parts.append(nodes.where(asked).select(
            "doc_id", "file", "node_id", F.when(is_said, kind).otherwise("order").alias("kind"), F.when(is_said, of("id")).otherwise(of("src")).alias("id"), F.when(is_said, F.coalesce("text", F.lit(""))).alias("text"),
        ))
    rows = parts[0].unionByName(parts[1])
    k = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("file", "node_id")).cast("long")
    return rows.select("kind", "doc_id", "id", "text", k.alias("k"))


_PICTURES = f"""WITH lv AS ({_LEVEL}), i AS (SELECT doc_id, 'table_' || id || '_cell_0_0_img_0' AS name, CAST(level AS BIGINT) AS n FROM lv UNION ALL SELECT doc_id, 'table_t2_cell_1_1_img_' || CAST(k AS VARCHAR), 6 + k FROM documents, range(2) r(k)
    UNION ALL SELECT doc_id, 'id_3', 8 FROM documents), f AS (SELECT doc_id, name || CASE WHEN n % 2 = 1 THEN '.png' ELSE '.gif' END AS name, sha256('image ' || n || ' of ' || CAST(doc_id AS VARCHAR)) AS sha256, CASE WHEN n % 2 = 1 THEN 'image/png' ELSE 'image/gif' END AS type FROM i)"""


@query(f"""{_PICTURES}, p AS (SELECT 'book' AS kind, '' AS folder, '' AS base UNION ALL SELECT 'e-book', 'EPUB/images/', 'images/' UNION ALL SELECT 'e-book of book', 'EPUB/images/', 'images/')
  SELECT kind, doc_id, 'entry' AS place, folder || name AS path, sha256 AS value FROM f, p UNION ALL SELECT kind, doc_id, 'manifest', base || name, type FROM f, p UNION ALL SELECT kind, doc_id, 'shown', base || name, NULL FROM f, p""")
def cell_pictures(spark, sf_dir):
    """Images of cells to any depth: in archives, in manifests and in contents; those of hidden cells are in none."""
    word, book = _docx(spark, sf_dir), _book(spark, sf_dir)
    content, parts = convert.docx_content(word), []
    talking = store.written(packages.zip_entries(convert.word_to_talking_book(word, book, content=content)))  # an e-book is made of it, too
    again = writers.archives(books.epub_entries(talking))
    for kind, made, package in (("book", None, "dtbook.opf"), ("e-book", convert.word_to_ebook(word, book, content=content), "EPUB/package.opf"), ("e-book of book", again, "EPUB/package.opf")):
        entries = talking if made is None else store.written(packages.zip_entries(made))  # read for files and for elements
        files = entries.where("path rlike '[.](png|gif)$'").select("doc_id", F.lit("entry").alias("place"), "path", F.sha2("content", 256).alias("value"))
        nodes = packages.xml_nodes(entries.where((F.col("path") == package) | F.col("path").rlike("dtbook.xml$|[.]xhtml$")), ("item", "img"), ("doc_id", "tag", "attrs"))
        listed, of = F.col("tag") == "item", lambda a: F.col("attrs")[a]
        told = nodes.where((F.col("tag") == "img") | listed & of("media-type").like("image/%")).select(
            "doc_id", F.when(listed, "manifest").otherwise("shown").alias("place"), F.when(listed, of("href")).otherwise(of("src")).alias("path"), F.when(listed, of("media-type")).alias("value")
        )
        parts.append(files.unionByName(told).withColumn("kind", F.lit(kind)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "doc_id", "place", "path", "value")


_HELD = """(VALUES ('t2', 0, 0, 0, 'p', 'over'), ('t2', 0, 1, 0, 'p', 'one'), ('t2', 0, 1, 1, 'table', 't2_cell_0_1_nested_0'), ('t2', 0, 1, 2, 'p', 'two'), ('t2', 0, 1, 3, 'table', 't2_cell_0_1_nested_1'), ('t2', 0, 1, 4, 'p', 'three'), ('t2', 0, 1, 6, 'p', 'four'),
  ('t2', 1, 0, 0, 'p', 'under'), ('t2', 1, 0, 1, 'table', 't2_cell_1_0_nested_0'), ('t2', 1, 1, 0, 'p', ''), ('t2_cell_0_1_nested_0', 0, 0, 0, 'p', '* first'), ('t2_cell_0_1_nested_1', 0, 0, 0, 'p', '* second'), ('t2_cell_1_0_nested_0', 0, 0, 0, 'p', '* hidden')) h(base, row, tc, seq, kind, text)"""


@query(f"""WITH lv AS ({_LEVEL}) SELECT doc_id, id AS base, CAST(0 AS BIGINT) AS row, CAST(0 AS BIGINT) AS tc, CAST(0 AS BIGINT) AS seq, 'p' AS kind, CAST(doc_id AS VARCHAR) || ' above ' || level AS text FROM lv
  UNION ALL SELECT doc_id, id, 0, 0, 1, 'table', id || '_cell_0_0_nested_0' FROM lv WHERE level < deepest UNION ALL SELECT doc_id, id, 0, 0, CASE WHEN level < deepest THEN 2 ELSE 1 END, 'p', CAST(doc_id AS VARCHAR) || ' below ' || level FROM lv
  UNION ALL SELECT doc_id, base, row, tc, seq, kind, replace(h.text, '*', CAST(doc_id AS VARCHAR)) FROM documents, {_HELD}""")
def cell_contents(spark, sf_dir):
    """What cells hold in its order: paragraphs and tables, content controls opened at every level."""
    rows = packages.docx_parts(_docx(spark, sf_dir)).where("kind = 'content'")
    return rows.select("doc_id", "base", "row", "tc", "seq", F.col("style").alias("kind"), "text")


@query(f"""WITH lv AS ({_LEVEL}) SELECT doc_id, 'rId' || level AS rid, 'cell' AS owner, CAST(doc_id AS VARCHAR) || ' above ' || level AS first FROM lv UNION ALL SELECT doc_id, rid, owner, replace(first, '*', CAST(doc_id AS VARCHAR)) FROM documents, (VALUES ('rId6', 'cell', NULL), ('rId7', 'cell', NULL), ('rId7', 'cell', '* hidden'), ('rId8', 'paragraph', 'between')) v(rid, owner, first)""")
def image_owners(spark, sf_dir):
    """The nearest cell, table or paragraph around each image by its path in the file's XML, and the first text there."""
    nodes = store.written(packages.xml_nodes(packages.zip_entries(_docx(spark, sf_dir)).where("path = 'word/document.xml'")))
    return lookups.image_owners(nodes).select("doc_id", "rid", "owner", "first")


@query("""WITH m AS (SELECT * FROM (VALUES (0, 'word/document.xml'), (1, 'word/_rels/document.xml.rels')) v(ord, path) UNION ALL SELECT n + 1, 'word/media/image' || n || CASE WHEN n % 2 = 1 THEN '.png' ELSE '.gif' END FROM range(1, 9) r(n))
  SELECT doc_id, CAST(ord AS BIGINT) AS ord, path, CASE WHEN ord > 1 THEN sha256('image ' || (ord - 1) || ' of ' || CAST(doc_id AS VARCHAR)) END AS sha256, way FROM documents, m, (VALUES ('batch'), ('stream')) w(way)""")
def packages_source(spark, sf_dir):
    """Files written as a data source with a commit, and read back by it entry by entry, in a batch and as a stream."""
    folder = store.new_folder(spark, "packages")
    writers.save(_docx(spark, sf_dir), folder, "docx")
    found = spark.read.format("packages").option("glob", "*.docx").load(folder).withColumn("way", F.lit("batch"))
    arriving = spark.readStream.format("packages").option("glob", "*.docx").load(folder).withColumn("way", F.lit("stream"))
    rows = found.unionByName(jobs.appended(arriving, store.new_folder(spark, "stream")))
    sha = F.when(F.col("ord") > 1, F.sha2("content", 256))
    return rows.select(F.regexp_extract("file", "([0-9]+)[.]docx$", 1).cast("long").alias("doc_id"), "ord", "path", sha.alias("sha256"), "way")
