"""Round trips of packages and the word-processor reader."""

import io
import zipfile

from foliary import convert
from foliary.operators import books, integrity, tables
from foliary.sources import packages, writers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def docx():
    p = lambda t, s="Normal", more="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r>{more}</w:p>'
    cell = lambda t, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{t}</w:tc>"
    nested = f"<w:tbl><w:tr>{cell(p('in'))}</w:tr></w:tbl>"
    rows = f"<w:tr>{cell(p('wide'), '<w:gridSpan w:val=\"2\"/>')}</w:tr><w:tr>{cell(p('x') + p('x') + p('y'), '<w:vMerge/>')}{cell(p('n') + nested)}</w:tr>"
    body = p("Title", "Heading 1") + f"<w:tbl>{rows}</w:tbl>" + p("end", more='<w:r><a:blip r:embed="rId5"/></w:r>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId5" Type="http://x/image" Target="media/a.png"/></Relationships>')
    return out.getvalue()


def test_docx(spark):
    df = spark.createDataFrame([(1, docx()), (2, b"broken")], "doc_id long, content binary")
    rows = packages.docx_parts(df).collect()
    assert [(r.body_idx, r.para_idx, r.style, r.text) for r in rows if r.kind == "block"] == [(0, 0, "Heading 1", "Title"), (2, 1, "Normal", "end")]
    assert [(r.para_idx, r.run_idx, r.rid) for r in rows if r.kind == "image"] == [(1, 1, "rId5")]
    assert [r.target for r in rows if r.kind == "rel"] == ["media/a.png"]
    cells = sorted((r.table_id, r.parent_table, r.row, r.tc, r.colspan, r.v_state or "", r.text) for r in rows if r.kind == "cell" and r.parent_table is None)
    assert cells == [(0, None, 0, 0, 2, "", "wide"), (0, None, 1, 0, 1, "continue", "x y"), (0, None, 1, 1, 1, "", "n")]
    assert [(r.table_id, r.parent_table, r.text) for r in rows if r.kind == "cell" and r.parent_table is not None] == [(1, 0, "in")]
    assert [r.doc_id for r in rows if r.kind == "error"] == [2]


def test_daisy_round_trip(spark, tmp_path):
    book = spark.createDataFrame([(1, "T & <t>", "a", "p", "ko", None)], "doc_id long, title string, author string, publisher string, language string, isbn string")
    rows = [(1, "p_4", "h1", "A", 1), (1, "page_5", "pagenum", "2", 2), (1, "p_6", "p", "b < c", 3), (1, "p_7", "h2", "B", 4)]
    items = spark.createDataFrame(rows, "doc_id long, elem_id string, type string, text string, sorted_no long")
    archives = writers.archives(writers.daisy_entries(book, items))
    entries = packages.zip_entries(archives)
    nodes = packages.xml_nodes(entries)
    found = integrity.union(integrity.required_files(book.select("doc_id"), entries), integrity.xml_structure(nodes))
    assert found.count() == 0
    points = nodes.where("tag in ('navPoint', 'pageTarget')").selectExpr("tag", "attrs['playOrder'] o").collect()
    assert sorted((r.o, r.tag) for r in points) == [("1", "navPoint"), ("2", "navPoint"), ("3", "pageTarget")]
    assert nodes.where("file = 'dtbook.xml' and attrs['id'] = 'p_6'").first().text == "b < c"
    saved = writers.save(archives, str(tmp_path / "out"), "zip").collect()
    assert packages.files(spark, str(tmp_path / "out"), "*.zip").count() == len(saved) == 1


def test_epub_stores_its_type_first(spark):
    book = spark.createDataFrame([(1, "T", "a", "p", "ko", "978")], "doc_id long, title string, author string, publisher string, language string, isbn string")
    items = spark.createDataFrame([(1, "p_1", "h1", "A", 1)], "doc_id long, elem_id string, type string, text string, sorted_no long")
    with zipfile.ZipFile(io.BytesIO(bytes(writers.archives(writers.epub_entries(book, items)).first().content))) as z:
        first = z.infolist()[0]
        assert (first.filename, first.compress_type) == ("mimetype", zipfile.ZIP_STORED)
        assert set(integrity.EPUB_REQUIRED) <= set(z.namelist())


def test_structure_errors(spark):
    df = spark.createDataFrame([(1, "dtbook.ncx", b"<ncx/>"), (1, "dtbook.xml", b"<a>")], "doc_id long, path string, content binary")
    said = {r.message for r in integrity.xml_structure(packages.xml_nodes(df)).collect()}
    assert said == {"dtbook.ncx: the root is not ncx", "dtbook.ncx: head is missing", "dtbook.ncx: navMap is missing", "dtbook.xml is not well-formed"}


def test_cells_of_nested_tables_are_merged_like_others(spark):
    cells = packages.docx_parts(spark.createDataFrame([(1, docx())], "doc_id long, content binary")).where("kind = 'cell'")
    spans = tables.merged_spans(cells, ["doc_id", "table_id"]).where("not is_merged_area").collect()
    assert sorted((r.table_id, r.row, r.g, r.rowspan, r.colspan) for r in spans) == [(0, 0, 0, 1, 2), (0, 1, 0, 1, 1), (0, 1, 1, 1, 1), (1, 0, 0, 1, 1)]


def test_text_of_nested_elements(spark):
    xml = b"<dtbook><book><bodymatter><level1 id='l'><p id='a'> one <em>two <w>three</w></em> four<br/>five<pagenum>9</pagenum> six<imggroup><caption>no</caption></imggroup></p> seven</level1></bodymatter></book></dtbook>"
    nodes = packages.xml_nodes(spark.createDataFrame([(1, "dtbook.xml", xml)], "doc_id long, path string, content binary"))
    targets = nodes.where("attrs['id'] is not null or tag = 'pagenum'")
    got = {r.tag: r.text for r in books.texts(nodes, targets).join(targets.select("node_id", "tag"), "node_id").collect()}
    assert got == {"p": "one two three four five six", "level1": "one two three four five six seven", "pagenum": "9"}


def test_navigation_shows_the_next_level_only(spark):
    def point(i, level, inner=""):
        return f"<navPoint id='n{i}' class='level{level}'><navLabel><text>t{i}</text></navLabel><content src='dtbook.smil#smil_par_p{i}'/>{inner}</navPoint>"

    ncx = f"<ncx><navMap>{point(1, 1, point(2, 2, point(3, 4)) + point(4, 3, point(5, 4)))}{point(6, 2)}{point(7, 1)}{point(8, 1)}</navMap></ncx>"
    book = "<dtbook><book><bodymatter>" + "".join(f"<level1><h1 id='p{i}'>t</h1></level1>" for i in range(1, 8)) + "</bodymatter></book></dtbook>"
    nodes = packages.xml_nodes(spark.createDataFrame([(1, "dtbook.ncx", ncx.encode()), (1, "dtbook.xml", book.encode())], "doc_id long, path string, content binary"))
    points = books.nav_points(nodes)
    files = books.content_files(books.nav_elements(points, nodes))
    assert sorted((r.nav_id, r.filename) for r in files.collect()) == [("n1", "dtbook-2.xhtml"), ("n7", "dtbook-3.xhtml")]
    assert sorted((r.nav_id, r.level, r.filename) for r in books.nav_tree(points, files).collect()) == [("n1", 1, "dtbook-2.xhtml"), ("n2", 2, "dtbook-2.xhtml"), ("n7", 1, "dtbook-3.xhtml")]


def test_written_books_are_well_formed(spark):
    book = spark.createDataFrame([(1, "T", "", None, "ko", ""), (2, "empty", "a", "p", "en", "9")], "doc_id long, title string, author string, publisher string, language string, isbn string")
    rows = [(1, f"p_{i}", k, "x\x01 & y", 0, i) for i, k in enumerate(["p", "h3", "h2", "h4", "h1", "h6", "h2"], 1)]
    items = spark.createDataFrame(rows, "doc_id long, elem_id string, type string, text string, seg long, sorted_no long")
    for made in (writers.daisy_entries(book, items), writers.epub_entries(book, items)):
        nodes = packages.xml_nodes(made.where("path <> 'mimetype' and path not like '%.css'").select("doc_id", "path", "content"))
        assert nodes.where("error is not null").count() == 0 and nodes.where("file in ('dtbook.xml', 'EPUB/content.xhtml')").select("doc_id").distinct().count() == 2


def test_folders_are_compared(spark, tmp_path):
    for name, files in {"old": {"a.txt": b"1\n2", "b.bin": b"0\n\x00", "c.txt": b"same", "x.log": b"1"}, "new": {"a.txt": b"1\n3", "b.bin": b"0\n\x00\x01", "c.txt": b"same", "d/e.txt": b"new", "x.log": b"2"}}.items():
        for path, content in files.items():
            (tmp_path / name / path).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name / path).write_bytes(content)
    rows = {r.path: (r.status, bool(r.diff)) for r in convert.folder_diff(spark, str(tmp_path / "old"), str(tmp_path / "new"), ("*.log",)).collect()}
    assert rows == {"a.txt": ("modified", True), "b.bin": ("modified", False), "c.txt": ("same", False), "d/e.txt": ("added", False)}


def test_unreadable_files_give_books_without_content(spark):
    book = spark.createDataFrame([(1, "T", "a", "p", "ko", "1")], "doc_id long, title string, author string, publisher string, language string, isbn string")
    entries = packages.zip_entries(convert.word_to_talking_book(spark.createDataFrame([(1, b"broken")], "doc_id long, content binary"), book))
    assert integrity.xml_structure(packages.xml_nodes(entries.where("path <> 'dtbook.res'"))).count() == 0 and entries.count() == 5
