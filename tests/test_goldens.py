"""Hand-worked cases: markers, styles, words, pages, outline, merged cells, runs, escaping, validation, diff, jobs."""

import difflib

import pytest
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import blocks, diff, integrity, items, jobs, lookups, outline, runs, tables


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("x")).orderBy("i")
    return [r.x for r in rows.collect()]


def test_page_markers(spark):
    assert values(spark, ["$#11 #$3-1 #p8.1 #Piv-1", "#i"], T.page_values) == [["11", "3-1", "8.1", "iv-1"], []]


def test_marker_order_and_cleaning(spark):
    text = "a $#1 b $note{이것은 각주입니다.} c $#2 d $sidebar{이것은 사이드바 내용입니다.}"
    rows = blocks.markers(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("m").collect()
    assert [(r.type, r.value) for r in rows] == [("page", "1"), ("note", "이것은 각주입니다."), ("page", "2"), ("sidebar", "이것은 사이드바 내용입니다.")]
    assert values(spark, ["x $#3 y $note{n} z $line{5}", "$#11 $#1", "$note{a $#1 b}"], T.cleaned) == ["x  y n z ", " ", "a  b"]


def test_styles(spark):
    names = ["Heading 1", "heading1", "제목 2", "제목2", "Heading 2 + Bold", "Heading 10", "Heading 7", "Normal"]
    assert values(spark, names, T.heading_type) == ["h1", "h1", "h2", "h2", "h2", "p", "p", "p"]
    assert values(spark, names, T.heading_type_by_prefix) == ["h1", "p", "h2", "p", "h2", "h1", "p", "p"]


def test_words(spark):
    found = values(spark, ["Hello, world", "!!wow", "!!", "!", "a.b", "a<br/>b", "  "], T.words)
    assert found == [["Hello,", "world"], ["!!", "wow"], ["!", "!"], ["!"], ["a.b"], ["a", "b"], []]


def test_page_numbers(spark):
    assert values(spark, ["1", "3-12", "8.1", "iv", "iv-2"], T.page_number) == [1, 12, 8, None, 2]


def test_escaping(spark):
    assert values(spark, ["<b>a & \"b\"</b>'"], T.stripped_and_escaped) == ["a &amp; &quot;b&quot;&#x27;"]


def test_items(spark):
    rows = spark.createDataFrame([(1, 0, "Heading 1", "A"), (1, 1, "Normal", "b<br/>c $#2"), (1, 2, "Normal", "d")], "doc_id long, i long, style string, text string")
    body = spark.createDataFrame([(1, 0, "p"), (1, 1, "p"), (1, 2, "table"), (1, 3, "p")], "doc_id long, body_idx long, kind string")
    images = spark.createDataFrame([(1, 2, 0, "r1")], "doc_id long, para_idx long, run_idx long, rid string")
    out = items.content_items(items.image_items(images), items.paragraph_items(rows), items.table_items(items.table_anchors(body))).orderBy("sorted_no").collect()
    assert [(r.type, r.position, r.elem_id) for r in out] == [
        ("h1", 100, "p_4"), ("p", 1100, "p_5"), ("p", 1100, "p_6"), ("pagenum", 1150, "page_7"), ("p", 1200, "p_8"),
        ("image", 2000, "id_3"), ("p", 2100, "p_9"), ("table", 2500, "table_10"),
    ]


def test_marker_only_paragraph_keeps_an_empty_text(spark):
    rows = spark.createDataFrame([(1, 0, "Normal", "$#9")], "doc_id long, i long, style string, text string")
    assert sorted((r.type, r.text) for r in items.paragraph_items(rows).collect()) == [("p", ""), ("pagenum", "9")]


def test_outline(spark):
    heads = spark.createDataFrame([(1, i + 1, n) for i, n in enumerate([1, 3, 5, 2, 1, 3])], "doc_id long, ord long, level long")
    rows = outline.outline(heads).orderBy("ord").collect()
    assert [r.parent_ord for r in rows] == [None, 1, 2, 1, None, 5]
    assert [r.section_ord for r in rows] == [None, 1, 1, 1, None, 5]
    assert [r.play_order for r in rows] == [1, 2, 3, 4, 5, 6]
    assert outline.depth(heads).first().depth == 5
    assert [r.closes for r in outline.section_closes(heads).orderBy("ord").collect()] == [0, 0, 0, 2, 2, 0]


def test_merged_cells(spark):
    r, c = "restart", "continue"
    cells = [(1, 0, 0, 2, None), (1, 0, 1, 1, r), (1, 1, 0, 1, None), (1, 1, 1, 1, None), (1, 1, 2, 1, c), (1, 2, 0, 1, c), (1, 2, 1, 1, None), (1, 2, 2, 1, c)]
    found = tables.merged_spans(spark.createDataFrame(cells, "tbl long, row long, tc long, colspan long, v_state string"), ["tbl"])
    got = {(x.row, x.g): (x.rowspan, x.colspan, x.is_merged, x.is_merged_area) for x in found.collect()}
    one, area = (1, 1, False, False), (1, 1, False, True)
    assert got == {(0, 0): (1, 2, True, False), (0, 1): area, (0, 2): (3, 1, True, False), (1, 0): one, (1, 1): one, (1, 2): area, (2, 0): one, (2, 1): one, (2, 2): area}


def test_runs(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "a", "b", "a"])], "k long, i long, text string")
    assert [r.text for r in runs.without_repeats(rows, ["k"], "i").orderBy("i").collect()] == ["a", "b", "a"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["1. x", "2. y", "- z", "p", "3. w"])], "k long, i long, text string")
    assert [(r.kind, r.first, r.last) for r in runs.lists(rows, ["k"], "i").orderBy("first").collect()] == [("ol", 0, 1), ("ul", 2, 2), ("ol", 4, 4)]


def test_findings(spark):
    ids = spark.createDataFrame([(1, "p_1"), (2, "p_1")], "doc_id long, id string")
    refs = spark.createDataFrame([(1, "d#p_1"), (1, "d#p_1"), (1, "d#p_9"), (2, "d#p_9"), (2, "d#p_9")], "doc_id long, src string")
    lost = integrity.dangling_references(refs, ids)
    assert sorted((r.doc_id, r.message) for r in lost.collect()) == [(1, "no element for d#p_9"), (2, "no element for d#p_9"), (2, "no element for d#p_9")]
    docs = spark.createDataFrame([(i,) for i in range(1, 6)], "doc_id long")
    heads = spark.createDataFrame([(2, 2), (3, 1), (3, 1), (4, 1)], "doc_id long, level long")
    said = {r.doc_id: r.message for r in integrity.heading_rules(docs, heads).collect()}
    assert said == {1: "no heading", 2: "no level-1 heading", 3: "several level-1 headings", 5: "no heading"}
    errors = spark.createDataFrame([(1, "x", "error", f"e{i}") for i in range(5)] + [(2, "x", "warning", "w")], "doc_id long, category string, severity string, message string")
    assert integrity.first_findings(errors).collect()[0].text == "e0; e1; e2 (2 more)"
    assert {r.doc_id: r.is_valid for r in integrity.summary(docs, errors).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True}


def test_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    new = spark.createDataFrame([("b", "2"), ("c", "4"), ("d", "5")], "path string, content string")
    got = {r.path: r.status for r in diff.compare(diff.digests(old), diff.digests(new)).collect()}
    assert got == {"a": "removed", "b": "same", "c": "modified", "d": "added"}
    pairs = spark.createDataFrame([("p", "a\nb", "a\nc")], "path string, old string, new string")
    want = "\n".join(difflib.unified_diff(["a", "b"], ["a", "c"], "old/p", "new/p", lineterm=""))
    assert diff.unified(pairs).first().diff == want


@pytest.mark.parametrize(("ext", "mime"), [("jpg", "image/jpeg"), ("tif", "image/tiff"), ("webp", "image/webp"), ("xyz", "image/xyz")])
def test_mime(spark, ext, mime):
    assert values(spark, [ext], T.mime_type) == [mime]


def test_jobs(spark):
    assert values(spark, ["95", "100"], lambda x: jobs.remapped(x.cast("decimal(10,0)"))) == [48, 50]
    assert values(spark, ["m (경과: 3.0초)"], lambda x: T.with_elapsed(x, F.lit(2.5))) == ["m (경과: 2.5초)"]


def test_captions(spark):
    images = spark.createDataFrame([(1, 3, 0)], "doc_id long, para_idx long, run_idx long")
    paragraphs = spark.createDataFrame([(1, 1, "[그림 1]"), (1, 4, "[표 2]"), (1, 6, "[사진 9]"), (1, 3, "[other]")], "doc_id long, para_idx long, text string")
    assert lookups.nearest_caption(images, paragraphs).first().caption == "표 2"
