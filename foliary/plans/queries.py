"""Queries over the driver's tables: each operator on data that stands for what it works on, and the same in DuckDB SQL.

Markers, styles and breaks are put into documents' lines by a fixed recipe, as
the tables have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import blocks, diff, integrity, items, jobs, lookups, outline, runs, scan, tables

#: The recipe, the same text in both dialects; i is the line's number from 0.
BROKEN = "CASE WHEN i % 4 = 1 AND instr(line, ', ') > 0 THEN substr(line, 1, instr(line, ', ') - 1) || '<br/>' || substr(line, instr(line, ', ') + 2) ELSE line END"
STYLE = "CASE WHEN i = 0 THEN 'Heading 1' WHEN i % 11 = 0 THEN 'Heading 10' WHEN i % 7 = 0 THEN 'heading2' WHEN i % 5 = 0 THEN '제목 3' ELSE 'Normal' END"
_N = "CAST(i + 1 AS VARCHAR(20))"
_I = "CAST(i AS VARCHAR(20))"
MARKED = (
    f"(CASE WHEN i % 9 = 8 THEN '' ELSE {BROKEN} END) || CASE (doc_id + i) % 12 "
    f"WHEN 0 THEN ' $#' || {_N} WHEN 1 THEN ' $note{{n' || {_I} || '}}' WHEN 2 THEN ' #p' || {_N} || '-2' WHEN 3 THEN ' #$iv' WHEN 4 THEN ' #P8.1' "
    f"WHEN 5 THEN ' $sidebar{{s' || {_I} || '}}' WHEN 6 THEN ' $annotation{{a' || {_I} || '}}' WHEN 7 THEN ' $line{{' || {_I} || '}}' "
    f"WHEN 8 THEN ' $noteref{{' || {_I} || '}}' WHEN 9 THEN ' $prodnote{{d' || {_I} || '}}' ELSE '' END"
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"there are two queries of the name {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, i, style, text."""
    rows = blocks.lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "i", F.expr(STYLE).alias("style"), F.expr(MARKED).alias("text"))


_LINES = """WITH lines AS (
  SELECT doc_id, CAST(i - 1 AS BIGINT) AS i, parts[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"""
_BLOCKS = f"""{_LINES}, blk AS (SELECT doc_id, i, {STYLE} AS style, {MARKED} AS text FROM lines)"""
_BR = "'(?i)<(?:br|hs)\\s*/?>'"
_SEGS = f"""{_BLOCKS}, seg AS (
  SELECT doc_id, i, style, CAST(k - 1 AS BIGINT) AS seg, parts[k] AS segment
  FROM (SELECT doc_id, i, style, string_split_regex(text, {_BR}) AS parts, unnest(range(1, len(string_split_regex(text, {_BR})) + 1)) AS k FROM blk))"""
_TYPE = """CASE WHEN regexp_extract(lower(style), '(?:heading|제목)\\s*([1-6])\\b', 1) <> '' THEN 'h' || regexp_extract(lower(style), '(?:heading|제목)\\s*([1-6])\\b', 1) ELSE 'p' END"""
_PAGE = "'" + T.PAGE + "'"


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = T.heading_type(F.col("style"))
    return _blocks(spark, sf_dir).select("doc_id", (F.col("i") + 1).alias("ord"), T.heading_level(kind).alias("level")).where("level > 0")


_HEADS = f"""{_BLOCKS}, heads AS (SELECT doc_id, i + 1 AS ord, CAST(substr(kind, 2, 1) AS BIGINT) AS level
  FROM (SELECT *, {_TYPE} AS kind FROM blk) WHERE kind <> 'p')"""


@query(f"{_BLOCKS} SELECT doc_id, i, style, text FROM blk")
def doc_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(f"""{_SEGS} SELECT doc_id, i, style, seg, false AS is_blank, segment FROM seg WHERE trim(segment) <> ''
  UNION ALL SELECT doc_id, i, style, seg, true, '' FROM seg WHERE seg > 0""")
def br_segments(spark, sf_dir):
    return blocks.segments(_blocks(spark, sf_dir))


@query(f"{_BLOCKS} SELECT {_TYPE} AS type, style, count(*) AS n FROM blk GROUP BY ALL")
def style_levels(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy(T.heading_type(F.col("style")).alias("type"), "style").agg(F.count("*").alias("n"))


_EPUB_TYPE = "CASE " + " ".join(f"WHEN starts_with(lower(style), 'heading {n}') OR lower(style) = '제목 {n}' THEN 'h{n}'" for n in range(1, 7)) + " ELSE 'p' END"


@query(f"{_BLOCKS} SELECT {_EPUB_TYPE} AS type, style, count(*) AS n FROM blk GROUP BY ALL")
def style_levels_epub(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy(T.heading_type_by_prefix(F.col("style")).alias("type"), "style").agg(F.count("*").alias("n"))


_MARKS = " UNION ALL ".join(f"SELECT doc_id, i, '{k}' AS type, unnest(regexp_extract_all(text, '{p}', 1)) AS value, unnest(regexp_extract_all(text, '{p}', 0)) AS original FROM blk" for k, p in T.MARKERS.items())


#: A second marker after the first on every third line, so that places decide their order.
_TWICE = "CASE WHEN i % 3 = 0 THEN text || ' $line{99} and $#77' ELSE text END"


@query(f"""{_BLOCKS.replace("AS text FROM lines", "AS text0 FROM lines").replace("blk AS (", "blk0 AS (")}, blk AS (SELECT doc_id, i, {_TWICE.replace("text", "text0")} AS text FROM blk0)
  SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, i ORDER BY instr(text, original), type, original) AS m, type, value, original FROM ({_MARKS.replace("SELECT doc_id, i,", "SELECT doc_id, i, text,")})""")
def markers_all(spark, sf_dir):
    return blocks.markers(_blocks(spark, sf_dir).drop("style").withColumn("text", F.expr(_TWICE)))


@query(f"{_SEGS} SELECT doc_id, i, seg, unnest(regexp_extract_all(segment, {_PAGE}, 1)) AS value FROM seg WHERE trim(segment) <> ''")
def markers_page(spark, sf_dir):
    parts = blocks.segments(_blocks(spark, sf_dir)).where("not is_blank")
    return parts.select("doc_id", "i", "seg", F.explode(T.page_values(F.col("segment"))).alias("value"))


_CLEAN = "text"
for _k, _p in T.MARKERS.items():
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{chr(92) + '1' if _k in T.KEPT_MARKERS else ''}', 'g')"


@query(f"{_BLOCKS} SELECT doc_id, i, {_CLEAN} AS cleaned FROM blk")
def text_cleaned(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "i", T.cleaned(F.col("text")).alias("cleaned"))


_NUMBER = """TRY_CAST(CASE WHEN contains(value, '-') THEN regexp_extract_all(value, '(\\d+)', 1)[-1] WHEN contains(value, '.') THEN regexp_extract_all(value, '(\\d+)', 1)[1] ELSE value END AS BIGINT)"""


@query(f"""{_BLOCKS}, pages AS (SELECT doc_id, unnest(regexp_extract_all(text, {_PAGE}, 1)) AS value FROM blk)
  SELECT doc_id, coalesce(max({_NUMBER}), 0) AS max_page FROM pages GROUP BY doc_id""")
def page_numbers_max(spark, sf_dir):
    pages = _blocks(spark, sf_dir).select("doc_id", F.explode(T.page_values(F.col("text"))).alias("value"))
    return pages.groupBy("doc_id").agg(F.coalesce(F.max(T.page_number(F.col("value"))), F.lit(0)).cast("long").alias("max_page"))


@query(f"{_BLOCKS} SELECT doc_id, CAST(sum(len(regexp_extract_all(text, {_PAGE}, 1))) AS BIGINT) AS pages FROM blk GROUP BY doc_id")
def page_count(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.size(T.page_values(F.col("text")))).cast("long").alias("pages"))


@query(f"""{_HEADS}, pages AS (SELECT doc_id, i + 1 AS ord FROM blk WHERE len(regexp_extract_all(text, {_PAGE}, 1)) > 0),
  b AS (SELECT doc_id, 'heading' AS kind, 1 AS rank, ord FROM heads UNION ALL SELECT doc_id, 'page', 2, ord FROM pages)
  SELECT doc_id, kind, ord, row_number() OVER (PARTITION BY doc_id ORDER BY rank, ord) AS play_order FROM b""")
def page_targets(spark, sf_dir):
    pages = _blocks(spark, sf_dir).where(F.size(T.page_values(F.col("text"))) > 0).select("doc_id", (F.col("i") + 1).alias("ord"))
    return outline.play_order(_heads(spark, sf_dir), pages)


_WORDS = f"list_filter(string_split_regex(regexp_replace(text, {_BR}, ' ', 'g'), '\\s+'), lambda w: w <> '')"
_LEAD = f"'^([{T.PUNCTUATION}]+)(.+)$'"


@query(f"""{_BLOCKS} SELECT doc_id, i, array_to_string(flatten(list_transform({_WORDS}, lambda w: CASE WHEN regexp_matches(w, {_LEAD})
  THEN [regexp_extract(w, {_LEAD}, 1), regexp_extract(w, {_LEAD}, 2)] ELSE [w] END)), ' ') AS words FROM blk""")
def word_split(spark, sf_dir):
    return _blocks(spark, sf_dir).select("doc_id", "i", F.array_join(T.words(F.col("text")), " ").alias("words"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS text FROM pages""")
def html_stripped_escaped(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.stripped_and_escaped(F.col("html")).alias("text"))


@query(f"SELECT page_id, CAST(k - 1 AS BIGINT) AS seg, parts[k] AS segment FROM (SELECT page_id, string_split_regex(html, {_BR}) AS parts, unnest(range(1, len(string_split_regex(html, {_BR})) + 1)) AS k FROM pages)")
def page_breaks(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.posexplode(T.segments(F.col("html"))).alias("seg", "segment")).withColumn("seg", F.col("seg").cast("long"))


_SAFE = r"""left(regexp_replace(regexp_replace(p_type, '[<>:"/\\|?*]', '_', 'g'), '\s+', '_', 'g'), 50)"""


@query(f"SELECT p_partkey, translate(p_name, ' /\\:', '____') AS path_safe, CASE WHEN {_SAFE} = '' THEN 'untitled' ELSE {_SAFE} END AS file_safe, regexp_replace(p_brand, '[^\\p{{L}}\\p{{N}} _-]', '', 'g') AS kept FROM part")
def safe_names(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(
        "p_partkey", T.path_safe(F.col("p_name")).alias("path_safe"), T.file_safe(F.col("p_type")).alias("file_safe"), T.kept_characters(F.col("p_brand")).alias("kept")
    )


_EXT = "CASE CAST(p_partkey % 8 AS INT) WHEN 0 THEN 'jpg' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'gif' WHEN 4 THEN 'svg' WHEN 5 THEN 'tif' WHEN 6 THEN 'webp' ELSE 'xyz' END"
_MIME = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.MIME.items()) + " ELSE 'image/' || ext END"


@query(f"SELECT ext, {_MIME} AS mime, CASE WHEN ext IN ('jpg','jpeg','png','gif','svg') THEN {_MIME} END AS strict, count(*) AS n FROM (SELECT {_EXT} AS ext FROM part) GROUP BY ext")
def mime_types(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.expr(_EXT.replace("AS INT", "AS INT")).alias("ext")).groupBy("ext").agg(F.count("*").alias("n"))
    return rows.select("ext", T.mime_type(F.col("ext")).alias("mime"), T.strict_mime_type(F.col("ext")).alias("strict"), "n")


_ESC = """replace(replace(replace(replace(replace(regexp_replace(line, '<[^>]*>', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""
_BOLD = rf"regexp_replace(regexp_replace(regexp_replace({_ESC}, '\*\*(.*?)\*\*', '<strong>\1</strong>', 'g'), '\*(.*?)\*', '<em>\1</em>', 'g'), '([가-힣]+)\(([가-힣]+)\)', '<ruby>\1<rt>\2</rt></ruby>', 'g')"
_REST = rf"""regexp_replace(regexp_replace(regexp_replace(whole, '\^(\d+)', '<sup>\1</sup>', 'g'), '_(\d+)', '<sub>\1</sub>', 'g'), '(https?://[^\s<>"]+)', '<a href="\1" title="외부 링크: \1" target="_blank" rel="noopener noreferrer">\1</a>', 'g')"""
_TAGGED = "CASE (doc_id + i) % 7 WHEN 0 THEN line || ' x^2 y_3 http://a.example/b?c=1' WHEN 1 THEN '---' WHEN 2 THEN '    ' || line WHEN 3 THEN '한글(한자) **b** *i* & \"q\"' WHEN 4 THEN '```' || line ELSE line END"


@query(rf"""{_LINES}, t AS (SELECT doc_id, i, {_TAGGED} AS line FROM lines), e AS (SELECT doc_id, i, {_BOLD} AS whole FROM t)
  SELECT doc_id, i, CASE WHEN regexp_matches(trim(whole), '^[-_]{{3,}}$') THEN '<hr/>' WHEN regexp_matches(whole, '^(?:```|    )') THEN '<pre><code>' || whole || '</code></pre>' ELSE {_REST} END AS html FROM e""")
def inline_rewrite(spark, sf_dir):
    rows = blocks.lines(_read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("line", F.expr(_TAGGED))
    return rows.select("doc_id", "i", T.inline_markup(F.col("line")).alias("html"))


# Items: tables stand after every 6th line, images at every 8th.
def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).select("doc_id", "i")
    para = rows.select("doc_id", (F.col("i") * 2).alias("body_idx"), F.lit("p").alias("kind"))
    return para.unionByName(rows.where("i % 6 = 5").select("doc_id", (F.col("i") * 2 + 1).alias("body_idx"), F.lit("table").alias("kind")))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, para_idx, run_idx, rid."""
    rows = _blocks(spark, sf_dir).where("i % 8 = 3")
    return rows.select("doc_id", F.col("i").alias("para_idx"), (F.col("i") % 3).alias("run_idx"), F.concat(F.lit("rId"), F.col("i").cast("string")).alias("rid"))


_ITEMS = f"""{_SEGS}, body AS (SELECT * FROM seg WHERE trim(segment) <> ''),
  pg AS (SELECT doc_id, i, seg, unnest(range(1, len(regexp_extract_all(segment, {_PAGE}, 1)) + 1)) AS sub, regexp_extract_all(segment, {_PAGE}, 1) AS vals FROM body),
  item AS (
    SELECT doc_id, 0 AS phase, i AS para, i % 3 AS seg, 0 AS sub, 'image' AS type, '' AS text, i * 1000 + i % 3 AS position FROM blk WHERE i % 8 = 3
    UNION ALL SELECT doc_id, 1, i, seg, 0, 'p', '', i * 1000 + seg * 100 FROM seg WHERE seg > 0
    UNION ALL SELECT doc_id, 1, i, seg, sub, 'pagenum', vals[sub], i * 1000 + seg * 100 + 50 FROM pg
    UNION ALL SELECT doc_id, 1, i, seg, 1000, {_TYPE}, {_CLEAN.replace("(text,", "(segment,", 1)}, i * 1000 + seg * 100 + 100 FROM body
    UNION ALL SELECT doc_id, 2, i, row_number() OVER (PARTITION BY doc_id ORDER BY i), 0, 'table', '', (i + 1) * 1000 + 500 FROM blk WHERE i % 6 = 5),
  num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY phase, para, seg, sub) + 2 AS id_no FROM item)"""


@query(f"""{_ITEMS} SELECT doc_id, CAST(para AS BIGINT) AS para, CAST(seg AS BIGINT) AS seg, CAST(sub AS BIGINT) AS sub, type, text, CAST(position AS BIGINT) AS position, CAST(id_no AS BIGINT) AS id_no,
  (CASE type WHEN 'pagenum' THEN 'page_' WHEN 'image' THEN 'id_' WHEN 'table' THEN 'table_' ELSE 'p_' END) || CAST(id_no AS VARCHAR) AS elem_id,
  row_number() OVER (PARTITION BY doc_id ORDER BY position, CASE WHEN type = 'image' THEN seg ELSE 0 END, id_no) AS sorted_no FROM num""")
def content_items_sorted(spark, sf_dir):
    anchors = items.table_anchors(_bodies(spark, sf_dir))
    return items.content_items(items.image_items(_images(spark, sf_dir)), items.paragraph_items(_blocks(spark, sf_dir)), items.table_items(anchors))


@query(f"""{_ITEMS} SELECT doc_id, CAST(id_no AS BIGINT) AS id_no, row_number() OVER (PARTITION BY doc_id ORDER BY position, CASE WHEN type = 'image' THEN 1 ELSE 0 END, id_no) AS epub_no FROM num""")
def epub_items_sorted(spark, sf_dir):
    rows = content_items_sorted(spark, sf_dir)
    last = F.when(F.col("type") == "image", 1).otherwise(0)  # images come last within a position
    order = Window.partitionBy("doc_id").orderBy("position", last, "id_no")
    return rows.select("doc_id", "id_no", F.row_number().over(order).cast("long").alias("epub_no"))


_PARENT = "coalesce(" + ", ".join(f"CASE WHEN level = {k} THEN max(CASE WHEN level < {k} THEN ord END) OVER w END" for k in range(2, 7)) + ")"
_SECTION = "coalesce(" + ", ".join(
    f"CASE WHEN level = {k} THEN coalesce(CASE WHEN max(CASE WHEN level = {k - 1} THEN ord END) OVER w > coalesce(max(CASE WHEN level < {k - 1} THEN ord END) OVER w, 0) THEN max(CASE WHEN level = {k - 1} THEN ord END) OVER w END, max(CASE WHEN level = 1 THEN ord END) OVER w) END"
    for k in range(2, 7)
) + ")"
_W = "WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"{_HEADS} SELECT doc_id, ord, level, {_PARENT} AS parent_ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS play_order FROM heads {_W}")
def toc_parents(spark, sf_dir):
    return outline.outline(_heads(spark, sf_dir)).select("doc_id", "ord", "level", "parent_ord", "play_order")


_LONG = f"{_HEADS}, long AS (SELECT CASE WHEN doc_id % 10 = 0 THEN doc_id ELSE -1 END AS book, doc_id * 1000000 + ord AS ord, level FROM heads)"


@query(f"{_LONG} SELECT book, ord, level, {_PARENT} AS parent_ord, {_SECTION} AS section_ord, row_number() OVER (PARTITION BY book ORDER BY ord) AS play_order FROM long {_W.replace('doc_id', 'book')}")
def long_outline(spark, sf_dir):
    """Nine in ten documents bound into one book: its outline by ranges, in no one task."""
    book = F.when(F.col("doc_id") % 10 == 0, F.col("doc_id")).otherwise(-1).cast("long")
    heads = _heads(spark, sf_dir).select(book.alias("book"), (F.col("doc_id") * 1_000_000 + F.col("ord")).alias("ord"), "level")
    return outline.long_outline(heads, ["book"]).select("book", "ord", "level", "parent_ord", "section_ord", "play_order")


@query(f"{_HEADS} SELECT doc_id, ord, level, {_SECTION} AS section_ord, level > 1 AND {_SECTION} IS NULL AS needs_top FROM heads {_W}")
def dtbook_parents(spark, sf_dir):
    return outline.outline(_heads(spark, sf_dir)).select("doc_id", "ord", "level", "section_ord", "needs_top")


@query(f"{_HEADS} SELECT doc_id, least(greatest(coalesce(max(level), 0), 1), 6) AS depth FROM heads GROUP BY doc_id")
def toc_depth(spark, sf_dir):
    return outline.depth(_heads(spark, sf_dir))


@query(f"""{_HEADS}, par AS (SELECT doc_id, ord, level, {_PARENT} AS p FROM heads {_W}),
  d1 AS (SELECT a.*, b.p AS p2 FROM par a LEFT JOIN par b ON a.doc_id = b.doc_id AND a.p = b.ord),
  d2 AS (SELECT a.*, b.p AS p3 FROM d1 a LEFT JOIN par b ON a.doc_id = b.doc_id AND a.p2 = b.ord),
  d AS (SELECT doc_id, ord, level, p AS parent_ord, CAST(1 + (p IS NOT NULL)::INT + (p2 IS NOT NULL)::INT + (p3 IS NOT NULL)::INT AS BIGINT) AS open_depth FROM d2)
  SELECT *, coalesce(lag(open_depth) OVER (PARTITION BY doc_id ORDER BY ord), 0) - open_depth + 1 AS closes FROM d""")
def section_closes(spark, sf_dir):
    return outline.section_closes(_heads(spark, sf_dir))


@query(f"{_HEADS} SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) + 1 AS file_index, 'dtbook-' || CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) + 1 AS VARCHAR) || '.xhtml' AS filename FROM heads WHERE level = 1")
def content_docs(spark, sf_dir):
    return outline.content_files(_heads(spark, sf_dir))


@query("""WITH n AS (SELECT 1 AS level, r_name AS label, r_name AS path FROM region UNION ALL SELECT 2, n_name, r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 3, c_name, r_name || '/' || n_name || '/' || c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT CAST(level AS BIGINT) AS level, label, path, row_number() OVER (ORDER BY path) AS play_order FROM n""")
def outline_regions(spark, sf_dir):
    """A ready outline of three levels; its play order is global, so it counts along ranges of the whole path."""
    region, nation, customer = (_read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    two = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    three = customer.join(two, F.col("c_nationkey") == F.col("n_nationkey"))
    pick = lambda df, n, label, *path: df.select(F.lit(n).cast("long").alias("level"), F.col(label).alias("label"), F.concat_ws("/", *path).alias("path"))
    rows = pick(region, 1, "r_name", "r_name").unionByName(pick(two, 2, "n_name", "r_name", "n_name")).unionByName(pick(three, 3, "c_name", "r_name", "n_name", "c_name"))
    counted = scan.running(rows, [], ["path"], {"n": ("sum", F.lit(1))})
    return counted.select("level", "label", "path", (F.col("n") + 1).alias("play_order"))


# Tables: an order is a table; its lines are rows, each of up to three cells.
def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tbl"), F.col("l_linenumber").cast("long").alias("row")).agg(F.min("l_returnflag").alias("flag"), F.max("l_linestatus").alias("text"))
    rows = rows.withColumn("tc", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1) + F.col("row") % 2)))
    state = F.when((F.col("flag") == "R") & (F.col("tc") == 0), "restart").when((F.col("flag") == "A") & (F.col("tc") < 2), "continue")
    return rows.select("tbl", "row", "tc", (F.lit(1) + (F.col("row") + F.col("tc")) % 2).alias("colspan"), state.alias("v_state"), F.concat("text", F.col("tc").cast("string")).alias("text"))


_CELLS = """WITH base AS (SELECT l_orderkey AS tbl, CAST(l_linenumber AS BIGINT) AS row, min(l_returnflag) AS flag, max(l_linestatus) AS txt FROM lineitem GROUP BY ALL),
  cell AS (SELECT tbl, row, tc, 1 + (row + tc) % 2 AS colspan, CASE WHEN flag = 'R' AND tc = 0 THEN 'restart' WHEN flag = 'A' AND tc < 2 THEN 'continue' END AS v_state, txt || CAST(tc AS VARCHAR) AS text
    FROM (SELECT *, CAST(unnest(range(0, 2 + row % 2)) AS BIGINT) AS tc FROM base)),
  gs AS (SELECT *, CAST(coalesce(sum(colspan) OVER (PARTITION BY tbl, row ORDER BY tc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS grid_start FROM cell)"""
_SPANS = f"""{_CELLS}, grid AS (SELECT *, CAST(unnest(range(grid_start, grid_start + colspan)) AS BIGINT) AS g FROM gs),
  isl AS (SELECT *, sum(br) OVER (PARTITION BY tbl, g ORDER BY row) AS island FROM (SELECT *, CASE WHEN coalesce(v_state, '') <> 'continue' OR lag(row) OVER w IS NULL OR lag(row) OVER w <> row - 1 THEN 1 ELSE 0 END AS br FROM grid WINDOW w AS (PARTITION BY tbl, g ORDER BY row))),
  sz AS (SELECT *, count(*) OVER (PARTITION BY tbl, g, island) AS n FROM isl),
  sp AS (SELECT tbl, row, g, n, colspan FROM sz WHERE v_state = 'restart' AND g = grid_start),
  ar AS (SELECT sz.*, g <> grid_start OR EXISTS (SELECT 1 FROM sp WHERE sp.tbl = sz.tbl AND sz.row > sp.row AND sz.row < sp.row + sp.n AND sz.g >= sp.g AND sz.g < sp.g + sp.colspan) AS area FROM sz),
  res AS (SELECT tbl, row, g, CASE WHEN NOT area AND v_state = 'restart' THEN n ELSE 1 END AS rowspan, CASE WHEN NOT area THEN colspan ELSE 1 END AS colspan, area FROM ar)"""


@query(f"{_CELLS} SELECT tbl, row, tc, colspan, v_state, text, grid_start FROM gs")
def grid_prefix(spark, sf_dir):
    return tables.grid_starts(_cells(spark, sf_dir), ["tbl"])


@query(f"{_SPANS} SELECT tbl, row, g, rowspan, colspan, NOT area AND (rowspan > 1 OR colspan > 1) AS is_merged, area AS is_merged_area FROM res")
def merge_spans(spark, sf_dir):
    return tables.merged_spans(_cells(spark, sf_dir), ["tbl"])


@query(f"{_CELLS} SELECT tbl, tc, count(*) AS n_rows, string_agg(text, '|' ORDER BY row) AS texts FROM cell GROUP BY ALL")
def table_columns(spark, sf_dir):
    return tables.columns(_cells(spark, sf_dir), ["tbl"])


@query(f"{_CELLS} SELECT tbl, count(*) AS n_rows, CAST(max(width) AS BIGINT) AS n_columns FROM (SELECT tbl, row, sum(colspan) AS width FROM cell GROUP BY ALL) GROUP BY tbl")
def table_shapes(spark, sf_dir):
    return tables.shape(_cells(spark, sf_dir), ["tbl"])


@query(f"""{_SPANS}, wide AS (SELECT tbl, min(row) AS row, CAST(unnest(range(0, 6)) AS BIGINT) AS g FROM cell GROUP BY tbl)
  SELECT tbl, row, g, coalesce(rowspan, 1) AS rowspan, coalesce(colspan, 1) AS colspan, coalesce(NOT area AND (rowspan > 1 OR colspan > 1), false) AS is_merged FROM wide LEFT JOIN res USING (tbl, row, g)""")
def cell_lookup(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    wide = cells.groupBy("tbl").agg(F.min("row").alias("row")).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))))
    return tables.lookup(wide, tables.merged_spans(cells, ["tbl"]), ["tbl"]).drop("is_merged_area")


@query(f"{_LINES} SELECT doc_id, i * 2 + 1 AS body_idx, 'table' AS kind, i AS after_para, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS table_no FROM lines WHERE i % 6 = 5")
def table_position(spark, sf_dir):
    return items.table_anchors(_bodies(spark, sf_dir))


_TURNS = "CASE turn % 5 WHEN 0 THEN '1. a' WHEN 1 THEN '2. b' WHEN 2 THEN '- c' WHEN 3 THEN 'plain' ELSE '3. d' END"
_RUNS = """changed AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  run AS (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM changed)
  SELECT conv_id, kind, min(turn) AS first, max(turn) AS last, count(*) AS n FROM run WHERE kind IS NOT NULL GROUP BY conv_id, run, kind"""
_CONV = "SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY conv_id, turn"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))


@query(f"""WITH t AS (SELECT conv_id, turn, CASE WHEN regexp_matches(x, '^\\d+\\.\\s') THEN 'ol' WHEN regexp_matches(x, '^[-•*]\\s') THEN 'ul' END AS kind FROM (SELECT conv_id, turn, {_TURNS} AS x FROM ({_CONV}))), {_RUNS}""")
def list_runs(spark, sf_dir):
    return runs.lists(_turns(spark, sf_dir).withColumn("text", F.expr(_TURNS)), ["conv_id"], "turn")


@query(f"WITH t AS (SELECT conv_id, turn, role AS kind FROM ({_CONV})), {_RUNS}")
def role_runs(spark, sf_dir):
    return runs.islands(_turns(spark, sf_dir), ["conv_id"], "turn", F.col("role"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS ahead FROM events) WHERE ahead IS NULL OR ahead <> event_type")
def consecutive_dedupe(spark, sf_dir):
    return runs.without_repeats(_read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id", "event_type")


@query(f"{_LINES}, f AS (SELECT doc_id, i FROM lines WHERE i % 3 = 0) SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, '(각주' || CAST(i AS VARCHAR) || ')' AS note FROM f")
def footnote_numbers(spark, sf_dir):
    rows = blocks.lines(_read(spark, sf_dir, "documents").select("doc_id", "text")).where("i % 3 = 0")
    return runs.numbered_notes(rows.withColumn("text", F.concat("line", F.lit(" (각주"), F.col("i").cast("string"), F.lit(")"))), ["doc_id"], "i")


# Packages: ids are those of the documents' items, references point at them, with defects put in by rule.
def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir).select("doc_id", "i", F.concat(F.lit("p_"), F.col("i").cast("string")).alias("id"))


@query(f"""{_LINES}, refs AS (SELECT doc_id, 'dtbook.xml#p_' || CAST(CASE WHEN doc_id % 13 = 0 AND i % 5 = 0 THEN i + 1000 ELSE i END AS VARCHAR) AS src FROM lines)
  SELECT doc_id, 'content_integrity' AS category, 'warning' AS severity, 'no element for ' || src AS message FROM refs
  WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = refs.doc_id AND 'p_' || CAST(l.i AS VARCHAR) = string_split(src, '#')[2])""")
def dangling_refs(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    wrong = F.when((F.col("doc_id") % 13 == 0) & (F.col("i") % 5 == 0), F.col("i") + 1000).otherwise(F.col("i"))
    return integrity.dangling_references(ids.select("doc_id", F.concat(F.lit("dtbook.xml#p_"), wrong.cast("string")).alias("src")), ids)


@query(f"{_LINES} SELECT doc_id, 'content_integrity' AS category, 'warning' AS severity, 'id occurs ' || CAST(count(*) AS VARCHAR) || ' times: ' || id AS message FROM (SELECT doc_id, 'p_' || CAST(i % 40 AS VARCHAR) AS id FROM lines) GROUP BY doc_id, id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return integrity.duplicate_ids(_ids(spark, sf_dir).select("doc_id", F.concat(F.lit("p_"), (F.col("i") % 40).cast("string")).alias("id")))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required files of each document; every 7th lacks one, every 11th has an empty one."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = docs.select("doc_id", "n_chars", F.posexplode(F.array(*map(F.lit, integrity.REQUIRED))).alias("k", "path"))
    size = F.when((F.col("doc_id") % 11 == 0) & (F.col("k") == F.col("doc_id") % 5), 0).otherwise(F.col("n_chars"))
    return rows.where("not (doc_id % 7 = 0 and k = doc_id % 5)").select("doc_id", "path", size.cast("long").alias("size"))


_FILES = "VALUES " + ", ".join(f"({k}, '{p}')" for k, p in enumerate(integrity.REQUIRED))
_MISSING = f"""SELECT doc_id, 'file_structure' AS category, 'error' AS severity, 'required file ' || path || CASE WHEN doc_id % 7 = 0 THEN ' is missing' ELSE ' is empty' END AS message
  FROM documents, ({_FILES}) f(k, path) WHERE k = doc_id % 5 AND (doc_id % 7 = 0 OR doc_id % 11 = 0 OR n_chars = 0) OR k <> doc_id % 5 AND n_chars = 0"""


@query(_MISSING)
def missing_files(spark, sf_dir):
    return integrity.required_files(_read(spark, sf_dir, "documents").select("doc_id"), _entries(spark, sf_dir))


_HREF = "'images/image' || CAST(i AS VARCHAR(20)) || '.jpeg'"


@query(f"""{_LINES} SELECT doc_id, 'file_structure' AS category, 'error' AS severity, 'image ' || {_HREF} || CASE WHEN i % 16 = 3 THEN ' is missing' ELSE ' is empty' END AS message
  FROM lines WHERE i % 8 = 3 AND (i % 16 = 3 OR doc_id % 9 = 0)""")
def manifest_missing(spark, sf_dir):
    rows = _blocks(spark, sf_dir)
    manifest = rows.select("doc_id", F.expr(_HREF).alias("href"), F.when(F.col("i") % 8 == 3, "image/jpeg").otherwise("text/css").alias("media_type"))
    entries = rows.where("i % 16 <> 3").select("doc_id", F.expr(_HREF).alias("path"), F.when(F.col("doc_id") % 9 == 0, 0).otherwise(5).alias("size"))
    return integrity.manifest_images(manifest, entries)


@query("""SELECT doc_id, 'metadata_consistency' AS category, 'warning' AS severity, 'title differs' AS message FROM documents WHERE doc_id % 6 = 0 AND lang <> 'en'
  UNION ALL SELECT doc_id, 'metadata_consistency', 'warning', 'author differs' FROM documents WHERE doc_id % 10 = 3""")
def metadata_mismatch(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    book = docs.select("doc_id", F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("title"), F.col("source").alias("author"))
    package = docs.select("doc_id", F.when(F.col("doc_id") % 6 == 0, "other").otherwise(F.col("lang")).alias("title"), F.when(F.col("doc_id") % 10 == 3, F.concat("source", F.lit("x"))).otherwise(F.col("source")).alias("author"))
    return integrity.metadata_mismatch(book, package)


_COUNTED = f"""{_HEADS}, c AS (SELECT d.doc_id, count(h.ord) AS n, count(*) FILTER (WHERE h.level = 1) AS n1 FROM documents d
  LEFT JOIN (SELECT doc_id, ord, CASE WHEN doc_id % 4 = 0 THEN 2 WHEN ord > 8 THEN 1 ELSE level END AS level FROM heads WHERE doc_id % 5 <> 0) h ON d.doc_id = h.doc_id GROUP BY d.doc_id),
  hf AS (SELECT doc_id, 'accessibility' AS category, 'warning' AS severity, CASE WHEN n = 0 THEN 'no heading' WHEN n1 = 0 THEN 'no level-1 heading' ELSE 'several level-1 headings' END AS message FROM c WHERE n = 0 OR n1 <> 1)"""


@query(f"{_COUNTED} SELECT * FROM hf")
def heading_rules(spark, sf_dir):
    level = F.when(F.col("doc_id") % 4 == 0, 2).when(F.col("ord") > 8, 1).otherwise(F.col("level"))
    heads = _heads(spark, sf_dir).where("doc_id % 5 <> 0").withColumn("level", level)
    return integrity.heading_rules(_read(spark, sf_dir, "documents"), heads)


@query(f"{_LINES} SELECT doc_id, 'accessibility' AS category, 'warning' AS severity, 'no alternative text: ' || {_HREF} AS message FROM lines WHERE i % 8 = 3 AND (i + doc_id) % 3 < 2")
def alt_missing(spark, sf_dir):
    alt = F.when((F.col("i") + F.col("doc_id")) % 3 == 0, F.lit("  ")).when((F.col("i") + F.col("doc_id")) % 3 == 1, F.lit(None)).otherwise("x")
    return integrity.missing_alternatives(_blocks(spark, sf_dir).where("i % 8 = 3").select("doc_id", F.expr(_HREF).alias("src"), alt.alias("alt")))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.union(missing_files(spark, sf_dir), manifest_missing(spark, sf_dir), heading_rules(spark, sf_dir))


_MANIFEST = f"""SELECT doc_id, 'file_structure', 'error', 'image ' || {_HREF} || CASE WHEN i % 16 = 3 THEN ' is missing' ELSE ' is empty' END FROM lines WHERE i % 8 = 3 AND (i % 16 = 3 OR doc_id % 9 = 0)"""
_FINDINGS = f"{_COUNTED}, f AS (SELECT * FROM hf UNION ALL {_MISSING} UNION ALL {_MANIFEST})"


@query(f"""{_FINDINGS} SELECT d.doc_id, count(*) FILTER (WHERE severity = 'error') AS error_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count,
  count(*) FILTER (WHERE severity = 'error') = 0 AS is_valid FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id""")
def finding_summary(spark, sf_dir):
    return integrity.summary(_read(spark, sf_dir, "documents"), _findings(spark, sf_dir))


@query(f"""{_FINDINGS}, r AS (SELECT doc_id, message, row_number() OVER (PARTITION BY doc_id ORDER BY message) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM f WHERE severity = 'error')
  SELECT doc_id, string_agg(message, '; ' ORDER BY k) FILTER (WHERE k <= 3) || CASE WHEN max(n) > 3 THEN ' (' || CAST(max(n) - 3 AS VARCHAR) || ' more)' ELSE '' END AS text FROM r GROUP BY doc_id""")
def first_k_findings(spark, sf_dir):
    return integrity.first_findings(_findings(spark, sf_dir))


@query("SELECT doc_id, 'metadata' AS category, 'error' AS severity, 'title is mandatory' AS message FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'metadata', 'error', 'author is mandatory' FROM documents WHERE doc_id % 8 = 1")
def mandatory_metadata(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return integrity.mandatory_metadata(docs.select("doc_id", F.when(F.col("doc_id") % 3 != 0, "t").otherwise("  ").alias("title"), F.when(F.col("doc_id") % 8 != 1, "a").alias("author")))


# Images.
@query(f"{_LINES} SELECT doc_id, 'rId' || CAST(i AS VARCHAR) AS rid, i AS para_idx, i % 3 AS run_idx, i * 10 AS size FROM lines WHERE i % 8 = 3 AND i % 16 <> 3")
def image_parts(spark, sf_dir):
    parts = _blocks(spark, sf_dir).where("i % 16 <> 3").select("doc_id", F.concat(F.lit("rId"), F.col("i").cast("string")).alias("rid"), (F.col("i") * 10).alias("size"))
    return lookups.with_parts(_images(spark, sf_dir), parts)


@query(f"{_LINES} SELECT doc_id, 'rId' || CAST(i AS VARCHAR) AS rid, i AS para_idx, i % 3 AS run_idx, CASE WHEN i % 16 = 3 THEN 'jpeg' WHEN doc_id % 2 = 0 THEN 'png' ELSE 'gif' END AS ext FROM lines WHERE i % 8 = 3")
def image_ext_default(spark, sf_dir):
    target = F.concat(F.lit("media/a"), F.when(F.col("doc_id") % 2 == 0, ".PNG").otherwise(".gif"))
    rels = _blocks(spark, sf_dir).where("i % 16 <> 3").select("doc_id", F.concat(F.lit("rId"), F.col("i").cast("string")).alias("rid"), target.alias("target"))
    return lookups.with_extension(_images(spark, sf_dir), rels)


_KIND = "CASE (doc_id + i) % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'cell' WHEN 2 THEN 'table' ELSE 'paragraph' END"


@query(f"""{_LINES}, a AS (SELECT l.doc_id, l.i AS node, l.i - d AS ancestor, CASE (l.doc_id + l.i - d) % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'cell' WHEN 2 THEN 'table' ELSE 'paragraph' END AS kind, d
    FROM lines l, (SELECT unnest(range(0, 4)) AS d) WHERE l.i - d >= 0)
  SELECT doc_id, node, arg_min(ancestor, d) AS ancestor, arg_min(kind, d) AS kind FROM a WHERE kind <> 'run' GROUP BY doc_id, node""")
def nearest_ancestors(spark, sf_dir):
    up = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("i"), F.lit(3)))).alias("distance")
    rows = _blocks(spark, sf_dir).select("doc_id", F.col("i").alias("node"), up).withColumn("ancestor", F.col("node") - F.col("distance"))
    return lookups.nearest_ancestor(rows.withColumn("kind", F.expr(_KIND.replace("+ i)", "+ ancestor)"))))


@query(f"""{_LINES} SELECT doc_id, i // 10 AS cell, count(*) FILTER (WHERE i % 8 = 3) AS n, coalesce(string_agg('rId' || CAST(i AS VARCHAR), ',' ORDER BY 'rId' || CAST(i AS VARCHAR)) FILTER (WHERE i % 8 = 3), '') AS images FROM lines GROUP BY ALL""")
def cell_images(spark, sf_dir):
    cell = F.floor(F.col("i") / 10).alias("cell")
    owners = _blocks(spark, sf_dir).select("doc_id", cell).distinct()
    images = _images(spark, sf_dir).select("doc_id", F.floor(F.col("para_idx") / 10).alias("cell"), "rid")
    out = lookups.by_owner(images, owners, ["doc_id", "cell"])
    return out.select("doc_id", "cell", F.size("images").cast("long").alias("n"), F.array_join("images", ",").alias("images"))


_CAPTION = "CASE (doc_id + i) % 6 WHEN 0 THEN 'a [그림 ' || CAST(i AS VARCHAR(20)) || '] b' WHEN 2 THEN '[note] [표 ' || CAST(i AS VARCHAR(20)) || ']' ELSE 'x' END"


@query(f"""{_LINES}, p AS (SELECT doc_id, i AS p, {_CAPTION} AS text FROM lines),
  c AS (SELECT doc_id, p, text, unnest(regexp_extract_all(text, '\\[(.*?)\\]', 1)) AS caption FROM p),
  k AS (SELECT *, instr(text, '[' || caption || ']') - 1 AS pos FROM c WHERE regexp_matches(caption, '{"|".join(T.CAPTION_KEYWORDS)}')),
  m AS (SELECT l.doc_id, l.i AS para_idx, l.i % 3 AS run_idx, caption, CASE WHEN p = l.i THEN abs(pos - l.i % 3) ELSE abs(p - l.i) END AS dist, CASE WHEN p = l.i THEN 0 WHEN p < l.i THEN 1 ELSE 2 END AS side, p
    FROM lines l JOIN k ON k.doc_id = l.doc_id AND k.p BETWEEN l.i - 2 AND l.i + 2 WHERE l.i % 8 = 3)
  SELECT doc_id, para_idx, run_idx, caption FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY dist, side, p) AS r FROM m) WHERE r = 1""")
def nearest_caption(spark, sf_dir):
    paragraphs = _blocks(spark, sf_dir).select("doc_id", F.col("i").alias("para_idx"), F.expr(_CAPTION).alias("text"))
    return lookups.nearest_caption(_images(spark, sf_dir).drop("rid"), paragraphs)


# Two versions of a file set: documents, with some left out, some added and some changed.
_PATH = "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR(20)) || CASE WHEN doc_id % 3 = 0 THEN '.txt' WHEN doc_id % 3 = 1 THEN '.log' ELSE '.md' END"


def _version(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").where("doc_id % 10 <> 1" if new else "doc_id % 10 <> 2")
    content = F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text")) if new else F.col("text")
    return rows.select(F.expr(_PATH).alias("path"), content.alias("content"))


_STATUS = f"SELECT {_PATH} AS path, CASE doc_id % 10 WHEN 1 THEN 'removed' WHEN 2 THEN 'added' WHEN 3 THEN 'modified' ELSE 'same' END AS status FROM documents"


@query(_STATUS)
def file_diff(spark, sf_dir):
    return diff.compare(diff.digests(_version(spark, sf_dir, False)), diff.digests(_version(spark, sf_dir, True)))


@query(f"SELECT status, count(*) AS n FROM ({_STATUS}) GROUP BY status")
def file_diff_counts(spark, sf_dir):
    return diff.counts(file_diff(spark, sf_dir))


@query(f"SELECT {_PATH} AS path, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 <> 2")
def file_hashes(spark, sf_dir):
    return diff.digests(_version(spark, sf_dir, False))


@query(f"SELECT path FROM (SELECT {_PATH} AS path FROM documents WHERE doc_id % 10 <> 2) WHERE NOT (path LIKE '%.log' OR path LIKE 'src1%/en/%')")
def ignored_paths(spark, sf_dir):
    return diff.ignored(_version(spark, sf_dir, False), ["*.log", "src1*/en/*"]).select("path")


@query(None)
def unified_diff(spark, sf_dir):
    """Line matching is beyond SQL; a test holds it against the standard library."""
    old, new = _version(spark, sf_dir, False).withColumnRenamed("content", "old"), _version(spark, sf_dir, True).withColumnRenamed("content", "new")
    return diff.unified(old.join(new, "path").where("old <> new")).select("path", "diff")


# Jobs: a user is a job, an event type its status.
_JOBS = "SELECT event_id, 'job:' || CAST(user_id AS VARCHAR(20)) AS job_id, ts, event_type AS status, CAST(event_id % 101 AS BIGINT) AS progress FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events")
    return rows.select("event_id", F.concat(F.lit("job:"), F.col("user_id").cast("string")).alias("job_id"), "ts", F.col("event_type").alias("status"), (F.col("event_id") % 101).alias("progress"))


_LATEST = f"SELECT job_id, ts, status, progress, n_events FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY job_id) AS n_events FROM ({_JOBS})) WHERE r = 1"


@query(_LATEST)
def job_latest(spark, sf_dir):
    return jobs.latest(_events(spark, sf_dir))


_MESSAGE = """coalesce(nullif(own, ''), CASE status WHEN 'finished' THEN '변환 작업이 완료되었습니다.' WHEN 'failed' THEN '변환 작업이 실패했습니다.' WHEN 'started' THEN '변환 작업이 진행 중입니다.' ELSE '변환 작업이 대기 중입니다.' END)"""
_STATE = "CASE progress % 4 WHEN 0 THEN 'finished' WHEN 1 THEN 'failed' WHEN 2 THEN 'started' ELSE 'queued' END"


@query(f"SELECT job_id, status, {_MESSAGE} AS message, string_split({_MESSAGE}, ' (경과:')[1] || ' (경과: ' || format('{{:.1f}}', progress / 10) || '초)' AS shown FROM (SELECT job_id, progress, {_STATE} AS status, CASE WHEN progress % 3 = 0 THEN 'own (경과: 1.0초)' ELSE '' END AS own FROM ({_LATEST}))")
def job_message(spark, sf_dir):
    state = job_latest(spark, sf_dir).select("job_id", F.expr(_STATE).alias("status"), "progress", F.when(F.col("progress") % 3 == 0, "own (경과: 1.0초)").otherwise("").alias("own_message"))
    return jobs.messages(state).select("job_id", "status", "message", T.with_elapsed(F.col("message"), F.col("progress") / 10).alias("shown"))


@query(f"SELECT l.*, c_name AS filename FROM ({_LATEST}) l LEFT JOIN (SELECT 'job:' || CAST(c_custkey AS VARCHAR) AS job_id, c_name FROM customer WHERE c_custkey % 3 = 0) USING (job_id)")
def job_enriched(spark, sf_dir):
    dim = _read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("job:"), F.col("c_custkey").cast("string")).alias("job_id"), F.col("c_name").alias("filename"))
    return jobs.enriched(job_latest(spark, sf_dir), dim)


@query(f"SELECT job_id FROM ({_LATEST}) WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 86400 SECONDS")
def job_expired(spark, sf_dir):
    as_of = _read(spark, sf_dir, "events").agg(F.max("ts").alias("as_of"))  # one row
    return jobs.expired(job_latest(spark, sf_dir).crossJoin(F.broadcast(as_of)), F.col("as_of")).select("job_id")


@query("SELECT user_id % 10 AS batch, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY ALL")
def batch_totals(spark, sf_dir):
    return jobs.totals(_read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("batch"), F.col("event_type").alias("status")), ["batch"])


@query(f"SELECT job_id, status, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS seconds, count(*) AS n FROM ({_JOBS}) GROUP BY ALL")
def stage_timings(spark, sf_dir):
    return jobs.stage_seconds(_events(spark, sf_dir))


@query(f"SELECT event_id, CAST(floor(15 + progress * 0.35) AS BIGINT) AS shown FROM ({_JOBS})")
def progress_remap(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", jobs.remapped(F.col("progress").cast("decimal(10,0)")).alias("shown"))


@query("""SELECT doc_id, CAST(k AS BIGINT) AS pos, CASE WHEN k < 2 THEN 't' || CAST(doc_id + k AS VARCHAR) END AS title, CASE WHEN k < 2 THEN 'a' END AS author FROM labels, (SELECT unnest(range(0, 3)) AS k)""")
def json_meta(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels")
    entry = lambda k: F.concat(F.lit('{"title":"t'), (F.col("doc_id") + k).cast("string"), F.lit('","author":"a"}'))
    batches = labels.select(F.col("doc_id").alias("batch_id"), F.concat(F.lit("["), entry(0), F.lit(","), entry(1), F.lit("]")).alias("metadata"))
    files = labels.select(F.col("doc_id").alias("batch_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("pos"))
    return jobs.with_metadata(files, jobs.batch_metadata(batches)).select(F.col("batch_id").alias("doc_id"), "pos", "title", "author")
