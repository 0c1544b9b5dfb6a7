"""Grids of tables with merged cells.

Cells have table (any key columns), row, tc (place in the row), colspan and
v_state: `restart`, `continue` or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.sources import store


def grid_starts(cells: DataFrame, key: list[str]) -> DataFrame:
    """`cells` with grid_start: the columns that earlier cells of the row take."""
    before = Window.partitionBy(*key, "row").orderBy("tc").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("grid_start", F.coalesce(F.sum("colspan").over(before), F.lit(0)).cast("long"))


def _spans(cells: DataFrame, key: list[str]) -> DataFrame:
    """Every grid place: the columns of its cell, g, grid_start, r and c (the spans shown) and area (whether a merged cell covers it)."""
    # One distribution by table serves all windows, which are by finer keys of it.
    place = F.explode(F.sequence(F.col("grid_start"), F.col("grid_start") + F.col("colspan") - 1)).alias("g")
    grid = grid_starts(store.dealt(cells, *key), key).select("*", place)
    down = Window.partitionBy(*key, "g").orderBy("row")
    new = (F.coalesce(F.col("v_state"), F.lit("")) != "continue") | (F.lag("row").over(down).isNull()) | (F.lag("row").over(down) != F.col("row") - 1)
    grid = grid.withColumn("new", new)
    grid = grid.withColumn("island", F.sum(F.when(F.col("new"), 1).otherwise(0)).over(down))
    # The columns that a restart's cell covers go down its run, if the run is that of the cell's first column.
    width = F.when((F.col("v_state") == "restart") & (F.col("g") == F.col("grid_start")), F.col("colspan")).otherwise(0)
    grid = grid.withColumn("width", F.last(F.when(F.col("new"), width), ignorenulls=True).over(down))
    grid = grid.withColumn("n", F.count("*").over(Window.partitionBy(*key, "g", "island")))
    # So the places of a row that are covered are told along the row.
    along = Window.partitionBy(*key, "row").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)
    covered = F.max(F.when(~F.col("new"), F.col("g") + F.col("width") - 1)).over(along) >= F.col("g")
    grid = grid.withColumn("area", (F.col("g") != F.col("grid_start")) | F.coalesce(covered, F.lit(False)))
    r = F.when(~F.col("area") & (F.col("v_state") == "restart"), F.col("n")).otherwise(1).cast("long")
    c = F.when(~F.col("area"), F.col("colspan")).otherwise(1).cast("long")
    return grid.withColumns({"r": r, "c": c}).drop("new", "island", "width", "n")


def merged_spans(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, row, g, rowspan, colspan, is_merged, is_merged_area of each grid place.

    Runs of continued cells below a restart are found as islands; a restart's
    run is tested at its first column only. A continued cell without a restart
    stays a cell of its own.
    """
    out = _spans(cells.select(*key, "row", "tc", "colspan", "v_state"), key)
    return out.select(*key, "row", "g", F.col("r").alias("rowspan"), F.col("c").alias("colspan"), (~F.col("area") & ((F.col("r") > 1) | (F.col("c") > 1))).alias("is_merged"), F.col("area").alias("is_merged_area"))


def columns(cells: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, tc, n_rows, texts: the texts of each column from top to bottom, joined by |."""
    ordered = F.array_sort(F.collect_list(F.struct("row", F.col(text).alias("t"))))
    return cells.groupBy(*key, "tc").agg(F.count("*").alias("n_rows"), F.array_join(F.transform(ordered, lambda x: x["t"]), "|").alias("texts"))


def shape(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, n_rows, n_columns: of the widest row."""
    rows = cells.groupBy(*key, "row").agg(F.sum("colspan").alias("width"))
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows"), F.max("width").cast("long").alias("n_columns"))


def lookup(grid: DataFrame, cells: DataFrame, key: list[str]) -> DataFrame:
    """Grid places with what is known of their cells; a place without one is 1 by 1 and not merged."""
    found = grid.join(cells, [*key, "row", "g"], "left")
    return found.withColumns({"rowspan": F.coalesce("rowspan", F.lit(1)).cast("long"), "colspan": F.coalesce("colspan", F.lit(1)).cast("long"), "is_merged": F.coalesce("is_merged", F.lit(False))})


#: Places in a cell: behind all paragraphs where nested tables have none of their own, then images, then the end.
_NESTED, _IMAGES, _END = 1 << 40, 1 << 41, 1 << 42
#: The alternative text of images in cells, a fixed value before their number.
CELL_IMAGE = "표 셀 이미지"


def _outer_cells() -> Column:
    """The cells around a table, as its id has them: structs of table_id, row and the column g."""
    parts = F.split("table_id", "_cell_")
    number = lambda i, n: F.regexp_extract(F.element_at(parts, i + 1), "^([0-9]+)_([0-9]+)_", n).cast("long")
    cell = lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "_cell_").alias("table_id"), number(i, 1).alias("row"), number(i, 2).alias("g"))
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), cell))


def _told_path() -> Column:
    """The path to a table from its id; nested tables stand behind the paragraphs of their cell, in order of their numbers."""
    numbers = F.transform(F.regexp_extract_all("table_id", F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("long"))
    return F.transform(numbers, lambda x, i: F.when((i > 0) & (i % 3 == 0), x + _NESTED).otherwise(x))


def contents_of(cells: DataFrame) -> DataFrame:
    """doc_id, table_id, row, tc, seq, k, text, and g and path if cells have them: the lines of cells' texts as paragraphs."""
    own = ["doc_id", "table_id", "row", "tc", *(c for c in ("g", "path") if c in cells.columns)]
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("k", "line")
    return cells.select(*own, lines).select(*own, F.col("k").cast("long").alias("seq"), F.col("k").cast("long").alias("k"), F.col("line").alias("text"))


def shown(cells: DataFrame) -> DataFrame:
    """Cells that are shown (doc_id, table_id, path, row, tc and, where cells have it, text), with column g and the spans r and c: those under a merged cell go, with all tables nested in them."""
    key = ["doc_id", "table_id"]
    told = cells if "path" in cells.columns else cells.withColumn("path", _told_path())
    placed = store.written(_spans(told.select(*key, "path", "row", "tc", "colspan", "v_state", *(["text"] if "text" in told.columns else [])), key).where("g = grid_start"))  # read three times
    hidden = placed.where("area").select("doc_id", F.struct("table_id", "row", "g").alias("cell"))
    lost = placed.where(F.col("table_id").contains("_cell_")).select(*key).distinct().select(*key, F.explode(_outer_cells()).alias("cell")).join(hidden, ["doc_id", "cell"], "left_semi").select(*key).distinct()
    return placed.where("not area").join(lost, key, "left_anti").drop("grid_start", "colspan", "v_state", "area")


def cell_images(cells: DataFrame, images: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """`images` (doc_id, table_id, row, tc, k, ext, others) of cells that are shown (`kept`, where these are known), with elem_id: named by table, row, column and number."""
    at = (shown(cells) if kept is None else kept).select("doc_id", "table_id", "row", "tc", "g")
    name = F.concat(F.lit("table_"), "table_id", F.lit("_cell_"), F.col("row").cast("string"), F.lit("_"), F.col("g").cast("string"), F.lit("_img_"), F.col("k").cast("string"))
    return images.join(at, ["doc_id", "table_id", "row", "tc"]).withColumn("elem_id", name)


def rendered(cells: DataFrame, contents: DataFrame | None = None, images: DataFrame | None = None, folder: str = "", kept: DataFrame | None = None) -> DataFrame:
    """doc_id, table_id, html and pars (reading units) of tables at the top, with all tables nested in their cells, to any depth.

    `cells` are as above, with doc_id and table_id, and path or, for tables whose
    place in their cell is not known, none. `contents` (doc_id, table_id, row, tc,
    seq, k, text) are the paragraphs of cells, by default the lines of the cells'
    text; `images` (doc_id, table_id, row, tc, k, ext) follow what else a cell holds.

    Every tag and paragraph is a row with its path from the top: the number of the
    table, then row, column and place in the cell of each table on the way. Paths
    sort in document order, so one ordered aggregation by table at the top puts
    tables of any depth together. A table is one string in the end. `kept` is what `shown` gives, where that is known and written.
    """
    key = ["doc_id", "table_id"]
    if kept is None:
        kept = store.written(shown(cells))  # read by every part below
    at_cell = F.concat("path", F.array("row", "g"))
    piece = lambda at, x, u=None: F.struct(at.alias("at"), x.alias("x"), (F.lit(None).cast("string") if u is None else u).alias("u"))
    edge = lambda at, place: F.concat(at, F.array(F.lit(place).cast("long")))
    both = lambda at, begin, end: F.explode(F.array(piece(edge(at, -1), begin), piece(edge(at, _END), F.lit(end)))).alias("p")
    attr = lambda c, name: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    parts = [
        kept.select(*key, "path").distinct().select(*key, both(F.col("path"), F.lit("<table><tbody>"), "</tbody></table>")),
        kept.select(*key, "path", "row").distinct().select(*key, both(F.concat("path", F.array("row")), F.lit("<tr>"), "</tr>")),
        kept.select(*key, both(at_cell, F.concat(F.lit("<td"), attr("r", "rowspan"), attr("c", "colspan"), F.lit(">")), "</td>")),
    ]
    places = kept.select(*key, "row", "tc", "g", "path")
    if contents is None and "text" in kept.columns:
        held = contents_of(kept)  # which cells that are shown have with them
    else:
        held = (contents_of(cells) if contents is None else contents.select(*key, "row", "tc", "seq", "k", "text")).join(places, [*key, "row", "tc"])
    own = F.concat("table_id", F.lit("_cell_"), F.col("row").cast("string"), F.lit("_"), F.col("g").cast("string"), F.lit("_p_"), F.col("k").cast("string"))
    said = T.strip(F.coalesce("text", F.lit("")))
    html = F.concat(F.lit('<p id="table_'), own, F.lit('" smilref="dtbook.smil#smil_par_'), own, F.lit('">'), T.escaped(T.xml_safe(said)), F.lit("</p>"))
    unit = F.when(said != "", F.concat(F.lit('<par id="smil_par_'), own, F.lit('" class="p"><text src="dtbook.xml#table_'), own, F.lit('"/></par>')))
    parts.append(held.select(*key, piece(F.concat(at_cell, F.array("seq")), html, unit).alias("p")))
    if images is not None:
        found = images.select(*key, "row", "tc", "k", "ext").join(places, [*key, "row", "tc"])
        name = F.concat(F.lit(f"{folder}table_"), "table_id", F.lit("_cell_"), F.col("row").cast("string"), F.lit("_"), F.col("g").cast("string"), F.lit("_img_"), F.col("k").cast("string"), F.lit("."), "ext")
        img = F.concat(F.lit('<img src="'), name, F.lit(f'" alt="{CELL_IMAGE} '), (F.col("k") + 1).cast("string"), F.lit('"/>'))
        parts.append(found.select(*key, piece(F.concat(at_cell, F.array(F.lit(_IMAGES).cast("long"), F.col("k"))), img).alias("p")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = store.dealt(rows.withColumn("table_id", F.substring_index("table_id", "_cell_", 1)), *key)
    out = rows.groupBy(*key).agg(F.array_sort(F.collect_list("p")).alias("l"))
    return out.select(*key, F.array_join(F.transform("l", lambda p: p["x"]), "").alias("html"), F.array_join(F.transform("l", lambda p: p["u"]), "\n").alias("pars"))
