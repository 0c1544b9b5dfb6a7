"""Writers: items projected to the files of talking-book and e-book packages, and packages as archives.

All files of a package come from one ordered aggregation by document: every item
gives its piece of each file, with the tags that its place in the hierarchy
opens and closes, and the pieces are collected once. Results are entry rows
(doc_id, entry_ord, path, content); `archives` zips them.
"""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliary.functions import text as T
from foliary.operators import outline, tables
from foliary.operators.integrity import ROOTS
from foliary.sources import datasource, packages, store

#: Bytes up to which entries are stored, as deflating makes them no smaller.
_STORED = 32
#: Packages and bytes at which an Arrow batch of archives is full.
_FULL = 256, 8 << 20

# Names and types that the formats prescribe.
_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n'
_DTBOOK, _OPF, _SMIL, _NCX = (ROOTS[f][0] for f in ("dtbook.xml", "dtbook.opf", "dtbook.smil", "dtbook.ncx"))
_XHTML, _OPS, _MODS = "http://www.w3.org/1999/xhtml", "http://www.idpf.org/2007/ops", "http://www.loc.gov/mods/v3"
#: Resource file: the node sets of its two scopes.
RESOURCES = (("nsuri", _NCX, ("navPoint", "pageTarget", "navTarget", "navMap", "pageList", "navList", "ncx")), ("nsuri", _SMIL, ("math", "altimg")))
#: Files of a talking book that its package lists.
LISTED = (("xml", "application/x-dtbook+xml"), ("opf", "text/xml"), ("smil", "application/smil"), ("ncx", "application/x-dtbncx+xml"), ("res", "application/x-dtbresource+xml"))
UNTITLED = "제목 없음"
IMAGE = "이미지"  # the alternative text of images, before their number
STYLE = "body{line-height:1.6}figure{margin:1em 0}table{border-collapse:collapse}"
CONTAINER = f'{_HEAD}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def _s(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _words(x: Column) -> Column:
    return T.escaped(T.xml_safe(x))


def _uid() -> Column:
    return _s("uid_", F.col("doc_id").cast("string"))


def _par(id_: Column) -> Column:
    return _s("smil_par_", id_)


def with_defaults(book: DataFrame) -> DataFrame:
    """`book` with defaults in place of empty fields: doc_id, title, author, publisher, language, isbn."""
    fill = {"title": "Untitled", "author": "Unknown Author", "publisher": "Unknown Publisher", "language": "ko"}
    rows = book.withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(v)) for c, v in fill.items()})
    return rows.withColumn("isbn", F.coalesce(F.nullif(F.trim("isbn"), F.lit("")), _uid()))


def placed_items(items: DataFrame) -> DataFrame:
    """`items` with level (0 if no heading), first (of its document), was_open (an array: whether a section of each level is open ahead), depth and before (open sections after and ahead of a heading), h_no, p_no and i_no (running numbers of headings, pages and images)."""
    ahead = Window.partitionBy("doc_id").orderBy("sorted_no").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("doc_id").orderBy("sorted_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("level", T.heading_level(F.when(F.col("type").rlike("^h[1-6]$"), F.col("type")).otherwise("p")))
    was_open = outline.open_levels(F.col("level"), "sorted_no", ahead)
    rows = rows.withColumns({"was_open": F.array(*was_open), "first": F.count("*").over(ahead) == 0})
    depth = outline.open_depth(F.col("level"), [F.col("was_open")[k - 1] for k in outline.LEVELS])
    rows = rows.withColumn("depth", F.when(F.col("level") > 0, depth))
    return rows.withColumns({
        "before": F.coalesce(F.last("depth", True).over(ahead), F.lit(0)), "h_no": F.count(F.when(F.col("level") > 0, 1)).over(so_far), "p_no": F.count(F.when(F.col("type") == "pagenum", 1)).over(so_far),
        "i_no": F.count(F.when(F.col("type") == "image", 1)).over(so_far),
    })


def _level_tags() -> Column:
    """What closes and opens ahead of an item in a book of nested levels; a first item that is no level-1 heading gets a level 1 made up."""
    level, first = F.col("level"), F.col("first")
    ends = [F.when((level > 0) & (level <= k) & F.col("was_open")[k - 1], f"</level{k}>").otherwise("") for k in range(6, 1, -1)]
    own = F.when(level > 0, _s("<level", level.cast("string"), ">")).otherwise("")
    made_up = F.when(first & (level != 1), f"<level1><h1>{UNTITLED}</h1>").otherwise("")
    return _s(*ends, F.when(~first & (level == 1), "</level1>").otherwise(""), made_up, own)


def _last_open() -> list[Column]:
    """Aggregates: the last heading of each level from 1 to 6, by sorted_no."""
    return [F.max(F.when(F.col("level") == k, F.col("sorted_no"))).alias(f"last_{k}") for k in outline.LEVELS]


def _level_ends() -> Column:
    """What closes a book's last sections, from the columns of `_last_open`."""
    last = lambda k: F.coalesce(F.col(f"last_{k}"), F.lit(0))
    ends = [F.when(last(k) > (F.greatest(*(last(j) for j in range(1, k))) if k > 2 else last(1)), f"</level{k}>").otherwise("") for k in range(6, 1, -1)]
    return _s(*ends, F.when(F.col("n") > 0, "</level1>").otherwise(""))


def _nested(label: Column, end: str, inner: tuple[str, str] = ("", "")) -> Column:
    """A heading's entry in a tree: what ends ahead of it, and its own beginning."""
    up = F.greatest(F.col("before") - F.col("depth"), F.lit(0)).cast("int")
    deeper = (F.col("before") > 0) & (F.col("depth") > F.col("before"))
    return F.when(F.col("before") == 0, label).when(deeper, _s(inner[0], label)).otherwise(_s(end, F.repeat(F.lit(inner[1] + end), up), label))


def _joined(field: str, between: str = "\n") -> Column:
    return F.array_join(F.transform("pieces", lambda p: p[field]), between)


def _collected(rows: DataFrame, pieces: dict[str, Column]) -> DataFrame:
    """A row per document: pieces (an array of structs in order), n, headings, depth of the last heading and of all, last headings by level."""
    ordered = F.array_sort(F.collect_list(F.struct("sorted_no", *(v.alias(k) for k, v in pieces.items())))).alias("pieces")
    return rows.groupBy("doc_id").agg(
        ordered, F.count("*").alias("n"), F.max("h_no").alias("headings"), F.max_by("depth", F.when(F.col("level") > 0, F.col("sorted_no"))).alias("end_depth"),
        F.least(F.greatest(F.max("level"), F.lit(1)), F.lit(6)).alias("deepest"), *_last_open(),
    )


def _entries(rows: DataFrame, files: list[tuple[str, Column]], only: Collection[str] | None = None) -> DataFrame:
    """A row per file, in order, or per file of those in `only`."""
    chosen = [(i, p, c) for i, (p, c) in enumerate(files) if only is None or p in only]
    # Contents are columns first, as generated code makes these but not what an explode is given.
    made = rows.select("doc_id", *(c.cast("binary").alias(f"__{i}") for i, _, c in chosen))
    listed = F.array(*(F.struct(F.lit(i).alias("entry_ord"), F.lit(p).alias("path"), F.col(f"__{i}").alias("content")) for i, p, _ in chosen))
    if not chosen:
        listed = listed.cast("array<struct<entry_ord:int,path:string,content:binary>>")
    return made.select("doc_id", F.explode(listed).alias("x")).select("doc_id", "x.*")


def _of_kinds(items: DataFrame, images: bool, headings: bool) -> DataFrame:
    """The items that packages (images) and contents (headings and pages) speak of."""
    asked = F.lit(False)
    if images:
        asked = asked | (F.col("type") == "image")
    if headings:
        asked = asked | F.col("type").rlike("^(?:h[1-6]|pagenum)$")
    return items.where(asked)


def _image_entries(images: DataFrame, folder: str, first: int) -> DataFrame:
    """Entries of images (doc_id, elem_id, ext, content), after all other files."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("elem_id")) + (first - 1)
    return images.select("doc_id", place.alias("entry_ord"), _s(folder, F.col("elem_id"), ".", F.col("ext")).alias("path"), F.col("content").cast("binary").alias("content"))


def _with_parts(items: DataFrame, cells: DataFrame | None, images: DataFrame | None, contents: DataFrame | None, cell_images: DataFrame | None, folder: str = "", kept: DataFrame | None = None) -> DataFrame:
    """`items` with html and pars of their table and ext of their image. Tables are told by `seg`, their number in the document.

    Only items that are tables or images go through a join; all others, most of a book, stay where they are.
    """
    none, kind = F.lit(None).cast("string"), F.coalesce("type", F.lit(""))
    plain = {"html": none, "pars": none, "ext": F.lit("jpeg")}
    rows = items.where(~kind.isin(*(["table"] if cells is not None else []), *(["image"] if images is not None else []))).withColumns(plain)
    if cells is not None:
        made = tables.rendered(cells, contents, cell_images, folder, kept).select("doc_id", F.regexp_extract("table_id", "^t([0-9]+)$", 1).cast("long").alias("table_no"), "html", "pars").withColumnRenamed("doc_id", "d")
        found = items.where(kind == "table").join(made, (F.col("doc_id") == F.col("d")) & (F.col("seg") == F.col("table_no")), "left").drop("d", "table_no")
        rows = rows.unionByName(found.withColumn("ext", plain["ext"]))
    if images is not None:
        known = images.select(F.col("doc_id").alias("d"), F.col("elem_id").alias("e"), F.col("ext").alias("own_ext"))
        found = items.where(kind == "image").join(known, (F.col("doc_id") == F.col("d")) & (F.col("elem_id") == F.col("e")), "left").withColumns({"html": none, "pars": none, "ext": F.coalesce("own_ext", F.lit("jpeg"))})
        rows = rows.unionByName(found.drop("d", "e", "own_ext"))
    return rows


def _all_images(cells: DataFrame | None, images: DataFrame | None, cell_images: DataFrame | None, kept: DataFrame | None = None) -> DataFrame | None:
    """doc_id, elem_id, ext, content of images between paragraphs and of those in cells that are shown."""
    if cells is None or cell_images is None:
        return images
    named = tables.cell_images(cells, cell_images, kept).select("doc_id", "elem_id", "ext", "content")
    return named if images is None else images.select("doc_id", "elem_id", "ext", "content").unionByName(named)


def _listed_images(made: DataFrame, images: DataFrame | None, folder: str) -> tuple[DataFrame, Column]:
    """`made` with what the manifest has of images in cells, and that as a column."""
    if images is None:
        return made, F.lit("")
    of_cells = images.where("elem_id like 'table%'")
    item = _s('<item id="img_', F.col("elem_id"), f'" href="{folder}', F.col("elem_id"), ".", F.col("ext"), '" media-type="', T.mime_type(F.col("ext")), '"/>')
    listed = of_cells.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("cell_items"))
    return made.join(listed, "doc_id", "left"), F.coalesce("cell_items", F.lit(""))


def daisy_entries(
    book: DataFrame, items: DataFrame, as_of: str = "1970-01-01", cells: DataFrame | None = None, images: DataFrame | None = None, notes: DataFrame | None = None, contents: DataFrame | None = None,
    cell_images: DataFrame | None = None, only: Collection[str] | None = None, kept: DataFrame | None = None,
) -> DataFrame:
    """The files of a talking book, its five texts and then its images; or those texts alone that `only` names, with no work for the others.

    `book`: doc_id, title, author, publisher, language, isbn; `items`: doc_id, elem_id, type, text, seg, sorted_no;
    `cells` and `contents`: as `tables.rendered` takes them; `images`: doc_id, elem_id, ext, content; `cell_images`:
    doc_id, table_id, row, tc, k, ext, content; `notes`: doc_id, ord, elem_id, text; `kept`: what `tables.shown` gives
    of the cells, where that is known and written.
    """
    wanted = lambda *files: only is None or not set(files).isdisjoint(only)
    with_tables, with_images = wanted("dtbook.xml", "dtbook.smil"), wanted("dtbook.xml", "dtbook.opf")
    if kept is None and cells is not None and (with_tables or cell_images is not None):
        kept = store.written(tables.shown(cells))
    if not wanted("dtbook.xml", "dtbook.smil"):
        items = _of_kinds(items, wanted("dtbook.opf"), wanted("dtbook.ncx"))
    rows = _with_parts(items, cells if with_tables else None, images if with_images else None, contents, cell_images, "", kept)
    rows = placed_items(store.dealt(rows, "doc_id"))
    images = _all_images(cells, images, cell_images, kept) if wanted("dtbook.opf") else None
    alt = _s(f'alt="{IMAGE} ', F.col("i_no").cast("string"), '"')
    words, id_, kind, page = _words(F.col("text")), F.col("elem_id"), F.col("type") == "pagenum", F.col("p_no").cast("string")
    src = _s(id_, ".", F.col("ext"))
    element = (
        F.when(kind, _s('<pagenum id="', id_, '" page="normal" smilref="dtbook.smil#', _par(id_), '">', words, "</pagenum>"))
        .when(F.col("type") == "image", _s('<imggroup id="', id_, '"><img id="', id_, '_img" src="', src, '" ', alt, '/><caption id="', id_, '_caption">', words, "</caption></imggroup>"))
        .when(F.col("type") == "table", _s('<table id="', id_, '">', F.coalesce(F.regexp_replace("html", "^<table>|</table>$", ""), F.lit("<tbody><tr><td></td></tr></tbody>")), "</table>"))
        .otherwise(_s("<", F.col("type"), ' id="', id_, '" smilref="dtbook.smil#', _par(id_), '">', words, "</", F.col("type"), ">"))
    )
    unit = F.when(F.col("type") == "table", F.nullif("pars", F.lit(""))).otherwise(_s('<par id="', _par(id_), '" class="', F.col("type"), '"><text src="dtbook.xml#', id_, '"/></par>'))
    label = _s("<navLabel><text>", words, '</text></navLabel><content src="dtbook.smil#', _par(id_), '"/>')
    point = _nested(_s('<navPoint id="ncx_', id_, '" class="level', F.col("level").cast("string"), '" playOrder="', F.col("h_no").cast("string"), '">', label), "</navPoint>")
    target = lambda order: _s('<pageTarget id="ncx_', id_, '" type="normal" playOrder="', order, '">', label, "</pageTarget>")
    # Pages come after all headings: their order is put in once these are counted.
    pieces = {
        "book": ("dtbook.xml", _s(_level_tags(), element)), "smil": ("dtbook.smil", unit), "nav": ("dtbook.ncx", F.when(F.col("level") > 0, point)), "page": ("dtbook.ncx", F.when(kind, target(F.lit("\x00")))),
        "page_no": ("dtbook.ncx", F.when(kind, page)), "image": ("dtbook.opf", F.when(F.col("type") == "image", _s('<item id="', id_, '" href="', src, '" media-type="', T.mime_type(F.col("ext")), '"/>'))),
    }
    # What no file asks for is null, so that its making falls away.
    made = _collected(rows, {k: c if wanted(f) else F.lit(None).cast("string") for k, (f, c) in pieces.items()})
    if notes is None or not wanted("dtbook.ncx"):
        made = made.withColumn("targets", F.array().cast("array<struct<ord:bigint,elem_id:string,text:string>>"))
    else:
        listed = F.array_sort(F.collect_list(F.struct("ord", "elem_id", _words(F.col("text")).alias("text"))))
        made = made.join(notes.groupBy("doc_id").agg(listed.alias("targets")), "doc_id", "left")
    made, of_cells = _listed_images(store.dealt(with_defaults(book), "doc_id").join(made, "doc_id", "left"), images, "")
    title, author, text = _words(F.col("title")), _words(F.col("author")), lambda c: F.coalesce(c, F.lit(""))
    uid = F.col("isbn")
    heads = F.coalesce("headings", F.lit(0))
    pages = F.transform(F.filter("pieces", lambda p: p["page"].isNotNull()), lambda p: F.replace(p["page"], F.lit("\x00"), (heads + p["page_no"].cast("long")).cast("string")))
    n_pages = F.coalesce(F.size(F.filter("pieces", lambda p: p["page"].isNotNull())), F.lit(0))
    target_of = lambda t, k: _s(
        '<navTarget id="ncx_note_', t["elem_id"], "_", k.cast("string"), '" class="noteref" playOrder="', (heads + n_pages + k + 1).cast("string"), '"><navLabel><text>', t["text"], '</text></navLabel><content src="dtbook.smil#', _par(t["elem_id"]), '"/></navTarget>',
    )
    lists = F.when(F.size("targets") > 0, _s('<navList class="note"><navLabel><text>notes</text></navLabel>', F.array_join(F.transform("targets", target_of), "\n"), "</navList>"))
    meta = _s('<meta name="dtb:uid" content="', uid, '"/><meta name="dc:Title" content="', title, '"/><meta name="dc:Creator" content="', author, f'"/><meta name="dc:Date" content="{as_of}"/>')
    body = _s('<bodymatter>\n', text(_joined("book")), F.when(F.col("n") > 0, _level_ends()).otherwise(F.lit(f"<level1><h1>{UNTITLED}</h1></level1>")), "\n</bodymatter>")
    dtbook = _s(_HEAD, f'<dtbook xmlns="{_DTBOOK}" version="2005-3"><head>', meta, "</head><book><frontmatter><doctitle>", title, "</doctitle><docauthor>", author, "</docauthor></frontmatter>", body, "</book></dtbook>")
    dc = _s("<metadata><dc-metadata><Title>", title, "</Title><Creator>", author, "</Creator><Publisher>", _words(F.col("publisher")), "</Publisher><Language>", F.col("language"), '</Language><Identifier id="uid">', uid, "</Identifier></dc-metadata></metadata>")
    fixed = "".join(f'<item id="{i}" href="dtbook.{i}" media-type="{m}"/>' for i, m in LISTED)
    opf = _s(_HEAD, f'<package xmlns="{_OPF}" unique-identifier="uid">', dc, f"<manifest>{fixed}", text(_joined("image", "")), of_cells, '</manifest><spine><itemref idref="smil"/></spine></package>')
    smil = _s(_HEAD, f'<smil xmlns="{_SMIL}"><head><meta name="dtb:uid" content="', uid, '"/></head><body><seq id="mseq">\n', text(_joined("smil")), "\n</seq></body></smil>")
    ncx = _s(
        _HEAD, f'<ncx xmlns="{_NCX}" version="2005-1"><head><meta name="dtb:uid" content="', uid, '"/><meta name="dtb:depth" content="', F.coalesce("deepest", F.lit(1)).cast("string"), '"/><meta name="dtb:totalPageCount" content="', n_pages.cast("string"),
        '"/></head><docTitle><text>', title, "</text></docTitle><navMap>\n", text(_joined("nav")), F.repeat(F.lit("</navPoint>"), F.coalesce("end_depth", F.lit(0)).cast("int")),
        "\n</navMap><pageList>\n", text(F.array_join(pages, "\n")), "\n</pageList>", text(lists), "</ncx>",
    )
    scopes = "".join(f'<scope nsuri="{u}">' + "".join(f'<nodeSet id="ns_{n}" select="//{n}"><resource xml:lang="en"><text>{n}</text></resource></nodeSet>' for n in names) + "</scope>" for _, u, names in RESOURCES)
    res = f'{_HEAD}<resources xmlns="http://www.daisy.org/z3986/2005/resource/" version="2005-1">{scopes}</resources>'
    out = _entries(made, [("dtbook.xml", dtbook), ("dtbook.opf", opf), ("dtbook.smil", smil), ("dtbook.ncx", ncx), ("dtbook.res", F.lit(res))], only)
    return out if images is None or only is not None else out.unionByName(_image_entries(images, "", 5))


def title_page(title: Column, author: Column, publisher: Column, language: Column) -> Column:
    return _s(
        _HEAD, f'<html xmlns="{_XHTML}" xml:lang="', language, '"><head><title>', _words(title), '</title><link rel="stylesheet" type="text/css" href="style.css"/></head><body><section id="title_page"><h1>', _words(title), "</h1><p>", _words(author), "</p><p>", _words(publisher), "</p></section></body></html>",
    )


def mods(title: Column, author: Column, language: Column) -> Column:
    """The bibliographic record of a book, its elements and values as the format prescribes."""
    return _s(
        _HEAD, f'<mods xmlns="{_MODS}"><titleInfo><title>', _words(title), '</title></titleInfo><name type="personal"><namePart>', _words(author), '</namePart><role><roleTerm type="text">author</roleTerm></role></name><language><languageTerm type="code" authority="iso639-2b">',
        _words(language), '</languageTerm></language><physicalDescription><form authority="marcform">electronic</form><internetMediaType>application/epub+zip</internetMediaType></physicalDescription><typeOfResource>text</typeOfResource></mods>',
    )


def package_file(manifest: Column, spine: Column, as_of: str) -> Column:
    """The package of an e-book; needs the columns of `with_defaults`."""
    return _s(
        _HEAD, '<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid">', F.col("isbn"),
        "</dc:identifier><dc:title>", _words(F.col("title")), "</dc:title><dc:creator>", _words(F.col("author")), "</dc:creator><dc:publisher>", _words(F.col("publisher")), "</dc:publisher><dc:language>", F.col("language"),
        f'</dc:language><meta property="dcterms:modified">{as_of}</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="style.css" media-type="text/css"/>',
        manifest, "</manifest><spine>", spine, "</spine></package>",
    )


def epub_entries(
    book: DataFrame, items: DataFrame, as_of: str = "1970-01-01T00:00:00Z", cells: DataFrame | None = None, images: DataFrame | None = None, contents: DataFrame | None = None, cell_images: DataFrame | None = None,
    only: Collection[str] | None = None, kept: DataFrame | None = None,
) -> DataFrame:
    """The files of an e-book: the type first, then container, package, navigation, title page, content, style and images; or those texts alone that `only` names."""
    wanted = lambda *files: only is None or not set(files).isdisjoint(only)
    with_images = wanted("EPUB/content.xhtml", "EPUB/package.opf")
    if kept is None and cells is not None and (wanted("EPUB/content.xhtml") or cell_images is not None):
        kept = store.written(tables.shown(cells))
    if not wanted("EPUB/content.xhtml"):
        items = _of_kinds(items, wanted("EPUB/package.opf"), wanted("EPUB/nav.xhtml"))
    rows = _with_parts(items, cells if wanted("EPUB/content.xhtml") else None, images if with_images else None, contents, cell_images, "images/", kept)
    rows = placed_items(store.dealt(rows, "doc_id"))
    images = _all_images(cells, images, cell_images, kept) if wanted("EPUB/package.opf") else None
    alt = _s(f'alt="{IMAGE} ', F.col("i_no").cast("string"), '"')
    id_, kind = F.col("elem_id"), F.col("type")
    src = _s("images/", id_, ".", F.col("ext"))
    piece = (
        F.when(kind == "pagenum", _s('<span id="', id_, '" role="doc-pagebreak" epub:type="pagebreak" aria-label="', _words(F.col("text")), '"></span>'))
        .when(kind == "image", _s('<figure id="', id_, '"><img src="', src, '" ', alt, '/></figure>'))
        .when(kind == "table", _s('<table id="', id_, '">', F.coalesce(F.regexp_replace(F.regexp_replace("html", ' smilref="[^"]*"', ""), "^<table>|</table>$", ""), F.lit("<tbody><tr><td></td></tr></tbody>")), "</table>"))
        .when(F.col("text") == "", _s('<p id="', id_, '"><br/></p>'))
        .otherwise(_s("<", kind, ' id="', id_, '">', T.inline_markup(T.xml_safe(F.col("text"))), "</", kind, ">"))
    )
    link = lambda n: _s(f'<li id="{n}', id_, '"><a href="content.xhtml#', id_, '">', _words(F.col("text")), "</a>")
    pieces = {
        "content": ("EPUB/content.xhtml", piece), "nav": ("EPUB/nav.xhtml", F.when(F.col("level") > 0, _nested(link("toc_"), "</li>", ("<ol>", "</ol>")))),
        "page": ("EPUB/nav.xhtml", F.when(kind == "pagenum", _s(link("page_"), "</li>"))),
        "image": ("EPUB/package.opf", F.when(kind == "image", _s('<item id="img_', id_, '" href="', src, '" media-type="', T.mime_type(F.col("ext")), '"/>'))),
    }
    made = _collected(rows, {k: c if wanted(f) else F.lit(None).cast("string") for k, (f, c) in pieces.items()})
    made, of_cells = _listed_images(store.dealt(with_defaults(book), "doc_id").join(made, "doc_id", "left"), images, "images/")
    title, text = _words(F.col("title")), lambda c: F.coalesce(c, F.lit(""))
    head = _s(_HEAD, f'<html xmlns="{_XHTML}" xmlns:epub="{_OPS}" xml:lang="', F.col("language"), '"><head><title>', title, '</title><link rel="stylesheet" type="text/css" href="style.css"/></head><body>')
    ends = F.when(F.col("end_depth") > 0, _s("</li>", F.repeat(F.lit("</ol></li>"), (F.col("end_depth") - 1).cast("int")))).otherwise("")
    nav = _s(head, '<nav epub:type="toc" role="doc-toc"><ol><li id="toc_title"><a href="title.xhtml">', title, "</a></li>", text(_joined("nav")), ends, '</ol></nav><nav epub:type="page-list" role="doc-pagelist"><ol>', text(_joined("page")), "</ol></nav></body></html>")
    manifest = _s('<item id="title" href="title.xhtml" media-type="application/xhtml+xml"/><item id="content" href="content.xhtml" media-type="application/xhtml+xml"/>', text(_joined("image", "")), of_cells)
    package = package_file(manifest, F.lit('<itemref idref="title"/><itemref idref="content"/>'), as_of)
    content = _s(head, "\n", text(_joined("content")), "\n</body></html>")
    out = _entries(made, [
        ("mimetype", F.lit("application/epub+zip")), ("META-INF/container.xml", F.lit(CONTAINER)), ("EPUB/package.opf", package), ("EPUB/nav.xhtml", nav),
        ("EPUB/title.xhtml", title_page(F.col("title"), F.col("author"), F.col("publisher"), F.col("language"))), ("EPUB/content.xhtml", content), ("EPUB/style.css", F.lit(STYLE)),
    ], only)
    return out if images is None or only is not None else out.unionByName(_image_entries(images, "EPUB/images/", 7))


def archives(entries: DataFrame) -> DataFrame:
    """doc_id, content: one ZIP of each document's entries in their order; a `mimetype` entry and those of a few bytes are stored, all others deflated.

    Entries are dealt by document and sorted, so one package is held at a time. They are dealt by a hash of their own: Spark leaves
    out a repartition by doc_id if a union's parts have one each, and may then put these parts' partitions together in different ways.
    """

    def packed(entries: Iterable[tuple]) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for _, path, content in entries:
                info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
                z.writestr(info, content, zipfile.ZIP_STORED if path == "mimetype" or len(content) <= _STORED else zipfile.ZIP_DEFLATED)
        return out.getvalue()

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.binary())], ["doc_id", "content"])
        rows, held = [], 0
        for doc_id, own in itertools.groupby((x for part in parts for x in zip(*(c.to_pylist() for c in part.columns), strict=True)), lambda x: x[0]):
            rows.append((doc_id, packed(own)))
            held += len(rows[-1][1])
            if len(rows) >= _FULL[0] or held >= _FULL[1]:
                yield made(rows)
                rows, held = [], 0
        if rows:
            yield made(rows)

    dealt = entries.select(F.col("doc_id").cast("long").alias("doc_id"), "path", F.col("content").cast("binary").alias("content"), "entry_ord").repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "entry_ord")
    return packages.few_rows(dealt.select("doc_id", "path", "content")).mapInArrow(pack, "doc_id long, content binary")


def save(packages: DataFrame, folder: str, suffix: str) -> DataFrame:
    """Writes each archive (doc_id, content) to folder/doc_id.suffix from the executors, as a whole or not at all; gives back doc_id, path, size of what is there.

    `folder` may be a path that all executors share or any URI that Arrow's file systems open.
    """
    spark = packages.sparkSession
    datasource.register(spark)
    packages.select("doc_id", "content").write.format("packages").option("suffix", suffix).mode("append").save(folder)
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder)
    return found.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).cast("long").alias("doc_id"), "path", F.col("length").alias("size"))
