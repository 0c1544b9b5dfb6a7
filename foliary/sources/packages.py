"""Readers: packages as tables of entries, XML nodes, and the parts of word-processor files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Collection, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
V = "{urn:schemas-microsoft-com:vml}"
# Names of elements and attributes that are asked for at every element.
_P, _PROPERTIES, _STYLE, _RUN, _T, _BR, _TAB, _VAL = (f"{W}{x}" for x in ("p", "pPr", "pStyle", "r", "t", "br", "tab", "val"))
_TBL, _TR, _TC, _CELL, _SPAN, _MERGE, _CONTROLS = f"{W}tbl", f"{W}tr", f"{W}tc", f"{W}tcPr", f"{W}gridSpan", f"{W}vMerge", (f"{W}sdt", f"{W}sdtContent")
_BLIP, _IMAGEDATA = f"{A}blip", f"{V}imagedata"


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, modified, content of every file under `path`."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")


#: Rows and bytes of an Arrow batch of packages or files, which may be large.
_BATCH = 64, 16 << 20


def few_rows(df: DataFrame) -> DataFrame:
    """Batches of few packages. Results are lazy, so the session keeps the settings until others are made."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(_BATCH[0]))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_BATCH[1]))
    return df


#: Rows and bytes at which an Arrow batch of results is full: rows of many packages share one, and a large package fills several.
_FULL = 8_192, 8 << 20
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _mapped(df: DataFrame, columns: tuple[str, ...], read: Callable[..., Iterator[tuple[int, tuple]]], schema: dict[str, str]) -> DataFrame:
    """The rows that `read` gives for the columns of each row, as (bytes, values); nulls are values like others."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([(c, _ARROW[kind]) for c, kind in schema.items()])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
        rows, held = [], 0
        for part in parts:
            for given in zip(*(part.column(c).to_pylist() for c in columns), strict=True):
                for n, row in read(*given):
                    rows.append(row)
                    held += n
                    if len(rows) >= _FULL[0] or held >= _FULL[1]:
                        yield made(rows)
                        rows, held = [], 0
        if rows:
            yield made(rows)

    return few_rows(df).select(*columns).mapInArrow(batches, ", ".join(f"{c} {kind}" for c, kind in schema.items()))


def images_in(entries: DataFrame, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "gif", "svg")) -> DataFrame:
    """Entries at the top of a package that are images by their extension, by path."""
    return entries.where(~F.col("path").contains("/") & F.lower("path").rlike(rf"\.(?:{'|'.join(extensions)})$"))


def outdated(files: DataFrame, as_of, seconds: int = 86_400, suffixes: tuple[str, ...] = (".zip", ".epub")) -> DataFrame:
    """Result files (path, modified) that were last changed longer ago than that."""
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | F.col("path").endswith(s)
    return files.where(ends & (F.col("modified") < as_of - F.expr(f"INTERVAL {seconds} SECONDS")))


def zip_entries(packages: DataFrame, prefix: str = "") -> DataFrame:
    """doc_id, ord, path, size, content of every entry of each package (doc_id, content), or of those whose path starts with `prefix`; a broken one gives a row with error."""

    def read(doc_id: int | None, content: bytes | None) -> Iterator[tuple[int, tuple]]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                rows = [(doc_id, i, x.filename, x.file_size, z.read(x), None) for i, x in enumerate(z.infolist()) if not x.is_dir() and x.filename.startswith(prefix)]
        except (zipfile.BadZipFile, TypeError) as e:
            rows = [(doc_id, 0, None, None, None, str(e))]
        return ((64 + len(row[4] or b""), row) for row in rows)

    return _mapped(packages, ("doc_id", "content"), read, {"doc_id": "long", "ord": "long", "path": "string", "size": "long", "content": "binary", "error": "string"})


def _walk(root: ElementTree.Element) -> Iterator[tuple]:
    """node_id, last_id (of the last element below), ancestors, their tags, ord, element in document order."""
    sizes: dict[ElementTree.Element, int] = {}  # of elements that hold others
    for e in reversed(list(root.iter())):  # those below an element come ahead of it
        if len(e):
            n = 1
            for c in e:
                n += sizes.get(c, 1)
            sizes[e] = n
    stack, n = [(root, [], [], 0)], 0
    while stack:
        e, parents, around, ord_ = stack.pop()
        own, n = n, n + 1
        if not len(e):
            yield own, own, parents, around, ord_, e
            continue
        yield own, own + sizes[e] - 1, parents, around, ord_, e
        below, tags = [*parents, own], [*around, _local(e.tag)[1]]
        stack += [(c, below, tags, i) for i, c in zip(range(len(e) - 1, -1, -1), reversed(e), strict=True)]


def _local(tag: str) -> tuple[str, str]:
    ns, _, name = tag.rpartition("}")
    return ns.lstrip("{"), name


def _every(root: ElementTree.Element) -> Iterator[tuple]:
    """The same with ns and tag."""
    names: dict[str, tuple[str, str]] = {}
    for own, last, parents, around, ord_, e in _walk(root):
        yield own, last, parents, around, ord_, *(names.get(e.tag) or names.setdefault(e.tag, _local(e.tag))), e


def _told(root: ElementTree.Element, tags: Collection[str], paths: bool, lasts: bool, places: bool = True) -> Iterator[tuple]:
    """The same with ns and tag of elements of `tags` alone; all others are only counted. Without `paths` the parent stands for all ancestors, without `lasts` last_id is not told, without `places` neither parent nor ord."""
    order = list(root.iter())
    sizes: dict[ElementTree.Element, int] = {}
    for e in reversed(order) if lasts else ():
        if len(e):
            sizes[e] = 1 + sum([sizes.get(c, 1) for c in e])
    names: dict[str, tuple[str, str]] = {}
    up: dict[ElementTree.Element, tuple[int, int]] = {}  # parent and place
    for n, e in enumerate(order):
        if places and len(e):
            for i, c in enumerate(e):
                up[c] = n, i
        ns, tag = names.get(e.tag) or names.setdefault(e.tag, _local(e.tag))
        if tag not in tags:
            continue
        at, ord_ = up.get(e, (None, 0))
        parents = [] if at is None else [at]
        while paths and (above := up.get(order[parents[-1]]) if parents else None):
            parents.append(above[0])
        parents.reverse()
        yield n, n + sizes.get(e, 1) - 1 if lasts else None, parents, [names[order[x].tag][1] for x in parents] if paths else [], ord_, ns, tag, e


def xml_nodes(entries: DataFrame, tags: Collection[str] | None = None, columns: Collection[str] | None = None) -> DataFrame:
    """All elements of XML entries (doc_id, path, content), or those of `tags`, numbered alike: file, node_id (in document order), last_id (of the last element below it, or its own), parent_id, ord, depth, ancestors (from the root), around (their tags), ns, tag, attrs, text, tail, error; or those `columns` alone."""
    schema = {
        "doc_id": "long", "file": "string", "node_id": "long", "last_id": "long", "parent_id": "long", "ord": "long", "depth": "int", "ancestors": "array<long>", "around": "array<string>", "ns": "string", "tag": "string",
        "attrs": "map<string,string>", "text": "string", "tail": "string", "error": "string",
    }
    asked = [i for i, c in enumerate(schema) if columns is None or c in columns]
    paths, lasts, places = (columns is None or not set(columns).isdisjoint(of) for of in (("depth", "ancestors", "around"), ("last_id",), ("depth", "ancestors", "around", "parent_id", "ord")))

    def read(doc_id: int | None, path: str, content: bytes | None) -> Iterator[tuple[int, tuple]]:
        for n, row in elements(doc_id, path, content):
            yield n, row if columns is None else tuple(row[i] for i in asked)

    def elements(doc_id: int | None, path: str, content: bytes | None) -> Iterator[tuple[int, tuple]]:
        try:
            root = ElementTree.fromstring(content)
        except (ElementTree.ParseError, TypeError) as e:
            yield 0, (doc_id, path, 0, 0, None, 0, 0, [], [], None, None, None, None, None, str(e))
            return
        for own, last, parents, around, ord_, ns, tag, x in _every(root) if tags is None else _told(root, tags, paths, lasts, places):
            attrs = list({k if k[0] != "{" else _local(k)[1]: v for k, v in x.attrib.items()}.items())
            n = 128 + 32 * (len(parents) + len(attrs)) + len(x.text or "") + len(x.tail or "") + sum([len(v) for _, v in attrs])
            yield n, (doc_id, path, own, last, parents[-1] if parents else None, ord_, len(parents), parents, around, ns, tag, attrs, x.text, x.tail, None)

    return _mapped(entries, ("doc_id", "path", "content"), read, {c: schema[c] for c in (list(schema)[i] for i in asked)})


def _paragraph(p: ElementTree.Element) -> tuple[str, str, list]:
    """style, text, and the first image of each run."""
    style = _below(p, _PROPERTIES, _STYLE)
    text, images = [], []
    for i, run in enumerate(p.iter(_RUN)):
        blips, drawn = [], []
        for t in run.iter():
            tag = t.tag
            if tag == _T:
                text.append(t.text or "")
            elif tag == _BR:
                text.append("\n")
            elif tag == _TAB:
                text.append("\t")
            elif tag == _BLIP:
                blips.append(t.get(f"{R}embed"))
            elif tag == _IMAGEDATA:
                drawn.append(t.get(f"{R}id"))
        if blips or drawn:
            images.append((i, (blips or drawn)[0]))
    return (style.get(_VAL) if style is not None else "Normal"), "".join(text), images


def _below(e: ElementTree.Element, outer: str, inner: str) -> ElementTree.Element | None:
    """The first `inner` in an `outer` of an element."""
    for x in e:
        if x.tag == outer:
            for y in x:
                if y.tag == inner:
                    return y
    return None


def _row_cells(row: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Cells of a row, those in content controls included; not those of tables nested in its cells."""
    for x in row:
        if x.tag == _TC:
            yield x
        elif x.tag in _CONTROLS:
            yield from _row_cells(x)


def _cell_blocks(cell: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """Paragraphs and tables of a cell in their order, content controls opened at every level."""
    for x in cell:
        if x.tag == _P or x.tag == _TBL:
            yield x
        elif x.tag in _CONTROLS:
            yield from _cell_blocks(x)


def _table(t: ElementTree.Element, number: Iterator[int], parent: int | None, out: list[dict], base: str, path: list[int], around: dict) -> int:
    """Appends cells, and what they hold, of a table and those nested in it to any depth; returns the table's number.

    `base` names a table by where it is: the cell of the table around it, and its number there. `path` leads to it:
    the number of the table at the top, then row, column and place in the cell of each table on the way.
    """
    own = next(number)
    for r, row in enumerate(t.findall(_TR)):
        column = 0
        for c, cell in enumerate(_row_cells(row)):
            span, merge = _below(cell, _CELL, _SPAN), _below(cell, _CELL, _MERGE)
            state = None if merge is None else merge.get(_VAL) or "continue"
            width = int(span.get(_VAL)) if span is not None else 1
            at = {"base": base, "row": r, "tc": c}
            made = {"kind": "cell", "table_id": own, "parent_table": parent, "colspan": width, "v_state": state, "path": path} | at | around
            out.append(made)
            kept, images, nested = [], 0, 0
            for seq, block in enumerate(_cell_blocks(cell)):
                if block.tag == _TBL:
                    name = f"{base}_cell_{r}_{column}_nested_{nested}"
                    nested += 1
                    out.append({"kind": "content", "seq": seq, "style": "table", "text": name} | at)
                    _table(block, number, own, out, name, [*path, r, column, seq], {"parent_base": base, "parent_row": r, "parent_tc": c})
                    continue
                _, text, found = _paragraph(block)
                if not kept or text != kept[-1]:
                    out.append({"kind": "content", "seq": seq, "k": len(kept), "style": "p", "text": text} | at)
                    kept.append(text)
                for _, rid in found:
                    out.append({"kind": "cell_image", "seq": seq, "k": images, "rid": rid} | at)
                    images += 1
            made |= {"text": " ".join(kept), "lines": "\n".join(kept)}
            column += width
    return own


def docx_parts(packages: DataFrame, kinds: Collection[str] | None = None, columns: Collection[str] | None = None) -> DataFrame:
    """One flat table of word-processor files (doc_id, content): kind is block, table, cell, content, cell_image, image, rel or error; or rows of those `kinds`, and those `columns`, alone.

    Nested tables are flattened with the id of the table around them. What a cell
    holds is in order of `seq`: paragraphs (style `p`, with their number k) and
    tables (style `table`, whose text is the base of it); a paragraph like the one
    ahead is left out. Images of a cell are numbered by k. Columns not of a kind
    are null.
    """
    names = [
        "doc_id", "kind", "body_idx", "para_idx", "style", "text", "run_idx", "rid", "target", "table_id", "parent_table", "row", "tc", "colspan", "v_state", "lines", "base", "parent_base", "parent_row", "parent_tc",
        "seq", "k", "path",
    ]

    if columns is not None:
        names = [c for c in names if c in ("doc_id", *columns)]
    strings = ("kind", "style", "text", "rid", "target", "v_state", "lines", "base", "parent_base")

    wanted = lambda *of: kinds is None or not set(kinds).isdisjoint(of)
    with_paragraphs, with_tables = wanted("block", "image"), wanted("table", "cell", "content", "cell_image")

    def parts(doc_id: int | None, content: bytes | None) -> list[dict]:
        rows: list[dict] = []
        add = lambda kind, **x: rows.append({"kind": kind} | x)
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
                rels = ElementTree.fromstring(z.read("word/_rels/document.xml.rels")) if "word/_rels/document.xml.rels" in z.namelist() else []
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as e:
            add("error", text=str(e))
            return rows
        for rel in rels:
            if "image" in rel.get("Type", ""):
                add("rel", rid=rel.get("Id"), target=rel.get("Target"))
        para, number, tables = 0, iter(range(1 << 31)), 0
        for at, child in enumerate(body if body is not None else []):
            if child.tag == _P and not with_paragraphs or child.tag == _TBL and not with_tables:
                continue  # which no row asked for tells of
            if child.tag == _P:
                style, text, images = _paragraph(child)
                add("block", body_idx=at, para_idx=para, style=style, text=text)
                for run, rid in images:
                    add("image", para_idx=para, run_idx=run, rid=rid)
                para += 1
            elif child.tag == _TBL:
                cells, tables = [], tables + 1
                add("table", body_idx=at, table_id=_table(child, number, None, cells, f"t{tables}", [tables], {}))
                rows += cells
        return rows

    def read(doc_id: int | None, content: bytes | None) -> Iterator[tuple[int, tuple]]:
        for row in parts(doc_id, content):
            if kinds is not None and row["kind"] not in kinds:
                continue
            yield 256 + len(row.get("text") or "") + len(row.get("lines") or ""), (doc_id, *(row.get(c) for c in names[1:]))

    schema = {c: "string" if c in strings else "array<long>" if c == "path" else "long" for c in names}
    return _mapped(packages, ("doc_id", "content"), read, schema)
