"""Column functions on the text of documents: markers, breaks, styles, words, escaping, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define the data model.
PAGE = r"(?:\$#|#\$|#[Pp])((?:\d+|[IVXLCDMivxlcdm]+)(?:[.-](?:\d+|[IVXLCDMivxlcdm]+))?)"
MARKERS = {
    "page": PAGE,
    "note": r"\$note\{([^}]+)\}",
    "sidebar": r"\$sidebar\{([^}]+)\}",
    "annotation": r"\$annotation\{([^}]+)\}",
    "linenum": r"\$line\{(\d+)\}",
    "noteref": r"\$noteref\{([^}]+)\}",
    "prodnote": r"\$prodnote\{([^}]+)\}",
}
KEPT_MARKERS = ("note", "sidebar", "prodnote")
BREAK = r"(?i)<(?:br|hs)\s*/?>"
TAG = r"<[^>]*>"
PUNCTUATION = ".。,，!！?？:：;；"
BRACKET = r"\[(.*?)\]"
CAPTION_KEYWORDS = ("그림", "사진", "이미지", "QR", "코드", "차트", "표", "다이어그램")
TABLE_TITLE = r"(?i)\[?표\s*\d+\.?\d*\]?"
MIME = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "svg": "image/svg+xml", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff", "webp": "image/webp",
}
STRICT_MIME = ("jpg", "jpeg", "png", "gif", "svg")

#: White space as Unicode has it, and the four information separators.
_SPACE = r"[\s\x1c-\x1f]"


def strip(x: Column) -> Column:
    # The first and last characters spare most texts the pattern, which tries every place.
    edge = F.substring(x, 1, 1).rlike(f"(?U){_SPACE}") | F.substring(x, -1, 1).rlike(f"(?U){_SPACE}")
    return F.when(edge, F.regexp_replace(x, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")).otherwise(x)


def is_blank(x: Column) -> Column:
    """Whether nothing is left when it is stripped."""
    return ~x.rlike(r"(?U)[^\s\x1c-\x1f]")


def page_values(x: Column) -> Column:
    found = F.regexp_extract_all(x, F.lit(PAGE), F.lit(1))
    return F.when(x.contains("#"), found).when(x.isNotNull(), F.array().cast("array<string>"))


_MARKER = "array<struct<place:int,rank:int,type:string,value:string,original:string>>"


def _may_hold_markers(x: Column) -> Column:
    """One look that spares most texts the patterns: every marker has one of these signs."""
    return x.contains("$") | x.contains("#")


def markers(x: Column) -> Column:
    """All markers of a text as structs of type, value, original and place, in order of place, then of type as listed."""

    def of(rank: int, kind: str, pattern: str) -> Column:
        both = F.arrays_zip(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)).alias("value"), F.regexp_extract_all(x, F.lit(pattern), F.lit(0)).alias("original"))
        make = lambda m: F.struct(
            F.instr(x, m["original"]).alias("place"), F.lit(rank).alias("rank"), F.lit(kind).alias("type"), m["value"].alias("value"), m["original"].alias("original")
        )
        return F.transform(both, make)

    found = F.array_sort(F.concat(*(of(i, k, p) for i, (k, p) in enumerate(MARKERS.items()))))
    return F.when(_may_hold_markers(x), found).otherwise(F.array().cast(_MARKER))


def cleaned(x: Column) -> Column:
    """The text without markers; notes, sidebars and producer's notes leave what they hold."""
    # Pages go first and have a sign that others lack; what is taken out brings in no sign, so the text at hand tells what may be there.
    no_pages = F.when(x.contains("#"), F.regexp_replace(x, MARKERS["page"], "")).otherwise(x)
    clean = no_pages
    for kind, pattern in MARKERS.items():
        if kind != "page":
            clean = F.regexp_replace(clean, pattern, "$1" if kind in KEPT_MARKERS else "")
    return F.when(x.contains("$") & x.contains("{"), clean).otherwise(no_pages)


def segments(x: Column) -> Column:
    """Pieces between break tags, empty ones included."""
    # One look for the sign that every break has spares most texts the pattern.
    return F.when(x.contains("<"), F.split(x, BREAK, -1)).when(x.isNotNull(), F.array(x))


def heading_type(style: Column) -> Column:
    """h1 to h6 or p from a style name: the word for heading anywhere, then a digit from 1 to 6."""
    level = F.regexp_extract(F.regexp_replace(F.lower(F.trim(style)), r"\s+", " "), r"(?:heading|제목)\s*([1-6])\b", 1)
    named = F.lower(style).contains("heading") | F.lower(style).contains("제목")
    return F.when(named, F.when(level != "", F.concat(F.lit("h"), level)).otherwise("p")).otherwise("p")


def heading_type_by_prefix(style: Column) -> Column:
    """h1 to h6 or p from a style name that starts with `heading N` or is `제목 N`."""
    name, out = F.lower(style), F.lit("p")
    for n in range(6, 0, -1):
        out = F.when(name.startswith(f"heading {n}") | (name == f"제목 {n}"), f"h{n}").otherwise(out)
    return out


def heading_level(kind: Column) -> Column:
    return F.when(kind.startswith("h"), F.substring(kind, 2, 1).cast("long")).otherwise(F.lit(0).cast("long"))


def words(x: Column) -> Column:
    """Words by white space; punctuation that starts a word stands alone. Breaks part words."""
    lead = rf"^([{PUNCTUATION}]+)(.+)$"
    found = F.filter(F.split(F.regexp_replace(x, BREAK, " "), rf"(?U){_SPACE}+", -1), lambda w: w != "")
    apart = F.transform(found, lambda w: F.when(w.rlike(lead), F.array(F.regexp_extract(w, lead, 1), F.regexp_extract(w, lead, 2))).otherwise(F.array(w)))
    return F.flatten(apart)


def xml_safe(x: Column) -> Column:
    """The text without characters that XML cannot hold."""
    return F.regexp_replace(x, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def escaped(x: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(mark), F.lit(name))
    return x


def stripped_and_escaped(x: Column) -> Column:
    return escaped(F.regexp_replace(x, TAG, ""))


def page_number(value: Column) -> Column:
    """A page marker's number: the last digits after a dash, the first before a dot, else the whole; null if there is none."""
    digits = F.regexp_extract_all(value, F.lit(r"(\d+)"), F.lit(1))
    dashed, dotted = F.try_element_at(digits, F.lit(-1)), F.try_element_at(digits, F.lit(1))
    return F.when(value.contains("-"), dashed).when(value.contains("."), dotted).otherwise(value).try_cast("bigint")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def mime_type(ext: Column) -> Column:
    known = F.lit("")
    for e, m in MIME.items():
        known = F.when(ext == e, m).otherwise(known)
    return F.when(known != "", known).otherwise(F.concat(F.lit("image/"), ext))


def strict_mime_type(ext: Column) -> Column:
    """Null for other than the core types."""
    return F.when(ext.isin(*STRICT_MIME), mime_type(ext))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The base name without its last extension; names that begin with their only dot have none."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def relative(path: Column, root: Column) -> Column:
    """The path from `root` on; paths outside of it as they are."""
    inside = path.startswith(F.concat(root, F.lit("/")))
    return F.when(inside, F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def is_table_title(x: Column) -> Column:
    return x.rlike(TABLE_TITLE)


def path_safe(x: Column) -> Column:
    return F.translate(x, " /\\:", "____")


def file_safe(x: Column) -> Column:
    short = F.left(F.regexp_replace(F.regexp_replace(x, r'[<>:"/\\|?*]', "_"), r"\s+", "_"), F.lit(50))
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("untitled"))


def kept_characters(x: Column) -> Column:
    return F.regexp_replace(x, r"[^\p{L}\p{N} _-]", "")


def inline_markup(x: Column) -> Column:
    """Escaped text with emphasis, ruby, raised and lowered digits and links marked up, in this order; rules and code as a whole."""
    body = stripped_and_escaped(x)
    y = F.regexp_replace(body, r"\*\*(.*?)\*\*", "<strong>$1</strong>")
    y = F.regexp_replace(y, r"\*(.*?)\*", "<em>$1</em>")
    y = F.regexp_replace(y, r"([가-힣]+)\(([가-힣]+)\)", "<ruby>$1<rt>$2</rt></ruby>")
    whole = y
    y = F.regexp_replace(y, r"\^(\d+)", "<sup>$1</sup>")
    y = F.regexp_replace(y, r"_(\d+)", "<sub>$1</sub>")
    link = '<a href="$1" title="외부 링크: $1" target="_blank" rel="noopener noreferrer">$1</a>'
    y = F.regexp_replace(y, r'(https?://[^\s<>"]+)', link)
    return (
        F.when(F.trim(whole).rlike(r"^[-_]{3,}$"), F.lit("<hr/>"))
        .when(whole.rlike("^(?:```|    )"), F.concat(F.lit("<pre><code>"), whole, F.lit("</code></pre>")))
        .otherwise(y)
    )


#: Kinds of note references, fixed values: the word in the text, the prefix of ids, and what an entry says of it.
NOTES = (("각주", "fn", "에 대한 설명"), ("난외주석", "marg", "에 대한 설명"), ("정답", "ans", "에 대한 정답"))
FORMULA = r"\\\\(.*?)\\\\"
DRAWING = r"\\svg\\(.*?)\\"
LINK = r'https?://[^\s<>"]+'


def formulas(x: Column) -> Column:
    """What stands between pairs of two backslashes."""
    return F.regexp_extract_all(x, F.lit(FORMULA), F.lit(1))


def with_formulas(x: Column) -> Column:
    """Formulas as MathML that holds them as text, drawings as an image of that name: evident intent, as a fixed formula or shape would say nothing of them."""
    x = F.regexp_replace(x, FORMULA, '<math xmlns="http://www.w3.org/1998/Math/MathML" alttext="$1"><mtext>$1</mtext></math>')
    return F.regexp_replace(x, DRAWING, '<svg xmlns="http://www.w3.org/2000/svg" role="img" aria-label="$1"><title>$1</title></svg>')


def links(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(LINK), F.lit(0))


def list_kind(x: Column) -> Column:
    """ol for `N. `, ul for a bullet, else null."""
    return F.when(x.rlike(r"^\d+\.\s"), "ol").when(x.rlike(r"^[-•*]\s"), "ul")


def note_references(x: Column, word: str) -> Column:
    return F.regexp_extract_all(x, F.lit(rf"\({word}\d+\)"), F.lit(0))


def fragment(src: Column, last: bool = False) -> Column:
    """What follows # in a reference: the second piece, or the last."""
    return F.try_element_at(F.split(src, "#"), F.lit(-1 if last else 2))


def message(status: Column, own: Column) -> Column:
    """A job's own message if it has one, else that of its status (fixed values)."""
    said = (
        F.when(status == "finished", "변환 작업이 완료되었습니다.")
        .when(status == "failed", "변환 작업이 실패했습니다.")
        .when(status == "started", "변환 작업이 진행 중입니다.")
        .otherwise("변환 작업이 대기 중입니다.")
    )
    return F.coalesce(F.nullif(own, F.lit("")), said)


def with_elapsed(text: Column, seconds: Column) -> Column:
    """The text with the seconds that have passed in place of such a suffix (a fixed value)."""
    return F.concat(F.substring_index(text, " (경과:", 1), F.format_string(" (경과: %.1f초)", seconds))
