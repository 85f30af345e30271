"""Text expressions: normalisation, numbering, list items, keywords, hashes, critical fields."""

from __future__ import annotations

import difflib
import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values: names, tables and patterns that results depend on. ----
BLOCK_TYPES = ("title", "paragraph", "table", "list", "image", "caption", "formula")
WITHOUT_TEXT = ("image", "table", "formula")
TYPE_NAMES = {
    "text": "paragraph", "title": "title", "paragraph": "paragraph", "list": "list",
    "image": "image", "figure": "image", "table": "table", "table_cell": "table",
    "formula": "formula", "equation": "formula", "caption": "caption", "figure_caption": "caption",
    "table_caption": "caption", "paragraph_title": "title", "page_header": "paragraph", "page_footer": "paragraph",
}
CN = "一二三四五六七八九十"
NUMBERINGS = [
    (r"^\d+\.\d+\.\d+\.\d+(?:\s|[.。]|$)", 4),
    (r"^\d+\.\d+\.\d+(?:\s|[.。]|$)", 3),
    (r"^\d+\.\d+(?:\s|[.。]|$)", 2),
    (r"^\d+\.(?:\s|[.。]|$)", 1),
    (r"^第[\d一二三四五六七八九十百千]+(?:章|节|部分|篇)(?:\s|[.。]|$)", 1),
    (rf"^\([\d{CN}]+\)(?:\s|$)", 2),
    (r"^[IVX]+\.(?:\s|$)", 1),
]
LIST_ITEM = rf"^\s*(?:\d+[.)、]|[{CN}]+[、.]|\([\d{CN}]+\)|[IVX]+[.)]|[-•·*])"
SENTENCE_ENDS = ("。", "！", "？", "；", "：", '"', ".", "!", "?", ";", ":")
FIELDS = {
    "amount": r"(?i)(?:RMB|¥|￥|\$|USD|EUR)?\s*[0-9][0-9,]*\.?[0-9]*(?:元|块|万元|百万元|亿元|圆|角|分)?",
    "date": r"\b\d{4}[-/年.]\d{1,2}[-/月.]\d{1,2}(?:日)?\b|\b\d{1,2}[-/月.]\d{1,2}[-/]\d{4}\b",
    "code": r"(?i)(?:合同号|订单号|发票号|编号|No\.|NO:|合同编号|订单编号)[：:\s]*[A-Z0-9\-]{4,}",
    "id_card": r"\b\d{17}[\dXx]\b",
    "phone": r"\b1[3-9]\d{9}\b",
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
}
# ---- End of fixed values. ----

UNICODE = "(?U)"
#: Cells of a table of distances that the built-in function still fills.
SMALL_TABLE = 10_000


def text_of(column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def strip(column: Column) -> Column:
    """Without white space at the ends, Unicode's included."""
    return F.regexp_replace(column, UNICODE + r"^\s+|\s+$", "")


def normalize_type(column: Column) -> Column:
    """Standard block type of a provider's type name: exact, else the first name that holds it or that it holds."""
    key = F.lower(strip(F.coalesce(column, F.lit(""))))
    table = F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair))
    fuzzy = F.lit(None).cast("string")
    for name, kind in reversed(TYPE_NAMES.items()):
        fuzzy = F.when(F.contains(key, F.lit(name)) | F.contains(F.lit(name), key), F.lit(kind)).otherwise(fuzzy)
    return F.coalesce(F.try_element_at(table, key), fuzzy, F.lit("paragraph"))


def normalize_text(column: Column) -> Column:
    """One kind of line end, stripped lines, at most one blank line in a row, stripped ends."""
    lines = F.regexp_replace(F.regexp_replace(column, "\r\n|\r", "\n"), UNICODE + r"[^\S\n]*\n[^\S\n]*", "\n")
    return strip(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def full_to_half(column: Column) -> Column:
    """Full-width signs as ASCII, with runs of white space as one space."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "。、【】「」　"
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + '.,[]"" '
    return strip(F.regexp_replace(F.translate(column, wide, plain), UNICODE + r"\s+", " "))


def collapse(column: Column) -> Column:
    return strip(F.regexp_replace(column, UNICODE + r"\s+", " "))


def numbering(column: Column) -> Column:
    """struct(level, number) of a heading's own numbering; level 0 if it has none."""
    text = strip(F.coalesce(column, F.lit("")))
    level, number = F.lit(0), F.lit("")
    for pattern, n in reversed(NUMBERINGS):
        hit = text.rlike(UNICODE + pattern)
        level = F.when(hit, F.lit(n)).otherwise(level)
        number = F.when(hit, F.regexp_replace(F.regexp_extract(text, UNICODE + pattern, 0), UNICODE + r"[\s.。]+$", "")).otherwise(number)
    return F.struct(level.cast("int").alias("level"), number.alias("number"))


def heading_level(text: Column, local_level: Column) -> Column:
    """Level by numbering, else the block's own level, else 1."""
    own = F.when(local_level.between(1, 6), local_level)
    return F.coalesce(F.nullif(numbering(text)["level"], F.lit(0)), own, F.lit(1)).cast("int")


def is_list_item(column: Column) -> Column:
    return F.coalesce(column, F.lit("")).rlike(UNICODE + LIST_ITEM)


def list_number(column: Column) -> Column:
    """Leading number of a list item; a Chinese numeral counts by its first character."""
    text = strip(F.coalesce(column, F.lit("")))
    digits = F.regexp_extract(text, r"^(\d+)", 1)
    chinese = F.nullif(F.instr(F.lit(CN), F.substring(text, 1, 1)), F.lit(0))
    return F.when(digits != "", digits.try_cast("int")).when(text != "", chinese).cast("int")


def keywords(column: Column) -> Column:
    """Distinct lower-case words of two characters or more, and every CJK character."""
    text = F.coalesce(column, F.lit(""))
    words = F.filter(F.split(F.lower(strip(text)), UNICODE + r"\s+"), lambda w: F.length(w) > 1)
    return F.array_union(words, F.regexp_extract_all(text, F.lit("([一-鿿])"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two keyword sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def content_hash(column: Column) -> Column:
    return F.substring(F.sha1(F.coalesce(column, F.lit(""))), 1, 16)


def stable_id(kind: str, *parts: Column) -> Column:
    """An id that depends only on its parts."""
    return F.concat(F.lit(kind + "-"), F.substring(F.sha1(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 12))


@F.pandas_udf(T.StringType())
def dict_hash(values: pd.Series) -> pd.Series:
    """Hash of a JSON object whatever the order of its keys."""

    def one(text):
        canonical = json.dumps(json.loads(text), sort_keys=True, ensure_ascii=False, separators=(",", ":"), default=str)
        return hashlib.sha1(canonical.encode()).hexdigest()[:16]

    return values.map(one, na_action="ignore")


def ratio(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp similarity of stripped texts; 0 if either is blank."""
    a, b = (a or "").strip(), (b or "").strip()
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of two columns. There is no built-in equivalent."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance. Equal ends and texts that others hold in order take linear time, others one step of whole columns a character."""
    a, b = sorted((a, b), key=len)
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    a, b = a[start:], b[start:]
    end = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), len(a))
    a, b = a[: len(a) - end], b[: len(b) - end]
    rest = iter(b)
    if all(c in rest for c in a):
        return len(b) - len(a)
    # Myers 1999, as Hyyrö 2003 has it: bits of up and down stand for the steps between a column's neighbours.
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, len(a) - 1
    up, down, distance = every, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        level = ((same & up) + up ^ up | same | down) & every
        more, less = down | every & ~(level | up), level & up
        distance += (more >> last) - (less >> last)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | every & ~(level | more), more & level
    return distance


@F.pandas_udf(T.IntegerType())
def _edit_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance of texts of any length: the built-in function fills a whole table, which only short ones bear."""
    long = F.length(a).cast("long") * F.length(b) > SMALL_TABLE
    return F.when(long, _edit_distances(F.when(long, a), F.when(long, b))).otherwise(F.levenshtein(a, b))


def critical_fields(column: Column) -> Column:
    """array<struct(kind, value)>: every match of every kind of field, whole matches, stripped."""

    def of_kind(kind: str, pattern: str) -> Column:
        hits = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(UNICODE + pattern), F.lit(0))
        return F.transform(hits, lambda v: F.struct(F.lit(kind).alias("kind"), strip(v).alias("value")))

    return F.concat(*(of_kind(k, p) for k, p in FIELDS.items()))


def critical_field_spans(column: Column) -> Column:
    """array<struct(kind, value, start, end)> with places in characters."""
    schema = "array<struct<kind:string,value:string,start:int,end:int>>"

    @F.pandas_udf(schema)
    def spans(texts: pd.Series) -> pd.Series:
        import re

        rules = [(k, re.compile(p)) for k, p in FIELDS.items()]
        return texts.map(lambda t: [{"kind": k, "value": m.group(0).strip(), "start": m.start(), "end": m.end()} for k, r in rules for m in r.finditer(t or "")])

    return spans(F.coalesce(column, F.lit("")))


def without_fence(column: Column) -> Column:
    """The inside of a Markdown code fence around the whole text, else the text."""
    text = strip(F.coalesce(column, F.lit("")))
    fence = r"(?s)^```(?:json)?\s*\n?(.*?)\n?```\s*$"
    return F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text)


def masked(column: Column) -> Column:
    """A secret with all but its last four characters hidden; short ones hidden whole."""
    shown = F.when(F.length(column) > 4, F.right(column, F.lit(4))).otherwise("")
    return F.when(F.length(column) > 0, F.concat(F.lit("***"), shown)).otherwise("")


def points_to_emu(column: Column) -> Column:
    return (column * 12700).cast("long")
