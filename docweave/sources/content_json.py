"""Blocks from a layout provider's JSON, Markdown and line files; annotations; text lines.

All readers take a DataFrame of (doc_id, content) or (doc_id, path, content), so
the files may come from any store that Spark reads.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..functions.folds import unfold

# ---- Fixed values: type names of the provider's files. ----
TITLES = ("title", "heading", "head")
V2_NAMES = {
    "table": "table", "image": "image", "figure": "image", "picture": "image", "equation": "formula", "formula": "formula",
    "list": "list", "list_item": "list", "list-item": "list", "caption": "caption", "figure_caption": "caption", "table_caption": "caption",
}
# ---- End of fixed values. ----
TABLE_TEXT = 200
BLOCK = "page_id int, item int, raw_type string, level string, text string, bbox array<double>, score double, error string"
TITLE_SIZE, TITLE_LENGTH = 13.5, 80


def provider_type(raw: Column) -> Column:
    """Block type of a provider's type name, whatever its case."""
    key = F.lower(F.coalesce(raw, F.lit("text")))
    names = F.create_map(*(F.lit(x) for pair in V2_NAMES.items() for x in pair))
    return F.when(key.isin(*TITLES), "title").otherwise(F.coalesce(F.try_element_at(names, key), F.lit("paragraph")))


def _text_of_item(content, raw_type: str) -> str:
    """Text of a v2 item: a string, the parts of its own list, or every text below it.

    The nesting is free, so this walk is not an expression.
    """
    if isinstance(content, str):
        return content.strip()
    if not isinstance(content, dict):
        return ""
    own = content.get(f"{raw_type}_content")
    if isinstance(own, list):
        parts = [p if isinstance(p, str) else (p.get("content") or p.get("text") or "") for p in own if isinstance(p, str | dict)]
        return "\n".join(map(str, parts)).strip()
    found: list[str] = []
    waiting = [content]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            found.append(x)
        elif isinstance(x, list):
            waiting.extend(reversed(x))
        elif isinstance(x, dict):
            for k, v in reversed(x.items()):
                if k in ("text", "content") and isinstance(v, str) or isinstance(v, dict | list):
                    waiting.append(v)
    return " ".join(found).strip()


def _number(value, default):
    try:
        return float(value)
    except (TypeError, ValueError, OverflowError):
        return default


def _item(page, i: int, raw, level, said, box, score) -> tuple | None:
    """A row of BLOCK without its error, or None if the item has no box of four numbers or no page."""
    box = [_number(v, None) for v in box or [0, 0, 0, 0]] if isinstance(box, list | None) else []
    page = _number(page, None)
    if len(box) != 4 or None in box or page is None or not -(1 << 31) < page < 1 << 31:
        return None
    return int(page), i, str(raw or "text"), None if level is None else str(level), said, box, score


def _string(value) -> str:
    return value.strip() if isinstance(value, str) else "" if value is None or isinstance(value, dict | list) else str(value)


def _items(value) -> list[tuple[int, dict]]:
    """The objects of a list, with their places; what else it holds is skipped."""
    return [(i, x) for i, x in enumerate(value if isinstance(value, list) else []) if isinstance(x, dict)]


def parse_v2(data) -> list[tuple | None]:
    rows = []
    for page, items in enumerate(data if isinstance(data, list) else []):
        for i, item in _items(items):
            raw, content = str(item.get("type") or "text"), item.get("content") or {}
            rows.append(_item(page + 1, i, raw, content.get("level") if isinstance(content, dict) else None, _text_of_item(content, raw), item.get("bbox"), 0.9))
    return rows


def parse_v1(data) -> list[tuple | None]:
    return [_item(_number(item.get("page_idx") or 0, float("nan")) + 1, i, item.get("type"), None, _string(item.get("text")), item.get("bbox"), 0.9) for i, item in _items(data)]


def parse_layout(data) -> list[tuple | None]:
    rows = []
    for key, value in data.items() if isinstance(data, dict) else ():
        number = key.removeprefix("page_")
        if number == key or not number.lstrip("-").isdigit() or not isinstance(value, dict):
            continue
        for i, b in _items(value.get("blocks") or value.get("para_blocks")):
            rows.append(_item(int(number) + 1, i, b.get("type") or b.get("block_type"), None, _string(b.get("text") or b.get("content")), b.get("bbox"), _number(b.get("score", 0.85), 0.85)))
    return rows


PARSERS = {"v2": parse_v2, "v1": parse_v1, "layout": parse_layout}


def _parsed(files: DataFrame, kind: str) -> DataFrame:
    """(doc_id, content) as rows of BLOCK; what can't be read is a row with an error."""

    def read(content: str):
        try:
            data = json.loads(content or "")
        except (ValueError, RecursionError) as e:
            yield *(None,) * 7, f"not JSON: {e}"
            return
        rows = PARSERS[kind](data)
        yield from ((*row, None) for row in rows if row is not None)
        if skipped := rows.count(None):
            yield *(None,) * 7, f"{skipped} items without a page or a box of four numbers"
        elif not isinstance(data, dict if kind == "layout" else list):
            yield *(None,) * 7, f"not the shape of {kind}"

    return unfold(files, "content", read, BLOCK)


def file_errors(files: DataFrame, kind: str) -> DataFrame:
    """(doc_id, error) of what can't be read in files (doc_id, content) of a kind: v2, v1 or layout."""
    return _parsed(files, kind).where("error IS NOT NULL").select("doc_id", "error")


def _read(files: DataFrame, kind: str) -> DataFrame:
    """(doc_id, content) as blocks; files that are not JSON give none, nor do items without a box."""
    rows = _parsed(files, kind).where("error IS NULL")
    block = provider_type(F.col("raw_type"))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.col("level").try_cast("int"), F.lit(1))))
    said = F.when((block == "table") & F.lit(kind != "layout"), F.substring("text", 1, TABLE_TEXT)).otherwise(F.col("text"))
    return rows.select(
        "doc_id", (F.col("page_id") * 1_000_000 + F.col("item")).alias("pos"), "page_id", text.stable_id("block", F.col("doc_id"), F.col("page_id"), F.col("item")).alias("block_id"),
        boxes.box(*(F.col("bbox")[i] for i in range(4))).alias("bbox"), block.alias("block_type"), F.when(block == "title", level).alias("local_level"), said.alias("text"), F.col("score").alias("confidence"), F.lit("mineru-vlm-api").alias("model_version"),
    )


def content_list_v2(files: DataFrame) -> DataFrame:
    """Pages of items with nested content; titles keep their level, one to six."""
    return _read(files, "v2")


def content_list_v1(files: DataFrame) -> DataFrame:
    """A flat list of items, each with its page."""
    return _read(files, "v1")


def layout_json(files: DataFrame) -> DataFrame:
    """Objects named page_N with their blocks and scores."""
    return _read(files, "layout")


def markdown(files: DataFrame) -> DataFrame:
    """Whole files as one paragraph each."""
    said = F.regexp_replace(F.regexp_replace(text.text_of("content"), "\r\n|\r", "\n"), "\n$", "")
    return files.select(
        "doc_id", F.lit(0).alias("pos"), F.lit(1).alias("page_id"), text.stable_id("block", F.col("doc_id"), F.lit(1), F.lit(0)).alias("block_id"), boxes.box(*map(F.lit, (0, 0, 595, 842))).alias("bbox"),
        F.lit("paragraph").alias("block_type"), F.lit(None).cast("int").alias("local_level"), said.alias("text"), F.lit(0.8).alias("confidence"), F.lit("mineru-vlm-api").alias("model_version"),
    )


def chosen_files(files: DataFrame) -> DataFrame:
    """Of each document's files (doc_id, path, content) the one to read, and its ``format``: v2, v1, layout, other JSON, Markdown."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    rank = (
        F.when(name.endswith("_content_list_v2.json"), 0).when(name.endswith("_content_list.json"), 1).when(name.contains("layout") & name.endswith(".json"), 2)
        .when(name.endswith(".json") & ~name.contains("_content_list"), 3).when(name.endswith(".md"), 4)
    )
    best = files.withColumn("r", rank).where("r IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct("path", "content", "r"), F.struct("r", "path")).alias("f"))
    formats = F.array(*map(F.lit, ("v2", "v1", "layout", "layout", "markdown")))
    return best.select("doc_id", "f.path", "f.content", F.element_at(formats, F.col("f.r") + 1).alias("format"))


def provider_output(files: DataFrame) -> DataFrame:
    """Blocks of each document from the best of its files."""
    best = chosen_files(files)
    readers = {"v2": content_list_v2, "v1": content_list_v1, "layout": layout_json, "markdown": markdown}
    parts = [reader(best.where(F.col("format") == name).select("doc_id", "content")) for name, reader in readers.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rule_blocks(spans: DataFrame) -> DataFrame:
    """A block for each text line of page objects (doc_id, page_id, line, pos, text, font_size, bbox), typed by size, numbering and list marks."""
    b = F.col("bbox")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "")
    lines = spans.groupBy("doc_id", "page_id", "line").agg(
        said.alias("text"), F.max("font_size").alias("size"), F.min("pos").alias("pos"), boxes.box(F.min(b["x1"]), F.min(b["y1"]), F.max(b["x2"]), F.max(b["y2"])).alias("bbox")
    )
    lines = lines.withColumn("text", text.strip(F.col("text"))).where("text <> ''").withColumn("n", text.numbering(F.col("text")))
    level = F.when((F.col("size") >= TITLE_SIZE) & (F.length("text") < TITLE_LENGTH), 1).when(F.col("n.level") > 0, F.col("n.level"))
    item = F.col("text").rlike(text.UNICODE + r"^\s*\d+[.)、]|^\s*[-•·*]")
    kind = F.when(level.isNotNull(), "title").when(item, "list").otherwise("paragraph")
    return lines.select(
        "doc_id", "pos", "page_id", text.stable_id("block", F.col("doc_id"), F.col("page_id"), F.col("line")).alias("block_id"), "bbox", kind.alias("block_type"), level.alias("local_level"), "text", F.lit(0.85).alias("confidence"), F.lit("mock-pymupdf-1").alias("model_version"),
    )


def table_objects(tables: DataFrame) -> DataFrame:
    """Page tables with stripped cells, null as empty; tables without any text go."""
    clean = F.transform("cell_matrix", lambda row: F.transform(row, lambda c: text.strip(F.coalesce(c, F.lit("")))))
    x = tables.withColumn("cell_matrix", clean).where(F.exists("cell_matrix", lambda row: F.exists(row, lambda c: c != "")))
    return x.withColumn("kind", F.lit("table")).withColumn("row_count", F.size("cell_matrix")).withColumn("col_count", F.array_max(F.transform("cell_matrix", lambda row: F.size(row))))


def image_objects(images: DataFrame) -> DataFrame:
    """A row for each place of an image (doc_id, page_id, xref, content, rects), named by page, number and hash; unreadable ones go."""
    x = images.where("content IS NOT NULL AND size(rects) > 0").withColumn("hash", F.substring(F.sha1("content"), 1, 12))
    named = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit("_x"), F.col("xref").cast("string"), F.lit("_"), "hash")
    return x.select("doc_id", "page_id", "xref", "hash", named.alias("image_ref"), F.lit("image").alias("kind"), F.explode("rects").alias("bbox")).withColumn("width", boxes.width(F.col("bbox"))).withColumn("height", boxes.height(F.col("bbox")))


def text_objects(spans: DataFrame) -> DataFrame:
    """Text spans that are not blank, stripped."""
    return spans.withColumn("text", text.strip(text.text_of("text"))).where("text <> ''").withColumn("kind", F.lit("text_span"))


def page_objects(spans: DataFrame, images: DataFrame, tables: DataFrame) -> DataFrame:
    """All objects of the pages, with the columns of any kind."""
    return text_objects(spans).unionByName(image_objects(images), allowMissingColumns=True).unionByName(table_objects(tables), allowMissingColumns=True)


ANNOTATION = (
    "document_id string, docx_path string, dirt_level string, annotations array<struct<id:string,type:string,page:int,global_level:int,parent_id:string,sort_key:int,"
    "table_dims:struct<rows:int,cols:int>,cell_matrix:array<array<string>>,cross_page_pair:string,text:string>>, review_metadata struct<reviewer:string,review_time:string,notes:string>"
)


def annotations(files: DataFrame) -> DataFrame:
    """One row an annotation from (path, content) files; those that are not JSON go."""
    rows = files.select(F.regexp_extract("path", r"([^/]*?)(?:_annotations)?\.json$", 1).alias("stem"), F.from_json("content", ANNOTATION).alias("a")).where("a.annotations IS NOT NULL")
    return rows.select("stem", F.col("a.document_id").alias("doc_id"), F.coalesce("a.dirt_level", F.lit("unknown")).alias("dirt_level"), F.posexplode("a.annotations").alias("pos", "x")).select("stem", "doc_id", "dirt_level", "pos", "x.*")


def paired(documents: DataFrame, annotated: DataFrame) -> DataFrame:
    """Documents (path) with annotations of the same stem; the others go."""
    stem = F.regexp_extract("path", r"([^/]*)\.docx$", 1)
    return documents.withColumn("stem", stem).join(annotated.select("stem").distinct(), "stem", "left_semi")


def latest_annotations(edits: DataFrame) -> DataFrame:
    """Of the edits (doc_id, block_id, at, ...) of each block the last, with an id and a sort key."""
    x = edits.groupBy("doc_id", "block_id").agg(F.max_by(F.struct(*edits.columns), "at").alias("r")).select("r.*")
    return x.withColumn("id", F.coalesce(F.nullif("id", F.lit("")), "block_id") if "id" in edits.columns else F.col("block_id")).withColumn("sort_key", F.coalesce("sort_key", F.lit(0)) if "sort_key" in edits.columns else F.lit(0))


def annotation_files(blocks: DataFrame, edits: DataFrame, dirt_level: str = "medium", reviewer: str = "") -> DataFrame:
    """One annotation object a document: each block with its latest edit.

    ``edits`` has doc_id, block_id, at (its time) and any of type, global_level,
    parent_id, sort_key, text and deleted; a field that is null leaves the
    block's own, and a block that was last deleted goes. Edits of blocks that
    the document lacks add some.
    """
    last = edits
    for name, kind in (("type", "string"), ("global_level", "int"), ("parent_id", "string"), ("sort_key", "int"), ("text", "string"), ("deleted", "boolean")):
        last = last if name in last.columns else last.withColumn(name, F.lit(None).cast(kind))
    last = last.groupBy("doc_id", "block_id").agg(F.max_by(F.struct("type", "global_level", "parent_id", "sort_key", "text", "deleted"), "at").alias("e"))
    own = blocks.select("doc_id", "block_id", F.when(F.col("block_type") == "title", "heading").otherwise(F.col("block_type")).alias("type"), "page_id", "pos", "local_level", F.col("text").alias("said"))
    x = own.join(last, ["doc_id", "block_id"], "full").where("NOT coalesce(e.deleted, false)")
    order = F.coalesce("e.sort_key", F.col("pos").cast("int"), F.lit(1 << 30))
    one = F.struct(
        order.alias("sort_key"), F.col("block_id").alias("id"), F.coalesce("e.type", "type", F.lit("paragraph")).alias("type"), F.col("page_id").alias("page"),
        F.coalesce("e.global_level", "local_level").alias("global_level"), F.nullif("e.parent_id", F.lit("")).alias("parent_id"), F.coalesce("e.text", "said", F.lit("")).alias("text"),
    )
    meta = F.struct(F.lit(reviewer).alias("reviewer"), F.lit("").alias("notes")).alias("review_metadata")
    return x.groupBy(F.col("doc_id").alias("document_id")).agg(F.sort_array(F.collect_list(one)).alias("annotations")).select("document_id", F.lit(dirt_level).alias("dirt_level"), "annotations", meta)


def write_images(images: DataFrame, folder: str) -> DataFrame:
    """Writes each image (content) of ``image_objects``' inputs once, named as they are, into a folder that all executors share; (doc_id, image_ref, path, n_bytes, error).

    The result must be used for the files to be written.
    """
    from ..functions.folds import unfold

    place = folder.removeprefix("file://")
    if "://" in place:
        raise ValueError("images are written to mounted folders only")
    named = image_objects(images).select("doc_id", "image_ref", "page_id", "xref").distinct()
    x = images.select("doc_id", "page_id", "xref", "content").dropDuplicates(["doc_id", "page_id", "xref"]).join(named, ["doc_id", "page_id", "xref"])

    def write(row: dict):
        import os

        path = os.path.join(place, str(row["doc_id"]), row["image_ref"] + ".bin")
        try:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(f"{path}.part", "wb") as f:
                f.write(row["content"])
            os.replace(f"{path}.part", path)
            yield row["image_ref"], path, len(row["content"]), None
        except OSError as e:
            yield row["image_ref"], path, 0, str(e)

    return unfold(x.select("doc_id", F.struct("doc_id", "image_ref", "content").alias("row")), "row", write, "image_ref string, path string, n_bytes bigint, error string")
