"""Block operators: page sizes, noise, validity, order, nodes. Blocks are keyed by doc_id and ordered by pos.

blocks: doc_id, pos, page_id, block_id, bbox struct(x1, y1, x2, y2), block_type,
local_level, text, confidence, model_version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, text

PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0
MARGIN_SHARE, MARGIN_TEXT = 0.05, 50


def _needs_text() -> Column:
    return ~F.col("block_type").isin(*text.WITHOUT_TEXT)


def _page() -> Window:
    return Window.partitionBy("doc_id", "page_id")


def with_page_size(blocks: DataFrame) -> DataFrame:
    """``page_width`` and ``page_height`` from the blocks of a page, ten points beyond them and a standard page at least."""
    b = F.col("bbox")
    wide = F.greatest(F.max(b["x2"] + 10).over(_page()), F.lit(PAGE_WIDTH))
    tall = F.greatest(F.max(b["y2"] + 10).over(_page()), F.lit(PAGE_HEIGHT))
    return blocks.withColumn("page_width", wide).withColumn("page_height", tall)


def validate(blocks: DataFrame, *ties: Column) -> DataFrame:
    """Sound blocks, the first of each page, corner (to a tenth) and type; titles without a level get 1 and less confidence.

    Where places tie, ``ties`` say which block is the first.
    """
    b = F.col("bbox")
    sound = blocks.where((text.strip(text.text_of("block_id")) != "") & (F.col("page_id") >= 1) & (boxes.width(b) > 0) & (boxes.height(b) > 0))
    level = F.coalesce(F.col("local_level"), F.lit(0))
    odd = (F.col("block_type") == "title") & ~level.between(1, 6)
    sound = sound.withColumn("confidence", F.when(odd, F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")))
    sound = sound.withColumn("local_level", F.when(odd, F.lit(1)).otherwise(F.col("local_level")))
    same = Window.partitionBy("doc_id", "page_id", F.bround(b["x1"], 1), F.bround(b["y1"], 1), "block_type").orderBy("pos", *ties)
    return sound.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def inside_page(blocks: DataFrame, width: Column, height: Column, min_area: float = 1.0) -> DataFrame:
    """Blocks on the page, of some area, with text where their type needs it, titles with a level."""
    b = F.col("bbox")
    on = (b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= width + 1) & (b["y2"] <= height + 1)
    area = boxes.width(b) * boxes.height(b) >= min_area
    said = (text.text_of("text") != "") | ~_needs_text()
    level = (F.col("block_type") != "title") | F.coalesce(F.col("local_level").between(1, 6), F.lit(False))
    return blocks.where(on & area & said & level)


def without_noise(blocks: DataFrame) -> DataFrame:
    """Blocks without short headers and footers, and without empty ones where their type needs text."""
    b = F.col("bbox")
    tall = F.greatest(F.lit(PAGE_HEIGHT), F.max(b["y2"]).over(_page()))
    edge = (b["y2"] < tall * MARGIN_SHARE) | (b["y1"] > tall * (1 - MARGIN_SHARE))
    drop = (edge & (F.length(text.text_of("text")) < MARGIN_TEXT)) | ((text.text_of("text") == "") & _needs_text())
    return blocks.withColumn("_drop", drop).where("NOT _drop").drop("_drop")


def reading_order(blocks: DataFrame) -> DataFrame:
    """``position``: the place of each block of a document by page, top and left edge."""
    b = F.col("bbox")
    order = Window.partitionBy("doc_id").orderBy("page_id", b["y1"], b["x1"], "pos")
    return blocks.withColumn("position", F.row_number().over(order))


def preprocess(blocks: DataFrame) -> DataFrame:
    """Order, noise filter, text normalisation and a review flag for titles without text."""
    x = without_noise(reading_order(blocks)).withColumn("text", text.normalize_text(text.text_of("text")))
    empty = (F.col("block_type") == "title") & (F.col("text") == "")
    return x.withColumn("need_review", empty).withColumn("review_reason", F.when(empty, "标题块无文本"))


def adapt(blocks: DataFrame, raw_type: str = "raw_type", raw_bbox: str = "raw_bbox", version: str = "") -> DataFrame:
    """A provider's blocks (raw type names and number lists) as standard blocks: types, boxes, checks, page filter, version."""
    x = blocks.withColumn("block_type", text.normalize_type(F.col(raw_type)))
    x = x.withColumn("bbox", boxes.box(*(F.try_element_at(F.col(raw_bbox), F.lit(i)) for i in (1, 2, 3, 4))))
    x = with_page_size(x).withColumn("bbox", boxes.align(F.col(raw_bbox), F.col("page_width"), F.col("page_height")))
    x = inside_page(validate(x), F.col("page_width"), F.col("page_height"))
    own = F.col("model_version") if "model_version" in x.columns else F.lit(None).cast("string")
    return x.withColumn("model_version", F.coalesce(F.nullif(own, F.lit("")), F.lit(version)))


def to_nodes(blocks: DataFrame) -> DataFrame:
    """Blocks as tree nodes: type, page range, hash, where they come from, a first heading level."""
    kind = F.when(F.col("block_type") == "title", "heading").otherwise(F.col("block_type"))
    layer = F.coalesce(F.col("model_version").rlike("^(mock|fallback)-"), F.lit(False))
    return blocks.select(
        "doc_id", "pos", F.col("block_id").alias("node_id"), kind.alias("node_type"), "text", "page_id", F.array("page_id", "page_id").alias("page_range"), "bbox", "confidence", "model_version",
        text.content_hash(F.col("text")).alias("content_hash"), F.when(layer, "PDF文本层").otherwise("纯视觉识别").alias("provenance"),
        F.when(kind == "heading", F.coalesce(F.col("local_level"), F.lit(1))).alias("global_level"),
    )
