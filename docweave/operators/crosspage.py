"""Paragraphs, lists and tables that a page break splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

PARAGRAPH_OVERLAP, HEADER_OVERLAP, INDENT = 0.30, 0.80, 30.0


def _facing(blocks: DataFrame, depth: int, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The last ``depth`` blocks of each page and the first of the next page that has any, of those that ``keep`` says."""
    page = Window.partitionBy("doc_id", "page_id")
    x = blocks.withColumn("_first", F.row_number().over(page.orderBy("pos"))).withColumn("_last", F.row_number().over(page.orderBy(F.desc("pos"))))
    pages = blocks.select("doc_id", "page_id").distinct().withColumn("next_page", F.lead("page_id").over(Window.partitionBy("doc_id").orderBy("page_id")))
    tails = x.where((F.col("_last") <= depth) & keep).join(pages.where("next_page IS NOT NULL"), ["doc_id", "page_id"])
    heads = x.where((F.col("_first") <= depth) & keep)
    tails = tails.select("doc_id", "next_page", F.struct("pos", "block_id", "text", "bbox").alias("tail"))
    heads = heads.select("doc_id", F.col("page_id").alias("next_page"), F.struct("pos", "block_id", "text", "bbox").alias("head"))
    return tails, heads


def _first_head(pairs: DataFrame) -> DataFrame:
    first = pairs.groupBy("doc_id", F.col("tail")["pos"].alias("tail_pos")).agg(F.min_by(F.struct("tail", "head"), F.col("head")["pos"]).alias("p"))
    return first.select("doc_id", F.col("p.tail.block_id").alias("tail_id"), F.col("p.head.block_id").alias("head_id"), F.col("p.tail.pos").alias("tail_pos"), F.col("p.head.pos").alias("head_pos"))


def split_paragraphs(blocks: DataFrame) -> DataFrame:
    """Pairs of paragraphs (tail, head): the tail doesn't end a sentence and their keywords overlap."""
    tails, heads = _facing(blocks, 3, F.col("block_type") == "paragraph")
    said = lambda c: text.text_of(F.col(c)["text"])
    ends = F.substring(F.regexp_replace(said("tail"), text.UNICODE + r"\s+$", ""), -1, 1).isin(*text.SENTENCE_ENDS)
    # Words are found once a block and side, not for each pair and each use; a pair without a common word can't overlap.
    words = lambda df, c: df.select("doc_id", "next_page", F.struct(F.col(c)["pos"].alias("pos"), F.col(c)["block_id"].alias("block_id")).alias(c), F.explode(F.array(text.keywords(said(c)))).alias(f"{c}_words")).where(F.size(f"{c}_words") > 0)
    tails, heads = words(tails.where((said("tail") != "") & ~ends), "tail"), words(heads.where(said("head") != ""), "head")
    common = F.size(F.array_intersect("tail_words", "head_words"))
    overlap = common / (F.size("tail_words") + F.size("head_words") - common)
    return _first_head(tails.join(heads, ["doc_id", "next_page"]).where(overlap >= PARAGRAPH_OVERLAP))


def split_lists(blocks: DataFrame) -> DataFrame:
    """Pairs of list items: the head's number is the tail's plus one and their left edges agree."""
    tails, heads = _facing(blocks, 5, text.is_list_item(F.col("text")))
    next_number = text.list_number(F.col("head")["text"]) == text.list_number(F.col("tail")["text"]) + 1
    near = F.abs(F.col("tail")["bbox"]["x1"] - F.col("head")["bbox"]["x1"]) < INDENT
    return _first_head(tails.join(heads, ["doc_id", "next_page"]).where(next_number & near))


def split_tables(tables: DataFrame) -> DataFrame:
    """Pairs of neighbouring tables on consecutive pages with as many columns and like headers."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    after = F.lead(F.struct("object_id", "page_id", "col_count", "cell_matrix")).over(order)
    header = lambda m: F.array_join(F.coalesce(F.try_element_at(m, F.lit(1)), F.array().cast("array<string>")), " ")
    x = tables.withColumn("b", after)
    overlap = text.jaccard(text.keywords(header(F.col("cell_matrix"))), text.keywords(header(F.col("b")["cell_matrix"])))
    x = x.withColumn("overlap", overlap).where((F.col("b")["page_id"] - F.col("page_id") == 1) & F.col("col_count").eqNullSafe(F.col("b")["col_count"]) & (F.col("overlap") >= HEADER_OVERLAP))
    return x.select("doc_id", F.col("object_id").alias("upper_id"), F.col("b")["object_id"].alias("lower_id"), "overlap")
