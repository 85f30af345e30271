"""From blocks and page objects to trees, alignment, conflicts and rendered files, for many documents at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocks as B
from ..operators import render, tree, verify


@dataclass
class Result:
    nodes: DataFrame
    headers: DataFrame
    alignment: DataFrame
    alignment_counts: DataFrame
    conflicts: DataFrame
    captions: DataFrame


def joined_text(rows: DataFrame, column: str = "text", name: str = "text") -> DataFrame:
    """The non-empty texts of each document in order, with a space between them."""
    ordered = F.sort_array(F.collect_list(F.when(text.text_of(column) != "", F.struct("pos", column))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda r: r[column]), " ").alias(name))


def run(blocks: DataFrame, objects: DataFrame, partitions: int | None = None) -> Result:
    """All results of documents from their blocks and page objects.

    Both inputs are dealt by document once; the windows, joins and folds below
    reuse that.
    """
    deal = lambda df: df.repartition(partitions, "doc_id") if partitions else df.repartition("doc_id")
    blocks, objects = deal(blocks), deal(objects)
    ready = B.preprocess(blocks)
    tables = objects.where("kind = 'table'")
    spans = objects.where("kind = 'text_span'")
    nodes = B.to_nodes(ready)
    filled = tree.nearest_tables(nodes.where("node_type = 'table'").select("doc_id", "node_id", "page_id", "bbox"), tables)
    added = tree.missing_tables(filled.select("doc_id", "cell_matrix"), tables, nodes.where("node_type = 'heading'"))
    built = tree.build_tree(ready, added)
    # The nearest table's cells go to the table nodes that have none.
    mine = filled.select("doc_id", "node_id", F.col("cell_matrix").alias("_m"), F.col("row_count").alias("_r"), F.col("col_count").alias("_c"), "check")
    built = built.join(mine, ["doc_id", "node_id"], "left")
    built = built.withColumns({"cell_matrix": F.coalesce("cell_matrix", "_m"), "row_count": F.coalesce("row_count", "_r"), "col_count": F.coalesce("col_count", "_c")}).drop("_m", "_r", "_c")
    captions = tree.pair_captions(nodes)
    flagged = captions.where("need_review").select("doc_id", F.col("image_id").alias("node_id"), F.lit(True).alias("need_review"), F.lit("图片未找到匹配图注").alias("review_reason"))
    built = built.join(flagged, ["doc_id", "node_id"], "left").withColumn("need_review", F.coalesce("need_review", F.lit(False)))
    alignment = verify.align(ready, spans)
    both = joined_text(ready, name="vlm_text").join(joined_text(spans, name="pdf_text"), "doc_id", "left").withColumn("pdf_text", F.coalesce("pdf_text", F.lit("")))
    return Result(built, tree.document_headers(built), alignment, verify.level_counts(alignment), verify.verify_fields(both), captions)


def write(result: Result, path: str) -> None:
    """Nodes, alignment and conflicts under ``path``, and from the stored nodes trees as JSON lines, files and headers."""
    spark = result.nodes.sparkSession

    def table(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    nodes = table(result.nodes, "nodes")
    render.tree_json(nodes).write.mode("overwrite").json(f"{path}/trees")
    render.render(nodes).write.mode("overwrite").parquet(f"{path}/files")
    tree.document_headers(nodes).write.mode("overwrite").json(f"{path}/headers")
    verify.level_counts(table(result.alignment, "alignment")).write.mode("overwrite").json(f"{path}/alignment_counts")
    result.conflicts.write.mode("overwrite").json(f"{path}/conflicts")
