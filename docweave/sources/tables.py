"""Blocks, headings, boxes, lists and tables derived from the star-schema, documents and pages tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes

ELEMENT = r"<(title|h1|p|li|a|b|footer)[^>]*>([^<]*)"
LINES_PER_PAGE = 40


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph block for each line of ``documents``, forty to a page."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "text"))
    row = F.col("pos") % LINES_PER_PAGE
    y1 = (row * 20 + 10).cast("double")
    return lines.select(
        "doc_id", "pos", (F.floor(F.col("pos") / LINES_PER_PAGE) + 1).cast("int").alias("page_id"), F.concat(F.lit("b"), F.col("pos").cast("string")).alias("block_id"),
        boxes.box(F.lit(50), y1, F.lit(545), y1 + 12).alias("bbox"), F.lit("paragraph").alias("block_type"), F.lit(None).cast("int").alias("local_level"), "text", F.lit(0.9).alias("confidence"), F.lit("mock-lines").alias("model_version"),
    )


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered headings of three levels: regions, their nations, their customers; one document a region."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rk, nk = (F.col("r_regionkey") + 1).cast("string"), (F.col("n_nationkey") + 1).cast("string")
    rn = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    top = r.select(F.col("r_regionkey").alias("doc_id"), F.lit(0).alias("a"), F.lit(0).cast("long").alias("b"), F.concat(rk, F.lit(". "), "r_name").alias("text"))
    middle = rn.select(F.col("r_regionkey").alias("doc_id"), (F.col("n_nationkey") + 1).alias("a"), F.lit(0).cast("long").alias("b"), F.concat(rk, F.lit("."), nk, F.lit(" "), "n_name").alias("text"))
    leaf = c.join(rn, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("r_regionkey").alias("doc_id"), (F.col("n_nationkey") + 1).alias("a"), (F.col("c_custkey") + 1).alias("b"), F.concat(rk, F.lit("."), nk, F.lit("."), F.col("c_custkey").cast("string"), F.lit(" "), "c_name").alias("text")
    )
    order = Window.partitionBy("doc_id").orderBy("a", "b")
    rows = top.union(middle).union(leaf).withColumn("pos", F.row_number().over(order))
    return rows.select("doc_id", "pos", F.concat(F.lit("h"), F.col("pos").cast("string")).alias("node_id"), "text", F.lit(1).alias("global_level"), F.lit(1).alias("page_id"))


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, heading, paragraph, list, bold and footer texts of ``pages`` in order, as blocks."""
    html = F.coalesce("html", F.lit(""))
    tags, texts = F.regexp_extract_all(html, F.lit(ELEMENT), F.lit(1)), F.regexp_extract_all(html, F.lit(ELEMENT), F.lit(2))
    rows = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.posexplode(F.arrays_zip(tags.alias("tag"), texts.alias("text"))).alias("pos", "e")).select("doc_id", "pos", "e.tag", "e.text")
    kind = F.when(F.col("tag").isin("title", "h1"), "title").when(F.col("tag").isin("li", "a"), "list").otherwise("paragraph")
    y1 = F.when(F.col("tag") == "footer", 820.0).otherwise(F.least(F.lit(50.0) + F.col("pos") * 10, F.lit(790.0)))
    return rows.select(
        "doc_id", "pos", F.lit(1).alias("page_id"), F.concat(F.lit("e"), F.col("pos").cast("string")).alias("block_id"), boxes.box(F.lit(50), y1, F.lit(545), y1 + 8).alias("bbox"),
        kind.alias("block_type"), F.when(kind == "title", 1).alias("local_level"), "text", F.lit(0.85).alias("confidence"), F.lit("mock-html").alias("model_version"), "tag",
    )


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as boxes on pages of three; ``file`` and ``row`` are their place in the table."""
    x1, y1 = F.col("l_partkey") % 600 - 5, F.col("l_suppkey") * 7 % 850
    kind = F.element_at(F.array(*map(F.lit, ("title", "table", "image", "caption", "paragraph"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), (F.floor((F.col("l_linenumber") - 1) / 3) + 1).cast("int").alias("page_id"),
        F.concat(F.lit("l"), F.col("l_linenumber").cast("string")).alias("block_id"), boxes.box(x1, y1, x1 + F.col("l_quantity") - 1, y1 + F.floor(F.col("l_quantity") / 2)).alias("bbox"),
        kind.alias("block_type"), F.when(kind == "title", (F.col("l_partkey") % 9).cast("int")).alias("local_level"), F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_linestatus")).alias("text"), F.lit(0.9).alias("confidence"), F.lit("").alias("model_version"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )


def order_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as numbered list items, seven to a page."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), n.alias("pos"), "o_orderpriority", "o_orderkey")
    x1 = (50 + F.col("o_orderkey") % 3 * 20).cast("double")
    return rows.select(
        "doc_id", "pos", (F.floor((F.col("pos") - 1) / 7) + 1).cast("int").alias("page_id"), F.concat(F.lit("o"), F.col("pos").cast("string")).alias("block_id"),
        boxes.box(x1, F.col("pos") % 7 * 20, x1 + 200, F.col("pos") % 7 * 20 + 12).alias("bbox"), F.lit("list").alias("block_type"), F.concat(F.col("pos").cast("string"), F.lit(". "), "o_orderpriority").alias("text"),
    )


def nation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations of a region as tables of two columns, two nations each, under a header that names the table's parity."""
    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    rows = read(spark, sf_dir, "nation").withColumn("t", F.floor((F.row_number().over(order) - 1) / 2).cast("int"))
    body = rows.groupBy("n_regionkey", "t").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    header = F.array(F.lit("key number"), F.when(F.col("t") < 2, "nation name").otherwise("state name"))
    matrix = F.concat(F.array(header), F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    return body.select(
        F.col("n_regionkey").alias("doc_id"), F.col("t").alias("pos"), F.concat(F.lit("t"), F.col("t").cast("string")).alias("object_id"), (F.col("t") + 1).alias("page_id"),
        boxes.box(F.lit(50), F.col("t") * 100 + 50, F.lit(300), F.col("t") * 100 + 120).alias("bbox"), F.size(matrix).alias("row_count"), F.lit(2).alias("col_count"), matrix.alias("cell_matrix"),
    )
