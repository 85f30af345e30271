"""Document trees from blocks: heading levels and parents, chapters, reading order, tables, captions.

Everything but the caption pairing is window functions over one partitioning
by document: a heading's ancestors follow from the latest heading of each level
before it, so neither recursion nor a join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..functions.folds import fold_documents
from .blocks import to_nodes

LEVELS = range(1, 7)
CAPTION_RATIO = 0.30


def resolve_levels(headings: DataFrame) -> DataFrame:
    """``level`` and ``number`` of headings (text, global_level): numbering before the block's own level before 1."""
    return headings.withColumn("number", text.numbering(F.col("text"))["number"]).withColumn("level", text.heading_level(F.col("text"), F.col("global_level")))


def with_ancestors(headings: DataFrame, *carry: str) -> DataFrame:
    """``ancestors``: the open headings above each heading, outermost first, as struct(pos, node_id, carry...).

    ``headings`` has doc_id, pos, node_id and level. The latest heading of a
    level is still open if no later one has a smaller level.
    """
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    me = F.struct("pos", "node_id", *carry)
    latest = {n: F.last(F.when(F.col("level") == n, me), ignorenulls=True).over(before) for n in LEVELS[:-1]}
    x = headings.withColumns({f"_l{n}": c for n, c in latest.items()})
    open_: list[Column] = []
    closed = F.lit(-(1 << 62)).cast("long")
    for n in LEVELS[:-1]:
        at = F.col(f"_l{n}")["pos"].cast("long")
        open_.append(F.when((F.col("level") > n) & (at > closed), F.col(f"_l{n}")))
        closed = F.greatest(closed, F.coalesce(at, closed))
    return x.withColumn("ancestors", F.array_compact(F.array(*open_))).drop(*(f"_l{n}" for n in LEVELS[:-1]))


def with_parent(headings: DataFrame) -> DataFrame:
    """``parent_id``: the nearest heading before with a smaller level, or null for the root."""
    return with_ancestors(headings).withColumn("parent_id", F.try_element_at("ancestors", F.lit(-1))["node_id"]).drop("ancestors")


def attach_to_chapters(nodes: DataFrame) -> DataFrame:
    """``chapter_id`` of every node: the latest heading by page and top edge, headings first where they tie.

    ``nodes`` has doc_id, pos, node_id, node_type, page_id and y1.
    """
    heading = F.col("node_type") == "heading"
    seen = Window.partitionBy("doc_id").orderBy("page_id", "y1", (~heading).cast("int"), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return nodes.withColumn("chapter_id", F.last(F.when(heading, F.col("node_id")), ignorenulls=True).over(seen))


def build_tree(blocks: DataFrame, tables: DataFrame | None = None, document_order: bool = False) -> DataFrame:
    """Nodes of the trees of preprocessed blocks: parent_id (null under the root), depth and preorder.

    Sub-headings come before a heading's own content, and added tables last,
    unless ``document_order`` puts both by page and top edge.
    """
    nodes = to_nodes(blocks).withColumn("y1", F.col("bbox")["y1"])
    heading = F.col("node_type") == "heading"
    nodes = nodes.withColumn("level", F.when(heading, text.heading_level(F.col("text"), F.col("global_level"))))
    # Headings keep block order; content takes the chapter at its place.
    step = F.struct(F.when(F.lit(document_order), F.col("page_id")).otherwise(F.lit(0)).cast("int").alias("phase"), F.when(F.lit(document_order), F.col("y1")).otherwise(0.0).alias("y"), F.col("pos").cast("long").alias("pos"))
    headings = with_ancestors(nodes.where(heading).withColumn("step", step), "step")
    headings = headings.withColumn("path", F.concat(F.transform("ancestors", lambda a: a["step"]), F.array("step"))).withColumn("parent_id", F.try_element_at("ancestors", F.lit(-1))["node_id"])
    headings = headings.drop("ancestors", "step")
    content = nodes.where(~heading).withColumn("path", F.lit(None).cast(headings.schema["path"].dataType)).withColumn("parent_id", F.lit(None).cast("string"))
    both = headings.unionByName(content)
    seen = Window.partitionBy("doc_id").orderBy("page_id", "y1", (~heading).cast("int"), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chapter = F.last(F.when(heading, F.struct("node_id", "path")), ignorenulls=True).over(seen)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_id", "y1", "pos"))
    both = both.withColumn("_chapter", chapter).withColumn("_rank", rank.cast("long"))
    own = F.struct(F.when(F.lit(document_order), F.col("page_id")).otherwise(F.lit(1)).cast("int").alias("phase"), F.when(F.lit(document_order), F.col("y1")).otherwise(0.0).alias("y"), F.col("_rank").alias("pos"))
    empty = F.array().cast(headings.schema["path"].dataType)
    both = both.withColumn("path", F.when(heading, F.col("path")).otherwise(F.concat(F.coalesce(F.col("_chapter")["path"], empty), F.array(own))))
    both = both.withColumn("parent_id", F.when(heading, F.col("parent_id")).otherwise(F.col("_chapter")["node_id"])).drop("_chapter", "_rank")
    both = both.withColumn("global_level", F.coalesce("level", "global_level")).drop("level")
    if tables is not None:
        paths = both.where(heading).select("doc_id", F.col("node_id").alias("parent_id"), F.col("path").alias("_p"))
        added = tables.join(paths, ["doc_id", "parent_id"], "left")
        last = F.struct(F.lit(2).alias("phase"), F.lit(0.0).alias("y"), F.col("pos").cast("long").alias("pos"))
        added = added.withColumn("path", F.concat(F.coalesce("_p", empty), F.array(last))).drop("_p")
        both = both.unionByName(added, allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("path", "pos", "node_id")
    return both.withColumn("depth", F.size("path")).withColumn("preorder", F.row_number().over(order)).drop("path", "y1")


def nearest_tables(nodes: DataFrame, tables: DataFrame, same_page: bool = False) -> DataFrame:
    """Each table node (doc_id, node_id, page_id, bbox) with the table object whose center is nearest, the first where they tie.

    ``tables`` has doc_id, pos, object_id, page_id, bbox, row_count, col_count and cell_matrix.
    """
    t = tables.select("doc_id", F.struct("pos", "object_id", "page_id", "bbox", "row_count", "col_count", "cell_matrix").alias("t"))
    pairs = nodes.join(t, "doc_id")
    if same_page:
        pairs = pairs.where(F.col("page_id") == F.col("t")["page_id"])
    far = boxes.distance(F.col("bbox"), F.col("t")["bbox"])
    best = pairs.groupBy("doc_id", "node_id").agg(F.min_by("t", F.struct(far, F.col("t")["pos"])).alias("t"), F.min(far).alias("distance"))
    found = F.size(F.coalesce(F.col("t")["cell_matrix"], F.array())) > 0
    rows = F.when(found, F.size(F.col("t")["cell_matrix"]))
    same = (F.col("t")["row_count"] == rows)
    return best.select(
        "doc_id", "node_id", F.col("t")["object_id"].alias("object_id"), "distance", rows.alias("row_count"), F.when(found, F.coalesce(F.col("t")["col_count"], F.lit(0))).alias("col_count"),
        F.when(found, F.col("t")["cell_matrix"]).alias("cell_matrix"), F.when(found, F.when(same, "一致").otherwise("不一致")).alias("check"),
    )


def missing_tables(nodes: DataFrame, tables: DataFrame, headings: DataFrame) -> DataFrame:
    """Nodes for table objects whose cells no table node (doc_id, cell_matrix) has, under the first heading of the latest page so far.

    ``headings`` has doc_id, pos, node_id and page_id.
    """
    new = tables.join(nodes.select("doc_id", "cell_matrix").where("cell_matrix IS NOT NULL").distinct(), ["doc_id", "cell_matrix"], "left_anti")
    first = headings.groupBy("doc_id", "page_id").agg(F.min_by("node_id", "pos").alias("parent_id"))
    events = first.select("doc_id", "page_id", F.lit(0).alias("kind"), "parent_id").unionByName(new.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy("doc_id").orderBy("page_id", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = events.withColumn("parent_id", F.last("parent_id", ignorenulls=True).over(so_far)).where("kind = 1")
    return found.select(
        "doc_id", "pos", text.stable_id("node", F.col("doc_id"), F.col("object_id")).alias("node_id"), F.lit("table").alias("node_type"), F.lit("").alias("text"), "page_id",
        F.array("page_id", "page_id").alias("page_range"), "bbox", F.lit(0.95).alias("confidence"), F.lit("pymupdf-direct").alias("model_version"), text.content_hash(F.lit("")).alias("content_hash"),
        F.lit("PDF文本层").alias("provenance"), "parent_id", "cell_matrix", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("col_count", F.lit(0)).alias("col_count"),
    )


def pair_captions(nodes: DataFrame, ratio: float = CAPTION_RATIO, same_page: bool = False) -> DataFrame:
    """doc_id, image_id, caption_id (or null) and need_review: images take, in order, the nearest caption that is still free.

    The choice of one image depends on those before it, which no window expresses.
    """

    def run(rows: list[dict]):
        rows = sorted(rows, key=lambda r: (r["pos"], r["node_id"], r["y1"], r["y2"]))
        free = {r["node_id"]: r for r in rows if r["node_type"] == "caption"}
        for image in (r for r in rows if r["node_type"] == "image"):
            best, least = None, float("inf")
            for node_id, caption in free.items():
                if same_page and caption["page_id"] != image["page_id"]:
                    continue
                y = caption["y1"]
                far = y - image["y2"] if y >= image["y1"] else image["y1"] - y
                if far <= (image["y2"] - image["y1"]) * ratio and far < least:
                    best, least = node_id, far
            free.pop(best, None)
            yield image["node_id"], best, best is None

    few = nodes.where("node_type IN ('image', 'caption')").select("doc_id", "pos", "node_id", "node_type", "page_id", F.col("bbox")["y1"].alias("y1"), F.col("bbox")["y2"].alias("y2"))
    return fold_documents(few, ["pos", "node_id", "node_type", "page_id", "y1", "y2"], run, "image_id string, caption_id string, need_review boolean")


def tree_hash(nodes: DataFrame) -> DataFrame:
    """One hash a document over its nodes (node_id, parent_id, node_type, content_hash) in id order."""
    row = F.concat_ws("\x1f", "node_id", F.coalesce("parent_id", F.lit("root")), "node_type", "content_hash")
    return nodes.groupBy("doc_id").agg(F.substring(F.sha1(F.concat_ws("\x1e", F.sort_array(F.collect_list(row)))), 1, 16).alias("tree_hash"), F.count("*").alias("n_nodes"))


def document_headers(nodes: DataFrame) -> DataFrame:
    """One row a document: its versions joined, its counts and its share of nodes to review, the root included."""
    review = F.coalesce(F.col("need_review"), F.lit(False)) if "need_review" in nodes.columns else F.lit(False)
    flagged = F.count_if(review)
    return nodes.groupBy("doc_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.nullif("model_version", F.lit("")))), ",").alias("model_versions"),
        (F.count("*") + 1).alias("n_nodes"), flagged.alias("review_queue_count"), (flagged / (F.count("*") + 1)).alias("review_ratio"),
    )


def record_merge(nodes: DataFrame, sources: Column, strategy: Column) -> DataFrame:
    """``merge_history`` with an entry for the nodes that went into each node."""
    return nodes.withColumn("merge_history", F.array_append(F.coalesce("merge_history", F.array().cast("array<string>")), F.concat(strategy, F.lit(":"), F.array_join(sources, ","))))


def record_split(nodes: DataFrame, targets: Column, strategy: Column) -> DataFrame:
    """``split_history`` with an entry for the nodes that each node became."""
    return nodes.withColumn("split_history", F.array_append(F.coalesce("split_history", F.array().cast("array<string>")), F.concat(strategy, F.lit(":"), F.array_join(targets, ","))))


def mark_review(nodes: DataFrame, where: Column, reason: str) -> DataFrame:
    return nodes.withColumn("need_review", F.coalesce(F.col("need_review"), F.lit(False)) | where).withColumn("review_reason", F.when(where, reason).otherwise(F.col("review_reason")))
