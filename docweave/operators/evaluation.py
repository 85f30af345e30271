"""Scores of results against annotations, reports, fidelity. Inputs are keyed by doc_id."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.folds import fold_documents

# ---- Fixed values: thresholds that verdicts depend on. ----
BADCASES = {
    "heading_recall_loss": ("heading_level_accuracy", 1.0, "<", 0.8),
    "parent_child_disorder": ("parent_child_f1", 0.0, "<", 0.7),
    "reading_order_error": ("reading_order_kendall_tau", 1.0, "<", 0.7),
    "table_structure_damage": ("table_cell_f1", 1.0, "<", 0.7),
    "text_recognition_error": ("text_cer", 0.0, ">", 0.10),
    "review_overload": ("review_ratio", 0.0, ">", 0.20),
}
GATES = [
    ("light", 0.99, 0.98, 0.97, 0.95),
    ("medium", 0.99, 0.98, 0.95, 0.90),
    ("heavy", 0.99, 0.98, 0.88, 0.80),
]
# ---- End of fixed values. ----
METRICS = ("heading_level_accuracy", "parent_child_f1", "reading_order_kendall_tau", "table_cell_f1", "text_cer", "review_ratio")


def f1(tp: Column, n_left: Column, n_right: Column) -> Column:
    """F1 from counts: one if both sides are empty, zero if one is."""
    return F.when((n_left == 0) & (n_right == 0), 1.0).when((n_left == 0) | (n_right == 0), 0.0).otherwise(2 * tp / (n_left + n_right))


def heading_accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of a document's distinct true headings (doc_id, pos, text, chain) that are predicted with the same chain; the last of equal texts counts."""
    last = lambda df, name: df.groupBy("doc_id", "text").agg(F.max_by("chain", "pos").alias(name))
    both = last(truth, "true_chain").join(last(predicted, "chain"), ["doc_id", "text"], "left")
    return both.groupBy("doc_id").agg(F.avg(F.coalesce(F.col("chain") == F.col("true_chain"), F.lit(False)).cast("double")).alias("heading_level_accuracy"))


def pair_f1(predicted: DataFrame, truth: DataFrame, *key: str, name: str = "f1") -> DataFrame:
    """F1 of two sets of rows a document."""
    key = key or ("parent", "child")
    p = predicted.select("doc_id", *key).distinct().withColumn("p", F.lit(1))
    t = truth.select("doc_id", *key).distinct().withColumn("t", F.lit(1))
    counts = p.unionByName(t, allowMissingColumns=True).groupBy("doc_id", *key).agg(F.count("p").alias("p"), F.count("t").alias("t"))
    sums = counts.groupBy("doc_id").agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum("p").alias("np"), F.sum("t").alias("nt"))
    return sums.select("doc_id", F.when(F.col("np") > 0, F.col("tp") / F.col("np")).otherwise(0.0).alias("precision"), F.when(F.col("nt") > 0, F.col("tp") / F.col("nt")).otherwise(0.0).alias("recall"), f1(F.col("tp"), F.col("np"), F.col("nt")).alias(name))


def increasing_pairs(values: np.ndarray) -> int:
    """How many pairs of a sequence stand in increasing order, bit by bit: such a pair first differs in a bit that its later value has."""
    _, rank = np.unique(values, return_inverse=True)
    total = 0
    for bit in range(int(rank.max(initial=0)).bit_length()):
        order = np.argsort(rank >> (bit + 1), kind="stable")
        group, one = rank[order] >> (bit + 1), (rank[order] >> bit & 1).astype(bool)
        zeros = np.cumsum(~one)
        first = np.searchsorted(group, group)
        total += int((zeros - np.where(first > 0, zeros[first - 1], 0))[one].sum())
    return total


def kendall_tau(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Rank agreement of two orders (doc_id, pos, item) over the items of both; one if fewer than two.

    With repeated items a predicted item's rank is its first place, a true one's
    its last, and a pair of the same item disagrees. Pairs are counted, not formed.
    """
    t = truth.groupBy("doc_id", "item").agg(F.max("pos").alias("t"))
    first = Window.partitionBy("doc_id", "item")
    p = predicted.withColumn("p", F.min("pos").over(first)).join(t, ["doc_id", "item"])

    def tau(rows: list[dict]):
        rows = sorted(rows, key=lambda r: r["p"])
        t = np.array([r["t"] for r in rows])
        n = len(t) * (len(t) - 1) // 2
        yield 2 * increasing_pairs(t) / n - 1 if len(set(t.tolist())) > 1 else 1.0,

    found = fold_documents(p, ["p", "t"], tau, "tau double")
    everyone = predicted.select("doc_id").union(truth.select("doc_id")).distinct()
    return everyone.join(found, "doc_id", "left").select("doc_id", F.coalesce("tau", F.lit(1.0)).alias("reading_order_kendall_tau"))


def cells(tables: DataFrame, *key: str) -> DataFrame:
    """The normalised cells of tables (key..., cell_matrix) as rows with their number."""
    flat = tables.select(*key, F.explode(F.flatten("cell_matrix")).alias("cell")).withColumn("cell", text.collapse(text.text_of("cell")))
    return flat.groupBy(*key, "cell").agg(F.count("*").alias("n_cells"))


def cell_f1(predicted: DataFrame, truth: DataFrame, *key: str) -> DataFrame:
    """F1 of the multisets of cells of tables with the same key, wherever the cells stand."""
    both = cells(predicted, *key).withColumnRenamed("n_cells", "p").join(cells(truth, *key).withColumnRenamed("n_cells", "t"), [*key, "cell"], "full")
    sums = both.groupBy(*key).agg(F.sum(F.least(F.coalesce("p", F.lit(0)), F.coalesce("t", F.lit(0)))).alias("tp"), F.sum(F.coalesce("p", F.lit(0))).alias("np"), F.sum(F.coalesce("t", F.lit(0))).alias("nt"))
    return sums.select(*key, f1(F.col("tp"), F.col("np"), F.col("nt")).alias("f1"))


def paired_table_f1(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """A document's mean cell F1: tables (doc_id, pos, cell_matrix) pair by header and order; tables of unmatched headers count zero.

    Tables that are left over under a header that both sides have don't count.
    """
    header = text.strip(F.array_join(F.coalesce(F.try_element_at("cell_matrix", F.lit(1)), F.array().cast("array<string>")), "|"))
    order = Window.partitionBy("doc_id", "header").orderBy("pos")
    numbered = lambda df: df.withColumn("header", header).withColumn("n", F.row_number().over(order))
    p, t = numbered(predicted), numbered(truth)
    score = cell_f1(p, t, "doc_id", "header", "n")
    pairs = p.select("doc_id", "header", "n").join(t.select("doc_id", "header", "n"), ["doc_id", "header", "n"]).join(score, ["doc_id", "header", "n"], "left")
    matched = pairs.groupBy("doc_id").agg(F.sum(F.coalesce("f1", F.lit(1.0))).alias("s"), F.count("*").alias("m"))
    alone = lambda a, b, name: a.join(b.select("doc_id", "header").distinct(), ["doc_id", "header"], "left_anti").groupBy("doc_id").agg(F.count("*").alias(name))
    x = p.select("doc_id").union(t.select("doc_id")).distinct()
    for part in (matched, alone(p, t, "lp"), alone(t, p, "lt")):
        x = x.join(part, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    total = zero("m") + F.greatest(zero("lp"), zero("lt"))
    return x.select("doc_id", F.when(total > 0, zero("s") / total).otherwise(1.0).alias("table_cell_f1"))


def cer(predicted: Column, truth: Column) -> Column:
    """Character error rate of normalised texts; without a true text one if there is any other, else zero."""
    p, t = text.full_to_half(F.coalesce(predicted, F.lit(""))), text.full_to_half(F.coalesce(truth, F.lit("")))
    return F.when(t == "", F.when(p == "", 0.0).otherwise(1.0)).when(p == "", 1.0).otherwise(text.levenshtein(p, t) / F.length(t))


def badcase_count(heading: Column, pairs: Column, tables: Column, error: Column) -> Column:
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in (heading < 1, pairs < 1, tables < 1, error > 0.05)), F.lit(0))


def evaluate(parts: list[DataFrame], documents: DataFrame) -> DataFrame:
    """Documents (doc_id, dirt_level) with the metrics of ``parts`` side by side and their ``badcase_count``."""
    x = documents
    for part in parts:
        x = x.join(part, "doc_id", "left")
    for m in METRICS:
        x = x if m in x.columns else x.withColumn(m, F.lit(None).cast("double"))
    return x.withColumn("badcase_count", badcase_count(*(F.col(m) for m in ("heading_level_accuracy", "parent_child_f1", "table_cell_f1", "text_cer"))))


def _chains(rows: list[dict]) -> dict[str, list[str]]:
    """The chain of texts above each heading with text, outermost first; the last of equal texts counts."""
    said = {r["id"]: (r["text"] or "").strip() or r["id"] for r in rows if r["kind"] == "heading"}
    above = {r["id"]: r["parent_id"] for r in rows}
    found = {}
    for r in rows:
        if r["kind"] == "heading" and (r["text"] or "").strip():
            chain, up = [], r["parent_id"]
            while up and up not in chain:
                chain.append(up)
                up = above.get(up)
            found[r["text"].strip()] = [said.get(x, x) for x in reversed(chain)]
    return found


def _share(same: int, n: int, m: int) -> float:
    return 2 * same / (n + m) if n and m else float(n == m)


def _tau(predicted: list[str], truth: list[str]) -> float:
    """``kendall_tau`` of two lists of items."""
    last = {x: i for i, x in enumerate(truth)}
    first: dict[str, int] = {}
    both = sorted((first.setdefault(x, i), last[x]) for i, x in enumerate(predicted) if x in last)
    n = len(both) * (len(both) - 1) // 2
    return 2 * increasing_pairs(np.array([t for _, t in both])) / n - 1 if len(set(both)) > 1 else 1.0


def _tables(predicted: list[list], truth: list[list]) -> float:
    """``paired_table_f1`` of two lists of cell matrices."""
    by_header: tuple[dict, dict] = {}, {}
    for side, tables in zip(by_header, (predicted, truth), strict=True):
        for cells_ in tables:
            side.setdefault("|".join(c or "" for c in cells_[0] or ()).strip(), []).append(Counter(" ".join((c or "").split()) for row in cells_ for c in row or ()))
    p, t = by_header
    pairs = [(a, b) for header in p.keys() & t.keys() for a, b in zip(p[header], t[header], strict=False)]
    alone = max(sum(len(v) for k, v in a.items() if k not in b) for a, b in ((p, t), (t, p)))
    total = len(pairs) + alone
    return sum(_share((a & b).total(), a.total(), b.total()) for a, b in pairs) / total if total else 1.0


def evaluate_trees(nodes: DataFrame, truth: DataFrame, documents: DataFrame, true_parents: bool = False) -> DataFrame:
    """Documents (doc_id, dirt_level) with every metric of their trees against annotations.

    ``nodes`` are those of ``tree.build_tree`` (preorder is their reading order,
    pos that of their text); ``truth`` has doc_id, pos, id, type, text, parent_id
    and perhaps cell_matrix. Pairs are (root, heading) unless ``true_parents``.
    Both tables meet once, by document; each metric is the one of its own
    operator, over the document's rows.
    """
    matrix = lambda df: F.col("cell_matrix") if "cell_matrix" in df.columns else F.lit(None).cast("array<array<string>>")
    side = lambda df, name, place, id, kind, review: df.select("doc_id", F.lit(name).alias("side"), F.col(place).cast("long").alias("place"), F.col("pos").cast("long").alias("pos"), F.col(id).cast("string").alias("id"), F.col(kind).alias("kind"), "text", "parent_id", matrix(df).alias("cells"), review.alias("review"))
    flagged = F.coalesce(F.col("need_review"), F.lit(False)) if "need_review" in nodes.columns else F.lit(False)
    rows = side(nodes, "p", "preorder", "node_id", "node_type", flagged).unionByName(side(truth, "t", "pos", "id", "type", F.lit(False)))

    def scores(rows: list[dict]):
        p, t = (sorted((r for r in rows if r["side"] == name), key=lambda r: (r["place"], r["id"] or "")) for name in "pt")
        found, wanted = _chains(p), _chains(t)
        pairs = [{((chain[-1] if chain else "root") if true_parents else "root", said) for said, chain in chains.items()} for chains in (found, wanted)]
        tables = [[r["cells"] for r in side if r["kind"] == "table" and r["cells"]] for side in (p, t)]
        joined = (" ".join(r["text"] for r in sorted(side, key=lambda r: r["pos"]) if r["text"]) for side in (p, t))
        yield (
            sum(found.get(k) == v for k, v in wanted.items()) / len(wanted) if wanted else 1.0, _share(len(pairs[0] & pairs[1]), len(pairs[0]), len(pairs[1])),
            _tau([r["text"] for r in p if r["text"]], [r["text"] or r["id"] for r in t if r["text"] or r["id"]]), _tables(*tables), sum(r["review"] for r in p) / len(p) if p else 0.0, *joined,
        )

    schema = "heading_level_accuracy double, parent_child_f1 double, reading_order_kendall_tau double, table_cell_f1 double, review_ratio double, p string, t string"
    x = fold_documents(rows, ["side", "place", "pos", "id", "kind", "text", "parent_id", "cells", "review"], scores, schema)
    return evaluate([x.withColumn("text_cer", cer(F.col("p"), F.col("t"))).drop("p", "t")], documents)


def report(results: DataFrame) -> DataFrame:
    """By dirt_level: documents, mean metrics (missing ones are zero) and badcases."""
    return results.groupBy("dirt_level").agg(F.count("*").alias("count"), *(F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(m) for m in METRICS), F.sum("badcase_count").cast("long").alias("badcase_total"))


def badcases(results: DataFrame) -> DataFrame:
    """doc_id, dirt_level and badcase of every threshold that a document misses."""
    flags = []
    for name, (metric, default, side, limit) in BADCASES.items():
        value = F.coalesce(F.col(metric), F.lit(default))
        flags.append(F.when(value < limit if side == "<" else value > limit, F.lit(name)))
    return results.select("doc_id", "dirt_level", F.explode(F.array_compact(F.array(*flags))).alias("badcase"))


def review_ratio(nodes: DataFrame, *key: str) -> DataFrame:
    """Share of nodes with ``need_review``."""
    return nodes.groupBy(*key).agg(F.coalesce(F.avg(F.coalesce(F.col("need_review"), F.lit(False)).cast("double")), F.lit(0.0)).alias("review_ratio"))


def recall(found: Column, wanted: Column) -> Column:
    """Capped at one; one if nothing is wanted."""
    return F.when(wanted == 0, 1.0).otherwise(F.least(F.lit(1.0), found / wanted))


def anchor_pages(paragraphs: DataFrame, pages: DataFrame, n: int = 10) -> DataFrame:
    """First page (doc_id, page_id, text) that holds the first ``n`` characters of each paragraph (doc_id, pos, text), or null.

    Each page is read once for all anchors of its document.
    """
    p = paragraphs.withColumn("anchor", text.strip(F.substring(text.text_of("text"), 1, n)))
    asked = p.where("anchor <> ''").select("doc_id", F.lit(None).cast("int").alias("page_id"), "anchor").distinct()
    rows = asked.unionByName(pages.select("doc_id", F.col("page_id").cast("int").alias("page_id"), F.col("text").alias("anchor")))

    def first_pages(rows: list[dict]):
        wanted: dict[int, set] = {}
        for r in rows:
            if r["page_id"] is None:
                wanted.setdefault(len(r["anchor"]), set()).add(r["anchor"])
        for page, said in sorted((r["page_id"], r["anchor"] or "") for r in rows if r["page_id"] is not None):
            for size, anchors in wanted.items():
                for found in anchors.intersection(said[i : i + size] for i in range(len(said) - size + 1)):
                    anchors.discard(found)
                    yield found, page

    found = fold_documents(rows, ["page_id", "anchor"], first_pages, "anchor string, found_page int")
    return p.join(found, ["doc_id", "anchor"], "left")


def page_deviation(pages: DataFrame) -> DataFrame:
    """Buckets of |expected_page - found_page|, five and missing together, and the share of at most one."""
    bucket = F.coalesce(F.least(F.abs(F.col("expected_page") - F.col("found_page")), F.lit(5)), F.lit(5)).cast("int")
    x = pages.withColumn("bucket", bucket).groupBy("doc_id", "bucket").agg(F.count("*").alias("n"))
    return x.groupBy("doc_id").agg(*(F.coalesce(F.sum(F.when(F.col("bucket") == i, F.col("n"))), F.lit(0)).alias(f"off_{i}") for i in range(6)), (F.coalesce(F.sum(F.when(F.col("bucket") <= 1, F.col("n"))), F.lit(0)) / F.sum("n")).alias("deviation_ratio"))


def go_no_go(fidelity: DataFrame) -> DataFrame:
    """Which fidelity figures (text_recall, image_recall, table_row_accuracy, deviation_ratio) reach the gates of a dirt_level; unknown levels are medium."""
    spark = fidelity.sparkSession
    gates = spark.createDataFrame(GATES, "level string, g1 double, g2 double, g3 double, g4 double")
    level = F.when(F.col("dirt_level").isin(*(g[0] for g in GATES)), F.col("dirt_level")).otherwise("medium")
    x = fidelity.withColumn("level", level).join(gates, "level")
    checks = {"text_ok": ("text_recall", "g1"), "image_ok": ("image_recall", "g2"), "table_ok": ("table_row_accuracy", "g3"), "deviation_ok": ("deviation_ratio", "g4")}
    x = x.withColumns({k: F.col(a) >= F.col(b) for k, (a, b) in checks.items()})
    return x.withColumn("overall", F.col("text_ok") & F.col("image_ok") & F.col("table_ok") & F.col("deviation_ok")).drop("level", "g1", "g2", "g3", "g4")


def kind_counts(objects: DataFrame, kinds: tuple = ("text_span", "image", "table")) -> DataFrame:
    """Objects of each kind, absent kinds included."""
    return objects.agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds)).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, kinds)), F.array(*map(F.col, kinds)))).alias("kind", "n"))


def call_costs(calls: DataFrame, budget: int = 20) -> DataFrame:
    """Calls (doc_id, task) by task, with the document's total, what is left of its budget and whether that is used up."""
    by_task = calls.groupBy("doc_id", "task").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return by_task.select("doc_id", "task", "n", total.alias("total"), F.greatest(F.lit(0).cast("long"), budget - total).alias("remaining"), (total >= budget).alias("exceeded"))
