"""Mixing sources to target weights by entropy balancing.

Each source gets a share of all words by weight, at most ``most`` times its own
size, what is over being shared again. Document rates are those nearest to one
copy in relative entropy (of ``most`` trials) whose words meet the targets: a
document of relative length x in a source with multiplier t is taken at
most / (1 + (most - 1) exp(-t x)), an exponential tilt by length. The multipliers
solve the convex dual by Newton steps, each one distributed aggregate over the
histogram of sizes; every state is a table. Rates become whole copies by carrying
the error from longer to shorter documents in buckets of bounded size.

Edge cases: a null text has size 0 and is never taken; a null source is one
source, last in order; repeated rows share their copies; null doc_ids are told
apart by their text; if all texts are empty all targets are 0; extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, doc_key, every_column, read, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Documents in a rounding bucket, about.
BUCKET = 2_000
#: Sources are joined by broadcast up to this many, which are counted first.
BROADCAST_SOURCES = 10_000
TOLERANCE = 1e-7
ROUNDS = 40
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, *extra: Column) -> DataFrame:
    """The ``extra`` columns of ``docs`` with ``src`` (a source name that is never null), ``size`` and a ``class`` that only repeated rows share."""
    k1, k2 = doc_key()
    src = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    return docs.select(*extra, src.alias("src"), size_of(F.col("text").cast("string")).alias("size"), F.xxhash64(k1, k2).alias("class"))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` as a table with their ``place`` by code point, null last, from 0; sorted in ranges, so that any number will do."""
    by = (F.col("src") == "-").cast("int")
    x = sources.withColumn("last", by).repartitionByRange("last", "src").sortWithinPartitions("last", "src").withColumn("at", F.monotonically_increasing_id())
    x = stored(x.drop("last"), "ranked")
    part = F.shiftright("at", 33)
    # One row a range.
    sizes = sorted((r[0], r[1]) for r in x.groupBy(part.alias("part")).count().collect())
    before = F.create_map(*(F.lit(v).cast("long") for i, (p, _) in enumerate(sizes) for v in (p, sum(n for _, n in sizes[:i])))) if sizes else None
    return x.withColumn("place", F.col("at") - F.shiftleft(part, 33) + (before[part] if sizes else F.lit(0).cast("long"))).drop("at")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (src, source_size) with ``target``: all words by weight, none above ``most`` times its size.

    The level (words a unit of weight) rises from the one that ignores the caps,
    as capped sources leave words to the others, until no more are capped; a
    round is one aggregate of whole numbers, so reruns agree.
    """
    cycle = F.array(*map(F.lit, weights))
    x = _ranked(sources).withColumn("weight", F.element_at(cycle, (F.col("place") % len(weights) + 1).cast("int"))).drop("place")
    cap = most * F.col("source_size").cast("double")
    level, capped = 0.0, -1
    while True:
        over = cap <= F.lit(level) * F.col("weight")
        total, held, free, n = x.agg(
            F.sum("source_size"), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)
        ).first()
        if n == capped or not free:
            break
        capped, level = n, (total - most * (held or 0)) / free
    return x.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")) if free else cap).drop("weight")


def _join_sources(left: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    return left.join(F.broadcast(sources) if few else sources, "src")


def balance(histogram: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> tuple[DataFrame, bool]:
    """(src, source_size, target, scale, tilt, full) from (src, size, n), and whether the sources are few."""
    sources = histogram.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs"))
    state = targets(sources, weights, most)
    whole = F.col("source_size") > 0
    ratio = F.col("target") / F.when(whole, F.col("source_size"))
    full = F.coalesce(ratio >= most * (1 - 1e-12), F.lit(True))
    start = F.when(full, 0.0).otherwise(F.log(ratio / (most - ratio) * (most - 1)))
    state = state.select(
        "src", "source_size", "target", (F.col("source_size") / F.col("n_docs")).alias("scale"), start.alias("tilt"), full.alias("full"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(float("inf")).alias("error"),
    )
    state = stored(state, "state")
    few = state.count() <= BROADCAST_SOURCES
    for _ in range(ROUNDS):
        x = F.col("size") / F.col("scale")
        part = 1 / (1 + (most - 1) * F.exp(-F.col("tilt") * x))
        words = F.col("n") * F.col("size")
        step = _join_sources(histogram, state.where("not full").select("src", "scale", "tilt"), few).groupBy("src").agg(
            F.sum(words * most * part).alias("got"), F.sum(words * most * part * (1 - part) * x).alias("slope")
        )
        x = _join_sources(state.where("not full"), step, few)
        gap = F.col("target") - F.col("got")
        low = F.when(gap > 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("high")).otherwise(F.col("tilt"))
        newton = F.col("tilt") + gap / F.col("slope")
        apart = F.when(low.isNull(), high - 2 * F.abs(high) - 1).when(high.isNull(), low + 2 * F.abs(low) + 1).otherwise((low + high) / 2)
        inside = (newton > F.coalesce(low, F.lit(float("-inf")))) & (newton < F.coalesce(high, F.lit(float("inf")))) & (F.abs(newton - F.col("tilt")) <= 2 * F.abs(F.col("tilt")) + 4)
        moved = x.select(
            "src", "source_size", "target", "scale", F.when(gap == 0, F.col("tilt")).when(inside, newton).otherwise(apart).alias("tilt"), "full",
            low.alias("low"), high.alias("high"), (F.abs(gap) / F.greatest(F.col("target"), F.lit(1e-300))).alias("error"),
        )
        before, state = state, stored(moved.unionByName(state.where("full").withColumn("error", F.lit(0.0))), "state")
        discard(before)
        if (state.agg(F.max("error")).first()[0] or 0.0) < TOLERANCE:
            break
    # Sums of fractions depend on their order in the last digits; rates must not.
    return state.select("src", "source_size", "target", "scale", F.round("tilt", 9).alias("tilt"), "full"), few


def _round_bucket(bucket, most: int):
    """Whole copies for a bucket's classes: the error of longer documents is carried to shorter ones."""
    bucket = bucket.sort_values(["size", "class"], ascending=[False, True], kind="stable", ignore_index=True)
    carry, out = 0.0, np.zeros(len(bucket), np.int64)
    for i, (size, n, rate) in enumerate(zip(bucket["size"].tolist(), bucket["n"].tolist(), bucket["rate"].tolist(), strict=True)):
        if size:
            wish = rate * n * size + carry
            out[i] = min(max(round(wish / size), 0), most * n)
            carry = wish - int(out[i]) * size
    bucket["copies"] = out
    return bucket[["src", "size", "class", "source_size", "target", "n", "copies"]]


def allocate(sized: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, size, class, source_size, target, n, copies): the copies that the n rows of each class share."""
    classes = stored(sized.groupBy("src", "size", "class").agg(F.count("*").alias("n")), "classes")
    histogram = stored(classes.groupBy("src", "size").agg(F.sum("n").alias("n")), "sizes")
    state, few = balance(histogram, weights, most)
    per_source = classes.groupBy("src").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
    x = _join_sources(classes, _join_sources(state, per_source, few), few)
    rate = F.when(F.col("full"), F.lit(float(most))).otherwise(most / (1 + (most - 1) * F.exp(-F.col("tilt") * F.col("size") / F.col("scale"))))
    x = x.select("src", "size", "class", "source_size", "target", "n", rate.alias("rate"), F.pmod("class", "buckets").alias("bucket"))
    schema = "src string, size long, class long, source_size long, target double, n long, copies long"
    return x.groupBy("src", "bucket").applyInPandas(lambda pdf: _round_bucket(pdf, most), schema)


def _own_copies(rows: DataFrame) -> DataFrame:
    """Joined rows with their own share of their class's copies."""
    number = F.row_number().over(Window.partitionBy("src", "size", "class").orderBy(F.lit(1)))
    return rows.withColumn("own", F.floor(F.col("copies") / F.col("n")) + (number <= F.col("copies") % F.col("n")).cast("long"))


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs`` (doc_id, text, source)."""
    sized = stored(keyed(docs, F.col("doc_id").cast("long").alias("doc_id")), "sized")
    rows = _own_copies(sized.join(allocate(sized, weights, most), ["src", "size", "class"]))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("own") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    rows = keyed(docs, F.struct(*every_column(docs)).alias("row"))
    chosen = stored(allocate(rows.drop("row"), weights, most), "mix").where("copies > 0").select("src", "size", "class", "n", "copies")
    rows = _own_copies(rows.join(chosen, ["src", "size", "class"])).where("own > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read(spark, sf_dir, "documents"))
