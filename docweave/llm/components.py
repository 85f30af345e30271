"""Connected components of an edge list that lives in tables, in rounds of star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many edges as it takes to connect what the edges a-b connect: each node to its component's least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _with_least(edges: DataFrame, least: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``edges`` joined with the ``least`` of their u, which is stored first, so that a node with very many edges can be split over tasks."""
    least = stored(least, name)
    return edges.join(least, "u"), least


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    joined, least = _with_least(both.where("v > u"), both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    found = stored(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
    discard(least)
    return found


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined, least = _with_least(down, down.groupBy("u").agg(F.min("v").alias("m")), "least")
    found = stored(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    discard(least)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(u, v) rows with v the least node of u's component, for every u that is not itself the least.

    ``edges`` has long columns u and v. Every round writes its edges to the
    shared folder, so lineage stays short and nothing of it reaches the driver
    but a row count and a checksum; tables of earlier rounds are deleted.
    """
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    edges = stored(edges.where("u <> v"), "edges")
    before = mark(edges)
    while before[0]:
        large = _large_star(edges)
        small = _small_star(large)
        discard(edges, large)
        edges = small
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges
