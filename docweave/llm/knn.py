"""Exact top-k inner-product search as a Voronoi join.

Data rows and queries fall into the cells of common pivots. Each cell's summary
is one row: its numbers, the radii of its data and of its queries around the
pivot, and the lowest of its queries' k-th scores against a bounded sample of
the data. From the summaries alone follows for each pair of cells what their
inner products can reach and what they cannot fall below, hence a bound below
which no true result of a query cell lies. A data cell that cannot reach a query
cell's bound is not sent there at all, and of the others only the rows that can
reach it by their own distance; each query group is solved against the rows it
got, in blocks, and the blocks' results are merged.

The bounds only save work. Where they exclude nothing (vectors without
clusters) every group sees every row, in blocks, and results are the same.

Edge cases: vectors that are null or hold a null or non-finite component take
no part, nor do rows without an id; a shorter vector is padded with zeros;
components and scores beyond the range of their types saturate; repeated query
rows give one result, rows that share an id but not the vector one each;
repeated data rows each count; a query never finds a row of its own id; fewer
rows than k give shorter results; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, in_worker, read, stored

#: Rows that pivots and the lower bounds are taken from, at most; a choice of speed only.
SAMPLE = 2048
#: Queries a pivot, about, and pivots at most; queries in a group and data rows in a block, about.
PIVOT_QUERIES = 512
MOST_PIVOTS = 256
GROUP_QUERIES = 16_384
BLOCK_ROWS = 50_000
#: Rows that are compared with all pivots or the sample at once, and scores that are held at once, about.
TILE = 1024
SCORES = 1 << 21
EXACT = float(1 << 53)
LARGEST = np.finfo(np.float64).max


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    out = np.zeros((len(column), width))
    if len(column):
        out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows, exact; beyond the long range they saturate."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    exact = whole(a) @ whole(b).T
    return np.clip(exact, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


def top(ids: np.ndarray, queries: np.ndarray, vec_id: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, vec_id, score) of the k best data rows of each query, ties to smaller ids; perhaps some more."""
    kth = np.full(len(ids), np.iinfo(np.int64).min)
    found = []
    tile = max(64, SCORES // max(len(ids), 1))
    for lo in range(0, len(vec_id), tile):
        own = vec_id[lo : lo + tile]
        score = products(queries, data[lo : lo + tile])
        allowed = ids[:, None] != own[None, :]
        score = np.where(allowed, score, np.iinfo(np.int64).min)
        if score.shape[1] >= k:
            kth = np.maximum(kth, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
        q, at = np.nonzero((score >= kth[:, None]) & allowed)
        found.append((q, own[at], score[q, at]))
    if not found:
        return np.zeros(0, np.int64), vec_id[:0], np.zeros(0, np.int64)
    q, vec, score = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((vec, -score, q))
    q, vec, score = q[order], vec[order], score[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return q[rank < k], vec[rank < k], score[rank < k]


def _integers(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the usable rows, components times 256 rounded down."""
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(sound & F.col("id").isNotNull())

    def floor(batches):
        for batch in batches:
            v = batch.column("v")
            with np.errstate(over="ignore"):
                flat = np.clip(np.floor(v.flatten().to_numpy() * 256.0), -LARGEST, LARGEST)
            sizes = pa.array(np.concatenate([[0], np.cumsum(np.diff(v.offsets.to_numpy()))]).astype(np.int32)) if len(v) else pa.array([0], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(sizes, pa.array(flat))], names=["id", "v"])

    return rows.mapInArrow(in_worker(floor), "id long, v array<double>")


def nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's pivot and its distance to it."""
    cell = np.zeros(len(v), np.int64)
    square = (pivots**2).sum(1)
    for lo in range(0, len(v), TILE):
        cell[lo : lo + TILE] = (square[None] - 2 * (v[lo : lo + TILE] @ pivots.T)).argmin(1)
    return cell, np.sqrt(((v - pivots[cell]) ** 2).sum(1))


def sample_bound(ids: np.ndarray, v: np.ndarray, sample_id: np.ndarray, sample_v: np.ndarray, k: int) -> np.ndarray:
    """What each query's k-th score is at least, by the sample."""
    bound = np.full(len(ids), -np.inf)
    if len(sample_id) > k:
        for lo in range(0, len(ids), TILE):
            score = v[lo : lo + TILE] @ sample_v.T
            score[(ids[lo : lo + TILE, None] == sample_id[None]) | ~np.isfinite(score)] = -np.inf
            bound[lo : lo + TILE] = np.partition(score, len(sample_id) - k, axis=1)[:, len(sample_id) - k]
    # Beyond the long range scores are equal.
    return np.minimum(bound, float(1 << 62))


class Cells:
    """The summaries of all cells, and what they say about which data a query cell needs."""

    def __init__(self, pivots: np.ndarray, summary: pa.Table, k: int):
        at = summary.column("g").to_numpy()

        def by_cell(name: str, empty: float) -> np.ndarray:
            out = np.full(len(pivots), empty)
            out[at] = summary.column(name).to_numpy()
            return out

        rows, self.asked = by_cell("n", 0.0), by_cell("asked", 0.0)
        radius, asked_radius, bound = by_cell("radius", 0.0), by_cell("asked_radius", 0.0), by_cell("bound", -np.inf)
        with np.errstate(all="ignore"):
            length = np.sqrt((pivots**2).sum(1))
            middle = pivots @ pivots.T  # data cells by query cells
            reach = length[None] * radius[:, None] + length[:, None] * asked_radius[None] + radius[:, None] * asked_radius[None]
            slack = 1e-9 * (np.abs(middle) + reach + 1)
            # A cell of more than k rows bounds the k-th score from below.
            least = np.where((rows > k)[:, None], middle - reach - slack, -np.inf)
            least = np.where(np.isnan(least), -np.inf, least).max(0, initial=-np.inf)
            self.bound = np.maximum(np.where(self.asked > 0, bound, np.inf), np.minimum(least, float(1 << 62)))
            self.need = ~(middle + reach + slack < self.bound[None]) & (self.asked > 0)[None]
        self.pivots, self.length, self.asked_radius = pivots, length, asked_radius

    def needed(self, v: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, query cell) pairs: where the rows of data are needed."""
        found = []
        with np.errstate(all="ignore"):
            for lo in range(0, len(v), TILE):
                x = v[lo : lo + TILE]
                own = np.sqrt((x**2).sum(1))[:, None]
                most = x @ self.pivots.T + own * self.asked_radius[None]
                # A little slack for rounding; it can only send more.
                slack = 1e-9 * (np.abs(most) + own * self.length[None] + 1)
                row, to = np.nonzero(~(most + slack < self.bound[None]) & self.need[cell[lo : lo + TILE]])
                found.append((row + lo, to))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _joined(df: DataFrame, k: int, every: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(id, v, g, s, b) of queries and of data, a copy for each group g, s and block b in which they meet; and the vectors' width."""
    rows = stored(_integers(df, id_col, vector_col), "vectors")
    n, n_queries, width = (x or 0 for x in rows.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.size("v"))).first())
    # A bounded sample: the rows with the smallest hashes.
    sample = rows.orderBy(F.xxhash64("v", "id"), "id").limit(SAMPLE).toArrow()
    sample_id, sample_v = sample.column("id").to_numpy(), matrix(sample.column("v"), width)
    n_pivots = int(np.clip(n_queries // PIVOT_QUERIES, 4, MOST_PIVOTS))
    pivots = np.unique(sample_v, axis=0)
    pivots = pivots[np.random.default_rng(7).permutation(len(pivots))[:n_pivots]] if len(pivots) else np.zeros((1, width))
    blocks = max(1, -(-n // BLOCK_ROWS))

    def place(batches):
        """Each row's cell and distance to the pivot, and of a query the lower bound of its k-th score."""
        for batch in batches:
            ids, v = batch.column("id").to_numpy(), matrix(batch.column("v"), width)
            with np.errstate(all="ignore"):
                cell, away = nearest(v, pivots)
                bound = np.full(len(ids), np.nan)
                asked = np.flatnonzero(ids % every == 0)
                bound[asked] = sample_bound(ids[asked], v[asked], sample_id, sample_v, k)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(away), pa.array(bound, from_pandas=True)], names=["id", "v", "g", "away", "bound"])

    placed = stored(rows.mapInArrow(in_worker(place), "id long, v array<double>, g int, away double, bound double"), "placed")
    discard(rows)
    query = F.col("bound").isNotNull()
    # One row a cell, at most MOST_PIVOTS.
    summary = placed.groupBy("g").agg(
        F.count("*").alias("n"), F.max("away").alias("radius"), F.count("bound").alias("asked"),
        F.coalesce(F.max(F.when(query, F.col("away"))), F.lit(0.0)).alias("asked_radius"), F.coalesce(F.min("bound"), F.lit(float("-inf"))).alias("bound"),
    ).toArrow()
    cells = Cells(pivots, summary, k)
    parts = np.maximum(1, -(-cells.asked // GROUP_QUERIES)).astype(np.int64)

    def send(batches):
        """A copy of each data row for every group that it may serve."""
        for batch in batches:
            ids = batch.column("id").to_numpy()
            row, to = cells.needed(matrix(batch.column("v"), width), batch.column("g").to_numpy())
            row, to, part = np.repeat(row, parts[to]), np.repeat(to, parts[to]), np.arange(parts[to].sum()) - np.repeat(np.cumsum(parts[to]) - parts[to], parts[to])
            block = (ids[row].astype(np.uint64) * np.uint64(2654435761) >> np.uint64(16)) % np.uint64(blocks)
            for lo in range(0, len(row), 10_000):
                own = pa.array(row[lo : lo + 10_000])
                columns = [batch.column("id").take(own), batch.column("v").take(own), *(pa.array(x[lo : lo + 10_000].astype(np.int32)) for x in (to, part, block))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "g", "s", "b"])

    data = placed.select("id", "v", "g").mapInArrow(in_worker(send), "id long, v array<double>, g int, s int, b int")
    numbers = F.array(*(F.lit(int(p)) for p in parts))
    part = F.pmod(F.xxhash64("id"), F.element_at(numbers, F.col("g") + 1)).cast("int")
    asked = placed.where(query).dropDuplicates(["id", "v"]).select("id", "v", "g", part.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    return asked, data, width


def replication(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """How many copies of a data row the join deals out, on average."""
    _, data, _ = _joined(df, k, every, id_col, vector_col)
    rows = df.where(F.col(vector_col).isNotNull()).count()
    return data.count() / max(rows, 1)


def voronoi_top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the k best other rows for each row whose id is divisible by ``every``."""
    asked, data, width = _joined(df, k, every, id_col, vector_col)

    def solve(query: pa.Table, own: pa.Table) -> pa.Table:
        if not (query.num_rows and own.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "row", "vec_id", "score")})
        ids, vec_id = query.column("id").to_numpy(), own.column("id").to_numpy()
        q, vec, score = top(ids, matrix(query.column("v"), width), vec_id, matrix(own.column("v"), width), k)
        return pa.table({"query_id": ids[q], "row": query.column("row").to_numpy()[q], "vec_id": vec, "score": score})

    # Rows of one id with different vectors are queries of their own.
    asked = asked.withColumn("row", F.xxhash64("id", "v"))
    best = asked.groupBy("g", "s", "b").cogroup(data.groupBy("g", "s", "b")).applyInArrow(solve, "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_top_k(read(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.v, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v d ON q.vec_id <> d.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
