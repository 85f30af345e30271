"""Helpers that the corpus operators share: tables, scratch space, Arrow text access."""

from __future__ import annotations

import ctypes
import sys
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Executors need not have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])

#: Python workers process texts in slices of about this many bytes.
SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a local one only where that is unset and all runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="docweave-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/docweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._docweave_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing will read any more: all that was made from them must itself be stored."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._docweave_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def process_cache(name: str, make):
    """A value that lives in the Python worker until a task of another name begins: workers outlast tasks, so at most one is kept."""
    held = sys.__dict__.setdefault("_docweave_process_cache", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def in_worker(run, cache: str = ""):
    """``run`` for mapInArrow: what other steps keep in the worker goes first, and free memory goes back to the system at the end."""

    def wrapped(batches):
        held = sys.__dict__.setdefault("_docweave_process_cache", {})
        if cache not in held:
            held.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def every_column(df: DataFrame) -> list:
    """All columns, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list:
    """Columns that identify a document even if doc_id is null or repeated.

    Rows that agree in both are repeats of one another, for which every operator
    computes the same.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(doc_id).isNull()).alias("k2"),
    ]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null reads as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def distinct_numbers(raw: np.ndarray, keep: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Numbers of byte spans, equal if and only if the bytes are: the spans, of the given sizes, make up ``raw[keep]``."""
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    spans = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(raw[keep])])
    return spans.dictionary_encode().indices.to_numpy()


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES):
    """Row ranges of a batch of about ``most`` bytes of text, one row at least."""
    _, at = utf8(batch.column(text))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


#: An odd multiplier for ordered pairs of hashes.
ODD = np.uint64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Masks of the last bytes of a span, by their number.
TAIL = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Spans longer than this are hashed one by one.
LONG_SPAN = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (shift, multiply, twice)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, eight at a time.

    Every step is scrambled, so that no family of texts collides by its form, as
    it does under polynomials modulo 2 ** 64; spans of equal length and at most
    eight bytes never collide.
    """
    from xxhash import xxh3_64_intdigest

    length = end - start
    h = mix(length.astype(np.uint64) * ODD + np.uint64(1))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    long = np.flatnonzero(length > LONG_SPAN)
    for i in long.tolist():
        h[i] = xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    live = np.flatnonzero((length > 0) & (length <= LONG_SPAN))
    done = 0
    while len(live):
        left = length[live] - done
        h[live] = mix(h[live] ^ (eight[start[live] + done] & TAIL[np.minimum(left, 8)]))
        live = live[left > 8]
        done += 8
    return h


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every ``[^\\x20\\x09-\\x0D]+`` word, and how many words come before each document."""
    solid = ~IS_SPACE[raw]
    n = len(raw)
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    inner = at[(at > 0) & (at < n)]
    opens[inner] = solid[inner]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    closes[inner - 1] = solid[inner - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, at)


def window_hash(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n word hashes, in O(log n) scrambled passes."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    done, total, part, width, left = 0, np.full(m, np.uint64(n)), word, 1, n
    while left:
        if left & 1:
            total = mix(total * ODD + part[done : done + m])
            done += width
        left >>= 1
        if left:
            part = mix(part[:-width] * ODD + part[width:])
            width *= 2
    return total
