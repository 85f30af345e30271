"""Sequential decisions within a document, many documents a batch.

A document's rows become one list, which an Arrow batch carries to Python with
those of many others: a call for each document would cost more than its work.
"""

from __future__ import annotations

import ctypes
import itertools
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

# Executors need not have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__.split(".")[0]])


#: Bytes of a batch whose rows are Python objects at once, and rows of a batch of results.
PIECE, RESULTS = 1 << 20, 10_000


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in pieces of some ``PIECE`` bytes, a row at least, so that memory doesn't grow with a batch; what is free after the last goes back."""
    try:
        for batch in batches:
            sizes = max(1, batch.num_rows * PIECE // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, sizes):
                yield batch.slice(i, sizes)
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def _results(found: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for rows in itertools.batched(found, RESULTS):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def fold_documents(rows: DataFrame, columns: list[str], fold: Callable[[list[dict]], Iterable[tuple]], schema: str, *key: str) -> DataFrame:
    """``key`` (doc_id unless stated) and the columns of ``schema``: what ``fold`` returns for the list of each key's rows, which come in no order."""
    key = key or ("doc_id",)
    lists = rows.groupBy(*key).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    out = StructType([*(StructField(k, rows.schema[k].dataType) for k in key), *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in pieces(batches):
            keys = zip(*(batch.column(k).to_pylist() for k in key), strict=True)
            yield from _results(((*own, *row) for own, rows_ in zip(keys, batch.column("rows").to_pylist(), strict=True) for row in fold(rows_)), arrow)

    return lists.mapInArrow(run, out)


def unfold(rows: DataFrame, column: str, read: Callable[[object], Iterable[tuple]], schema: str, key: str = "doc_id") -> DataFrame:
    """``key`` and the columns of ``schema``: the rows that ``read`` makes of each value of ``column``."""
    out = StructType([StructField(key, rows.schema[key].dataType), *_parse_datatype_string(schema).fields])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in pieces(batches):
            yield from _results(((k, *row) for k, value in zip(batch.column(key).to_pylist(), batch.column(column).to_pylist(), strict=True) for row in read(value)), arrow)

    return rows.select(key, column).mapInArrow(run, out)
