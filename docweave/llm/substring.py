"""Substring deduplication with an FM-index per shard.

A window of ``window`` words is routed by the smallest hash among its short
word n-grams, so equal windows meet wherever they are; neighbouring windows
with the same smallest hash travel as one segment. Only segments whose hash
occurs more than once can repeat. Of equal segments one copy, with their
number, is extracted; each shard builds a compressed FM-index of its segments
and streams them through it by backward search, which reports the windows that
occur more than once. Hashes with very many different segments are dealt anew,
window by window, and equal windows are summed before they reach a shard.

Edge cases: null text has no words; a document shorter than a window keeps all
its words; repeated rows are copies of one another, so their windows repeat;
null doc_ids are told apart by their text; extra columns are not read unless
asked for; an empty table gives an empty result; texts are never cut.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, ODD, discard, distinct_numbers, doc_key, every_column, in_worker, mix, read, slices, span_hash, stored, utf8, window_hash, words
from .fm_index import FMIndex, repeated_windows

WINDOW = 35
#: Words of the n-grams by which windows are routed.
ANCHOR = 8
#: The low bits of a hash that give way to a place when the smallest is sought.
PLACE = np.uint64((1 << 28) - 1)
#: Words in a shard, about.
SHARD_WORDS = 500_000
#: A hash with more different segments than this is dealt anew by window.
HOT = 2_000


def slide_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def segments(batch: pa.RecordBatch, window: int, full: bool) -> pa.RecordBatch | None:
    """Runs of windows that share the place of their smallest n-gram hash ``anchor``: key, first window, number of windows, content hash."""
    raw, at = utf8(batch.column("text"))
    start, end, first = words(raw, at)
    if len(start) < window:
        return None
    value = span_hash(raw, start, end)
    gram = min(ANCHOR, window)
    # The leftmost place of the smallest hash in each window, so that equal windows of a document are never in one run.
    gram_hash = window_hash(value, gram)
    place = np.arange(len(gram_hash), dtype=np.uint64)
    least = (slide_min((gram_hash & ~PLACE) | place, window - gram + 1) & PLACE).astype(np.int64)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(first))
    whole = doc[: len(least)] == doc[window - 1 :]
    begin = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])])
    count = np.diff(np.r_[begin, len(least)])
    begin, count = begin[whole[begin]], count[whole[begin]]
    anchor = pa.array(gram_hash[least[begin]].view(np.int64))
    if not full:
        return pa.RecordBatch.from_arrays([anchor], names=["anchor"])
    # The first and the last window of a segment cover it.
    whole_hash = window_hash(value, window)
    content = mix(mix(whole_hash[begin] * ODD + whole_hash[begin + count - 1]) ^ count.astype(np.uint64)).view(np.int64)
    own = pa.array(doc[begin])
    return pa.RecordBatch.from_arrays(
        [batch.column("k1").take(own), batch.column("k2").take(own), pa.array((begin - first[doc[begin]]).astype(np.int32)), pa.array(count.astype(np.int32)), anchor, pa.array(content)],
        names=["k1", "k2", "start", "n", "anchor", "content"],
    )


def _all_segments(docs: DataFrame, window: int, full: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                if (got := segments(part, window, full)) is not None:
                    yield got

    if not full:
        return docs.select("text").mapInArrow(in_worker(run), "anchor long")
    return docs.mapInArrow(in_worker(run), "k1 long, k2 long, start int, n int, anchor long, content long")


def _extracted(docs: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """The words of the chosen segments, or of each of their windows where they are hot."""
    lists = stored(chosen.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "anchor", "content", "copies", "hot")).alias("s")), "lists")

    def run(batches):
        from xxhash import xxh3_64_intdigest as xxh

        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, found in zip(part.column("text").to_pylist(), part.column("s").to_pylist(), strict=True):
                    every = (text or "").encode().split()
                    for s in found:
                        a, n = s["start"], s["n"]
                        if not s["hot"]:
                            rows.append((s["anchor"], s["content"], 0, n, s["copies"], s["anchor"], b" ".join(every[a : a + n + window - 1])))
                            continue
                        for i in range(n):
                            own = b" ".join(every[a + i : a + i + window])
                            rows.append((s["anchor"], s["content"], i, 1, s["copies"], xxh(own) - (1 << 63), own))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=False)), pa.array(list(cols[6]), pa.binary()).cast(pa.string())], names=["anchor", "content", "offset", "n", "copies", "route", "words"])

    found = docs.join(lists, ["k1", "k2"]).select("text", "s").mapInArrow(in_worker(run), "anchor long, content long, offset int, n int, copies long, route long, words string")
    found = stored(found, "segments")
    discard(lists)
    return found


def search_shard(parts: list[pa.RecordBatch], window: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Index all segments of a shard, then stream them through it: their rows and the windows that repeat."""
    table = pa.Table.from_batches(parts)
    # Repeated rows of a document extract the same segment again.
    seen = [table.column(c).to_numpy() for c in ("route", "anchor", "content", "offset")]
    order = np.lexsort(seen)
    once = np.ones(len(order), bool)
    once[1:] = np.any([c[order][1:] != c[order][:-1] for c in seen], axis=0)
    table = table.take(pa.array(order[once]))
    raw, at = utf8(table.column("words"))
    start, end, first = words(raw, at)
    lengths = np.diff(first)
    numbers = distinct_numbers(raw, ~IS_SPACE[raw], end - start).astype(np.int64) + 1
    index = FMIndex(numbers, lengths, table.column("copies").to_numpy() > 1)
    row, lo, hi = repeated_windows(index, numbers, lengths, window)
    return table, row, lo, hi


def _searched(found: DataFrame, shards: int, window: int) -> DataFrame:
    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table, row, lo, hi = search_shard(parts, window)
        own = table.select(["anchor", "content"]).take(pa.array(row))
        out = own.append_column("lo", pa.array(lo.astype(np.int32))).append_column("hi", pa.array(hi.astype(np.int32)))
        yield from out.to_batches(max_chunksize=100_000)

    return found.repartition(shards, "route").mapInArrow(in_worker(run), "anchor long, content long, lo int, hi int")


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, spans): for documents with repeated windows, the word ranges [lo, hi) that those cover.

    ``docs`` has k1, k2 (see ``doc_key``) and text.
    """
    # Small sides of joins are stored here, so that a key with very many rows can be split over tasks.
    repeated = stored(_all_segments(docs, window, False).groupBy("anchor").count().where("count > 1").select("anchor"), "repeated")
    candidates = stored(_all_segments(docs, window, True).join(repeated, "anchor"), "candidates")
    chosen = candidates.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "start", "n")).alias("at"))
    chosen = stored(chosen.select("anchor", "content", "copies", "at.*"), "chosen")
    hot = stored(chosen.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    found = _extracted(docs, chosen.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False))), window)
    discard(repeated, chosen, hot)
    dealt = F.col("route") == F.col("anchor")
    size = found.agg(F.sum(F.when(dealt, F.col("n") + window - 1)), F.sum(F.when(dealt, 0).otherwise(window))).first()
    shards = [max(1, -(-(x or 0) // SHARD_WORDS)) for x in size]
    result = _searched(found.where(dealt), shards[0], window)
    again = None
    if size[1]:
        # Equal windows of hot segments are one row, with their number, before they meet.
        apart = found.where(~dealt).dropDuplicates(["anchor", "content", "offset"])
        summed = apart.groupBy("route", "words").agg(F.sum("copies").alias("copies"))
        summed = summed.select(F.col("route").alias("anchor"), F.xxhash64("words").alias("content"), F.lit(0).alias("offset"), F.lit(1).alias("n"), "copies", "route", "words")
        again = stored(_searched(summed, shards[1], window).select(F.col("anchor").alias("route"), F.col("content").alias("of")), "again")
        back = apart.withColumn("of", F.xxhash64("words")).join(again, ["route", "of"])
        result = result.union(back.select("anchor", "content", F.col("offset").alias("lo"), (F.col("offset") + 1).alias("hi")))
    result = stored(result, "repeats")
    discard(found, *([again] if again else []))
    spans = candidates.join(result, ["anchor", "content"]).select("k1", "k2", F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") + window - 1).alias("hi")).alias("span"))
    spans = stored(spans.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans")), "spans")
    discard(candidates, result)
    return spans


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n words lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["lo"]] += 1
        edge[s["hi"]] -= 1
    return np.cumsum(edge[:-1]) > 0


def _with_spans(docs: DataFrame, window: int, *extra: Column) -> DataFrame:
    """The ``extra`` columns of every row of ``docs``, its ``text`` and its repeated ``spans``."""
    keyed = docs.select(*extra, F.col("text").cast("string").alias("text"), *doc_key())
    return keyed.join(repeated_passages(keyed.select("k1", "k2", "text"), window), ["k1", "k2"], "left").drop("k1", "k2")


def word_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words of each row of ``docs`` (doc_id, text)."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                every = (text or "").encode().split()
                kept = every
                if spans:
                    gone = covered(len(every), spans)
                    kept = [w for w, g in zip(every, gone.tolist(), strict=True) if not g]
                rows.append((doc_id, len(every), len(every) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_spans(docs, window, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(in_worker(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with each word that a repeated window covers, and the white space after it, cut from ``text``.

    All columns stay; a null text stays null.
    """

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                if spans:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    start, _, _ = words(raw, np.array([0, len(raw)]))
                    gone = covered(len(start), spans)
                    edge = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edge, start[gone], 1)
                    np.add.at(edge, np.append(start, len(raw))[1:][gone], -1)
                    text = raw[np.cumsum(edge[:-1]) == 0].tobytes().decode()
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    others = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    named = [x.alias(others[c]) for c, x in zip(docs.columns, every_column(docs), strict=True) if c != "text"]
    rows = _with_spans(docs, window, F.struct(F.lit(0).alias("none"), *named).alias("row"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(in_worker(run), schema).select(*(F.col("text") if c == "text" else F.col("row")[others[c]].alias(c) for c in docs.columns))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_digest(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35
), hashed AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM starts
), twice AS (
  SELECT h FROM hashed GROUP BY h HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM hashed WHERE h IN (SELECT h FROM twice)
), lists AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN lists USING (doc_id)
"""
