"""Quality rules by repetition coverage.

Rolling hashes of several n-gram lengths are compared within each document in
numpy, and n-grams of equal hashes word by word; what share of a document's
characters lies inside n-grams that occur more than once, or inside repeated
lines, decides.

Edge cases: a null text counts as empty (no words, so it fails the base rule);
null doc_ids and repeated rows pass through, one result a row; other columns
are not read, so clashing names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, ODD, distinct_numbers, in_worker, mix, read, slices, utf8, words

#: Most of a document's word characters that may lie in n-grams found twice or more, by n.
MOST_IN_NGRAMS = {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25}
#: Most of a document's line characters that may lie in repeats of earlier lines.
MOST_IN_LINES = 0.30

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_chars long, dup_line_chars long, " + ", ".join(f"dup_chars_{n} long" for n in MOST_IN_NGRAMS)
)


def _repeated(key: np.ndarray, at: np.ndarray, n: int, word: np.ndarray) -> np.ndarray:
    """The places ``at`` whose n words also stand at another place; ``key`` is a hash of those."""
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    a, b = at[order[same]], at[order[same + 1]]
    for i in range(n):
        equal = word[a + i] == word[b + i]
        a, b = a[equal], b[equal]
    out = np.zeros(len(word), bool)
    out[a] = out[b] = True
    return np.flatnonzero(out)


def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, at = utf8(batch.column("text"))
    n_docs = batch.num_rows
    per_doc = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])
    leads = (raw & 0xC0) != 0x80
    solid = ~IS_SPACE[raw]
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    start, end, first = words(raw, at)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n_docs), n_words)
    chars = np.concatenate([[0], np.cumsum(leads, dtype=np.int64)])
    length = chars[end] - chars[start]
    # Words have numbers, and equal words of two documents different ones.
    word = distinct_numbers(raw, solid, end - start) + doc * (np.int64(len(start)) + 1)
    out = {
        "doc_id": batch.column("doc_id").cast(pa.int64()),
        "n_words": n_words,
        "word_chars": per_doc(leads & solid),
        "n_symbols": per_doc(symbol[raw]),
    }

    # Lines: from each newline or document start to the next.
    cuts = np.flatnonzero(raw == 10)
    line_start = np.unique(np.concatenate([at[:-1], cuts + 1]))
    line_start = line_start[line_start < len(raw)]
    line_end = np.empty_like(line_start)
    if len(line_start):
        line_end[:-1] = line_start[1:]
        line_end[-1] = len(raw)
        ends_in_newline = raw[line_end - 1] == 10
        line_end = line_end - ends_in_newline
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_doc = np.searchsorted(at, line_start, "right") - 1
    line_chars = chars[line_end] - chars[line_start]
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[line_start] += 1
    edge[line_end] -= 1
    line = distinct_numbers(raw, np.cumsum(edge[:-1], dtype=np.int8) > 0, line_end - line_start) + line_doc * (np.int64(len(line_start)) + 1)
    order = np.argsort(line, kind="stable")
    later = np.zeros(len(line), bool)
    later[order[1:]] = line[order][1:] == line[order][:-1]
    count = lambda ids, weight: np.bincount(ids, weight, n_docs).astype(np.int64)
    out["n_dup_lines"] = count(line_doc[later], np.ones(int(later.sum())))
    out["line_chars"] = count(line_doc, line_chars)
    out["dup_line_chars"] = count(line_doc[later], line_chars[later])

    rolling = value = mix(word.astype(np.uint64) * ODD + np.uint64(1))
    width = 1
    for n in MOST_IN_NGRAMS:
        # One more word a step.
        while width < n and len(rolling) > 1:
            rolling = mix(rolling[:-1] * ODD + value[width:])
            width += 1
        covered = np.zeros(len(word) + 1, np.int32)
        if width == n and len(word) >= n:
            whole = np.flatnonzero(doc[: len(rolling)] == doc[n - 1 :])
            twice = _repeated(rolling[whole], whole, n, word)
            covered[twice] += 1
            covered[twice + n] -= 1
        inside = np.cumsum(covered[:-1]) > 0
        out[f"dup_chars_{n}"] = count(doc[inside], length[inside])
        if n == 8:
            out["n_repeat_words"] = np.bincount(doc[inside], minlength=n_docs)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(out[k], pa.int64()) for k in names], names=names)


def repetition_coverage(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): word, line and n-gram repetition figures, ``base_failed``, ``kept``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield measure(part)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(in_worker(run), SCHEMA)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    over = F.col("dup_line_chars") > MOST_IN_LINES * F.col("line_chars")
    for n, most in MOST_IN_NGRAMS.items():
        over = over | (F.col(f"dup_chars_{n}") > most * F.col("word_chars"))
    return found.withColumn("base_failed", base_failed).withColumn("kept", ~base_failed & ~over)


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_coverage(read(spark, sf_dir, "documents"))

def _oracle() -> str:
    grams = "\n".join(
        f"""g{n} AS (SELECT row, i, md5(array_to_string(w[i:i + {n - 1}], ' ')) AS h FROM (SELECT row, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n})),
t{n} AS (SELECT row, i FROM g{n} QUALIFY count(*) OVER (PARTITION BY row, h) > 1),
c{n} AS (SELECT row, count(*) AS repeats, sum(length(w[i]))::BIGINT AS chars FROM (SELECT DISTINCT row, unnest(range(i, i + {n})) AS i FROM t{n}) JOIN d USING (row) GROUP BY row),"""
        for n in MOST_IN_NGRAMS
    )
    joins = " ".join(f"LEFT JOIN c{n} USING (row)" for n in MOST_IN_NGRAMS)
    chars = ", ".join(f"coalesce(c{n}.chars, 0)::BIGINT AS dup_chars_{n}" for n in MOST_IN_NGRAMS)
    over = " OR ".join(f"dup_chars_{n} > {most}::DOUBLE * word_chars" for n, most in MOST_IN_NGRAMS.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
{grams}
l AS (SELECT row, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY row, line ORDER BY k) AS times FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
s AS (SELECT row, count(*) FILTER (times > 1) AS dup, sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (times > 1), 0) AS dup_chars FROM n GROUP BY row),
r AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(s.dup, 0)::BIGINT AS n_dup_lines, coalesce(c8.repeats, 0)::BIGINT AS n_repeat_words, coalesce(s.chars, 0)::BIGINT AS line_chars, coalesce(s.dup_chars, 0)::BIGINT AS dup_line_chars, {chars}
  FROM d LEFT JOIN s USING (row) {joins})
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (dup_line_chars > {MOST_IN_LINES}::DOUBLE * line_chars OR {over}) AS kept
FROM r
"""


OP7_SQL = _oracle()
