"""SimHash near-duplicates by a segment-popcount embedding.

Each 64-bit fingerprint maps to the bit counts of its 2-bit segments. The
Manhattan distance of two count vectors is a lower bound of the Hamming
distance, so fingerprints within ``distance`` bits agree in the counts of all
but ``distance`` of any blocks of segments. Each choice of the blocks that agree
is a grid over the count vectors; fingerprints meet in its cells, are cut down by
the Manhattan bound and verified bit by bit. Cells with very many members are dealt
anew by grids over the bits themselves. Links become connected components, and
only links that connect something new leave a task.

Edge cases: a null text has no words, and a text without words has fingerprint
zero and links like any other; a text with fewer words than a shingle is one
shingle; exact copies and repeated rows share a fingerprint and hence a
component; a null doc_id is never a component's name unless no member has an
id, in which case the name is null; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, in_worker, mix, read, slices, stored
from .components import components, local_stars

SEED = 42
SEGMENTS = 32
PAIRS = np.uint64(0x5555555555555555)
#: Rows of a grid that a task holds.
TASK_ROWS = 400_000
#: Cells up to this size compare all members at once; larger ones only what may still connect.
SMALL_CELL = 32
#: Cells with more members than this are dealt anew.
HOT_CELL = 5_000

# For each byte value a 64-bit word whose bytes are its bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint_of(texts: list[bytes], n: int) -> np.ndarray:
    """Fingerprints of UTF-8 texts: each bit by majority of the XXH64 of the n-word shingles, A-Z lower-cased."""
    from xxhash import xxh64_intdigest as xxh

    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        plain = b" ".join(words)
        if len(words) <= n:
            hashes.append(xxh(plain, SEED))
            sizes[i] = 1
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - n] + 1).tolist()]
        hashes += [xxh(plain[s:e], SEED) for s, e in zip(starts, ends[n - 1 :].tolist(), strict=True)]
        sizes[i] = len(starts)
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    lanes = LANES[np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)]
    # A lane counts to 255, so long documents are summed in runs.
    own = np.flatnonzero(sizes)
    size = sizes[own]
    first = np.cumsum(size) - size
    runs = -(-size // 255)
    run_first = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    sums = np.add.reduceat(lanes, run_first, axis=0).view(np.uint8).astype(np.int64)
    counts = np.add.reduceat(sums, np.cumsum(runs) - runs, axis=0)
    out[own] = np.packbits(2 * counts > size[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int, keep: tuple = ()) -> DataFrame:
    """The ``keep`` columns (doc_id by default) and ``fp`` (the fingerprint as a signed long) of each row."""
    keep = keep or (F.col("doc_id").cast("long").alias("doc_id"),)
    source = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kept = [f.name for f in source.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text"), "fp long"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                fp = fingerprint_of([(t or "").encode() for t in part.column("text").to_pylist()], words)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(fp.view(np.int64))], names=[*kept, "fp"])

    return source.mapInArrow(in_worker(run), schema)


def unary(fp: np.ndarray) -> np.ndarray:
    """The count of each 2-bit segment in unary: the Manhattan distance of counts is the Hamming distance of these."""
    low, high = fp & PAIRS, (fp >> np.uint64(1)) & PAIRS
    return (low | high) | ((low & high) << np.uint64(1))


def block_masks(blocks: int) -> list[int]:
    cuts = [round(i * SEGMENTS / blocks) for i in range(blocks + 1)]
    return [((1 << 2 * b) - 1) ^ ((1 << 2 * a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def n_blocks(n: int, distance: int, agree: float = 3 / 8) -> int:
    """How many blocks make the rows of the grids and the comparisons in their cells cheapest; results don't depend on it.

    Two random counts of a segment ``agree`` with probability 3/8, the bits of segments of equal counts with 1/2 at least.
    """
    cost = lambda m: comb(m, distance) * (n + n * n / 2 * agree ** (SEGMENTS * (m - distance) / m) / 50)
    return min(range(distance + 2, 2 * distance + 5), key=cost)


def cell_links(key: np.ndarray, fp: np.ndarray, grid: np.ndarray, masks: list[int], choices: list[tuple], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the cells, enough to connect what is connected.

    With ``choices`` a link counts only in the first grid in which its ends meet.
    What a cell leaves out is connected by links of earlier grids, by induction.
    """
    code = unary(fp)
    order = np.lexsort((fp, key))
    key, fp, code, grid = key[order], fp[order], code[order], grid[order]
    limit = np.uint64(distance)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    block = [np.uint64(m) for m in masks]
    rank = {c: i for i, c in enumerate(choices)}
    need = len(choices[0]) if choices else 0

    def near(a, b):
        """Manhattan bound, then bits."""
        hit = np.flatnonzero(np.bitwise_count(code[a] ^ code[b]) <= limit)
        a, b = a[hit], b[hit]
        hit = np.bitwise_count(fp[a] ^ fp[b]) <= limit
        return a[hit], b[hit]

    def take(a, b):
        if not len(a) or not choices:
            left.append(fp[a])
            right.append(fp[b])
            return
        differ = code[a] ^ code[b]
        agree = np.stack([(differ & m) == 0 for m in block], 1)
        first = agree & (np.cumsum(agree, 1) <= need)
        number = first @ (1 << np.arange(len(block)))
        own = np.array([rank[tuple(j for j in range(len(block)) if x >> j & 1)] for x in np.unique(number).tolist()])
        here = own[np.searchsorted(np.unique(number), number)] == grid[a]
        left.append(fp[a[here]])
        right.append(fp[b[here]])

    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(cuts)
    small = np.repeat(size <= SMALL_CELL, size) & np.repeat(size > 1, size)
    rows = np.flatnonzero(small)
    for off in range(1, SMALL_CELL):
        rows = rows[rows + off < len(key)]
        rows = rows[key[rows] == key[rows + off]]
        if not len(rows):
            break
        take(*near(rows, rows + off))
    for at in np.flatnonzero(size > SMALL_CELL).tolist():
        lo, n = int(cuts[at]), int(size[at])
        members = np.arange(lo, lo + n)
        label = np.arange(n)
        count = np.ones(n, np.int64)
        waiting = np.ones(n, bool)
        # Until all members outside the largest component have been compared with everything: any link has an end outside it.
        while True:
            largest = int(np.argmax(count))
            out = np.flatnonzero(waiting & (label != largest))
            if not len(out):
                break
            pivot = int(out[0])
            waiting[pivot] = False
            other = np.flatnonzero(label != label[pivot])
            _, hit = near(np.full(len(other), lo + pivot), members[other])
            if not len(hit):
                continue
            hit = hit - lo
            _, one_each = np.unique(label[hit], return_index=True)
            take(np.full(len(one_each), lo + pivot), lo + hit[one_each])
            joined = np.isin(label, np.append(label[hit[one_each]], label[pivot]))
            name = int(label[joined].min())
            label[joined] = name
            count = np.bincount(label, minlength=n)
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(left), np.concatenate(right)


def _to_cells(masks: list[int], distance: int, counts: bool):
    """For mapInArrow: (key, fp, grid) of every cell that a fingerprint lies in, by its counts or, within a cell ``of``, by its bits."""
    grids = np.array([sum(c) for c in combinations(masks, len(masks) - distance)], np.uint64)

    def run(batches):
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            of = np.zeros(len(every), np.uint64) if counts else batch.column("of").to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(every), 20_000):
                fp = every[lo : lo + 20_000]
                key = mix(((unary(fp) if counts else fp)[:, None] & grids) ^ mix(of[lo : lo + 20_000, None] + np.arange(1, len(grids) + 1, dtype=np.uint64)))
                grid = np.broadcast_to(np.arange(len(grids), dtype=np.int16), key.shape)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(fp, len(grids)).view(np.int64)), pa.array(grid.ravel())], names=["key", "fp", "grid"])

    return in_worker(run)


def _in_cells(masks: list[int], choices: list[tuple], distance: int):
    """For mapInArrow: the links of the cells of a task."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        key, fp, grid = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in ("key", "fp", "grid"))
        a, b = cell_links(key.view(np.uint64), fp.view(np.uint64), grid, masks, choices, distance)
        if len(a):
            a, b = local_stars(a.view(np.int64), b.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    return in_worker(run)


def links(classes: DataFrame, n: int, distance: int, hot_cell: int = HOT_CELL) -> DataFrame:
    """(u, v): links that connect the fingerprints ``fp`` within ``distance`` bits; ``n`` is their number."""
    blocks = n_blocks(max(n, 2), distance)
    masks, choices = block_masks(blocks), list(combinations(range(blocks), blocks - distance))
    schema = "key long, fp long, grid short"
    cells = classes.select("fp").mapInArrow(_to_cells(masks, distance, True), schema)
    tasks = max(1, -(-n * len(choices) // TASK_ROWS))
    hot = stored(cells.groupBy("key").count().where(F.col("count") > hot_cell).select("key"), "hot")
    if not hot.count():
        return cells.repartition(tasks, "key").mapInArrow(_in_cells(masks, choices, distance), "u long, v long")
    found = cells.join(hot, "key", "left_anti").repartition(tasks, "key").mapInArrow(_in_cells(masks, choices, distance), "u long, v long")
    members = stored(cells.join(hot, "key").select(F.col("key").alias("of"), "fp"), "members")
    many = members.count()
    blocks = n_blocks(many, distance, 1 / 2)
    masks = block_masks(blocks)
    tasks = max(1, -(-many * comb(blocks, distance) // TASK_ROWS))
    anew = members.mapInArrow(_to_cells(masks, distance, False), schema).repartition(tasks, "key")
    return found.union(anew.mapInArrow(_in_cells(masks, [], distance), "u long, v long"))


def near_duplicates(docs: DataFrame, words: int = 5, distance: int = 4) -> DataFrame:
    """doc_id, ``fingerprint`` (16 hex digits) and ``component_id`` of every row of ``docs`` (doc_id, text).

    Components are of all fingerprints that link at ``distance`` or fewer
    differing bits; their name is the smallest doc_id in them.
    """
    rows = stored(fingerprints(docs, words), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    found = components(links(classes, classes.count(), distance)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = classes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    name = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(name, "root").select("fp", "component_id"), "named")
    discard(classes)
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=4, distance=4)
