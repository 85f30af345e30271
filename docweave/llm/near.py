"""Near copies by the exact Jaccard similarity of their word shingles.

Links are all pairs of shingle sets with a similarity of ``LEAST`` or more. Two
routes find them, and each pair belongs to one. Pairs with fingerprints within
``DISTANCE`` bits come from ``simhash`` alone: its links make components, and
the sets of a component meet in a cell. Pairs that differ in more bits come
without loss by prefix filtering: the sets are sorted by one order for all, rare
shingles first, and two similar sets must share one of the first few, whose sets
are a cell. Components of over ``TOGETHER`` sets are dealt anew by these
shingles. Sets that meet are cut down by their sizes, the shingle's places and a
parity sketch of the sets, and compared as a whole. A first round compares each
set with one other a route, two more with the nearest sets of other components,
and the last compares all that these leave unconnected.

Edge cases: a null text has no words, and texts without words are copies of one
another; a text with fewer words than a shingle is one shingle; repeated shingles
of a text count once; A-Z are lower-cased; a null doc_id comes after all others;
repeated rows are copies; other columns, whatever their names, only pass through;
an empty table gives an empty result; texts are never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, doc_key, every_column, in_worker, mix, slices, span_hash, stored, utf8, window_hash, words
from .components import components

#: Least similarity, as a fraction.
LEAST = (4, 5)
#: Bits within which a pair belongs to the fingerprints.
DISTANCE = 4
#: Sets of a component of fingerprints that meet in one cell; larger ones are dealt anew by shingles. Results don't depend on it.
TOGETHER = 5_000
#: Sets that say which shingles are common, about, and how many of those are told apart. The order doesn't change results.
SAMPLE = 40_000
MOST_COMMON = 200_000
#: 64-bit words of the sketch that travels with a set's cells.
SMALL = 8
#: Rows of cells that a task holds, about; pairs that it compares at once.
TASK_ROWS = 200_000
#: Sets of other components that a set is compared with in a cell before the last round, and how many such rounds there are.
NEAREST, ROUNDS = 1, 2
PAIRS = 200_000
#: Texts that are compared as a whole are looked up by broadcast up to this many, which are counted first.
BROADCAST_ROWS = 250_000


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct n-word shingle, sorted by both."""
    raw, at = utf8(column)
    raw = raw + np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8)
    start, end, before = words(raw, at)
    word = span_hash(raw, start, end)
    count = np.diff(before)
    text = np.repeat(np.arange(len(count)), count)
    hashes = window_hash(word, n)
    inside = np.flatnonzero(text[: len(hashes)] == text[n - 1 :][: len(hashes)])
    short = np.flatnonzero((count > 0) & (count < n))
    whole = [window_hash(word[before[i] : before[i + 1]], int(count[i]))[0] for i in short.tolist()]
    text, hashes = np.r_[text[inside], short], np.r_[hashes[inside], np.array(whole, np.uint64)]
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def set_names(text: np.ndarray, hashes: np.ndarray, n_texts: int) -> np.ndarray:
    """A hash of each text's set."""
    name = np.zeros(n_texts, np.uint64)
    own, first = np.unique(text, return_index=True)
    if len(own):
        name[own] = mix(np.add.reduceat(mix(hashes), first))
    return name.view(np.int64)


def sketches(text: np.ndarray, hashes: np.ndarray, size: np.ndarray, longs: int = 0) -> pa.Array:
    """Parities of each text's set: each bit is that of its shingles there, so that two sets differ in at least as many shingles as bits.

    There are two bits a shingle at least, 1024 at least and a power of two, and
    the longer of two sketches is halved by combining its halves; or ``longs``
    64-bit words for every set.
    """
    longs = np.full(len(size), longs) if longs else 16 << np.ceil(np.log2(np.maximum(size, 512) / 512)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(longs)])
    code, count = np.unique(64 * at[text] + (mix(hashes) & (64 * longs[text] - 1).astype(np.uint64)).astype(np.int64), return_counts=True)
    odd = code[count % 2 == 1]
    bits = np.zeros(at[-1], np.uint64)
    np.bitwise_or.at(bits, odd >> 6, np.uint64(1) << (odd & 63).astype(np.uint64))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bits.view(np.int64)))


def _differ(a: str, b: str) -> Column:
    """In how many bits two sketches differ."""

    def fold(x: str) -> Column:
        half = F.shiftright(F.size(x), 1)
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    x = F.when(F.size(a) > F.size(b), fold(a)).otherwise(F.col(a))
    y = F.when(F.size(b) > F.size(a), fold(b)).otherwise(F.col(b))
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)


def _lists(text: np.ndarray, values: np.ndarray, n_texts: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n_texts + 1)).astype(np.int32)), pa.array(values.view(np.int64)))


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """``name`` and the whole ``set`` of each ``text``."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                text, hashes = shingle_sets(part.column("text"), n)
                yield pa.RecordBatch.from_arrays([pa.array(set_names(text, hashes, part.num_rows)), _lists(text, hashes, part.num_rows)], names=["name", "set"])

    return texts.select("text").mapInArrow(in_worker(run), "name long, set array<long>")


def _common(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sets of a bounded sample hold, sorted, and how many do."""
    rows = docs.count()
    texts = docs.select(F.col("text").cast("string").alias("text"))
    share = int(min(1.0, SAMPLE / max(rows, 1)) * 1_000_000)
    sample = texts.where(F.pmod(F.xxhash64("text", F.lit(n)), F.lit(1_000_000)) < share)
    counts = _sets(sample, n).dropDuplicates(["name"]).select(F.explode("set").alias("h")).groupBy("h").count().where("count > 2")
    got = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toArrow()
    h, count = got.column("h").to_numpy().view(np.uint64), got.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], count[order]


def _prefixes(docs: DataFrame, n: int, keep: tuple) -> DataFrame:
    """The ``keep`` columns, ``name``, ``size``, fingerprint ``fp``, the ``first`` shingles in the common order and the ``sketch`` of each row's set."""
    common, seen = _common(docs, n)
    source = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kept = [f for f in source.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "name long, size long, fp long, first array<long>, small array<long>, sketch array<long>"])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                text, hashes = shingle_sets(part.column("text"), n)
                name = set_names(text, hashes, part.num_rows)
                often = np.zeros(len(hashes), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                    often = np.where(common[at] == hashes, seen[at], 0)
                size = np.bincount(text, minlength=part.num_rows)
                order = np.lexsort((hashes, often, text))
                place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
                need = size - -(-LEAST[0] * size // LEAST[1]) + 1
                own = place < need[text]
                fp = simhash.fingerprint_of([(t or "").encode() for t in part.column("text").to_pylist()], n)
                columns = [*(part.column(f.name) for f in kept), pa.array(name), pa.array(size), pa.array(fp.view(np.int64)), _lists(text[own], hashes[order][own], part.num_rows), sketches(text, hashes, size, SMALL), sketches(text, hashes, size)]
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "name", "size", "fp", "first", "small", "sketch"])

    return source.mapInArrow(in_worker(run), schema)


def _cells(classes: DataFrame) -> DataFrame:
    """(key, name, size, place) of the first shingles that more than one set holds among its first."""
    rows = classes.select("name", "size", F.posexplode("first").alias("place", "key")).select("key", "name", F.col("size").cast("int").alias("size"), F.col("place").cast("int").alias("place"))
    # Stored, as are the other small sides of joins here, so that a key with very many rows can be split over tasks.
    met = stored(rows.groupBy("key").count().where("count > 1").select("key"), "met")
    cells = stored(rows.join(met, "key", "left_semi"), "cells")
    discard(met)
    return cells


def _may(size_a: Column, size_b: Column, place_a: Column, place_b: Column) -> Column:
    """Whether sets may be similar by their sizes and the places of a shingle that both hold.

    A pair's first common shingle bounds what follows it; for later ones the bound may drop the pair, which has then met before.
    """
    top, bottom = (F.lit(x).cast("long") for x in LEAST)
    return ((top + bottom) * F.least(size_a - place_a, size_b - place_b) >= top * (size_a + size_b)) & (bottom * F.least(size_a, size_b) >= top * F.greatest(size_a, size_b))


def _to_least(cells: DataFrame) -> DataFrame:
    """Pairs of each cell's least name with its others."""
    least = stored(cells.groupBy("key").agg(F.min(F.struct("name", "size", "place")).alias("m")), "least")
    x = cells.join(least, "key").where((F.col("name") != F.col("m.name")) & _may(F.col("size"), F.col("m.size"), F.col("place"), F.col("m.place")))
    pairs = stored(x.select(F.col("m.name").alias("u"), F.col("name").alias("v")).distinct(), "pairs")
    discard(least)
    return pairs


def _by_fingerprint(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of sets whose fingerprints are equal or linked; and cells, as of ``_cells``, in which similar sets with fingerprints within ``DISTANCE`` bits meet."""
    first = stored(classes.groupBy("fp").agg(F.min(F.struct("name", "size")).alias("m")), "fingerprints")
    found = stored(simhash.links(first, first.count(), DISTANCE), "links")
    side = lambda e: first.select(F.col("fp").alias(e), F.col("m").alias(f"m{e}"))
    linked = found.join(side("u"), "u").join(side("v"), "v").select(F.col("mu").alias("a"), F.col("mv").alias("b"))
    same = classes.join(first, "fp").select(F.col("m").alias("a"), F.struct("name", "size").alias("b"))
    close = LEAST[1] * F.least("a.size", "b.size") >= LEAST[0] * F.greatest("a.size", "b.size")
    pairs = linked.union(same).where((F.col("a.name") != F.col("b.name")) & close)
    pairs = stored(pairs.select(F.least("a.name", "b.name").alias("u"), F.greatest("a.name", "b.name").alias("v")).distinct(), "pairs")
    roots = components(found)
    sets = classes.join(roots.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    together = stored(sets.groupBy("root").count().where("count > 1"), "together")
    members = sets.withColumn("size", F.col("size").cast("int")).join(together, "root")
    cells = members.where(F.col("count") <= TOGETHER).select(F.xxhash64("root").alias("key"), "name", "size", F.lit(0).alias("place"))
    if together.where(F.col("count") > TOGETHER).count():
        anew = members.where(F.col("count") > TOGETHER).select("root", "name", "size", F.posexplode("first").alias("place", "shingle"))
        cells = cells.union(anew.select(F.xxhash64("root", "shingle"), "name", "size", "place"))
    cells = stored(cells, "close")
    discard(first, found, roots, together)
    return pairs, cells


def cell_pairs(key, name, size, place, close, label, fp, small, every: bool):
    """Pairs of names of different labels that meet in a cell of their route and may be similar by sizes, places and small sketches, in parts.

    In cells that are ``close`` these are pairs with fingerprints ``fp`` within
    DISTANCE bits, and in others those that differ in more. Members of a cell's
    most frequent label are compared with the others only; unless ``every``, each
    of these others gives its NEAREST pairs alone.
    """
    top, bottom = LEAST
    order = np.lexsort((name, size, key))
    key, name, size, place, close, label, fp, small = key[order], name[order], size[order].astype(np.int64), place[order].astype(np.int64), close[order], label[order], fp[order], small[order]
    if not len(key):
        return
    cell = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    by_label = np.lexsort((label, cell))
    run = np.cumsum(np.r_[True, (np.diff(cell[by_label]) != 0) | (np.diff(label[by_label]) != 0)]) - 1
    count = np.bincount(run)
    head = np.flatnonzero(np.r_[True, np.diff(run) != 0])
    best = np.lexsort((-count, cell[by_label[head]]))
    most = label[by_label[head[best[np.r_[True, np.diff(cell[by_label[head[best]]]) != 0]]]]]
    other = label != most[cell]
    width = np.int64(size.max()) + 1
    spot = cell * width + size
    rows = np.flatnonzero(other)
    lo = np.searchsorted(spot, cell[rows] * width + -(-top * size[rows] // bottom))
    hi = np.searchsorted(spot, cell[rows] * width + np.minimum(bottom * size[rows] // top, width - 1), "right")
    ahead = np.cumsum(hi - lo)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ahead, (ahead[at - 1] if at else 0) + PAIRS, "right")))
        n = hi[at:stop] - lo[at:stop]
        a = np.repeat(rows[at:stop], n)
        b = np.repeat(lo[at:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
        hit = (label[a] != label[b]) & (~other[b] | (a < b) | (not every)) & ((top + bottom) * np.minimum(size[a] - place[a], size[b] - place[b]) >= top * (size[a] + size[b]))
        a, b = a[hit], b[hit]
        hit = (np.bitwise_count(fp[a] ^ fp[b]) <= DISTANCE) == close[a]
        a, b = a[hit], b[hit]
        differ = np.bitwise_count(small[a] ^ small[b]).sum(1, dtype=np.int64)
        hit = (top + bottom) * differ <= (bottom - top) * (size[a] + size[b])
        a, b, differ = a[hit], b[hit], differ[hit]
        if not every:
            near = np.lexsort((name[b], differ, a))
            a, b = a[near], b[near]
            own = np.arange(len(a)) - np.searchsorted(a, a) < NEAREST
            a, b = a[own], b[own]
        a, b = name[a], name[b]
        yield np.minimum(a, b), np.maximum(a, b)
        at = stop


def _unconnected(cells: DataFrame, classes: DataFrame, roots: DataFrame, every: bool) -> DataFrame:
    """Pairs that meet in a cell and are of different components by ``roots``; all of them, or each set's nearest."""
    named = roots.select(F.col("u").alias("name"), F.col("v").alias("root"))
    labelled = stored(cells.join(named, "name", "left").select("key", "name", "size", "place", "close", F.coalesce("root", "name").alias("label")), "labelled")
    mixed = stored(labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key"), "mixed")
    rest = stored(labelled.join(mixed, "key", "left_semi").join(classes.select("name", "fp", "small"), "name"), "rest")
    names = ("key", "name", "size", "place", "close", "label")

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        small = np.concatenate([b.column("small").flatten().to_numpy() for b in got]).view(np.uint64).reshape(-1, SMALL)
        fp = np.concatenate([b.column("fp").to_numpy() for b in got]).view(np.uint64)
        for u, v in cell_pairs(*(np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in got]) for c in names), fp, small, every):
            both = np.unique(np.stack([u, v], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["u", "v"])

    tasks = max(1, -(-rest.count() // TASK_ROWS))
    pairs = stored(rest.select(*names, "fp", "small").repartition(tasks, "key").mapInArrow(in_worker(run), "u long, v long").distinct(), "pairs")
    discard(labelled, mixed, rest)
    return pairs


def _beyond(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) with fingerprints that differ in more than ``DISTANCE`` bits."""
    side = lambda e: classes.select(F.col("name").alias(e), F.col("fp").alias(f"fp_{e}"))
    return pairs.join(side("u"), "u").join(side("v"), "v").where(F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) > DISTANCE).select("u", "v")


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) that their sketches don't rule out."""
    top, bottom = LEAST
    side = lambda e: classes.select(F.col("name").alias(e), F.col("size").alias(f"size_{e}"), F.col("sketch").alias(f"sketch_{e}"))
    # Of similar sets at most this share of the sizes' sum differs.
    return pairs.join(side("u"), "u").join(side("v"), "v").where(_differ("sketch_u", "sketch_v") * (top + bottom) <= (F.col("size_u") + F.col("size_v")) * (bottom - top)).select("u", "v")


def _similar(pairs: DataFrame, rows: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """The pairs (u, v) whose whole sets are similar."""
    top, bottom = LEAST
    needed = stored(pairs.select(F.col("u").alias("name")).union(pairs.select("v")).distinct(), "needed")
    chosen = stored(rows.join(needed, "name", "left_semi").groupBy("name").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2"), "chosen")
    few = chosen.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("text").cast("string").alias("text"), *doc_key()).join(F.broadcast(chosen) if few else chosen, ["k1", "k2"], "left_semi")
    sets = stored(_sets(texts, n).dropDuplicates(["name"]), "sets")
    both = pairs.join(sets.select(F.col("name").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("name").alias("v"), F.col("set").alias("b")), "v")
    alike = F.size(F.array_intersect("a", "b")) * (top + bottom) >= (F.size("a") + F.size("b")) * top
    links = stored(both.where(alike).select("u", "v"), "links")
    discard(needed, chosen, sets)
    return links


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row of each component of ``docs``, all columns: that of its smallest doc_id.

    Two rows link if their sets of ``words``-word shingles have a Jaccard similarity of ``LEAST`` or more.
    """
    prefixes = stored(_prefixes(docs, words, (F.col("doc_id").cast("long").alias("doc_id"), *doc_key())), "prefixes")
    rows = stored(prefixes.select("doc_id", "k1", "k2", "name"), "rows")
    classes = stored(prefixes.drop("doc_id", "k1", "k2").dropDuplicates(["name"]), "classes")
    discard(prefixes)
    rare, (linked, close) = _cells(classes), _by_fingerprint(classes)
    cells = rare.withColumn("close", F.lit(False)).union(close.withColumn("close", F.lit(True)))
    met = _to_least(rare)
    beyond = stored(_beyond(met, classes), "beyond")
    # Each set is compared with one other of each route.
    one = lambda pairs: _alike(pairs, classes).groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    some = stored(one(beyond).union(one(linked)).distinct(), "some")
    links = _similar(some, rows, docs, words)
    roots = components(links)
    discard(linked, met, beyond, some, links)
    left = ROUNDS
    while True:
        every = left == 0
        pairs = _unconnected(cells, classes, roots, every)
        rest = stored(_alike(pairs, classes), "rest")
        links = _similar(rest, rows, docs, words)
        before, roots = roots, components(roots.union(links))
        left = left - 1 if links.count() else 0
        discard(before, pairs, rest, links)
        if every:
            break
    rooted = rows.join(roots.select(F.col("u").alias("name"), F.col("v").alias("root")), "name", "left").withColumn("root", F.coalesce("root", "name"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "k1", "k2")).alias("first")
    kept = stored(rooted.groupBy("root").agg(first).select("first.k1", "first.k2", F.lit(True).alias("kept")), "kept")
    # What goes altogether, and what only goes in part because rows are repeated; most rows are neither.
    every = rows.groupBy("k1", "k2").count().join(kept, ["k1", "k2"], "left")
    gone = stored(every.where("kept IS NULL").select("k1", "k2"), "gone")
    again = stored(every.where("kept AND count > 1").select("k1", "k2"), "again")
    discard(classes, rare, close, roots, rows, kept)
    small = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    gone, again = small(gone), small(again)
    whole = docs.select(F.struct(*every_column(docs)).alias("row"), *doc_key()).join(gone, ["k1", "k2"], "left_anti")
    once = whole.join(again, ["k1", "k2"], "left_anti")
    return once.union(whole.join(again, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])).select("row.*")
