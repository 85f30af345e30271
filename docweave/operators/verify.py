"""Agreement of two extractions of a document: aligned texts and critical fields."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from difflib import SequenceMatcher
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.folds import fold_documents

WEAK, STRONG = 0.80, 0.95
#: Blocks of a document that one fold compares with all of its spans.
CHUNK = 500


def _greedy(rows: list[dict]):
    """Pairs (block_id, object_id, similarity, overlap) by similarity, overlapping boxes first, then block and span order; each side once."""
    used_b, used_s = set(), set()
    for r in sorted(rows, key=lambda r: (-r["similarity"], not r["overlap"], r["bp"], r["sp"])):
        if r["block_id"] not in used_b and r["object_id"] not in used_s:
            used_b.add(r["block_id"])
            used_s.add(r["object_id"])
            yield r["block_id"], r["object_id"], r["similarity"], r["overlap"]


def _meet(a: dict | None, b: dict | None) -> bool:
    return bool(a and b) and min(a["x2"], b["x2"]) > max(a["x1"], b["x1"]) and min(a["y2"], b["y2"]) > max(a["y1"], b["y1"])


def _equal(blocks: list[dict], spans: list[dict]):
    """The greedy pairs (block, span, overlap) among blocks and spans of one text.

    Spans wait in a queue for each box, so that those of one box are looked at once.
    """
    blocks, spans = (sorted(side, key=lambda r: r["pos"]) for side in (blocks, spans))
    box = lambda r: r["bbox"] and tuple(r["bbox"].values())
    queues: dict[tuple, tuple[dict, deque[int]]] = {}
    for i, span in enumerate(spans):
        queues.setdefault(box(span), (span["bbox"], deque()))[1].append(i)
    facing: dict[tuple, list[deque[int]]] = {}
    rest, taken = [], set()
    for block in blocks:
        if (place := box(block)) not in facing:
            facing[place] = [q for where, q in queues.values() if _meet(block["bbox"], where)]
        if near := [q for q in facing[place] if q]:
            hit = min(near, key=lambda q: q[0]).popleft()
            taken.add(hit)
            yield block, spans[hit], True
        else:
            rest.append(block)
    yield from ((block, span, False) for block, span in zip(rest, (s for i, s in enumerate(spans) if i not in taken), strict=False))


def _alike(rows: list[dict]):
    """(bp, block_id, sp, object_id, similarity, overlap) of the blocks and spans that are similar enough.

    Lengths, counts of letters and the longest common subsequence bound the
    similarity from above and rule pairs out. Equal texts are compared once.
    """
    blocks, spans = ({}, {})
    for r in rows:
        (blocks if r["side"] == "b" else spans).setdefault(r["text"].strip(), []).append(r)
    if not (blocks and spans):
        return
    texts = list(blocks)
    length = np.array([len(x) for x in texts])
    counts = np.stack([_letters(x) for x in texts])
    matcher = SequenceMatcher(None)
    for said, mine in spans.items():
        n = len(said)
        near = np.flatnonzero(2 * np.minimum(length, n) >= WEAK * (length + n))
        most = 2 * np.minimum(counts[near], _letters(said)).sum(1)
        near = near[most >= WEAK * (length[near] + n)].tolist()
        if not near:
            continue
        places: dict[str, int] = {}
        for i, c in enumerate(said):
            places[c] = places.get(c, 0) | 1 << i
        matcher.set_seq2(said)
        for other in (texts[i] for i in near):
            if not n or 2 * _common(other, places, n) < WEAK * (len(other) + n):
                continue
            matcher.set_seq1(other)
            similarity = matcher.ratio()
            if similarity >= WEAK:
                for b, s in product(blocks[other], mine):
                    yield b["pos"], b["id"], s["pos"], s["id"], similarity, _meet(b["bbox"], s["bbox"])


def _common(said: str, places: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence with a text of ``n`` characters, given the bits of each one's places."""
    free = every = (1 << n) - 1
    for c in said:
        hit = free & places.get(c, 0)
        free = (free + hit | free - hit) & every
    return n - free.bit_count()


def _letters(said: str) -> np.ndarray:
    """How often each of 64 classes of characters occurs."""
    return np.bincount(np.frombuffer(said.encode("utf-32-le", "surrogatepass"), np.uint32) & 63, minlength=64)


def _first_pass(rows: list[dict]):
    """A document's equal texts matched, and the rest as well if it is small; else the rest in chunks of blocks, each with all of its spans.

    Rows are (chunk, side, pos, id, bbox, text, object_id, similarity, overlap);
    chunk -1 has what is settled (d) and which blocks wait for their chunk (w).
    """
    by_text: dict[str, tuple[list, list]] = {}
    for r in rows:
        by_text.setdefault(r["text"] if r["key"] is None else r["key"], ([], []))[r["side"] == "s"].append(r)
    blank = by_text.pop("", ([], []))[0]
    settled = lambda block_id, *match: (-1, "d", None, block_id, None, None, *(match or (None,) * 3))
    yield from (settled(r["id"]) for r in blank)
    left, over = [], []
    for blocks, spans in by_text.values():
        seen = set()
        for b, s, overlap in _equal(blocks, spans) if blocks and spans else ():
            seen |= {id(b), id(s)}
            yield settled(b["id"], s["id"], 1.0, overlap)
        left += (r for r in blocks if id(r) not in seen)
        over += (r for r in spans if id(r) not in seen)
    if len(left) <= CHUNK:
        yield from (settled(*row) for row in _settle(_alike(left + over), [r["id"] for r in left]))
        return
    left.sort(key=lambda r: r["pos"])
    for chunk, first in enumerate(range(0, len(left), CHUNK)):
        yield from ((-1, "w", None, r["id"], *(None,) * 5) for r in left[first : first + CHUNK])
        yield from ((chunk, r["side"], r["pos"], r["id"], r["bbox"], r["text"], *(None,) * 3) for r in left[first : first + CHUNK] + over)


def _settle(pairs: Iterable[tuple], waiting: list[str]):
    """The greedy choice among ``pairs``, then each waiting block without a match."""
    matched = set()
    for row in _greedy([dict(zip(("bp", "block_id", "sp", "object_id", "similarity", "overlap"), p, strict=True)) for p in pairs]):
        matched.add(row[0])
        yield row
    yield from ((x, None, None, None) for x in waiting if x not in matched)


def _second_pass(rows: list[dict]):
    """The similar pairs (p) of a chunk; what is settled or waits goes on."""
    if rows[0]["side"] in "dw":
        yield from ((r["side"], None, r["id"], None, r["object_id"], r["similarity"], r["overlap"]) for r in rows)
    else:
        yield from (("p", *pair) for pair in _alike(rows))


def _last_pass(rows: list[dict]):
    of = lambda kind, *names: (tuple(r[n] for n in names) for r in rows if r["kind"] == kind)
    yield from of("d", "block_id", "object_id", "similarity", "overlap")
    yield from _settle(of("p", "bp", "block_id", "sp", "object_id", "similarity", "overlap"), [x for x, in of("w", "block_id")])


def align(blocks: DataFrame, spans: DataFrame, same_page: bool = False) -> DataFrame:
    """doc_id, block_id, object_id, similarity, overlap, level and confidence: one match at most for each block and span.

    Pairs are taken greedily by similarity, overlapping boxes first, then block
    and span order. Equal texts have the highest similarity, so they are matched
    first, text by text. What is left of a document meets at once, or in chunks
    if it has many blocks. Each table is read once. With ``same_page`` only texts
    of one page match. Blocks without a match get a row of level ``none``.
    """
    place = ("doc_id", "page_id")
    page = F.col("page_id").cast("int") if same_page else F.lit(0)
    key = text.strip(F.col("text"))
    side = lambda df, name, who, wanted: df.where(wanted != "").select("doc_id", page.alias("page_id"), F.lit(name).alias("side"), F.col("pos").cast("long").alias("pos"), F.col(who).cast("string").alias("id"), "bbox", "text", F.when(key != F.col("text"), key).alias("key"))
    rows = side(blocks, "b", "block_id", text.text_of("text")).unionByName(side(spans, "s", "object_id", text.strip(text.text_of("text"))))
    match = "object_id string, similarity double, overlap boolean"
    box = rows.schema["bbox"].dataType.simpleString()
    first = fold_documents(rows, ["side", "pos", "id", "bbox", "text", "key"], _first_pass, f"chunk int, side string, pos bigint, id string, bbox {box}, text string, {match}", *place)
    second = fold_documents(first, ["side", "pos", "id", "bbox", "text", "object_id", "similarity", "overlap"], _second_pass, f"kind string, bp bigint, block_id string, sp bigint, {match}", *place, "chunk")
    found = fold_documents(second, ["kind", "bp", "block_id", "sp", "object_id", "similarity", "overlap"], _last_pass, f"block_id string, {match}", *place)
    strong = (F.col("similarity") >= STRONG) & F.col("overlap")
    level = F.when(F.col("object_id").isNull(), "none").when(strong, "strong").otherwise("weak")
    sure = F.when(level == "strong", (F.col("similarity") + 1) / 2).when(level == "weak", F.col("similarity") * 0.8).otherwise(0.0)
    return found.select("doc_id", "block_id", F.coalesce("object_id", F.lit("")).alias("object_id"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("overlap", F.lit(False)).alias("overlap"), level.alias("level"), sure.alias("confidence"))


def level_counts(alignment: DataFrame) -> DataFrame:
    level = F.col("level")
    return alignment.groupBy("doc_id").agg(F.count("*").alias("total"), *(F.count_if(level == k).alias(k) for k in ("strong", "weak", "none")))


def _counts(docs: DataFrame, column: str) -> DataFrame:
    hits = docs.select("doc_id", F.explode(text.critical_fields(F.col(column))).alias("f"))
    return hits.groupBy("doc_id", F.col("f.kind").alias("kind"), F.col("f.value").alias("value")).agg(F.count("*").alias("n"))


def compare_fields(docs: DataFrame, left: str, right: str, source: str, resolution: str) -> DataFrame:
    """Fields of text ``left`` that text ``right`` has another number of times."""
    other = _counts(docs, right).withColumnRenamed("n", "m")
    both = _counts(docs, left).join(other, ["doc_id", "kind", "value"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    listed = lambda n: F.array_join(F.array_repeat("value", F.col(n).cast("int")), ", ")
    return both.where("n <> m").select("doc_id", "kind", "value", listed("n").alias("left_value"), listed("m").alias("right_value"), F.lit(source).alias("source"), F.lit(resolution).alias("resolution"))


def verify_fields(docs: DataFrame, with_docx: bool = False) -> DataFrame:
    """Conflicts between ``vlm_text`` and ``pdf_text``, and between ``pdf_text`` and ``docx_text`` where there is one."""
    found = compare_fields(docs, "vlm_text", "pdf_text", "vlm_vs_pdf", "adopted_pdf")
    if with_docx:
        found = found.unionByName(compare_fields(docs.where(text.text_of("docx_text") != ""), "pdf_text", "docx_text", "pdf_vs_docx", "adopted_docx"))
    return found
