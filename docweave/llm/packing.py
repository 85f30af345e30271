"""Best-fit packing of token sequences under several capacities.

Each document becomes token ids plus an end id; only documents longer than a
sequence are cut. Pieces are dealt evenly into shards of a stated size and each
shard is packed by vector best-fit decreasing: an item goes to the open
sequence, among those with room in every dimension (tokens, documents,
attention cost), that the residual norm or the weighted dot product prefers.

Edge cases: a null or empty text is a document of the end id alone; null
doc_ids and repeated rows are packed like any other row; extra columns are not
read; an empty table gives an empty result; a text of any length is cut into
as many pieces as it takes.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, in_worker, process_cache, read, slices, stored, utf8, words

LENGTH = 4096
END_ID = 1
#: How much the residual tokens, documents and attention cost of a sequence count when a piece chooses among those with room.
WEIGHTS = (1.0, 1.0, 1.0)
#: Pieces in a shard. A shard wastes at most part of its last few sequences.
SHARD_PIECES = 40_000
#: Distinct words of a generation, two of which a Python worker remembers; and the bytes of text that it reads at once, about.
MOST_WORDS = 250_000
SLICE = 4 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Letters whose lower case is not the same everywhere, and signs that end most words.
ODD = re.compile("[\u0130\u03a3]")
SIGNS = frozenset(".,!?;:")
IS_SIGN, IS_LETTER = np.zeros(256, bool), np.zeros(256, bool)
IS_SIGN[list(b".,!?;:")] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_LETTER[65:91] = IS_LETTER[97:123] = True


def byte_letters() -> str:
    """The printable character that byte-level vocabularies use for each byte, ASCII as it is: itself, or the next one from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return "".join(chr(256 + others.index(b)) if b >= 0x80 and b in others else chr(b) for b in range(256))


def plain_letters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of UTF-8 belong to letters of ASCII or Latin-1, and the bytes with those letters in lower case."""
    letter, lower = IS_LETTER[raw], LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] & 0x9F) != 0x97]  # neither of the two signs among the letters
    letter[lead] = letter[lead + 1] = True
    capital = lead[raw[lead + 1] <= 0x9E]
    lower[capital + 1] |= 0x20
    return letter, lower


class Known:
    """Ids of words: each word's row, and the rows' ids in one flat array."""

    def __init__(self):
        self.rows: dict[bytes, int] = {}
        self.ids = np.zeros(0, "<u4")
        self.at = np.zeros(1, np.int64)

    def add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.rows)
        self.rows.update(zip(words, range(n, n + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows, one row after another, and how many each has."""
        start = self.at[rows]
        sizes = self.at[rows + 1] - start
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(start - ends + sizes, sizes) + np.arange(sizes.sum())], sizes


class WordIds:
    """Token ids of whole texts, remembered by white-space separated word.

    The tokenizer lower-cases, splits at white space and by a pattern, and
    merges within the pre-tokens so found; so a text's ids are those of its
    words in turn. Words of Latin-1 letters, with a sign behind or without, are
    lower-cased and cut as arrays; each distinct rest is split once, and all
    new pre-tokens go to the tokenizer's merges, many at a time. Words with
    letters or signs that libraries may treat differently, and texts that may
    hold a special token's string, go to the tokenizer whole. Two generations
    of words are remembered, so that frequent ones stay.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        usual = [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] and split["behavior"] == "Removed" and split["invert"]
        if not usual or level["type"] != "ByteLevel" or level["add_prefix_space"] or spec["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError("only lower-casing byte-level tokenizers that split by a pattern and mark word ends")
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.encode = getattr(self.merges, "encode_batch_fast", self.merges.encode_batch)
        self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith("</w>")]] = True
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        self.letters = byte_letters()
        self.new, self.old = Known(), Known()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def parts(self, word: bytes) -> list[str] | None:
        """A word's pre-tokens, or None if it is to be asked for whole."""
        text = word.decode()
        if not text.isascii() and (ODD.search(text) or not unicodedata.is_normalized("NFC", text)):
            return None
        text = text.lower()
        if text.isalpha():
            return [text]
        if text[-1] in SIGNS and text[:-1].isalpha():
            return [text[:-1], text[-1]]
        return self.split(text) if text.isprintable() else None

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after another, and how many each has."""
        found = [np.zeros(0, "<u4")]
        for lo in range(0, len(pieces), 2_000):
            text = " ".join(pieces[lo : lo + 2_000])
            text = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            found.append(np.array(self.encode([text], add_special_tokens=False)[0].ids, "<u4"))
        ids = np.concatenate(found)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        number: dict[str, int] = {}
        odd: list[np.ndarray] = []
        asked: list[int] = []
        counts = []
        for word in words:
            split = self.parts(word)
            if split is None:
                odd.append(self.ids(word.decode()))
                asked.append(-len(odd))
                counts.append(1)
            else:
                asked += [number.setdefault(p, len(number)) for p in split]
                counts.append(len(split))
        ids, sizes = self.merged(list(number))
        every = Known()
        every.ids = np.concatenate([ids, *odd])
        every.at = np.concatenate([[0], np.cumsum(np.concatenate([sizes, np.array([len(x) for x in odd], np.int64)]))])
        rows = np.array(asked, np.int64)
        ids, sizes = every.of(np.where(rows < 0, len(number) - 1 - rows, rows))
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])])

    def rows(self, words: list[bytes]) -> np.ndarray:
        """The row of each of the distinct ``words`` in ``new``."""
        if len(self.new.rows) > MOST_WORDS:
            self.new, self.old = Known(), self.new
        look = lambda known, some: np.fromiter((known.rows.get(w, -1) for w in some), np.int64, len(some))
        found = look(self.new, words)
        missing = [words[i] for i in np.flatnonzero(found < 0).tolist()]
        if missing:
            before = look(self.old, missing)
            again = [missing[i] for i in np.flatnonzero(before >= 0).tolist()]
            unknown = [missing[i] for i in np.flatnonzero(before < 0).tolist()]
            self.new.add(again, *self.old.of(before[before >= 0]))
            self.new.add(unknown, *self.learn(unknown))
            found[found < 0] = look(self.new, missing)
        return found

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and where each text's begin and end; null reads as empty."""
        raw, at = utf8(column)
        whole = {}
        blob = raw.tobytes()
        if any(s in blob for s in self.special):
            texts = [blob[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            whole = {i: self.ids(t.decode()) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        start, end, first = words(raw, at)
        letter, lower = plain_letters(raw)
        others = np.concatenate([[0], np.cumsum(~letter)])
        n_others = others[end] - others[start]
        signed = (n_others == 1) & IS_SIGN[raw[end - 1]] & (end - start > 1)
        # Words that aren't letters alone keep their capitals.
        edge = np.zeros(len(raw) + 1, np.int8)
        kept = (n_others > 0) & ~signed
        edge[start[kept]] += 1
        edge[end[kept]] -= 1
        lower = np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, raw, lower)[~IS_SPACE[raw]]
        # A signed word is two tokens.
        place = np.arange(len(start)) + np.cumsum(signed)
        size = np.empty(len(start) + int(signed.sum()), np.int64)
        size[place] = np.where(signed, 1, end - start)
        size[place[signed] - 1] = (end - start)[signed] - 1
        token_first = np.concatenate([[0], np.cumsum(signed)])[first] + first
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        tokens = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(lower)]).dictionary_encode()
        ids, sizes = self.new_ids(tokens)
        bounds = np.concatenate([[0], np.cumsum(sizes)])[token_first]
        if whole:
            own = [whole.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(at) - 1)]
            ids, bounds = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        return ids, bounds

    def new_ids(self, tokens: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        rows = self.rows(tokens.dictionary.to_pylist())
        return self.new.of(rows[tokens.indices.to_numpy()])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def to_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Rows of PIECES: every document's ids and end id, cut where longer than ``length``."""
    name = f"ids {tokenizer}"

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of = process_cache(name, lambda: WordIds(tokenizer))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, at = ids_of.of(part.column("text"))
                n = part.num_rows
                at = at + np.arange(n + 1)
                every = np.full(at[-1], end_id, "<u4")
                own = np.ones(len(every), bool)
                own[at[1:] - 1] = False
                every[own] = ids
                size = np.diff(at)
                pieces = -(-size // length)
                doc = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                lo = at[doc] + piece * length
                hi = np.minimum(lo + length, at[doc + 1])
                view = memoryview(every).cast("B")
                crc = [zlib.crc32(view[a:b]) for a, b in zip((4 * lo).tolist(), (4 * hi).tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(piece * length), pa.array(hi - lo), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(in_worker(run, name), PIECES)


def best_fit(items: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "dot") -> np.ndarray:
    """Bin of each item (n x dimensions, largest first by the first dimension).

    ``norm``: the feasible open bin with the smallest weighted squared residual
    after the item. ``dot``: the feasible bin whose residual has the largest
    weighted cosine with the item, ties by that norm. Ties go to the oldest
    bin. Items that exceed the capacity get a bin of their own.
    """
    n, dims = items.shape
    scale = 1.0 / capacity
    out = np.empty(n, np.int64)
    residual = np.empty((dims, 1024))
    ids = np.empty(1024, np.int64)
    n_open = n_bins = 0
    # What later items need at least, in each dimension: bins with less are closed.
    least = np.minimum.accumulate(items[::-1], axis=0)[::-1]
    for i, item in enumerate(items.tolist()):
        if i % 256 == 0 and n_open:
            keep = np.flatnonzero((residual[:, :n_open] >= least[i][:, None]).all(axis=0))
            n_open = len(keep)
            residual[:, :n_open], ids[:n_open] = residual[:, keep], ids[keep]
        fits = residual[0, :n_open] >= item[0]
        for d in range(1, dims):
            fits &= residual[d, :n_open] >= item[d]
        fits = np.flatnonzero(fits)
        if len(fits) and rule == "dot":
            own, want = residual[:, fits] * scale[:, None], np.array(item) * scale
            cosine = np.round((weights * want) @ own / np.sqrt((weights @ (own * own)) * (weights @ (want * want)) + 1e-300), 9)
            fits = fits[cosine == cosine.max()]
        if len(fits):
            best = fits[0]
            if len(fits) > 1:
                norm = np.zeros(len(fits))
                for d in range(dims):
                    norm += weights[d] * ((residual[d, fits] - item[d]) * scale[d]) ** 2
                best = fits[norm.argmin()]
        else:
            if n_open == len(ids):
                residual = np.concatenate([residual, np.empty_like(residual)], axis=1)
                ids = np.concatenate([ids, np.empty_like(ids)])
            best = n_open
            residual[:, best], ids[best] = capacity, n_bins
            n_open, n_bins = n_open + 1, n_bins + 1
        residual[:, best] -= item
        out[i] = ids[best]
    return out


def pack(
    pieces: DataFrame,
    length: int = LENGTH,
    max_docs: int | None = None,
    max_attention: float | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "dot",
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """PIECES plus ``sequence_id`` and a gapless ``offset`` in each sequence.

    A sequence holds at most ``length`` tokens, ``max_docs`` pieces and
    ``max_attention`` of summed squared lengths. The defaults of the last two
    are what ``length`` tokens can reach: they turn no piece away, so that a
    corpus needs no more sequences than its tokens do, but what is left of them
    takes part in choosing the sequence. The shards are even, whatever the keys,
    and each is packed in one task of ``shard_pieces`` small rows.
    """
    capacity = np.array([length, max_docs or length, max_attention or float(length) ** 2], float)
    pieces = stored(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    weight = np.array(weights, float)

    def run(batches):
        import pandas as pd

        got = [b.to_pandas() for b in batches]
        if not got:
            return
        x = pd.concat(got, ignore_index=True)
        x = x.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        size = x["length"].to_numpy(np.float64)
        bins = np.empty(len(x), np.int64)
        full = int((size >= length).sum())
        bins[:full] = np.arange(full)
        bins[full:] = full + best_fit(np.stack([size[full:], np.ones(len(x) - full), size[full:] ** 2], 1), capacity, weight, rule)
        order = np.argsort(bins, kind="stable")
        ahead = np.cumsum(size[order]) - size[order]
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        offset = np.empty(len(x), np.int64)
        offset[order] = ahead - np.repeat(ahead[first], np.diff(np.r_[np.flatnonzero(first), len(x)]))
        x["sequence_id"] = (TaskContext.get().partitionId() << 40) + bins
        x["offset"] = offset
        x["doc_id"] = x["doc_id"].astype("Int64")
        yield from pa.Table.from_pandas(x, preserve_index=False).to_batches(max_chunksize=10_000)

    return pieces.repartition(shards).mapInArrow(in_worker(run), PIECES + ", sequence_id long, offset long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(to_pieces(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))
