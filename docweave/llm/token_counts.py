"""Token counts by rank-synchronous array merging.

A text's pre-tokens (a run of spaces and the word after it, or a newline) never
merge with each other. The distinct pre-tokens of a batch are held as one
ragged numpy array of symbols; in each round every pre-token applies its
lowest-rank pair, all of them at once, until none has a pair left. What
survives is the count, and a symbol that the vocabulary lacks counts its bytes.

Edge cases: a null text counts as empty, which has no tokens; null doc_ids and
repeated rows pass through; extra columns are not read; an empty table gives
an empty result; texts are never cut.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_worker, process_cache, read, slices, utf8

LIMIT = 4096
#: Distinct pre-tokens whose counts a Python worker remembers.
MOST_SEEN = 1_000_000
SPACE = "▁"
NONE = np.int64(1 << 40)


class Merges:
    """The merges of a byte-fallback BPE piece model, as sorted arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        usual = spec.name == "identity" and not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces
        if not (usual and spec.escape_whitespaces and trainer.byte_fallback and trainer.model_type == trainer.BPE):
            raise ValueError("only identity-normalised byte-fallback BPE models with a dummy prefix")
        piece = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in piece):
            raise ValueError("pieces cross pre-tokens")
        # Equal scores are equal ranks: the leftmost pair then goes first.
        scores = sorted({-model.pieces[i].score for i in piece.values()})
        rank_of = {s: r for r, s in enumerate(scores)}
        self.size = len(model.pieces)
        found = []
        for p, i in piece.items():
            for cut in range(1, len(p)):
                if p[:cut] in piece and p[cut:] in piece:
                    found.append((piece[p[:cut]] * self.size + piece[p[cut:]], rank_of[-model.pieces[i].score], i))
        keys, ranks, made = (np.array(x, np.int64) for x in zip(*sorted(found), strict=True))
        self.keys, self.ranks, self.made = np.append(keys, np.int64(1) << 62), np.append(ranks, NONE), np.append(made, 0)
        # A merge is safe to apply to all its places at once if nothing built from its result ranks before it.
        own = np.full(self.size, NONE)
        for i in piece.values():
            own[i] = rank_of[-model.pieces[i].score]
        first = np.full(self.size, NONE)
        np.minimum.at(first, keys // self.size, ranks)
        np.minimum.at(first, keys % self.size, ranks)
        self.safe = first > own
        # Code point to symbol; what the vocabulary lacks gets negative symbols of as many bytes.
        width = np.ones(0x110000, np.int32)
        for at, n in ((0x80, 2), (0x800, 3), (0x10000, 4)):
            width[at:] = n
        self.symbol = -width
        for p, i in piece.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, np.int64(-1))
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def made_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.made[np.searchsorted(self.keys, left.astype(np.int64) * self.size + right)]

    def count(self, tokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        total = np.zeros(len(tokens), np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        symbols = self.symbol[np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), np.uint32)]
        row = np.repeat(np.arange(len(tokens)), lengths)
        pair = np.full(len(symbols), NONE)  # rank of a symbol with the next one of its row
        inner = np.flatnonzero(row[1:] == row[:-1]) if len(row) else np.zeros(0, np.int64)
        pair[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            size = np.diff(np.r_[first, len(row)])
            best = np.minimum.reduceat(pair, first)
            done = best == NONE
            if done.any():
                over = np.repeat(done, size)
                total += np.bincount(row[over], np.where(symbols[over] < 0, -symbols[over], 1), len(tokens)).astype(np.int64)
                symbols, row, pair = symbols[~over], row[~over], pair[~over]
                if not len(symbols):
                    break
                size, best = size[~done], best[~done]
                first = np.cumsum(size) - size
            at = np.flatnonzero(pair == np.repeat(best, size))
            made = self.made_of(symbols[at], symbols[at + 1])
            # The leftmost place of each row, and the others where that changes nothing; overlapping places (aaa) alternate from the left.
            lead = np.r_[True, row[at][1:] != row[at][:-1]]
            head = np.maximum.accumulate(np.where(lead, np.arange(len(at)), 0))
            same = self.safe[made] & (made == made[head])
            run = np.r_[True, np.diff(at) != 1] | lead
            since = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            use = lead | (same & (since % 2 == 0))
            at, made = at[use], made[use]
            symbols[at] = made
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            fresh = np.zeros(len(symbols), bool)
            fresh[at] = True
            fresh[at[at > 0] - 1] = True
            # The neighbour left of a merged place may itself be a removed symbol of the merge before.
            gone = at[at > 1] - 1
            fresh[gone[~keep[gone]] - 1] = True
            symbols, row, pair, fresh = symbols[keep], row[keep], pair[keep], fresh[keep]
            anew = np.flatnonzero(fresh)
            last = anew[anew == len(row) - 1]
            anew = anew[anew < len(row) - 1]
            near = row[anew] == row[anew + 1]
            pair[anew[~near]] = NONE
            pair[last] = NONE
            anew = anew[near]
            pair[anew] = self.rank(symbols[anew], symbols[anew + 1])
        return total


class Counter:
    PARTS = re.compile(rb"\n| *[^ \n]+| +")

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.seen: dict[bytes, int] = {}
        self.mark = SPACE.encode()

    def parts(self, text: bytes) -> list[bytes]:
        """Pre-tokens of a non-empty text. Parts without a leading newline or space have one space before them."""
        if self.mark in text:
            text = text.replace(self.mark, b" ")
        if b"  " in text or b" \n" in text or text[:1] == b" " or text[-1:] == b" ":
            return [b"\n" if p == b"\n" else (p[1:] if p[:1] == b" " and p[1:2] not in (b" ", b"") else b"\n\n" + p) for p in self.PARTS.findall(b" " + text)]
        return text.replace(b"\n", b" \n").split(b" ")

    @staticmethod
    def spelled(part: bytes) -> str:
        """The symbols of a part; a newline is a symbol of its own that merges with nothing."""
        if part[:2] == b"\n\n":  # as it is: spaces, or a word that follows a newline
            return part[2:].decode().replace(" ", SPACE)
        if part[:1] == b"\n":
            return part.decode()
        return SPACE + part.decode()

    def of(self, texts: list[bytes]) -> list[int]:
        split = [self.parts(t) if t else [] for t in texts]
        if len(self.seen) > MOST_SEEN:
            self.seen.clear()
        missing = list(set().union(*split).difference(self.seen))
        for lo in range(0, len(missing), 50_000):
            some = missing[lo : lo + 50_000]
            self.seen.update(zip(some, self.merges.count([self.spelled(p) for p in some]).tolist(), strict=True))
        look = self.seen.__getitem__
        return [sum(map(look, s)) for s in split]


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text)."""
    name = f"counts {model}"

    def run(batches):
        counter = process_cache(name, lambda: Counter(model))
        for batch in batches:
            for part in slices(batch, "text"):
                _, at = utf8(part.column("text"))
                n = np.array(counter.of([(t or "").encode() for t in part.column("text").to_pylist()]), np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(in_worker(run, name), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
