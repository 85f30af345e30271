"""The numpy cores against brute force; no Spark."""

import random
import re
from collections import Counter as Bag
from collections import defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash

from docweave.llm import packing, repetition, simhash, token_counts, toxicity
from docweave.llm.common import LONG_SPAN, distinct_numbers, mix, span_hash, utf8, window_hash, words
from docweave.llm.components import local_stars
from docweave.llm.fm_index import FMIndex, repeated_windows, suffix_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BITS = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "▁", "ing", "<s>", "<0x0A>", "0", "1", "日", "本", "💥", "-", "====", "aaaa", "\r\n", " ", "İ", "Σ", "'s", "<|endoftext|>", "é", "\x1c", "\x0b", "#$"]


def fuzz(n, seed=1, longest=30):
    rng = random.Random(seed)
    return ["", " ", "\n\n", "a" * 3000, "ab" * 999, *("".join(rng.choice(BITS) for _ in range(rng.randint(0, longest))) for _ in range(n))]


def test_words_match_the_pattern():
    texts = fuzz(300)
    raw, at = utf8(pa.array(texts))
    start, end, first = words(raw, at)
    for i, text in enumerate(texts):
        assert [bytes(raw[s:e]).decode() for s, e in zip(start[first[i] : first[i + 1]], end[first[i] : first[i + 1]])] == WORD.findall(text)


def test_nulls_and_slices_read_as_text():
    raw, at = utf8(pa.array(["x", None, "yz"])[1:])
    assert bytes(raw) == b"yz" and at.tolist() == [0, 0, 2]
    raw, at = utf8(pa.array([None, None], pa.string()))
    assert len(raw) == 0 and at.tolist() == [0, 0, 0]


def test_token_counts_equal_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter, library = token_counts.Counter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = fuzz(1500)
    assert counter.of([t.encode() for t in texts]) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_word_ids_equal_the_library():
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = fuzz(1500, 2)
    wanted = [np.array(x.ids, "<u4").tobytes() for x in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # all new, then all known
        got, at = ids.of(pa.array(texts))
        assert [got[a:b].tobytes() for a, b in zip(at, at[1:])] == wanted


def test_word_ids_are_the_same_when_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 50)
    ids = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [*fuzz(300, 6), "Été ÀÇ×÷ß ŸÿÆ Kelvin \u212a don't Über, naïve. ÑANDÚ! œuf µª", "A" * 5000, "é" * 700]
    for lo in range(0, len(texts), 20):
        got, at = ids.of(pa.array([None, *texts[lo : lo + 20]]))
        wanted = [[], *(x.ids for x in ids.tokenizer.encode_batch(texts[lo : lo + 20], add_special_tokens=False))]
        assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == wanted


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_capacity(rule):
    rng = np.random.default_rng(0)
    size = np.sort(rng.integers(1, 100, 2000))[::-1].astype(float)
    items = np.stack([size, np.ones(len(size)), size**2], 1)
    capacity = np.array([100.0, 5, 6000])
    items[items[:, 2] > 6000, 2] = 6000
    bins = packing.best_fit(items, capacity, np.array([1.0, 0.1, 0.1]), rule)
    for d in range(3):
        assert (np.bincount(bins, items[:, d]) <= capacity[d]).all()


def test_packing_by_all_capacities_is_near_the_bound_and_chooses_otherwise():
    rng = np.random.default_rng(1)
    size = np.sort(np.minimum(rng.lognormal(6, 1, 6000).astype(int) + 1, 4096))[::-1].astype(float)
    items, capacity = np.stack([size, np.ones(len(size)), size**2], 1), np.array([4096.0, 4096, 4096.0**2])
    pack = lambda *weights, rule="dot": packing.best_fit(items, capacity, np.array(weights), rule)
    by_tokens, by_all = pack(1.0, 0.0, 0.0, rule="norm"), pack(*packing.WEIGHTS)
    bound = np.ceil(size.sum() / 4096)
    for bins in (by_tokens, by_all, pack(*packing.WEIGHTS, rule="norm")):
        assert (np.bincount(bins, size) <= 4096).all() and bins.max() + 1 <= 1.01 * bound
    # Documents and attention cost take part in the choice.
    assert (by_tokens != by_all).mean() > 0.1
    assert (pack(1.0, 1.0, 0.0) != by_all).any() and (pack(1.0, 0.0, 1.0) != by_all).any()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_against_every_sequence(rule):
    rng = np.random.default_rng(4)
    size = np.sort(rng.integers(1, 60, 80))[::-1].astype(float)
    items, capacity, weights = np.stack([size, np.ones(80), size**2], 1), np.array([100.0, 6, 4000]), np.array([1.0, 0.5, 0.25])
    open_bins = []
    cosine = lambda a, b: (weights * a) @ b / np.sqrt((weights @ a**2) * (weights @ b**2))
    for item, got in zip(items, packing.best_fit(items, capacity, weights, rule)):
        fits = [(-round(cosine(item / capacity, r / capacity), 9) if rule == "dot" else 0, weights @ (((r - item) / capacity) ** 2), b) for b, r in enumerate(open_bins) if (r >= item).all()]
        wanted = min(fits)[2] if fits else len(open_bins)
        if not fits:
            open_bins.append(capacity.copy())
        open_bins[wanted] -= item
        assert got == wanted


def brute_fingerprint(text, n=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    bits = [sum(xxhash.xxh64(g.encode(), seed=42).intdigest() >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def test_fingerprints():
    texts = [*fuzz(200, 3), "One two Three", "ÀB x " * 400]
    assert simhash.fingerprint_of([t.encode() for t in texts], 4).tolist() == [brute_fingerprint(t) for t in texts]


def groups(nodes, edges):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    out = defaultdict(list)
    for x in nodes:
        out[find(x)].append(x)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("blocks", [6, 8])
@pytest.mark.parametrize("seed", range(3))
def test_cells_lose_no_connection(blocks, seed):
    rng = np.random.default_rng(seed)
    prints = set()
    for centre in rng.integers(0, 1 << 63, 4).tolist():
        for _ in range(int(rng.choice([5, 60, 200]))):
            x = centre
            for b in rng.choice(64, rng.integers(0, 9), replace=False).tolist():
                x ^= 1 << b
            prints.add(x)
    fp = np.array(sorted(prints), np.uint64)
    masks = simhash.block_masks(blocks)
    choices = list(combinations(range(blocks), blocks - 4))
    grids = np.array([sum(masks[j] for j in c) for c in choices], np.uint64)
    key = mix((simhash.unary(fp)[:, None] & grids) ^ mix(np.arange(1, len(grids) + 1, dtype=np.uint64)))
    a, b = simhash.cell_links(key.ravel(), np.repeat(fp, len(grids)), np.broadcast_to(np.arange(len(grids)), key.shape).ravel(), masks, choices, 4)
    wanted = [(x, y) for x, y in combinations(fp.tolist(), 2) if (x ^ y).bit_count() <= 4]
    assert groups(fp.tolist(), zip(a.tolist(), b.tolist())) == groups(fp.tolist(), wanted)
    u, v = local_stars(a, b)
    assert groups(fp.tolist(), zip(u.tolist(), v.tolist())) == groups(fp.tolist(), wanted)


def test_manhattan_distance_is_a_lower_bound():
    x = np.random.default_rng(5).integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    assert (np.bitwise_count(simhash.unary(x[0]) ^ simhash.unary(x[1])) <= np.bitwise_count(x[0] ^ x[1])).all()


def test_suffix_order():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 200)
    separator = np.zeros(200, bool)
    separator[[50, 51, 120, 199]] = True
    text[separator] = 0
    key = lambda i: [(0, j) if separator[j] else (1, int(text[j])) for j in range(i, 200)]
    assert suffix_order(text, separator).tolist() == sorted(range(200), key=key)


@pytest.mark.parametrize("seed", range(4))
def test_fm_index_reports_exactly_the_repeated_windows(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(1, 6, 300)
    parts = [rng.integers(1, 6, rng.integers(0, 40)) for _ in range(30)] + [base[a : a + rng.integers(4, 60)] for a in rng.integers(0, 250, 20)]
    weights = rng.choice([1, 1, 1, 2], len(parts))
    lengths = np.array([len(p) for p in parts])
    window = 9
    row, lo, hi = repeated_windows(FMIndex(np.concatenate(parts), lengths, weights > 1), np.concatenate(parts), lengths, window)
    got = {(r, i) for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist()) for i in range(a, b)}
    seen = Bag()
    for p, w in zip(parts, weights.tolist()):
        for i in range(len(p) - window + 1):
            seen[tuple(p[i : i + window].tolist())] += w
    wanted = {(r, i) for r, p in enumerate(parts) for i in range(len(p) - window + 1) if seen[tuple(p[i : i + window].tolist())] > 1}
    assert got == wanted


def test_repetition_figures():
    texts = [*fuzz(150, 4, 200), "one two three four five six seven eight nine\n" * 5, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for row, text in zip(repetition.measure(batch).to_pylist(), texts):
        text = text or ""
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert row["n_words"] == len(w) and row["word_chars"] == sum(map(len, w))
        assert row["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        for n in (5, 8, 10):
            grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
            count = Bag(grams)
            inside = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + n)}
            assert row[f"dup_chars_{n}"] == sum(len(w[j]) for j in inside)
            if n == 8:
                assert row["n_repeat_words"] == len(inside)


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_hashes_tell_spans_apart():
    texts = [b"abc", b"abc", b"abd", b"", b"ab", b"abc\0", *(b"x" * n for n in range(1, 40)), thue_morse(1024).encode(), thue_morse(2048)[1024:].encode(), b"y" * (LONG_SPAN + 1), b"y" * (LONG_SPAN + 2)]
    raw, end = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    start = end - [len(t) for t in texts]
    h = span_hash(raw, start, end)
    assert h[0] == h[1] and len(set(h.tolist())) == len(set(texts))
    numbers = distinct_numbers(raw, np.ones(len(raw), bool), end - start)
    assert numbers[0] == numbers[1] and len(set(numbers.tolist())) == len(set(texts))
    word = span_hash(raw, start, end)[np.array([(i.bit_count() & 1) + 1 for i in range(4096)])]
    for n in (5, 35, 64, 1024):
        seen = {tuple(word[i : i + n].tolist()) for i in range(0, 4097 - n)}
        assert len(set(window_hash(word, n).tolist())) == len(seen)


def test_lines_and_words_of_like_pattern_are_told_apart():
    for n in (1024, 2048, 4096):
        one, other = thue_morse(2 * n)[:n], thue_morse(2 * n)[n:]
        text = f"{one}\n{other}\n" + " ".join([one, "b", "c", "d", "e", "f", "g", "h", other, "b", "c", "d", "e", "f", "g", "h"])
        row = repetition.measure(pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], names=["doc_id", "text"])).to_pylist()[0]
        assert row["n_dup_lines"] == 0 and row["n_repeat_words"] == 0


def test_channel_restores_obfuscated_words():
    table = toxicity.class_table()
    counts = toxicity.count_trigrams(["the idiot and the stupid moron trash loser clown pathetic worthless " * 50], table) + 0.5
    counts = counts.reshape(toxicity.CLASSES, toxicity.CLASSES, toxicity.CLASSES)
    channel = toxicity.Channel(-np.log(counts / counts.sum(2, keepdims=True)))
    for given, wanted in {"1d10t": "idiot", "l.o.s.e.r": "loser", "loooooser": "loser", "$tup1d": "stupid", "tr@sh": "trash", "m0r0n": "moron"}.items():
        assert channel.restore(given) == wanted


def test_regression_separates():
    rng = np.random.default_rng(0)
    label = (np.arange(400) % 4 == 0).astype(float)
    row = np.concatenate([np.flatnonzero(label), rng.integers(0, 400, 300)])
    feature = np.concatenate([np.zeros(int(label.sum()), int), rng.integers(1, 20, 300)])
    weight, bias = toxicity.fit(row, feature, 20, label)
    assert bias + weight[0] > 0 > bias
