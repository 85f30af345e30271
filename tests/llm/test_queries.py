"""Operators on small awkward tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docweave.llm import knn, licenses, mixing, near, packing, repetition, simhash, substring, token_counts, toxicity, url_lists

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, k1 long, spans string, fp long, score double"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "Theta", "iota.", "kappa\n"]) + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = [prose(rng, rng.randint(1, 120)) for _ in range(30)]
    texts += [prose(rng, 20) + " " + passage + " " + prose(rng, rng.randint(0, 9)) for _ in range(8)]
    texts += [texts[0], texts[35], None, "", " \n", "word", "a b " * 150, "x " * 5000, "same line\n" * 40]
    found = [(i, t, "en", ["s1", "s2", None, "s3"][i % 4], len(t or ""), "r", 1, "s", 2, 0.5) for i, t in enumerate(texts)]
    found += [found[31], found[31], (None, texts[3], "en", "s1", 5, "r", 1, "s", 2, 0.5), (None, None, None, None, None, None, None, None, None, None)]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def key(rows, *names):
    return sorted((tuple(r[n] for n in names) for r in rows), key=str)


def removed(texts, window):
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    for w in split:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        yield w, gone


@pytest.mark.parametrize("hot", [substring.HOT, 0])
def test_substring_digest(docs, rows, none, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    wanted = []
    for (doc_id, text, *_), (w, gone) in zip(rows, removed([r[1] for r in rows], 35)):
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        wanted.append({"doc_id": doc_id, "n_words": len(w), "n_removed": len(gone), "kept_sha256": hashlib.sha256(kept.encode()).hexdigest()})
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert key(substring.word_digest(docs).collect(), *names) == key(wanted, *names)
    assert substring.word_digest(none).count() == 0


def test_substring_cut_keeps_columns(docs, rows):
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns
    wanted = []
    for (doc_id, *_), (w, gone) in zip(rows, removed([r[1] for r in rows], 35)):
        wanted.append((doc_id, tuple(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(((r["doc_id"], tuple(WORD.findall(r["text"] or ""))) for r in out.collect()), key=str) == sorted(wanted, key=str)


def test_near_duplicates(docs, rows, none):
    prints = [int(simhash.fingerprint_of([(r[1] or "").encode()], 4)[0]) for r in rows]
    least = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4 and least[j] < least[i]:
                    least[i], changed = least[j], True
    members = defaultdict(list)
    for i, r in enumerate(rows):
        members[least[i]].append(r[0])
    wanted = [{"doc_id": r[0], "fingerprint": f"{prints[i]:016x}", "component_id": min((x for x in members[least[i]] if x is not None), default=None)} for i, r in enumerate(rows)]
    names = ("doc_id", "fingerprint", "component_id")
    assert key(simhash.near_duplicates(docs, 4, 4).collect(), *names) == key(wanted, *names)
    assert simhash.near_duplicates(none, 4, 4).count() == 0


def test_a_cell_with_very_many_fingerprints(spark):
    """One bit a segment: all share every cell of counts, and next to none links."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    sides = np.unique(rng.integers(0, 1 << 32, 40_000, dtype=np.uint64))
    spread = np.zeros(len(sides), np.uint64)
    for i in range(32):
        spread |= ((sides >> np.uint64(i)) & np.uint64(1)) + np.uint64(1) << np.uint64(2 * i)
    planted = spread[:50] ^ (np.uint64(3) << rng.integers(0, 32, 50).astype(np.uint64) * np.uint64(2))
    fp = np.unique(np.r_[spread, planted]).view(np.int64)
    found = simhash.links(spark.createDataFrame(pa.table({"fp": fp})).repartition(4), len(fp), 4).collect()
    near = {(r["u"], r["v"]) for r in found} | {(r["v"], r["u"]) for r in found}
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 * 50 for a, b in near)
    label = {x: x for x in fp.tolist()}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in near:
        label[root(a)] = root(b)
    pairs = list(zip(spread[:50].view(np.int64).tolist(), planted.view(np.int64).tolist()))
    assert all(root(a) == root(b) for a, b in pairs)


@pytest.mark.parametrize("hot", [1, 3, 40])
def test_hot_cells_lose_no_connection(spark, hot):
    rng, prints = random.Random(hot), set()
    for centre in (rng.getrandbits(64) for _ in range(6)):
        for _ in range(60):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))))
    fp = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    least = {x: x for x in fp}

    def groups(edges):
        label = {x: x for x in fp}
        find = lambda x: x if label[x] == x else find(label[x])
        for a, b in edges:
            label[find(a)] = find(b)
        return {frozenset(x for x in fp if find(x) == r) for r in {find(x) for x in fp}}

    wanted = groups((a, b) for a in fp for b in fp if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    got = simhash.links(spark.createDataFrame([(x,) for x in least], "fp long"), len(fp), 4, hot).collect()
    assert groups(got) == wanted


def test_packing_round_trip(docs, rows, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(packing.to_pieces(docs, path, 512), 512, shard_pieces=30).collect()
    wanted = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for p, lo in enumerate(range(0, len(ids), 512)):
            wanted[(r[0], p, lo, len(ids[lo : lo + 512]), zlib.crc32(np.array(ids[lo : lo + 512], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == wanted
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 512
    assert packing.pack(packing.to_pieces(none, path)).count() == 0


def test_packing_under_several_capacities(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    for rule in ("norm", "dot"):
        out = packing.pack(packing.to_pieces(docs, path, 256), 256, max_docs=2, max_attention=50_000.0, weights=(1.0, 1.0, 1.0), rule=rule)
        x = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("d"), F.sum(F.col("length") ** 2).alias("a"))
        assert x.where("n > 256 OR d > 2 OR (a > 50000 AND d > 1)").count() == 0


def test_counts_and_repetition_keep_rows(docs, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    counts = token_counts.token_counts(docs, model, limit=100)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model)
    wanted = [{"doc_id": r[0], "n_tokens": len(library.encode(r[1] or "")), "n_bytes": len((r[1] or "").encode())} for r in docs.collect()]
    assert key(counts.collect(), "doc_id", "n_tokens", "n_bytes") == key(wanted, "doc_id", "n_tokens", "n_bytes")
    assert counts.count() == docs.count() and counts.where("over_limit <> (n_tokens > 100)").count() == 0
    assert counts.where("n_bytes = 0").agg(F.max("n_tokens")).first()[0] == 0
    scores = repetition.repetition_coverage(docs)
    assert scores.count() == docs.count()
    assert {r["kept"] for r in scores.where("doc_id = 44 OR doc_id = 46").collect()} == {False}
    assert token_counts.token_counts(none, model).count() == 0 and repetition.repetition_coverage(none).count() == 0


def water_fill(sizes, weights=(5.0, 2.0, 1.0), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest, open_ = total - sum(capped.values()), [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}


def test_mixture_meets_targets(spark, none):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(int(rng.paretovariate(1) * 20) % 800 + 1)), f"s{min(i % 9, 5)}" if i % 10 else None) for i in range(3000)]
    rows += [(9_000, "tiny", "aa"), (None, None, None), (None, None, None), (5, rows[5][1], "s5")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixture(docs)
    again = key(mixing.mixture(docs.repartition(5)).collect(), "doc_id", "size", "taken")
    got = out.join(docs.dropDuplicates(["doc_id"]).select("doc_id", "source"), "doc_id").collect()
    assert key(out.collect(), "doc_id", "size", "taken") == again
    sizes, taken, target = Counter(), Counter(), {}
    for i, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
    wanted = water_fill(sizes)
    for s, t in wanted.items():
        assert target[s] == pytest.approx(t)
        assert abs(taken[s] - t) <= max(2, 0.01 * t)
    assert target["aa"] == 3
    assert mixing.mixture(none).count() == 0 and mixing.mixed(none).count() == 0


def test_mixed_repeats_rows(docs):
    mix, out = mixing.mixture(docs), mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = out.groupBy("doc_id").agg(F.sum(mixing.size_of(F.col("text"))).alias("n"))
    assert key(taken.where("n > 0").collect(), "doc_id", "n") == key(mix.groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0").collect(), "doc_id", "n")


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 60)
    monkeypatch.setattr(knn, "GROUP_QUERIES", 2)
    rng = np.random.default_rng(0)
    vectors = [[float(x) for x in rng.normal(0, 1, 6) + 5 * (i % 3)] for i in range(300)]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(500 + i, vectors[7]) for i in range(40)] + [(50, vectors[50]), (900, None), (950, [1.0, None]), (1000, [float("nan")] * 6), (1050, [float("inf")] * 6), (None, vectors[1]), (1100, [1e30, -1e30, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("g", F.lit(1))
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    wanted = []
    for q, v in {i: v for i, v in sound if i % 50 == 0}.items():
        scored = sorted((-max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in sound if i != q)[:5]
        wanted += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    got = [tuple(r) for r in knn.voronoi_top_k(df).collect()]
    assert sorted(got) == sorted(wanted)
    assert knn.voronoi_top_k(df.where("false")).count() == 0
    assert knn.voronoi_top_k(df.where("vec_id IN (0, 3)")).count() == 1


def test_top_k_of_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), *((i, [float(i), 9.0 - i]) for i in range(1, 9))]
    got = sorted(tuple(r) for r in knn.voronoi_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect())
    assert got == [(0, 1, 1, 8 * 65536), (0, 1, 8, 8 * 65536), (0, 2, 2, 7 * 65536), (0, 2, 7, 7 * 65536)]


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e306, 1.0]), (50, [1.0, 1.0]), (3, [2.0, 3.0])]
    got = sorted(tuple(r) for r in knn.voronoi_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    most = (1 << 63) - 1
    assert got == [(0, 1, 3, most), (0, 2, 50, most), (50, 1, 0, most), (50, 2, 3, 5 * 65536)]


def test_only_clustered_data_is_spared_copies(spark, monkeypatch):
    monkeypatch.setattr(knn, "PIVOT_QUERIES", 4)
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 1, (12, 16)) * 40
    clustered = [(i, [float(x) for x in centre[i % 12] + rng.normal(0, 0.5, 16)]) for i in range(3000)]
    uniform = [(i, [float(x) for x in rng.normal(0, 1, 16)]) for i in range(3000)]
    copies = [knn.replication(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) for rows in (clustered, uniform)]
    assert copies[0] < 0.5 * copies[1]


def test_cells_of_many_pivots_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(3)
    pivots, v = np.floor(rng.normal(0, 100, (256, 64))), np.floor(rng.normal(0, 100, (10_000, 64)))
    tracemalloc.start()
    cell, away = knn.nearest(v, pivots)
    bound = knn.sample_bound(np.arange(10_000), v, np.arange(2048), v[:2048], 5)
    each = lambda x: pa.array(np.full(256, float(x)))
    cells = knn.Cells(pivots, pa.table({"g": np.arange(256, dtype=np.int32), "n": each(100), "radius": each(away.max()), "asked": each(10), "asked_radius": each(away.max()), "bound": each(bound.min())}), 5)
    row, to = cells.needed(v[:5000], cell[:5000])
    assert len(row) and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    assert (((v[:50, None] - pivots[None]) ** 2).sum(2).argmin(1) == cell[:50]).all()


def test_toxicity_learns_and_leaves_held_out_labels_alone(spark, none):
    rng = random.Random(1)
    bad = ["scoundrel", "villain", "wretch"]
    rows = []
    for i in range(600):
        toxic = int(rng.random() < 0.25)
        w = [rng.choice(["lamp", "table", "river", "stone", "cloud", "walking", "green"]) for _ in range(20)]
        if toxic:
            w[rng.randint(0, 19)] = rng.choice(bad)
        rows.append((i, " ".join(w), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (700, ""), (701, "you sc0undre1 there"), (702, "you v i l l a i n there")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - x) for i, _, x in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    held = [(got[i]["predicted"], x) for i, _, x in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert got[701]["predicted"] == got[702]["predicted"] == 1 and got[700]["predicted"] == got[None]["predicted"] == 0
    assert toxicity.not_toxic(docs, labels).columns == docs.columns
    assert toxicity.toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("false")).collect()} == {0.0}


def test_url_lists(spark):
    day = lambda df: df.withColumn("day", F.to_date("day"))
    entries = day(spark.createDataFrame([("a", "x.org", "add", "2024-01-01"), ("a", "x.org", "remove", "2024-02-01"), ("a", "x.org", "add", "2024-02-01"), ("b", "y.x.org/bad", "add", "2024-01-15"), ("b", None, "add", "2024-01-01"), ("c", "X.ORG", "add", None)], "list string, pattern string, action string, day string"))
    rows = [(1, "https://y.x.org/bad/1", "2024-01-20"), (1, "https://y.x.org/bad/1", "2024-01-20"), (2, "http://xx.org/", "2024-01-20"), (3, "HTTP://u:p@X.org:80?q", "2024-02-01"), (4, None, "2024-01-20"), (5, "https://x.org/", None), (None, "https://x.org/", "2023-12-31")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched")).withColumn("pattern", F.lit("z"))
    got = key(url_lists.url_verdicts(captures, entries).collect(), "page_id", "n_active", "lists", "blocked")
    assert got == sorted([(1, 2, "a,b", True), (1, 2, "a,b", True), (2, 0, "", False), (3, 0, "", False), (4, 0, "", False), (5, 0, "", False), (None, 0, "", False)], key=str)
    assert url_lists.url_verdicts(captures.where("false"), entries).count() == 0
    assert url_lists.url_verdicts(captures, entries.where("false")).where("blocked").count() == 0


def test_licenses(spark):
    mit = [k for k, v in licenses.SENTENCES.items() if v == "mit-grant"][0]
    notice = [k for k, v in licenses.SENTENCES.items() if v == "mit-notice"][0]
    rows = [(1, f"Hello.\nReleased under the MIT License.\nAll rights reserved"), (2, f"{mit.upper()}. {notice}."), (3, f"{notice}. {mit}."), (4, None), (5, ""), (6, "We license nothing."), (None, "Licensed under CC BY-NC 4.0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r["doc_id"]: (r["licenses"], r["n_sentences"], r["restricted"]) for r in licenses.license_scan(docs).collect()}
    assert got == {1: ("MIT,Proprietary", 2, True), 2: ("MIT-text", 2, False), 3: ("", 2, False), 4: ("", 0, False), 5: ("", 0, False), 6: ("", 0, False), None: ("CC-BY-NC-4.0", 1, True)}


def test_native_plans_have_no_python(spark, tmp_path):
    for df in (licenses.license_scan(spark.createDataFrame([(1, "x")], "doc_id long, text string")), url_lists.url_verdicts(spark.createDataFrame([(1, "x")], "page_id long, url string").withColumn("fetched", F.current_date()), spark.createDataFrame(url_lists.ENTRIES, "list string, pattern string, action string, day string").withColumn("day", F.to_date("day")))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_any_column_names_pass_through(spark):
    """Names with signs, and names that the operators use themselves."""
    rng = random.Random(4)
    rows = [(i, prose(rng, 60), "s", i, i, "x", None, i, i) for i in range(12)] + [(99, None, None, None, None, None, None, None, None)]
    columns = "doc_id long, text string, source string, `_` long, `a.b` long, `c``d` string, none string, row long, c0 long"
    docs = spark.createDataFrame(rows, columns)
    labels = spark.createDataFrame([(i, int(i == 3)) for i in range(12)], "doc_id long, toxic int")
    for out in (substring.without_repeats(docs), near.one_of_each(docs), mixing.mixed(docs), toxicity.not_toxic(docs, labels)):
        assert out.columns == docs.columns
        for r in out.collect():
            assert r["doc_id"] is None or r["a.b"] == r["_"] == r["row"] == r["c0"] == (None if r["doc_id"] == 99 else r["doc_id"])
        assert out.where("`a.b` >= 0").count() > 0


def test_one_very_long_text(spark):
    """A text far longer than a slice beside short ones, and one of a single word."""
    rng = random.Random(6)
    letters = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"]
    long = " ".join("".join(rng.choices(letters, k=5)) for _ in range(180_000))
    rows = [(1, long, "a"), (2, "z" * 200_000, "a"), (3, "short text", "b"), (50, "short text", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, toxic int")
    n = {r["doc_id"]: r["size"] for r in mixing.mixture(docs).collect()}
    assert n == {1: 180_000, 2: 1, 3: 2, 50: 2}
    prints = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, 4, 4).collect()}
    assert prints[50] == 3 and prints[1] == 1 and prints[2] == 2
    assert sorted(r["doc_id"] for r in near.one_of_each(docs).collect()) == [1, 2, 3]
    assert {r["doc_id"]: r["n_words"] for r in substring.word_digest(docs).collect()} == n
    assert {r["doc_id"]: r["n_words"] for r in repetition.repetition_coverage(docs).collect()} == n
    assert licenses.license_scan(docs).count() == 4 and toxicity.toxicity(docs, labels).count() == 4
    assert packing.to_pieces(docs.where("doc_id <> 2"), public_tokenizers.path("word_bpe_49k.json")).where("length > 4096").count() == 0


def test_substrings_of_like_pattern(spark):
    """Two documents that differ in one word of the same pattern have no window in common."""
    letters = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    rest = [f"w{i}" for i in range(18)]
    rows = [(i, " ".join([*rest, x, *rest])) for i, x in enumerate((letters[:1024], letters[1024:]))]
    assert {r["n_removed"] for r in substring.word_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
