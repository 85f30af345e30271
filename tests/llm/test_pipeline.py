"""The pipeline on a small corpus: every stage takes effect and leaves clean documents alone."""

import random

import pytest

import corpus_pipeline
from docweave.llm import registry


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = text(60)
    rows, labels = [], []
    for i in range(200):
        toxic = int(i % 5 == 0)
        t = text(100) + (" scoundrel villain" if toxic else "")
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, toxic))
    rows += [(300 + i, rows[1][1], "en", "s1", rows[1][4]) for i in range(3)]
    rows += [(400 + i, text(30) + " " + passage + " " + text(10), "en", "s2", 1) for i in range(5)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, passage


def test_stages(spark, corpus):
    path, rows, passage = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == names
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = docs.collect()
    ids = lambda name: sorted(r["doc_id"] for r in kept[name])
    assert ids("toxicity") == sorted(r[0] for r in rows if "scoundrel" not in r[1])
    assert ids("simhash_near_dedup") == [i for i in ids("toxicity") if not 300 <= i < 303]
    assert ids("substring_dedup") == ids("simhash_near_dedup")
    before = {r["doc_id"]: r["text"] for r in kept["simhash_near_dedup"]}
    for r in kept["substring_dedup"]:
        assert (passage not in r["text"]) if r["doc_id"] >= 400 else r["text"] == before[r["doc_id"]]
        assert r["n_chars"] == len(r["text"])
    assert set(ids("mixing")) <= set(ids("substring_dedup")) and max(map(ids("mixing").count, ids("mixing"))) <= 3


def test_run_equals_its_stages(spark, corpus):
    path = corpus[0]
    out = corpus_pipeline.run(spark, path)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "mixing", "packing"]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) == 10


def test_stages_on_awkward_rows(spark, corpus, tmp_path):
    """Nulls, empty texts, repeated rows and odd columns; then no rows at all."""
    path, rows, _ = corpus
    columns = "doc_id long, text string, lang string, source string, n_chars long, `row.x` long, k1 string, size string"
    odd = [(*r, r[0], "k", None) for r in rows[:40]] + [(*rows[1], 1, "k", None)] * 2
    odd += [(None, None, None, None, None, None, None, None), (500, None, None, None, None, 500, None, None), (501, "", "en", "s1", 0, 501, None, None), (502, " \n", "en", None, 2, 502, None, None), (None, rows[2][1], "en", None, 1, None, None, None)]
    docs = spark.createDataFrame(odd, columns)
    for some in (docs, docs.where("false")):
        left = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, left, path)
            assert out.columns == docs.columns
            left = spark.createDataFrame(out.collect(), docs.schema)
            ids = [r["doc_id"] for r in left.collect()]
            assert all(r["row.x"] == r["doc_id"] for r in left.collect())
            if some is docs and name in ("simhash_near_dedup", "substring_dedup"):
                assert ids.count(1) == ids.count(2) == 1 and ids.count(500) == 1 and not {501, 502, None} & set(ids)
        pieces = corpus_pipeline.STAGES[-1][1](spark, left, path)
        assert pieces.count() == left.count() and (some is docs) == (left.count() > 0)
