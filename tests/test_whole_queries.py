"""Queries over whole inputs, against brute force."""

import random
import re

from docweave.functions import text
from docweave.plans.queries import QUERIES
from docweave.sources import tables


def documents(spark, path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_whole_lines_across_pages(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["alpha", "Beta", "gamma.", "delta!", "é", "a", "漢字"]) + str(rng.randint(0, 400)) * rng.randint(0, 1) for _ in range(rng.randint(0, 200))) for _ in range(12)] + [None, ""]
    got = QUERIES["cross_page_paragraphs"](spark, documents(spark, tmp_path, texts)).collect()
    wanted = []
    for doc, said in enumerate(texts):
        w = (said or "").split()
        lines = [" ".join(w[i : i + 12]) for i in range(0, len(w), 6)]
        words = lambda x: {k for k in x.lower().split() if len(k) > 1} | set(re.findall("[一-鿿]", x))
        for page in range(0, len(lines), 4):
            heads = range(page + 4, min(page + 7, len(lines)))
            for tail in range(max(page, min(page + 4, len(lines)) - 3), min(page + 4, len(lines))):
                a = words(lines[tail])
                hit = next((h for h in heads if lines[tail][-1] not in text.SENTENCE_ENDS and a and words(lines[h]) and len(a & words(lines[h])) / len(a | words(lines[h])) >= 0.3), None)
                wanted += [(doc, tail, hit)] if hit is not None else []
    assert sorted(map(tuple, got)) == sorted(wanted) and len(wanted) > 5


def test_every_paragraph_has_a_page(spark, tmp_path):
    lines = [f"line {i % 50:03d} of it" for i in range(130)]
    lines[7] = lines[60] = " "
    got = QUERIES["page_deviation"](spark, documents(spark, tmp_path, ["\n".join(lines)])).first()
    off = [0] * 6
    for i, x in enumerate(lines):
        if x.strip():
            anchor = x[:10].strip()
            found = min(j // 40 for j, y in enumerate(lines) if anchor in y)
            off[min(abs(i // 40 - found), 5)] += 1
    assert [got[f"off_{i}"] for i in range(6)] == off and sum(off) == 128
    assert abs(got["deviation_ratio"] - (off[0] + off[1]) / 128) < 1e-6


def test_every_element_is_aligned(spark):
    sf = "/root/testdata/sf0.001"
    said = tables.page_elements(spark, sf).where(text.text_of("text") != "").select("doc_id", "block_id").collect()
    got = QUERIES["text_align_fuzzy"](spark, sf).select("doc_id", "block_id").collect()
    assert sorted(got) == sorted(said)
    assert QUERIES["align_level_counts"](spark, sf).groupBy().sum("total").first()[0] == len(said)


def test_all_kinds_of_fields(spark, tmp_path):
    texts = ["Paid USD 1,200.50 on 2024-05-06, No.AB1234, a.b@c.de", "13812345678 and 11010519900307123X", "合同号：HT-2024-01 12月", None, ""]
    got = QUERIES["critical_fields"](spark, documents(spark, tmp_path, texts)).collect()
    wanted = [(i, k, m.group(0).strip()) for i, t in enumerate(texts) for k, p in text.FIELDS.items() for m in re.finditer(p, t or "")]
    assert sorted(map(tuple, got)) == sorted(wanted) and {k for _, k, _ in wanted} == set(text.FIELDS)


def test_lines_of_one_place_keep_the_first_of_the_table(spark, tmp_path):
    row = "{} l_orderkey, {} l_partkey, 3L l_suppkey, 5 l_linenumber, 9D l_quantity, 'A' l_returnflag, 'F' l_linestatus"
    # Spark reads the larger file first.
    spark.range(50).selectExpr(*(x.strip() for x in row.format("id", "605L").split(","))).coalesce(1).write.parquet(f"{tmp_path}/a")
    spark.range(5000).selectExpr(*(x.strip() for x in row.format("id", "5L + id * 600").split(","))).coalesce(1).write.parquet(f"{tmp_path}/b")
    table = tmp_path / "lineitem.parquet"
    table.mkdir()
    for part in "ab":
        next((tmp_path / part).glob("*.parquet")).rename(table / f"{part}.parquet")
    got = QUERIES["block_validate_dedup"](spark, str(tmp_path)).where("doc_id < 50").collect()
    assert len(got) == 50 and {r["local_level"] for r in got} == {605 % 9}
