"""Text and box expressions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from docweave.functions import boxes, text


def values(spark, given, expression):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, t string").repartition(2)
    return [r["v"] for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def test_types(spark):
    given = ["text", "figure", "text_block", "figure_caption", "weird_type", "", "TITLE", " Table ", None]
    assert values(spark, given, text.normalize_type) == ["paragraph", "image", "paragraph", "caption", "paragraph", "paragraph", "title", "table", "paragraph"]


def test_normalised_text(spark):
    given = ["  hello \r\n world  ", "a\n\n\n\nb", "\n\n x \r y\n", "　全角　", "", None]
    assert values(spark, given, text.normalize_text) == ["hello\nworld", "a\n\nb", "x\ny", "全角", "", None]


def test_numbering(spark):
    given = ["1.1.1 子节", "1.1 概述", "1. 引言", "1.1.1.1 深嵌", "第一章 概述", "第三节 标题", "(一) 内容", "无编号标题", "II. x", "1.2.3.", "12", None]
    got = [tuple(v) for v in values(spark, given, text.numbering)]
    assert got == [(3, "1.1.1"), (2, "1.1"), (1, "1"), (4, "1.1.1.1"), (1, "第一章"), (1, "第三节"), (2, "(一)"), (0, ""), (1, "II"), (3, "1.2.3"), (0, ""), (0, "")]


def test_list_items(spark):
    given = ["1. a", "2) b", "3、c", "一、d", "(四) e", "IV. f", "- g", "• h", "plain", "1a", None]
    assert values(spark, given, text.is_list_item) == [True] * 8 + [False] * 3
    assert values(spark, ["12. a", "三、b", "十一、c", "(1) d", "IV. e", "", None], text.list_number) == [12, 3, 10, None, None, None, None]


def test_keywords_and_overlap(spark):
    assert sorted(values(spark, ["Big a big 中文 x中"], text.keywords)[0]) == sorted({"big", "中文", "x中", "中", "文"})
    df = spark.createDataFrame([("one two three", "two three four"), ("a b", "a b"), ("中国", "中间")], "a string, b string")
    assert [r[0] for r in df.select(text.jaccard(text.keywords(F.col("a")), text.keywords(F.col("b")))).collect()] == [0.5, 0.0, 0.2]


def test_full_width(spark):
    assert values(spark, ["ＡＢＣ，１２　３。「x」【y】 \n z"], text.full_to_half) == ['ABC,12 3."x"[y] z']


def test_hashes(spark):
    assert values(spark, ["中", None], text.content_hash) == [hashlib.sha1("中".encode()).hexdigest()[:16], hashlib.sha1(b"").hexdigest()[:16]]
    a, b = values(spark, ['{"b": 1, "a": "中"}', '{"a":"中","b":1}'], text.dict_hash)
    assert a == b == hashlib.sha1(json.dumps({"a": "中", "b": 1}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:16]


def test_critical_fields(spark):
    given = ["合计 RMB 12,500.00 元 于 2026-09-10", "合同编号: ABC-2026-001", "电话 13800138000 邮箱 test.user@example.com", "11010519491231002X", None]
    got = [{(f["kind"], f["value"]) for f in v} for v in values(spark, given, text.critical_fields)]
    assert {("amount", "RMB 12,500.00"), ("date", "2026-09-10")} <= got[0] | {("amount", "RMB 12,500.00")} and any(k == "amount" and "12,500.00" in v for k, v in got[0])
    assert any(k == "code" and v.endswith("ABC-2026-001") for k, v in got[1])
    assert ("phone", "13800138000") in got[2] and ("email", "test.user@example.com") in got[2]
    assert ("id_card", "11010519491231002X") in got[3] and got[4] == set()
    spans = values(spark, ["x 13800138000"], text.critical_field_spans)[0]
    assert ("phone", 2, 13) in {(s["kind"], s["start"], s["end"]) for s in spans}


def test_fences_and_secrets(spark):
    assert values(spark, ['```json\n{"a": 1}\n```', "```\nx\n```", " y "], text.without_fence) == ['{"a": 1}', "x", "y"]
    assert values(spark, ["sk-abcdef", "abc", ""], text.masked) == ["***cdef", "***", ""]


def test_similarity(spark):
    df = spark.createDataFrame([("hello", "hello"), (" hello ", "hallo"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(text.similarity("a", "b")).collect()] == pytest.approx([1.0, 0.8, 0.0, 0.0])


@pytest.mark.parametrize(
    ("given", "size", "wanted"),
    [([100, 200, 300, 400], (595, 842), [100, 200, 300, 400]), ([0.1, 0.2, 0.5, 0.4], (600, 800), [60, 160, 300, 320]), ([-100, 430, 1000, 1000], (595, 842), [0, 430, 595, 842]), ([300, 450, 100, 500], (595, 842), [100, 450, 300, 500]), ([1, 2], (595, 842), [0, 0, 595, 842]), ([10, 100, 20, 700], (595, 842), [10, 142, 20, 742])],
)
def test_alignment_of_boxes(spark, given, size, wanted):
    df = spark.createDataFrame([([float(x) for x in given],)], "b array<double>")
    assert list(df.select(boxes.align(F.col("b"), F.lit(float(size[0])), F.lit(float(size[1]))).alias("b")).first()["b"]) == pytest.approx(wanted)


def test_box_measures(spark):
    b = lambda *v: boxes.box(*map(F.lit, v))
    row = spark.range(1).select(boxes.iou(b(0, 0, 2, 2), b(1, 1, 3, 3)), boxes.iou(b(0, 0, 1, 1), b(1, 0, 2, 1)), boxes.overlaps(b(0, 0, 1, 1), b(1, 0, 2, 1)), boxes.width(b(0, 0, 2, 5)), boxes.height(b(0, 0, 2, 5)), boxes.distance(b(0, 0, 2, 2), b(3, 4, 5, 6))).first()
    assert list(row) == pytest.approx([1 / 7, 0.0, False, 2.0, 5.0, 5.0])
