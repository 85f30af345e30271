"""Document operators on small frames."""

import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.functions import text

from docweave.operators import blocks as B
from docweave.operators import cleaning, crosspage, evaluation, judge, render, tree, verify

BLOCK = "doc_id int, pos int, page_id int, block_id string, x1 double, y1 double, x2 double, y2 double, block_type string, local_level int, text string"


def frame(spark, rows):
    """Blocks from (page, type, x, y, text[, level]) rows of one document, 100 by 20 points."""
    full = [(1, i, p, f"b{i}", float(x), float(y), x + 100.0, y + 20.0, k, level[0] if level else None, t) for i, (p, k, x, y, t, *level) in enumerate(rows)]
    df = spark.createDataFrame(full, BLOCK)
    return df.select("doc_id", "pos", "page_id", "block_id", F.struct("x1", "y1", "x2", "y2").alias("bbox"), "block_type", "local_level", "text", F.lit(0.9).alias("confidence"), F.lit("mock-1").alias("model_version"))


def texts(df, *order):
    return [r["text"] for r in df.orderBy(*(order or ("pos",))).collect()]


def test_preprocessing(spark):
    x = frame(spark, [(1, "paragraph", 0, 300, "B"), (1, "paragraph", 0, 200, "A"), (2, "paragraph", 0, 100, "C"), (1, "paragraph", 0, 400, ""), (1, "paragraph", 0, 10, "header"), (1, "paragraph", 0, 10, "h" * 60), (1, "image", 0, 500, ""), (1, "paragraph", 0, 600, None)])
    out = B.preprocess(x)
    assert texts(out, "position") == ["h" * 60, "A", "B", "", "C"]
    titles = B.preprocess(frame(spark, [(1, "title", 0, 200, " ", 1)])).first()
    assert titles["need_review"] and titles["review_reason"]
    assert B.preprocess(x.where("false")).count() == 0


def test_validation_and_page_filter(spark):
    x = frame(spark, [(1, "title", 0, 100, "t"), (1, "title", 0, 100.04, "again", 2), (0, "paragraph", 0, 0, "no page"), (1, "paragraph", 700, 0, "outside"), (1, "table", 5, 5, ""), (1, "paragraph", 5, 50, "")])
    ok = B.validate(x)
    assert texts(ok) == ["t", "outside", "", ""] and ok.where("text = 't'").first()["local_level"] == 1 and ok.where("text = 't'").first()["confidence"] == 0.5
    assert texts(B.inside_page(ok, F.lit(595.0), F.lit(842.0))) == ["t", ""]


def test_adapter_chain(spark):
    rows = [(1, 0, 1, "a", "TITLE", [0.1, 0.1, 0.5, 0.2], 1, "Head", 0.9), (1, 1, 1, "b", "figure", [100.0, 200.0, 300.0, 300.0], None, "", 0.9), (1, 2, 1, " ", "text", [0.0, 0.0, 9.0, 9.0], None, "x", 0.9)]
    x = spark.createDataFrame(rows, "doc_id int, pos int, page_id int, block_id string, raw_type string, raw_bbox array<double>, local_level int, text string, confidence double")
    out = B.adapt(x, version="v1").orderBy("pos").collect()
    assert [(r["block_id"], r["block_type"], r["model_version"]) for r in out] == [("a", "title", "v1"), ("b", "image", "v1")]


def stack_parents(levels):
    stack, out = [], []
    for i, level in enumerate(levels):
        while stack and levels[stack[-1]] >= level:
            stack.pop()
        out.append([*stack])
        stack.append(i)
    return out


def test_ancestors_match_a_stack(spark):
    rng = random.Random(4)
    docs = {d: [rng.randint(1, 6) for _ in range(rng.randint(0, 40))] for d in range(25)}
    rows = [(d, i, f"n{i}", level) for d, levels in docs.items() for i, level in enumerate(levels)]
    x = tree.with_ancestors(spark.createDataFrame(rows, "doc_id int, pos int, node_id string, level int").repartition(3))
    got = {(r["doc_id"], r["pos"]): [a["pos"] for a in r["ancestors"]] for r in x.collect()}
    assert got == {(d, i): a for d, levels in docs.items() for i, a in enumerate(stack_parents(levels))}


def test_tree_order_and_parents(spark):
    x = frame(spark, [(1, "title", 0, 100, "第一章 概述"), (1, "paragraph", 0, 150, "own"), (1, "title", 0, 200, "1.1 部分"), (1, "paragraph", 0, 250, "sub"), (2, "title", 0, 100, "第二章 尾"), (1, "paragraph", 0, 60, "before")])
    out = tree.build_tree(x)
    assert texts(out, "preorder") == ["第一章 概述", "1.1 部分", "sub", "own", "第二章 尾", "before"]
    assert texts(tree.build_tree(x, document_order=True), "preorder") == ["before", "第一章 概述", "own", "1.1 部分", "sub", "第二章 尾"]
    parents = {r["text"]: r["parent_id"] for r in out.collect()}
    assert parents == {"第一章 概述": None, "own": "b0", "1.1 部分": "b0", "sub": "b2", "第二章 尾": None, "before": None}
    assert tree.tree_hash(out).count() == 1 and tree.document_headers(out).first()["n_nodes"] == 7


def test_tables_and_captions(spark):
    matrix = F.array(F.array(F.lit("a"), F.lit("b")))
    nodes = frame(spark, [(1, "table", 0, 100, "")]).withColumnRenamed("block_id", "node_id")
    objects = frame(spark, [(1, "table", 0, 400, ""), (1, "table", 0, 110, "")]).withColumnRenamed("block_id", "object_id").withColumns({"row_count": F.lit(1), "col_count": F.lit(2), "cell_matrix": F.when(F.col("pos") == 1, matrix).otherwise(F.array(F.array(F.lit("z"))))})
    near = tree.nearest_tables(nodes, objects)
    assert (near.first()["object_id"], near.first()["check"]) == ("b1", "一致")
    headings = frame(spark, [(1, "title", 0, 10, "h1"), (1, "title", 0, 20, "h2")]).withColumnRenamed("block_id", "node_id")
    added = tree.missing_tables(near.select("doc_id", "cell_matrix"), objects, headings)
    assert [(r["parent_id"], r["cell_matrix"]) for r in added.collect()] == [("b0", [["z"]])]
    pics = frame(spark, [(1, "image", 0, 100, ""), (1, "image", 0, 101, ""), (1, "caption", 0, 124, "c")]).withColumnRenamed("block_id", "node_id").withColumnRenamed("block_type", "node_type")
    got = {r["image_id"]: (r["caption_id"], r["need_review"]) for r in tree.pair_captions(pics).collect()}
    assert got == {"b0": ("b2", False), "b1": (None, True)}


def test_cross_page(spark):
    x = frame(spark, [(1, "paragraph", 0, 700, "合同 工作内容 包括，"), (2, "paragraph", 0, 100, "合同 工作内容 包括 附件"), (2, "paragraph", 0, 130, "结束。"), (3, "paragraph", 0, 100, "结束")])
    assert [(r["tail_id"], r["head_id"]) for r in crosspage.split_paragraphs(x).collect()] == [("b0", "b1")]
    y = frame(spark, [(1, "list", 50, 1, "1. a"), (1, "list", 50, 2, "3. c"), (2, "list", 60, 1, "4. d"), (2, "list", 90, 1, "4. far")])
    assert [(r["tail_id"], r["head_id"]) for r in crosspage.split_lists(y).collect()] == [("b1", "b2")]
    t = spark.createDataFrame([(1, 0, "t0", 1, 3, [["阶段", "周期", "交付物"]]), (1, 1, "t1", 2, 3, [["阶段", "周期", "交付物"]]), (1, 2, "t2", 3, 2, [["阶段", "周期"]])], "doc_id int, pos int, object_id string, page_id int, col_count int, cell_matrix array<array<string>>")
    assert [(r["upper_id"], r["lower_id"]) for r in crosspage.split_tables(t).collect()] == [("t0", "t1")]


def test_alignment(spark):
    x = frame(spark, [(1, "paragraph", 0, 100, "the quick brown fox"), (1, "paragraph", 0, 130, "unrelated words here"), (1, "paragraph", 0, 160, "the quick brown fox"), (1, "paragraph", 0, 190, "")])
    spans = frame(spark, [(1, "s", 0, 160, "the quick brown fox"), (1, "s", 0, 500, "zzz")]).withColumnRenamed("block_id", "object_id")
    got = {r["block_id"]: (r["object_id"], r["level"]) for r in verify.align(x, spans).collect()}
    assert got == {"b0": ("", "none"), "b1": ("", "none"), "b2": ("b0", "strong")}
    assert {r["level"] for r in verify.align(x, spans.where("false")).collect()} == {"none"}
    assert verify.level_counts(verify.align(x, spans)).first()["none"] == 2


def test_field_conflicts(spark):
    docs = spark.createDataFrame([(1, "共 1000 元", "共 10000 元", "共 9 元"), (2, "same 5", "same 5", ""), (3, None, "x", "")], "doc_id int, vlm_text string, pdf_text string, docx_text string")
    got = sorted((r["doc_id"], r["source"], r["resolution"]) for r in verify.verify_fields(docs, True).collect())
    assert got == [(1, "pdf_vs_docx", "adopted_docx"), (1, "vlm_vs_pdf", "adopted_pdf")]


def test_error_rates(spark):
    df = spark.createDataFrame([("hallo", "hello"), ("a", "a"), ("x", ""), ("", "x"), ("", " "), (None, None)], "p string, t string")
    assert [r[0] for r in df.select(evaluation.cer(F.col("p"), F.col("t"))).collect()] == pytest.approx([0.2, 0.0, 1.0, 1.0, 0.0, 0.0])


def order(spark, items):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(items)], "doc_id int, pos int, item string")


def brute_tau(p, t):
    from itertools import combinations

    common = set(p) & set(t)
    if len(common) < 2:
        return 1.0
    rank, seq = {x: i for i, x in enumerate(t)}, [x for x in p if x in common]
    score = [1 if ((seq.index(a) < seq.index(b)) if rank[a] < rank[b] else (seq.index(a) > seq.index(b))) else -1 for a, b in combinations(seq, 2)]
    return sum(score) / len(score)


@pytest.mark.parametrize(("p", "t"), [("abcd", "abcd"), ("abcd", "dcba"), ("abcd", "abdc"), ("a", "b"), ("abac", "caab"), ("xaby", "ba")])
def test_kendall(spark, p, t):
    assert evaluation.kendall_tau(order(spark, p), order(spark, t)).first()[1] == pytest.approx(brute_tau(p, t))


def test_f1_scores(spark):
    pairs = lambda *x: spark.createDataFrame([(1, *p) for p in x], "doc_id int, parent string, child string")
    assert evaluation.pair_f1(pairs("ab", "ac", "ab"), pairs("ab", "ad")).first()["f1"] == 0.5
    tables = lambda *m: spark.createDataFrame([(1, i, x) for i, x in enumerate(m)], "doc_id int, pos int, cell_matrix array<array<string>>")
    a, b = tables([["a", "b"], ["c", "d "]]), tables([["a", "b"], ["c", "e"]])
    assert evaluation.cell_f1(a, b, "doc_id", "pos").first()["f1"] == 0.75
    assert evaluation.paired_table_f1(a, tables([["a", "b"], ["c", "e"]], [["other"]])).first()["table_cell_f1"] == 0.375


@pytest.mark.parametrize("same_page", [False, True])
def test_alignment_against_all_pairs(spark, same_page, monkeypatch):
    monkeypatch.setattr(verify, "CHUNK", 3)
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows, spans = [], []
    for doc in range(6):
        for i in range(rng.randint(0, 14)):
            said = rng.choice(["", " ", "same line", " ".join(rng.choices(words, k=rng.randint(1, 6)))])
            rows.append((doc, i, rng.randint(1, 2), f"b{i}", (0.0, 10.0 * rng.randint(0, 3), 50.0, 10.0 * rng.randint(0, 3) + 12), said))
            if rng.random() < 0.8:
                spans.append((doc, i, rng.randint(1, 2), f"s{i}", (0.0, 10.0 * rng.randint(0, 3), 50.0, 10.0 * rng.randint(0, 3) + 12), said.replace("a", "e", rng.randint(0, 2)) + rng.choice(["", " ", "x"])))
    schema = "doc_id int, pos int, page_id int, {} string, bbox struct<x1:double,y1:double,x2:double,y2:double>, text string"
    got = verify.align(spark.createDataFrame(rows, schema.format("block_id")), spark.createDataFrame(spans, schema.format("object_id")), same_page).collect()
    wanted = {}
    for doc in range(6):
        pairs = []
        for b in (r for r in rows if r[0] == doc):
            for s in (r for r in spans if r[0] == doc and (not same_page or r[2] == b[2])):
                alike = text.ratio(b[5], s[5])
                meet = min(b[4][2], s[4][2]) > max(b[4][0], s[4][0]) and min(b[4][3], s[4][3]) > max(b[4][1], s[4][1])
                if alike >= verify.WEAK:
                    pairs.append((-alike, not meet, b[1], s[1], b[3], s[3]))
        used = set()
        for a, apart, _, _, b, s in sorted(pairs):
            if b not in used and s not in used:
                used |= {b, s}
                wanted[doc, b] = (s, -a, not apart)
    assert {(r["doc_id"], r["block_id"]): (r["object_id"], r["similarity"], r["overlap"]) for r in got if r["object_id"]} == wanted and len(wanted) > 5
    assert sorted((r["doc_id"], r["block_id"]) for r in got) == sorted((r[0], r[3]) for r in rows if r[5] != "")


def test_increasing_pairs():
    rng = random.Random(1)
    for _ in range(100):
        v = [rng.randint(0, 9) for _ in range(rng.randint(0, 20))]
        assert evaluation.increasing_pairs(np.array(v, int)) == sum(a < b for i, a in enumerate(v) for b in v[i + 1 :])


def test_heading_accuracy(spark):
    rows = lambda *x: spark.createDataFrame([(1, i, t, c) for i, (t, c) in enumerate(x)], "doc_id int, pos int, text string, chain array<string>")
    truth = rows(("a", []), ("b", ["a"]), ("c", ["a", "b"]))
    assert evaluation.heading_accuracy(rows(("a", []), ("b", []), ("c", ["a", "b"])), truth).first()[1] == pytest.approx(2 / 3)


def test_evaluation_of_trees_is_that_of_its_metrics(spark):
    rng = random.Random(11)
    nodes, truth = [], []
    for doc in range(20):
        for side in (nodes, truth):
            heads = []
            for i in range(rng.randint(0, 9)):
                kind = rng.choice(["heading", "heading", "paragraph", "table"])
                said = rng.choice(["A", "B", " C", "d e", "", None])
                cells = [[rng.choice(["h", "k "]), None], [rng.choice("xyz"), "1  2"]] if kind == "table" else None
                side.append((doc, i, f"n{i}", kind, said, rng.choice([*heads, None]), cells, rng.random() < 0.3))
                heads += [f"n{i}"] if kind == "heading" else []
    schema = "doc_id int, pos int, {} string, {} string, text string, parent_id string, cell_matrix array<array<string>>, need_review boolean"
    p = spark.createDataFrame(nodes, schema.format("node_id", "node_type")).withColumn("preorder", F.col("pos"))
    t = spark.createDataFrame(truth, schema.format("id", "type")).drop("need_review")
    docs = spark.createDataFrame([(i, "light") for i in range(20)], "doc_id int, dirt_level string")
    got = {r["doc_id"]: r for r in evaluation.evaluate_trees(p, t, docs).collect()}
    items = lambda df, id: df.select("doc_id", "pos", F.coalesce(F.nullif("text", F.lit("")), id).alias("item")).where("item IS NOT NULL")
    tau = {r[0]: r[1] for r in evaluation.kendall_tau(items(p, F.lit(None)), items(t, F.col("id"))).collect()}
    tables = {r[0]: r[1] for r in evaluation.paired_table_f1(p.where("node_type = 'table'"), t.where("type = 'table'")).collect()}
    heads = lambda df, kind: df.where(F.col(kind) == "heading").select("doc_id", F.lit("root").alias("parent"), F.trim("text").alias("child")).where("child <> ''")
    f1 = {r["doc_id"]: r["f1"] for r in evaluation.pair_f1(heads(p, "node_type"), heads(t, "type")).collect()}
    review = {r[0]: r[1] for r in evaluation.review_ratio(p, "doc_id").collect()}
    for doc, r in got.items():
        if any(x[0] == doc for x in nodes + truth):
            wanted = [tau.get(doc, 1.0), tables.get(doc, 1.0), f1.get(doc, 1.0), review.get(doc, 0.0)]
            assert [r["reading_order_kendall_tau"], r["table_cell_f1"], r["parent_child_f1"], r["review_ratio"]] == pytest.approx(wanted), doc


def test_report_and_badcases(spark):
    docs = spark.createDataFrame([(1, "light"), (2, "light"), (3, "heavy")], "doc_id int, dirt_level string")
    part = spark.createDataFrame([(1, 1.0, 0.5, 0.2), (2, 1.0, 1.0, 0.0)], "doc_id int, heading_level_accuracy double, parent_child_f1 double, text_cer double")
    results = evaluation.evaluate([part], docs)
    report = {r["dirt_level"]: r for r in evaluation.report(results).collect()}
    assert report["light"]["count"] == 2 and report["light"]["parent_child_f1"] == 0.75 and report["light"]["badcase_total"] == 2
    assert sorted((r["doc_id"], r["badcase"]) for r in evaluation.badcases(results).collect()) == [(1, "parent_child_disorder"), (1, "text_recognition_error"), (3, "parent_child_disorder")]


def docx(body, extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
        for name in extra:
            z.writestr(name, "x")
    return out.getvalue()


def run_of(text, mark=""):
    return f"<w:r><w:rPr>{mark}</w:rPr><w:t>{text}</w:t></w:r>"


def test_cleaning_rules():
    field = '<w:r><w:fldChar w:fldCharType="{}"/></w:r>'.format
    body = (
        f"<w:p><w:ins><w:ins>{run_of('kept')}</w:ins></w:ins><w:del>{run_of('gone')}</w:del>{run_of('hidden', '<w:vanish/>')}{run_of('struck', '<w:dstrike/>')}"
        f'<w:commentRangeStart/>{field("begin")}{run_of("CODE")}{field("separate")}{run_of("result")}{field("end")}<w:fldSimple>{run_of("simple")}</w:fldSimple></w:p>'
    )
    content, counts = cleaning.clean_bytes(docx(body, ["word/comments.xml", "word/vbaProject.bin"]))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml, names = z.read("word/document.xml").decode(), z.namelist()
    assert counts == {"accept_revisions": 3, "remove_vanish": 1, "remove_strikethrough": 1, "strip_comments": 1, "freeze_fields": 2, "strip_macros": 1}
    assert [w for w in ("kept", "gone", "hidden", "struck", "CODE", "result", "simple") if w in xml] == ["kept", "result", "simple"]
    assert names == ["word/document.xml"]


def test_fields_in_fields():
    mark = '<w:r><w:fldChar w:fldCharType="{}"/></w:r>'.format
    inner = mark("begin") + run_of("CODE2") + mark("separate") + run_of("inner") + mark("end")
    in_result = mark("begin") + run_of("CODE1") + mark("separate") + run_of("before") + inner + run_of("after") + mark("end")
    in_code = mark("begin") + run_of("CODE3") + inner + mark("separate") + run_of("result") + mark("end")
    rest = mark("begin") + run_of("CODE4") + mark("end") + mark("end") + mark("separate") + run_of("open") + mark("begin")
    content, counts = cleaning.clean_bytes(docx(f"<w:p>{in_result}</w:p><w:p>{in_code}</w:p><w:p>{rest}</w:p>"))
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode()
    assert counts["freeze_fields"] == 3
    assert [w for w in ("CODE1", "before", "CODE2", "inner", "after", "CODE3", "result", "CODE4", "open") if w in xml] == ["before", "inner", "after", "result", "CODE4", "open"]


def test_a_rule_that_fails_loses_no_other(monkeypatch):
    def broken(p):
        p.tree(cleaning.MAIN).clear()
        raise ValueError("half done")

    rules = [cleaning.RULES[0], ("broken", broken), cleaning.RULES[1]]
    content, counts = cleaning.clean_bytes(docx(f"<w:p><w:ins>{run_of('kept')}</w:ins>{run_of('hidden', '<w:vanish/>')}</w:p>"), rules)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode()
    assert counts == {"accept_revisions": 1, "broken": 0, "remove_vanish": 1} and "kept" in xml and "hidden" not in xml and "w:ins" not in xml


def test_cleaning_frames(spark):
    files = spark.createDataFrame([(1, bytearray(docx(f"<w:p><w:ins>{run_of('a')}</w:ins></w:p>"))), (2, bytearray(b"no zip")), (3, None)], "doc_id int, content binary")
    out = {r["doc_id"]: r for r in cleaning.clean(files).collect()}
    assert out[1]["changes"]["accept_revisions"] == 1 and out[2]["error"] and out[3]["error"]
    assert {r["rule"]: r["n_changes"] for r in cleaning.changes_by_rule(cleaning.clean(files)).collect()}["accept_revisions"] == 1


def test_rendered_files_read_back(spark):
    nodes = tree.build_tree(frame(spark, [(1, "title", 0, 100, "1. One"), (1, "paragraph", 0, 150, "a < b & c"), (1, "title", 0, 200, "1.1 Two"), (1, "image", 0, 300, "")]))
    items = cleaning.body_items(bytes(render.render(nodes).first()["content"]))
    assert [(i[1], i[2], i[3], i[4]) for i in items] == [("heading", "1. One", 1, None), ("heading", "1.1 Two", 2, 0), ("paragraph", "[图片: (空)]", None, 1), ("paragraph", "a < b & c", None, 1)]
    assert '"node_count":4' in render.tree_json(nodes).first()["value"]


class Scripted:
    def __init__(self, *replies):
        self.replies = list(replies)

    def chat(self, **_):
        reply = self.replies.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    def version(self):
        return "scripted"


GOOD = '```json\n{"is_same_table": true, "confidence": 0.9}\n```'


def test_model_calls(spark):
    schema = judge.SCHEMAS["cross_page_table"]
    client = judge.Client(Scripted("no json", ValueError("down"), GOOD), budget=1)
    assert client.call("t", "", "", schema, 0, 9) == ({"is_same_table": True, "confidence": 0.9}, 3)
    with pytest.raises(judge.CallError):
        client.call("t", "", "", schema, 0, 9)
    with pytest.raises(judge.AnswerError):
        judge.Client(Scripted(*['{"is_same_table": true, "confidence": 2}'] * 3)).call("t", "", "", schema, 0, 9)
    q = spark.createDataFrame([(1, 0, "cross_page_table", "p"), (1, 1, "cross_page_table", "p"), (2, 0, "semantic_check", "p")], "doc_id int, pos int, task string, prompt string")
    asked = judge.ask(q.where("doc_id = 1"), Scripted(*[GOOD] * 9), budget=1).orderBy("pos").collect()
    assert asked[0]["error"] is None and asked[1]["error"]
    assert judge.ask(q.where("doc_id = 2"), judge.EmptyProvider(), swallow=True).first()["answer"] == "[]"
    assert judge.answers(judge.ask(q.where("pos = 0 AND doc_id = 1"), Scripted(GOOD)), "cross_page_table").first()["is_same_table"]


def test_heading_windows(spark):
    x = spark.range(20).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"))
    sizes = {r["window"]: r["count"] for r in judge.heading_windows(x).groupBy("window").count().collect()}
    assert sizes == {0: 10, 1: 10, 2: 4}


def test_costs_and_gates(spark):
    calls = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id int, task string")
    assert {(r["task"], r["n"], r["total"], r["remaining"], r["exceeded"]) for r in evaluation.call_costs(calls, 3).collect()} == {("a", 2, 3, 0, True), ("b", 1, 3, 0, True)}
    f = spark.createDataFrame([("light", 1.0, 1.0, 0.96, 1.0), ("odd", 1.0, 1.0, 0.96, 1.0)], "dirt_level string, text_recall double, image_recall double, table_row_accuracy double, deviation_ratio double")
    assert {r["dirt_level"]: r["overall"] for r in evaluation.go_no_go(f).collect()} == {"light": False, "odd": True}


def test_distances_of_long_texts(spark):
    rng = random.Random(7)

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
        return row[-1]

    said = lambda n: "".join(rng.choices("ab é漢😀", k=n))
    pairs = [(said(n), said(m)) for n, m in ((0, 0), (0, 5), (7, 3), (20, 20), (150, 90), (130, 160))] + [((x := said(300)), x[:40] + "z" + x[41:200] + x[220:]), (x, x), (x, x[1:-1:2])]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(text.levenshtein(F.col("a"), F.col("b"))).collect()] == [text.edit_distance(*p) for p in pairs] == [brute(*p) for p in pairs]
    # A whole table of these would have 16 thousand million cells.
    book = said(130_000)
    long = spark.createDataFrame([(book[::2], book)], "a string, b string")
    assert long.select(evaluation.cer(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.5, abs=0.1)


def test_large_batches_are_read_in_pieces(spark, monkeypatch):
    import pyarrow as pa

    from docweave.functions import folds

    # The function that a frame would map, on one batch.
    rows = spark.createDataFrame([], "doc_id string, content string")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: run)
    length = lambda x: [(len(x),)]
    n, said = 4000, "x" * 2000
    for run, column, value in (
        (folds.unfold(rows, "content", length, "n int"), "content", said), (folds.fold_documents(rows, ["content"], length, "n int"), "rows", [{"content": said}]), (cleaning.clean(rows), "content", said),
    ):
        batch = pa.RecordBatch.from_pydict({"doc_id": [str(i) for i in range(n)], column: [value] * n})
        sizes = [out.num_rows for out in run(iter([batch]))]
        assert sum(sizes) == n and max(sizes) * len(said) <= 2 << 20


def test_equal_lines_look_at_each_box_once(monkeypatch):
    calls, meet = [], verify._meet
    monkeypatch.setattr(verify, "_meet", lambda a, b: calls.append(1) or meet(a, b))
    box = lambda y: {"x1": 0.0, "y1": y, "x2": 9.0, "y2": y + 5}
    row = lambda side, i, y: {"side": side, "pos": i, "id": f"{side}{i}", "bbox": box(y), "text": "same", "key": None}
    rows = [row("b", i, 10.0 * (i % 2)) for i in range(300)] + [row("s", i, 10.0 * (i % 2) + 20) for i in range(299)] + [row("s", 299, 0.0)]
    got = {r[3]: (r[6], r[8]) for r in verify._first_pass(rows)}
    assert got == {"b0": ("s299", True), **{f"b{i}": (f"s{i - 1}", False) for i in range(1, 300)}} and len(calls) < 10


def test_words_of_split_paragraphs_are_found_before_pairs(spark):
    x = frame(spark, [(1, "paragraph", 0, 100, "alpha beta gamma"), (2, "paragraph", 0, 100, "Beta gamma delta")])
    found = crosspage.split_paragraphs(x)
    assert [tuple(r) for r in found.collect()] == [(1, "b0", "b1", 0, 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and not any("regexp_extract_all" in line for line in joins)
