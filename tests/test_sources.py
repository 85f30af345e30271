"""Readers, plans, streams and the registered queries."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docweave import errors, log
from docweave.plans import __main__ as cli
from docweave.plans import config, queries
from docweave.sources import content_json as C
from docweave.sources import providers, remote
from docweave.streaming import blocks as S

DATA = "/root/testdata/sf0.001"


def files(spark, *contents):
    return spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "doc_id int, content string")


def test_content_list_v2(spark):
    item = lambda kind, content, box=(0, 0, 9, 9): {"type": kind, "content": content, "bbox": list(box)}
    page = [item("title", {"title_content": [{"type": "text", "content": "Head"}], "level": 9}), item("paragraph", " plain "), item("table", {"x": {"text": "a" * 300}}), item("x", {}, (1, 2))]
    out = C.content_list_v2(files(spark, json.dumps([page, "bad", [item("list", {"k": ["q", {"content": "r"}]})]]), "{", None)).orderBy("doc_id", "pos").collect()
    assert [(r["page_id"], r["block_type"], r["local_level"], len(r["text"])) for r in out] == [(1, "title", 6, 4), (1, "paragraph", None, 5), (1, "table", None, 200), (3, "list", None, 3)]


def test_other_formats(spark):
    v1 = C.content_list_v1(files(spark, json.dumps([{"type": "text", "text": " b ", "bbox": [0, 0, 1, 1], "page_idx": 1}, {"type": "title", "text": "a", "page_idx": 0}]))).orderBy("page_id").collect()
    assert [(r["page_id"], r["text"], r["block_type"]) for r in v1] == [(1, "a", "title"), (2, "b", "paragraph")]
    layout = C.layout_json(files(spark, json.dumps({"page_1": {"para_blocks": [{"type": "figure", "content": "x", "score": 0.5}]}, "page_x": {}, "other": 1}))).collect()
    assert [(r["page_id"], r["block_type"], r["confidence"]) for r in layout] == [(2, "image", 0.5)]
    assert C.markdown(files(spark, "a\r\nb\n")).first()["text"] == "a\nb"


def test_best_file_wins(spark):
    rows = [(1, "d/x_content_list.json", "[]"), (1, "d/x_content_list_v2.json", '[[{"type": "text", "content": "v2"}]]'), (2, "full.md", "md"), (2, "note.txt", "-"), (3, "a.txt", "-")]
    x = spark.createDataFrame(rows, "doc_id int, path string, content string")
    assert {r["doc_id"]: r["text"] for r in C.provider_output(x).collect()} == {1: "v2", 2: "md"}


def test_rule_blocks(spark):
    rows = [(1, 1, 1, 0, "Big ", 14.0), (1, 1, 1, 1, "head", 10.0), (1, 1, 2, 2, "1.2 numbered", 10.0), (1, 1, 3, 3, "- item", 10.0), (1, 1, 4, 4, "text", 10.0)]
    x = spark.createDataFrame(rows, "doc_id int, page_id int, line int, pos int, text string, font_size double").withColumn("bbox", F.struct(*(F.lit(float(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2")))))
    assert [(r["text"], r["block_type"], r["local_level"]) for r in C.rule_blocks(x).orderBy("pos").collect()] == [("Big head", "title", 1), ("1.2 numbered", "title", 2), ("- item", "list", None), ("text", "paragraph", None)]


def test_table_objects_and_annotations(spark):
    t = spark.createDataFrame([(1, [["a ", None], ["b"]]), (2, [[" ", None]])], "doc_id int, cell_matrix array<array<string>>")
    assert [(r["cell_matrix"], r["row_count"], r["col_count"]) for r in C.table_objects(t).collect()] == [([["a", ""], ["b"]], 2, 2)]
    a = spark.createDataFrame([("x/d1_annotations.json", '{"document_id": "d1", "annotations": [{"id": "a", "type": "heading", "text": "T"}]}'), ("y.json", "{")], "path string, content string")
    rows = C.annotations(a)
    assert [(r["stem"], r["dirt_level"], r["text"]) for r in rows.collect()] == [("d1", "unknown", "T")]
    docs = spark.createDataFrame([("x/d1.docx",), ("x/d2.docx",)], "path string")
    assert [r["path"] for r in C.paired(docs, rows).collect()] == ["x/d1.docx"]


def test_engine_chain_and_remote_loop():
    class Engine:
        def __init__(self, ok, result):
            self.ok, self.result = ok, result

        def is_available(self):
            return self.ok

        def convert(self, source):
            if self.result is None:
                raise RuntimeError("broken")
            return self.result

    engines = {"a": Engine(False, b""), "b": Engine(True, None), "c": Engine(True, b"pdf")}
    got = remote.convert(b"x", engines)
    assert (got["engine"], got["fallback"], len(got["errors"])) == ("c", True, 2) and remote.available(engines) == ["b", "c"]
    with pytest.raises(remote.ConversionError):
        remote.convert(b"x", engines, engine="b")
    states = iter([{"state": "running"}, {"state": "done", "full_zip_url": "z"}])
    assert remote.parse_remotely("https://x/y.pdf", lambda u: "t", lambda t: next(states), lambda z: {"full.md": z}, sleep=lambda s: None) == {"full.md": "z"}
    with pytest.raises(NotImplementedError):
        remote.parse_remotely("/local.pdf", None, None, None)
    assert remote.retried(lambda: 1 / 0, 1, lambda: "fallback") == "fallback"


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("DOCWEAVE_LLM_BUDGET=7\n# x\n")
    s = config.load(str(env), {"DOCWEAVE_LLM_API_KEY": "sk-12345"})
    assert s.llm_budget == 7 and s.masked()["llm_api_key"] == "***2345"
    assert cli.main(["version"]) == 0 and cli.main(["config"]) == 0


def test_command_line(spark, tmp_path):
    assert cli.main(["eval", str(tmp_path / "none"), str(tmp_path / "none"), str(tmp_path / "out")]) == 2
    rows = [(1, i, 1, f"b{i}", (50.0, 100.0 + 20 * i, 500.0, 110.0 + 20 * i), k, 1 if k == "title" else None, t, 0.9, "mock-1") for i, (k, t) in enumerate([("title", "1. One"), ("paragraph", "text of it"), ("title", "1.1 Two"), ("paragraph", "more")])]
    blocks = spark.createDataFrame(rows, "doc_id int, pos int, page_id int, block_id string, bbox struct<x1:double,y1:double,x2:double,y2:double>, block_type string, local_level int, text string, confidence double, model_version string")
    blocks.write.parquet(str(tmp_path / "blocks"))
    edits = [(1, "b2", 1, None, 3, "b0", False), (1, "b2", 2, None, 2, "b0", False), (1, "b3", 1, None, None, None, True), (1, "new", 1, "heading", 1, "", False)]
    spark.createDataFrame(edits, "doc_id int, block_id string, at int, type string, global_level int, parent_id string, deleted boolean").write.parquet(str(tmp_path / "edits"))
    assert cli.main(["annotate", str(tmp_path / "blocks"), str(tmp_path / "edits"), str(tmp_path / "notes")]) == 0
    note = spark.read.json(str(tmp_path / "notes")).first()
    assert [(a["id"], a["type"], a["global_level"], a["parent_id"]) for a in note["annotations"]] == [("b0", "heading", 1, None), ("b1", "paragraph", None, None), ("b2", "heading", 2, "b0"), ("new", "heading", 1, None)]
    spans = blocks.select("doc_id", "pos", F.concat(F.lit("s"), "pos").alias("object_id"), "page_id", "bbox", "text", F.lit("text_span").alias("kind"), F.lit(None).cast("int").alias("row_count"), F.lit(None).cast("int").alias("col_count"), F.lit(None).cast("array<array<string>>").alias("cell_matrix"))
    spans.write.parquet(str(tmp_path / "objects"))
    assert cli.main(["run", str(tmp_path / "blocks"), str(tmp_path / "objects"), str(tmp_path / "run"), "--log-file", str(tmp_path / "log"), "--json-log"]) == 0
    assert json.loads((tmp_path / "log").read_text().splitlines()[-1])["logger"] == "docweave.run"
    assert spark.read.json(str(tmp_path / "run/alignment_counts")).first()["strong"] == 4 and spark.read.parquet(str(tmp_path / "run/files")).count() == 1
    assert cli.main(["eval", str(tmp_path / "run/nodes"), str(tmp_path / "notes"), str(tmp_path / "out")]) == 0
    got = spark.read.parquet(str(tmp_path / "out/results")).first()
    assert got["heading_level_accuracy"] == got["parent_child_f1"] == 1.0 and got["reading_order_kendall_tau"] == pytest.approx(1 / 3) and spark.read.json(str(tmp_path / "out/report")).first()["count"] == 1


def test_stream(spark, tmp_path):
    schema = "doc_id int, block_type string, local_level int, text string, confidence double, bbox struct<x1:double,y1:double,x2:double,y2:double>"
    spark.createDataFrame([(1, "paragraph", None, " a \r\n b ", 0.9, (0.0, 0.0, 9.0, 9.0)), (1, "paragraph", None, "", 0.9, (0.0, 0.0, 9.0, 9.0))], schema).write.parquet(str(tmp_path / "in"))
    S.write(S.cleaned(S.read_blocks(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a\nb"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) <= set(__spark_entry__.queries())


BAD = {
    "v2": '[[{"type": "text", "bbox": [1, null, 3, 4], "content": "x"}, "odd", {"type": "text", "bbox": [1, 2, 3, 4], "content": "good"}, {"bbox": "b"}], null]',
    "v1": '[{"page_idx": "x", "text": "a"}, {"page_idx": 1, "text": 7, "bbox": ["1", 2, 3, 4]}, 5, {"text": null, "bbox": [1, 2]}]',
    "layout": '{"page_0": {"blocks": ["odd", {"text": 3, "bbox": [1, 2, 3, 4], "score": "high"}, {"bbox": [1, 2, "x", 4]}]}, "page_z": {}, "page_1": 5}',
}


@pytest.mark.parametrize("kind", BAD)
def test_files_that_are_partly_bad(spark, kind):
    x = spark.createDataFrame([(1, BAD[kind]), (2, "{"), (3, None), (4, "7"), (5, "[" * 5000)], "doc_id int, content string")
    read = {"v2": C.content_list_v2, "v1": C.content_list_v1, "layout": C.layout_json}[kind]
    got = [(r["doc_id"], r["text"], r["bbox"]["x1"]) for r in read(x).collect()]
    assert got == [(1, {"v2": "good", "v1": "7", "layout": "3"}[kind], 1.0)]
    errors = {r["doc_id"]: r["error"] for r in C.file_errors(x, kind).collect()}
    assert set(errors) == {1, 2, 3, 4, 5} and "items" in errors[1] and "JSON" in errors[2]


class Layout(providers.LayoutProvider):
    name = "test"

    def __init__(self, fails: bytes = b"none"):
        self.fails = fails

    def parse(self, content):
        if content == self.fails:
            raise OSError("unreadable")
        yield {"pos": 0, "page_id": 1, "block_id": "a", "raw_type": "text", "raw_bbox": [0.0, 0.0, 9.0, 9.0], "text": content.decode(), "confidence": 0.9}

    def version(self):
        return f"test-{self.fails.decode()}"


def test_layout_providers(spark):
    with pytest.raises(TypeError):
        providers.LayoutProvider()
    x = spark.createDataFrame([(1, bytearray(b"one")), (2, bytearray(b"two")), (3, None)], "doc_id int, content binary")
    got = {r["doc_id"]: r for r in providers.parsed(x, Layout(b"two")).collect()}
    assert got[1]["text"] == "one" and got[1]["model_version"] == "test-two" and "unreadable" in got[2]["error"] and got[3]["error"]
    got = {r["doc_id"]: r for r in providers.parsed(x, Layout(b"two"), Layout()).collect()}
    assert got[2]["text"] == "two" and got[2]["model_version"] == "test-none"


def test_page_objects_of_an_extractor(spark, tmp_path):
    def extract(content: bytes):
        if content == b"bad":
            raise ValueError("no pages")
        box = {"x1": 1.0, "y1": 2.0, "x2": 3.0, "y2": 4.0}
        yield {"kind": "text_span", "pos": 0, "page_id": 1, "text": " hello ", "bbox": box}
        yield {"kind": "image", "pos": 1, "page_id": 1, "xref": 7, "content": b"pixels", "bbox": box}
        yield {"kind": "table", "pos": 2, "page_id": 2, "cell_matrix": [["a", None], ["b", "c"]], "bbox": box}

    files = spark.createDataFrame([(1, bytearray(b"ok")), (2, bytearray(b"bad"))], "doc_id int, content binary")
    x = providers.extracted(files, extract)
    assert [r["error"] for r in x.where("doc_id = 2").collect()] == ["ValueError: no pages"]
    spans = x.where("kind = 'text_span'").select("doc_id", "page_id", "pos", "text", "bbox")
    images = x.where("kind = 'image'").select("doc_id", "page_id", "xref", "content", F.array("bbox").alias("rects"))
    tables = x.where("kind = 'table'").select("doc_id", "page_id", "pos", "cell_matrix", "bbox")
    rows = C.page_objects(spans, images, tables).orderBy("kind").collect()
    assert [(r["kind"], r["text"], r["row_count"]) for r in rows] == [("image", None, None), ("table", None, 2), ("text_span", "hello", None)]
    written = C.write_images(images, str(tmp_path)).first()
    assert open(written["path"], "rb").read() == b"pixels" and written["image_ref"] == rows[0]["image_ref"]


def test_chat_completions():
    sent = []

    def post(url, headers, body, timeout):
        sent.append((url, headers["Authorization"], json.loads(body), timeout))
        return b'{"choices": [{"message": {"content": "yes"}}]}'

    with pytest.raises(ValueError):
        providers.ChatCompletions("", "k", "m")
    model = providers.ChatCompletions("http://host/v1/", "key", "m", 5, post)
    assert model.chat(system_prompt="s", user_prompt="u") == "yes" and model.version() == "openai_compat-m"
    url, key, body, timeout = sent[0]
    assert (url, key, timeout, body["model"]) == ("http://host/v1/chat/completions", "Bearer key", 5, "m") and [m["content"] for m in body["messages"]] == ["s", "u"]
    for answer in (b"{", b"{}", b'{"choices": []}'):
        with pytest.raises(errors.CallError):
            providers.ChatCompletions("h", "k", "m", post=lambda *_, a=answer: a).chat(system_prompt="", user_prompt="")


def test_documents_parsed_remotely(spark):
    def fetch(url):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a/full.md", "text")
            z.writestr("a/x_content_list.json", "[]")
            z.writestr("a/image.png", "x")
        return out.getvalue()

    docs = spark.createDataFrame([(1, "https://x/a.pdf"), (2, "/local"), (3, "https://x/fails"), (4, None)], "doc_id int, url string")
    status = lambda task: {"state": "failed", "err_msg": "bad"} if "fails" in task else {"state": "done", "full_zip_url": "z"}
    got = remote.parse_documents(docs, lambda url: url, status, fetch, retries=1, poll=0).collect()
    assert sorted((r["doc_id"], r["path"]) for r in got if not r["error"]) == [(1, "a/full.md"), (1, "a/x_content_list.json")]
    assert sorted(r["doc_id"] for r in got if r["error"]) == [2, 3, 4]


def test_log_hides_secrets(tmp_path):
    log.configure(path=str(tmp_path / "log"), as_json=True)
    log.logger("x").info("api_key=sk-123456789 token: abc", extra={"doc_id": 7})
    try:
        raise errors.ConversionError("none", engine="a")
    except errors.DocweaveError as e:
        log.logger("x").exception("failed: %s", e.details)
    lines = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert lines[0]["doc_id"] == 7 and "123456789" not in lines[0]["msg"] and lines[0]["msg"].endswith("***") and "ConversionError" in lines[1]["exc"]
