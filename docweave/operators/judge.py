"""Questions to a language model: prompts, calls with a budget and retries, checked answers.

A provider is a ``LanguageProvider``, or any object with its methods; it travels
to the executors. Calls of a
document run in order, since they share its budget.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AnswerError, CallError
from ..functions.folds import fold_documents
from ..sources.providers import LanguageProvider

BUDGET, RETRIES = 20, 2
# ---- Fixed values: prompts and the shapes of answers. ----
PROMPTS = {
    "cross_page_table": (
        '你是一个文档结构分析专家。你的任务是判断两个表格是否逻辑上是同一个表格（被分页拆断）。\n\n严格规则：\n1. 仅基于表格的列数、表头语义、首行内容判断\n2. 不要修改、猜测或补充任何文字内容\n3. confidence表示判断确信度\n5. 无法确定时，confidence<0.5\n\n返回严格JSON：{"is_same_table": <bool>, "confidence": <0-1>}',
        "判断以下两个表格是否逻辑上是同一个表格（被分页拆断）：\n\n表格A：\n- 表头：%s\n- 列数：%s\n- 首行：%s\n- 所在页：%s\n\n表格B：\n- 表头：%s\n- 列数：%s\n- 首行：%s\n- 所在页：%s\n\n请仅返回JSON。",
        0.0, 64,
    ),
    "heading_level": (
        '你是一个文档结构分析专家。你的任务是对一组标题判断其全局层级（1-6级）与父子关系。\n\n严格规则：\n1. 禁止改写、补充、删减任何标题文本\n2. global_level必须是1-6的整数\n3. parent_id必须是该窗口内另一标题的id，或null（顶级标题）\n4. confidence表示判断确信度，无法判定时<0.5\n5. 如果标题文本自带"第X章"或"X.Y"等编号，应作为强信号\n6. 返回严格JSON数组，按输入顺序排列',
        '以下是按顺序出现的标题列表，请判断它们的全局层级与父子关系：\n\n输入标题（每行一个）：\n%s\n\n请返回JSON数组，每个元素形如：\n{"id": "<标题id>", "global_level": <1-6整数>, "parent_id": "<父标题id或null>", "confidence": <0-1>}',
        0.0, 2048,
    ),
    "semantic_check": (
        '你是一个中文文本质检专家。你的任务是发现文本中的语义异常。\n\n严格规则：\n1. 仅发现不通顺、歧义、语病、错别字等异常，不修改原文\n2. location描述异常位置（如"第2段第3句"或"标题：xxx"）\n3. issue_type从["不通顺","歧义","语病","错别字","其他"]中选择\n4. description简述问题，不要修改原文本\n5. confidence表示确信度，无明显异常时返回空数组',
        "请检查以下文本是否存在语义异常：\n\n%s\n\n文本：\n%s\n\n如无明显异常，返回空数组[]。如有异常，按JSON数组返回。",
        0.3, 512,
    ),
}
SCHEMAS = {
    "cross_page_table": {"type": "object", "fields": {"is_same_table": "boolean", "confidence": "share"}},
    "heading_level": {"type": "array", "fields": {"id": "string", "global_level": "level", "parent_id": "string?", "confidence": "share"}},
    "semantic_check": {"type": "array", "fields": {"location": "string", "issue_type": ("不通顺", "歧义", "语病", "错别字", "其他"), "description": "string", "confidence": "share"}},
}
# ---- End of fixed values. ----


def plain_answer(answer: str) -> str:
    inside = re.match(r"^```(?:json)?\s*\n?(.*?)\n?```\s*$", answer.strip(), re.DOTALL)
    return (inside[1] if inside else answer).strip()


def _fits(value, kind) -> bool:
    number = isinstance(value, int | float) and not isinstance(value, bool)
    if isinstance(kind, tuple):
        return value in kind
    return {
        "boolean": isinstance(value, bool), "share": number and 0 <= value <= 1, "string": isinstance(value, str), "string?": value is None or isinstance(value, str),
        "level": number and value == int(value) and 1 <= value <= 6,
    }[kind]


def checked(answer: str, schema: dict | None):
    """The parsed answer, if it has exactly the fields asked for."""
    try:
        data = json.loads(plain_answer(answer))
    except ValueError as e:
        raise AnswerError(f"not JSON ({e})", answer=answer) from e
    if schema is None:
        return data
    items = data if schema["type"] == "array" else [data]
    if not isinstance(items, list):
        raise AnswerError("a list was asked for", answer=answer)
    for item in items:
        if not isinstance(item, dict) or set(item) != set(schema["fields"]) or not all(_fits(item[k], kind) for k, kind in schema["fields"].items()):
            raise AnswerError("other fields or values than asked for", answer=answer)
    return data


@dataclass
class Client:
    """Calls of one document: the budget is looked at once before a call's attempts, and only calls that succeed count."""

    provider: object
    budget: int = BUDGET
    used: int = 0

    def call(self, task: str, system: str, user: str, schema: dict | None, temperature: float, max_tokens: int, retries: int = RETRIES):
        if self.used >= self.budget:
            raise CallError(f"all {self.budget} calls are used", task=task, attempts=0)
        error: Exception = CallError("no attempt", task=task, attempts=0)
        for attempt in range(1, retries + 2):
            try:
                data = checked(self.provider.chat(system_prompt=system, user_prompt=user, temperature=temperature, max_tokens=max_tokens), schema)
                self.used += 1
                return data, attempt
            except AnswerError as e:
                error = e
            except Exception as e:  # whatever a provider raises is an attempt that failed
                error = CallError(str(e), task=task, attempts=attempt)
        raise error


class EmptyProvider(LanguageProvider):
    """Answers every question with an empty object."""

    name = "mock"

    def chat(self, **_) -> str:
        return "{}"

    def version(self) -> str:
        return "mock-llm-1"


def table_prompt(a: str, b: str) -> Column:
    """The question whether two tables, struct(header, col_count, first_row, page), are one."""
    parts = [F.col(t)[f] if f != "first_row" else F.array_join(F.col(t)[f], " | ") for t in (a, b) for f in ("header", "col_count", "first_row", "page")]
    return F.format_string(PROMPTS["cross_page_table"][1], *(p.cast("string") for p in parts))


def heading_prompt(titles: Column) -> Column:
    """The question for the levels of titles, array<struct(id, text)>."""
    return F.format_string(PROMPTS["heading_level"][1], F.array_join(F.transform(titles, lambda t: F.concat(t["id"], F.lit(": "), t["text"])), "\n"))


def check_prompt(said: Column, context: Column) -> Column:
    return F.format_string(PROMPTS["semantic_check"][1], F.coalesce(context, F.lit("")), said)


def heading_windows(headings: DataFrame, size: int = 10, overlap: int = 2) -> DataFrame:
    """Headings in windows of ``size``, each sharing ``overlap`` with the next."""
    from pyspark.sql import Window

    step = size - overlap
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    x = headings.withColumn("_n", n).withColumn("_w", F.floor(F.col("_n") / step).cast("int"))
    windows = F.when((F.col("_n") % step < overlap) & (F.col("_w") > 0), F.array(F.col("_w") - 1, "_w")).otherwise(F.array("_w"))
    return x.withColumn("window", F.explode(windows)).drop("_n", "_w")


def ask(questions: DataFrame, provider: object, budget: int = BUDGET, swallow: bool = False) -> DataFrame:
    """Answers to questions (doc_id, pos, task, prompt): answer as JSON, attempts, and an error where a call failed.

    With ``swallow`` a failed call is an empty list of findings.
    """

    def run(rows: list[dict]):
        client = Client(provider, budget)
        for r in sorted(rows, key=lambda r: r["pos"]):
            system, _, temperature, most = PROMPTS[r["task"]]
            try:
                data, attempts = client.call(r["task"], system, r["prompt"], SCHEMAS[r["task"]], temperature, most)
                yield r["pos"], r["task"], json.dumps(data, ensure_ascii=False), attempts, None
            except CallError as e:
                yield r["pos"], r["task"], "[]" if swallow else None, 0, None if swallow else str(e)

    return fold_documents(questions.withColumn("pos", F.col("pos").cast("long")), ["pos", "task", "prompt"], run, "pos bigint, task string, answer string, attempts int, error string")


def answers(asked: DataFrame, task: str) -> DataFrame:
    """Answers of a task as columns, one row a finding."""
    kinds = {"boolean": "boolean", "share": "double", "level": "int"}
    fields = ", ".join(f"{k}: {kinds.get(v, 'string') if isinstance(v, str) else 'string'}" for k, v in SCHEMAS[task]["fields"].items())
    rows = asked.where((F.col("task") == task) & F.col("answer").isNotNull())
    if SCHEMAS[task]["type"] == "array":
        return rows.select("doc_id", "pos", F.explode(F.from_json("answer", f"array<struct<{fields}>>")).alias("a")).select("doc_id", "pos", "a.*")
    return rows.select("doc_id", "pos", F.from_json("answer", f"struct<{fields}>").alias("a")).select("doc_id", "pos", "a.*")
