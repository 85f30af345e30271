"""What a layout provider, a language model and a page reader have to offer, and what comes with this package.

Providers travel to the executors, so they hold settings only and open what
they need there.
"""

from __future__ import annotations

import json
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..errors import CallError, ProviderError

RAW_BLOCK = "pos int, page_id int, block_id string, raw_type string, raw_bbox array<double>, local_level int, text string, confidence double"
PAGE_OBJECT = "kind string, pos int, page_id int, text string, font_size double, bbox struct<x1:double,y1:double,x2:double,y2:double>, xref int, content binary, cell_matrix array<array<string>>"


class LayoutProvider(ABC):
    """Reads the blocks of a document."""

    name = ""

    @abstractmethod
    def parse(self, content: bytes) -> Iterable[dict]:
        """Rows of RAW_BLOCK, in order."""

    @abstractmethod
    def version(self) -> str:
        """Goes into the blocks' ``model_version``."""


class LanguageProvider(ABC):
    """Answers questions."""

    name = ""

    @abstractmethod
    def chat(self, *, system_prompt: str, user_prompt: str, temperature: float = 0.0, max_tokens: int = 2048) -> str:
        """The model's text."""

    @abstractmethod
    def version(self) -> str: ...


def _post(url: str, headers: dict, body: bytes, timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as answer:
        return answer.read()


class ChatCompletions(LanguageProvider):
    """Any service with the chat-completions protocol. ``post`` (url, headers, body, timeout) may replace the standard library's."""

    name = "openai_compat"

    def __init__(self, base_url: str, api_key: str, model: str, timeout: float = 120.0, post: Callable[..., bytes] = _post):
        missing = [k for k, v in (("base_url", base_url), ("api_key", api_key), ("model", model)) if not v]
        if missing:
            raise ValueError(f"{', '.join(missing)} must be set")
        self.base_url, self.api_key, self.model, self.timeout, self.post = base_url.rstrip("/"), api_key, model, timeout, post

    def request(self, system_prompt: str, user_prompt: str, temperature: float, max_tokens: int) -> tuple[str, dict, bytes]:
        """URL, headers and body of a question."""
        messages = [{"role": role, "content": said} for role, said in (("system", system_prompt), ("user", user_prompt))]
        body = json.dumps({"model": self.model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}, ensure_ascii=False)
        return f"{self.base_url}/chat/completions", {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"}, body.encode()

    def chat(self, *, system_prompt: str, user_prompt: str, temperature: float = 0.0, max_tokens: int = 2048) -> str:
        try:
            answer = json.loads(self.post(*self.request(system_prompt, user_prompt, temperature, max_tokens), self.timeout))
        except (OSError, ValueError) as e:
            raise CallError(f"no answer from {self.base_url}: {e}", task="chat", attempts=1) from e
        choices = answer.get("choices") if isinstance(answer, dict) else None
        if not choices:
            raise CallError("an answer without choices", task="chat", attempts=1)
        return choices[0].get("message", {}).get("content") or ""

    def version(self) -> str:
        return f"{self.name}-{self.model}"


def _each_file(files: DataFrame, read: Callable[[bytes], Iterable[dict]], schema: str) -> DataFrame:
    """doc_id, the columns of ``schema`` and an error of every row that ``read`` gives for the content of each file."""
    kind = files.schema["doc_id"].dataType.simpleString()
    whole = _parse_datatype_string(f"doc_id {kind}, {schema}, error string")
    arrow = to_arrow_schema(whole)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [{"doc_id": doc_id} | dict(row) for row in read(bytes(content))]
                except Exception as e:  # one file's failure must not lose the others
                    rows.append({"doc_id": doc_id, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("doc_id", "content").mapInArrow(run, whole)


def parsed(files: DataFrame, provider: LayoutProvider, fallback: LayoutProvider | None = None, retries: int = 2) -> DataFrame:
    """RAW_BLOCK rows of files (doc_id, content) with ``model_version``; the fallback reads what the provider can't, after retries.

    A file that neither reads is one row with an ``error``.
    """

    def read(content: bytes) -> list[dict]:
        error: Exception | None = None
        for who in [*[provider] * (retries + 1), *([fallback] if fallback else [])]:
            try:
                return [dict(row) | {"model_version": who.version()} for row in who.parse(content)]
            except Exception as e:  # the next attempt may do
                error = e
        raise ProviderError(str(error), provider=provider.name)

    return _each_file(files, read, RAW_BLOCK + ", model_version string")


def extracted(files: DataFrame, extractor: Callable[[bytes], Iterable[dict]]) -> DataFrame:
    """PAGE_OBJECT rows (text spans, images, tables) that an extractor finds in files (doc_id, content), with an ``error`` for files that it can't read."""
    return _each_file(files, extractor, PAGE_OBJECT)
