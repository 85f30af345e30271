"""Conversion engines and remote parse tasks: which is tried, the loop around them, and many documents at once.

The calls themselves are given by the caller, so nothing here needs a network.
"""

from __future__ import annotations

import io
import time
import zipfile
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import ConversionError, ProviderError

POLL_SECONDS, MOST_SECONDS = 5.0, 600.0


def available(engines: dict[str, object]) -> list[str]:
    """Names of the engines that can run here, in order."""
    return [name for name, engine in engines.items() if engine.is_available()]


def convert(source: bytes, engines: dict[str, object], engine: str | None = None, chain: Iterable[str] | None = None) -> dict:
    """The first result of the named engine or of the chain, with the errors of those before it."""
    errors: list[str] = []
    order = [engine] if engine else list(chain or engines)
    for i, name in enumerate(order):
        tool = engines.get(name)
        if tool is None or not tool.is_available():
            errors.append(f"{name}: unavailable")
            continue
        try:
            return {"engine": name, "content": tool.convert(source), "fallback": i > 0, "errors": errors}
        except Exception as e:  # the next engine may do
            errors.append(f"{name}: {e}")
    raise ConversionError("; ".join(errors) or "no engine")


def parse_remotely(url: str, post: Callable[[str], str], status: Callable[[str], dict], fetch: Callable[[str], dict[str, str]], poll: float = POLL_SECONDS, most: float = MOST_SECONDS, sleep=time.sleep, clock=time.monotonic) -> dict[str, str]:
    """Post a task, wait for it, and return its files by path."""
    if not url.startswith(("http://", "https://")):
        raise NotImplementedError("only public URLs can be parsed remotely")
    task, began = post(url), clock()
    while True:
        state = status(task)
        if state.get("state") == "done":
            if not state.get("full_zip_url"):
                raise ProviderError(f"no result file: {state}", provider="remote")
            return fetch(state["full_zip_url"])
        if state.get("state") == "failed":
            raise ProviderError(f"task failed: {state.get('err_msg', '')}", provider="remote")
        if clock() - began >= most:
            raise TimeoutError(f"task {task} took more than {most} s")
        sleep(poll)


def retried(parse: Callable[[], object], retries: int = 2, fallback: Callable[[], object] | None = None):
    """``parse()`` in up to retries + 1 attempts, then ``fallback()`` if there is one."""
    error: Exception | None = None
    for _ in range(retries + 1):
        try:
            return parse()
        except Exception as e:
            error = e
    if fallback is not None:
        return fallback()
    raise error


def unzipped(content: bytes) -> dict[str, str]:
    """The JSON and Markdown files of a result archive by path."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n: z.read(n).decode("utf-8", "replace") for n in z.namelist() if n.lower().endswith((".json", ".md"))}


def parse_documents(docs: DataFrame, post: Callable[[str], str], status: Callable[[str], dict], fetch: Callable[[str], bytes], retries: int = 2, **waiting) -> DataFrame:
    """(doc_id, path, content, error): the result files of each document (doc_id, url), parsed remotely from the executors.

    ``fetch`` returns the result archive. A document that fails after all
    attempts is one row with an error; the others are not touched by it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, url in zip(batch.column("doc_id").to_pylist(), batch.column("url").to_pylist(), strict=True):
                try:
                    files = retried(lambda url=url: parse_remotely(url or "", post, status, lambda where: unzipped(fetch(where)), **waiting), retries)
                    rows += [(doc_id, path, content, None) for path, content in sorted(files.items())]
                except Exception as e:  # one document's failure must not lose the others
                    rows.append((doc_id, None, None, f"{type(e).__name__}: {e}"))
            ids, paths, contents, errors = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("doc_id").type), *(pa.array(c, pa.string()) for c in (paths, contents, errors))], names=["doc_id", "path", "content", "error"])

    return docs.select("doc_id", "url").mapInArrow(run, f"doc_id {kind}, path string, content string, error string")
