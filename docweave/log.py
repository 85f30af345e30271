"""Log lines of this package, as text or as one JSON object each, with secrets hidden."""

from __future__ import annotations

import json
import logging
import re
import sys

ROOT = "docweave"
#: Fields that every record has; what else a record carries was given by the caller.
USUAL = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}
SECRET = re.compile(r"(?i)((?:api[_-]?key|token|secret|authorization)[\"']?\s*[:=]\s*[\"']?(?:bearer\s+)?)([^\s\"',;]+)")


def masked(said: str) -> str:
    """A text with the values of keys and tokens hidden but for their last four characters."""
    return SECRET.sub(lambda m: m[1] + "***" + (m[2][-4:] if len(m[2]) > 4 else ""), said)


class Lines(logging.Formatter):
    def __init__(self, as_json: bool):
        super().__init__("%(asctime)s %(levelname)-7s [%(name)s] %(message)s")
        self.as_json = as_json

    def format(self, record: logging.LogRecord) -> str:
        if not self.as_json:
            return masked(super().format(record))
        own = {k: v for k, v in vars(record).items() if k not in USUAL}
        line = {"ts": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "logger": record.name, "msg": record.getMessage(), **own}
        if record.exc_info:
            line["exc"] = self.formatException(record.exc_info)
        return masked(json.dumps(line, ensure_ascii=False, default=str))


def configure(level: int = logging.INFO, path: str | None = None, as_json: bool = False) -> logging.Logger:
    """Set where this package's lines go: standard error, and a file if there is a path. A later call replaces an earlier one."""
    root = logging.getLogger(ROOT)
    for old in list(root.handlers):
        root.removeHandler(old)
        old.close()
    for handler in [logging.StreamHandler(sys.stderr), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
        handler.setFormatter(Lines(as_json))
        root.addHandler(handler)
    root.setLevel(level)
    root.propagate = False
    return root


def logger(name: str) -> logging.Logger:
    return logging.getLogger(f"{ROOT}.{name}")
