"""What operators raise. Callers that have another way (an engine, a provider) catch the first level and go on."""

from __future__ import annotations


class DocweaveError(Exception):
    """Any failure of this package; ``details`` say where."""

    def __init__(self, message: str, **details: object):
        super().__init__(message)
        self.details = details


class ConversionError(DocweaveError):
    """No engine made a file; details: engine."""


class ProviderError(DocweaveError):
    """A layout provider gave no blocks; details: provider, page_id."""


class CallError(DocweaveError):
    """A question to a model failed after all attempts; details: task, attempts."""


class AnswerError(CallError):
    """An answer that is not the JSON asked for; details: answer."""
