"""Failures as typed values: codes of row errors and the exceptions behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of the ``error struct<code, message>`` column; null means success.
CODES = frozenset(
    """MISSING_ID MISSING_MEDIA_TYPE MISSING_PARENT UNSUPPORTED_MEDIA_TYPE INVALID_MEDIA_TYPE NO_CONTENT MISSING_PARENT_ID
    SOURCE_TOO_LARGE MALFORMED_SOURCE NO_TEXT_ARTIFACT MULTIPLE_TEXT_ARTIFACTS NO_ENGINE ENGINE_CRASHED ENGINE_UNAVAILABLE
    OUTPUT_TOO_LARGE PAGE_OUT_OF_RANGE INVALID_OPTIONS EMBED_MISSING_ARTIFACT_ID EMBED_MISSING_SOURCE_ID EMBED_EMPTY_TEXT
    EMBED_NEGATIVE_INDEX EMBED_RESPONSE_MISMATCH OBJECT_NOT_FOUND RANGE_NOT_SATISFIABLE INVALID_ARGUMENT ENGINE_FAILED""".split()
)


class DocflowError(Exception):
    """A row's failure, with its code."""

    def __init__(self, code: str, message: str = ""):
        if code not in CODES:
            raise ValueError(f"unknown code {code}")
        super().__init__(message or code)
        self.code, self.message = code, message or code

    @property
    def is_malformed(self) -> bool:
        return self.code in ("MALFORMED_SOURCE", "ENGINE_CRASHED")

    def __reduce__(self):
        return DocflowError, (self.code, self.message)


def malformed(media_type: str, cause: object) -> DocflowError:
    return DocflowError("MALFORMED_SOURCE", f"{media_type}: {cause}")


def error_column(*cases: tuple[Column, str]) -> Column:
    """The code of the first condition that holds, else null; a null condition doesn't hold."""
    out = F.lit(None).cast("string")
    for condition, code in reversed(cases):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(code)).otherwise(out)
    return out
