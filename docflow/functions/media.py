"""Media types: canonical form and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docflow.functions.text import WHITE_SPACE, utrim

# RFC 2045 token, type or type/subtype, then well-formed parameters.
_TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
_PARAMETER = rf"""{WHITE_SPACE}*;{WHITE_SPACE}*{_TOKEN}=(?:{_TOKEN}|"(?:[^"\\\r\n]|\\.)*"){WHITE_SPACE}*"""
_VALID = rf"\A{_TOKEN}(?:/{_TOKEN})?{WHITE_SPACE}*(?:{_PARAMETER})*(?:;{WHITE_SPACE}*)?\z"


def essence(media_type: Column) -> Column:
    """Type and subtype in lower case, without parameters and outer blanks; no validation."""
    return F.lower(utrim(F.substring_index(media_type, ";", 1)))


def is_valid(media_type: Column) -> Column:
    """Whether the type parses; false for null and for an empty type."""
    return F.coalesce(utrim(media_type).rlike(_VALID), F.lit(False))


def canonical(media_type: Column) -> Column:
    """The canonical type, or null where the type does not parse."""
    return F.when(is_valid(media_type), essence(media_type))
