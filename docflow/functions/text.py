"""Text expressions: token estimate, Unicode trimming, white-space normalisation, front matter, hashes.

All are built from JVM-side functions, so that they stay in whole-stage code generation and below
Python operators in the plan. Null inputs give null unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Unicode's White_Space as a Java character class.
WHITE_SPACE = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def estimate_tokens(text: Column) -> Column:
    """Default size of a text: code points divided by four, rounded up; 0 for an empty text."""
    return ((F.char_length(text) + 3) / 4).cast("int")


def utrim(text: Column) -> Column:
    """``text`` without white space (Unicode White_Space) at both ends.

    The lookbehind lets a run of white space within the text be tried once, at its start, and not at each place.
    """
    return F.regexp_replace(text, rf"\A{WHITE_SPACE}++|(?<!{WHITE_SPACE}){WHITE_SPACE}++\z", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only texts."""
    return F.coalesce(~text.rlike(rf"[^{WHITE_SPACE[1:]}"), F.lit(True))


def normalize_whitespace(text: Column) -> Column:
    """Lines trimmed, runs of blank lines made one, the whole trimmed.

    Lines are only ever separated by white space that holds a line end, so a run of white space with one line end
    becomes that one and a run with more becomes two: one pass over the text.
    """
    inline = WHITE_SPACE.replace(r"\x{9}-\x{d}", r"\x{9}\x{b}-\x{d}")
    runs = rf"(?<!{inline}){inline}*+(\n){inline}*+(?:(\n){WHITE_SPACE}*+)?"
    return utrim(F.regexp_replace(text, runs, "$1$2"))


def strip_bom(text: Column) -> Column:
    """``text`` without one leading U+FEFF."""
    return F.regexp_replace(text, r"\A\x{FEFF}", "")


def strip_front_matter(text: Column) -> Column:
    """``text`` without the ``---`` or ``+++`` block that opens it, if the block is closed."""
    block = r"\A(---|\+\+\+)[ \t\r]*\n(?s:.*?\n)??\1[ \t\r]*(?:\n|\z)"
    return F.regexp_replace(text, block, "")


def sha256_hex(value: Column) -> Column:
    """Lower-case SHA-256 of a string's UTF-8 bytes or of binary data."""
    return F.sha2(value.cast("binary"), 256)


def request_id(pos: Column) -> Column:
    """The id of an embedding request's input."""
    return F.concat(F.lit("in-"), pos.cast("string"))
