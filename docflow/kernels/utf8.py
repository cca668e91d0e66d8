"""Bytes and text: lossy decoding and positions in UTF-8."""

from __future__ import annotations

import re

_BAD = re.compile("[\udc80-\udcff]+")


def decode_lossy(data: bytes) -> str:
    """Text of ``data``; each run of bytes that aren't UTF-8 becomes one U+FFFD."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return _BAD.sub("�", data.decode("utf-8", "surrogateescape"))


def estimate(data: bytes) -> int:
    """Default size of UTF-8 bytes: code points divided by four, rounded up."""
    return (len(data.decode("utf-8", "surrogateescape")) + 3) // 4


def rune_floor(data: bytes, at: int, low: int) -> int:
    """The last rune start at or before ``at``, not below ``low``."""
    while low < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def rune_ceil(data: bytes, at: int) -> int:
    """The first rune start at or after ``at``."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def aligned(data: bytes, at: int) -> bool:
    return at == len(data) or data[at] & 0xC0 != 0x80
