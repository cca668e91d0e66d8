"""What the first bytes of a rendered page say about it."""

from __future__ import annotations

import struct

# Limits and defaults of rendering.
MAX_PAGES, MAX_PIXELS = 40_000, 16_384
DEFAULT_DPI, DEFAULT_PIXELS, DEFAULT_QUALITY = 150.0, 2048, 85
FORMATS = {0: ("png", "image/png"), 1: ("jpeg", "image/jpeg")}
_PNG = b"\x89PNG\r\n\x1a\n"
_SIZED = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}


def header(data: bytes) -> tuple[str, int, int]:
    """Format, width and height of a PNG or JPEG image."""
    if data.startswith(_PNG) and data[12:16] == b"IHDR" and len(data) >= 24:
        return ("png", *struct.unpack(">II", data[16:24]))
    if data.startswith(b"\xff\xd8"):
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker in _SIZED and at + 9 <= len(data):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return "jpeg", width, height
            at += 2 if marker == 0x01 or 0xD0 <= marker <= 0xD8 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise ValueError("neither PNG nor JPEG")


def check_header(data: bytes, kind: str, width: int, height: int, most: int) -> tuple[int, int]:
    """The image's size, which may differ by one pixel from the expected one and not be over ``most``."""
    found, w, h = header(data)
    if found != kind:
        raise ValueError(f"{found} instead of {kind}")
    if abs(w - width) > 1 or abs(h - height) > 1 or w < 1 or h < 1 or max(w, h) > most:
        raise ValueError(f"{w} x {h} pixels instead of {width} x {height}")
    return w, h
