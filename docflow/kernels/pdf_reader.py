"""A small PDF text reader for trusted documents: page tree, Flate streams, text-showing operators.

Fonts with their own encodings give the bytes as Latin-1; encrypted documents are refused.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_SHOW = re.compile(
    rb"(?P<str>\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>)|(?P<num>[-+]?\d*\.?\d+)|(?P<open>\[)|(?P<close>\])|(?P<op>[A-Za-z'\"*]+)", re.S
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
MAX_STREAM = 64 << 20


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:

        def unescape(m: re.Match) -> bytes:
            c = m[1]
            return bytes([int(c, 8) & 255]) if c[:1].isdigit() else _ESCAPES.get(c, b"" if c in b"\r\n" else c)

        data = re.sub(rb"\\([0-7]{1,3}|.)", unescape, raw[1:-1], flags=re.S)
    if data.startswith(b"\xfe\xff"):
        return data[2:].decode("utf-16-be", "replace")
    return data.decode("latin-1")


class _File:
    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("no PDF header")
        if b"/Encrypt" in data:
            raise ValueError("encrypted")
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        data = self.stream(body)
        n, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
        numbers = list(map(int, data[:first].split()))[: 2 * n]
        offsets = [*numbers[1::2], len(data) - first]
        for k, number in enumerate(numbers[0::2]):
            self.objects.setdefault(number, data[first + offsets[k] : first + offsets[k + 1]])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        if b"/FlateDecode" not in body[: m.start()]:
            return m[1]
        inflater = zlib.decompressobj()
        out = inflater.decompress(m[1], MAX_STREAM)
        if inflater.unconsumed_tail:
            raise ValueError("stream is over the limit")
        return out

    def pages(self) -> list[bytes]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        if root is None:
            raise ValueError("no catalog")
        found: list[bytes] = []
        stack, seen = [int(m[1]) for m in re.finditer(rb"/Pages\s+(\d+)\s+\d+\s+R", root)], set()
        while stack:
            number = stack.pop(0)
            body = self.objects.get(number)
            if body is None or number in seen:
                continue
            seen.add(number)
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids:
                stack = [int(m[1]) for m in _REF.finditer(kids[1])] + stack
            else:
                found.append(body)
        return found

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        return b"\n".join(self.stream(self.objects.get(int(r[1]), b"")) for r in _REF.finditer(m[1])) if m else b""


def _text(content: bytes) -> str:
    out: list[str] = []
    strings: list[str] = []
    numbers: list[float] = []
    inside = False
    for m in _SHOW.finditer(content):
        if m["str"]:
            strings.append(_string(m["str"]))
        elif m["num"]:
            if inside and float(m["num"]) < -200 and strings:
                strings.append(" ")
            numbers.append(float(m["num"]))
        elif m["open"] or m["close"]:
            inside = bool(m["open"])
        else:
            op = m["op"]
            if op in (b"'", b'"'):
                out.append("\n")
            if op in (b"Tj", b"TJ", b"'", b'"'):
                out += strings
            elif op == b"T*" or op in (b"Td", b"TD") and len(numbers) >= 2 and numbers[-1] != 0:
                out.append("\n")
            elif op in (b"Td", b"TD", b"ET"):
                out.append(" " if op != b"ET" else "\n")
            strings, numbers = [], []
    return "".join(out)


def read_pages(data: bytes) -> list[tuple[int, str]]:
    """Number and text of every page that has text; an unreadable page is left out."""
    file = _File(data)
    out = []
    for number, page in enumerate(file.pages(), 1):
        try:
            text = _text(file.content(page))
        except (ValueError, zlib.error):
            continue
        if text.strip():
            out.append((number, text))
    return out
