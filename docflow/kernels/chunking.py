"""Splitting one text into chunks under a token budget, with byte-exact spans.

A segmentation (paragraphs, headings, the caller's own units) gives byte spans; consecutive spans are packed up
to the budget, trailing ones are taken again as overlap. A span that is over the budget by itself is cut: at
lines around fenced code, else at sentences, words or runes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

from docflow.kernels.text_norm import WHITE_SPACE
from docflow.kernels.utf8 import aligned, estimate, rune_ceil, rune_floor

DEFAULT_MAX_TOKENS = 512
DEFAULT_OVERLAP_TOKENS = 64

Span = tuple[int, int]
Boundaries = Callable[[bytes], list[Span]]

# UTF-8 encodings of Unicode's White_Space.
_SPACE = rb"[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_SPACES = re.compile(_SPACE)
_PARAGRAPH_END = re.compile(rb"\n(?:\r?\n)+")
_LINE = re.compile(rb"[^\n]*\n|[^\n]+\Z")
_FENCE = re.compile(rb" {0,3}(?P<run>`{3,}|~{3,})(?P<info>.*)\Z", re.S)
_ATX = re.compile(rb" {0,3}(#{1,6})(?:[ \t]|\Z)")
_SETEXT = re.compile(rb" {0,3}(?:=+|-+)[ \t]*\Z")


class Chunk(NamedTuple):
    chunk_index: int
    text: str
    start_byte: int
    end_byte: int
    token_count: int


@dataclass(frozen=True)
class ChunkConfig:
    """Budget and overlap in tokens; values of 0 or less mean the defaults, ``no_overlap`` wins."""

    max_tokens: int = 0
    overlap_tokens: int = 0
    no_overlap: bool = False
    boundaries: Boundaries | None = None
    estimate: Callable[[bytes], int] = estimate

    @property
    def budget(self) -> int:
        return self.max_tokens if self.max_tokens > 0 else DEFAULT_MAX_TOKENS

    @property
    def overlap(self) -> int:
        if self.no_overlap:
            return 0
        return self.overlap_tokens if self.overlap_tokens > 0 else DEFAULT_OVERLAP_TOKENS


class Fence(NamedTuple):
    char: int
    length: int
    info: bool


def fence_of(line: bytes) -> Fence | None:
    """The fence a line is made of, if it is one. A back-tick fence has no back-tick after its run."""
    m = _FENCE.match(line)
    if not m or (m["run"][0] == 0x60 and b"`" in m["info"]):
        return None
    return Fence(m["run"][0], len(m["run"]), bool(m["info"].strip(b" \t\r")))


def closes(line: bytes, opened: Fence) -> bool:
    f = fence_of(line)
    return f is not None and f.char == opened.char and f.length >= opened.length and not f.info


def atx_level(line: bytes) -> int:
    m = _ATX.match(line)
    return len(m[1]) if m else 0


def is_setext(line: bytes) -> bool:
    return _SETEXT.match(line) is not None


def lines(data: bytes, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
    """Start, next start and content (no line end) of each line of a span."""
    for m in _LINE.finditer(data, start, end):
        content = m[0][:-1] if m[0].endswith(b"\n") else m[0]
        yield m.start(), m.end(), content[:-1] if content.endswith(b"\r") else content


def paragraphs(data: bytes) -> list[Span]:
    """Spans that end after a run of at least two line ends and cover the text."""
    ends = [m.end() for m in _PARAGRAPH_END.finditer(data)]
    if data and (not ends or ends[-1] < len(data)):
        ends.append(len(data))
    return list(zip([0, *ends], ends))


def headings(data: bytes) -> list[Span]:
    """Sections by ATX and setext headings outside fences, what comes before the first being one of its own;
    paragraphs where there is no heading."""
    starts: list[int] = []
    opened: Fence | None = None
    paragraph: int | None = None
    for at, _, line in lines(data, 0, len(data)):
        if opened:
            opened = None if closes(line, opened) else opened
            paragraph = None
            continue
        new = None
        opened = fence_of(line)
        if opened is None:
            if atx_level(line):
                new = at
            elif paragraph is not None and is_setext(line):
                new = paragraph
        paragraph = at if opened is None and new is None and _SPACES.sub(b"", line) else None
        if new is not None and (not starts or starts[-1] != new):
            starts.append(new)
    if not starts:
        return paragraphs(data)
    marks = starts if starts[0] == 0 else [0, *starts]
    return list(zip(marks, [*marks[1:], len(data)]))


BOUNDARIES: dict[str, Boundaries] = {"paragraphs": paragraphs, "headings": headings}


def valid_spans(data: bytes, spans: list[Span]) -> bool:
    """In range, in order, not empty, not overlapping, on rune starts; gaps are allowed."""
    last = 0
    for a, b in spans:
        if not last <= a < b <= len(data) or not (aligned(data, a) and aligned(data, b)):
            return False
        last = b
    return bool(spans)


def packed(tokens: list[int], budget: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """Runs ``(first, last, tokens)`` of consecutive parts within the budget; a part over it comes alone with
    the tokens -1. Each run takes again the trailing parts of the one before that fit in the overlap."""
    i = 0
    while i < len(tokens):
        if tokens[i] > budget:
            yield i, i, -1
            i += 1
            continue
        j, total = i, tokens[i]
        while j + 1 < len(tokens) and total + tokens[j + 1] <= budget:
            j += 1
            total += tokens[j]
        yield i, j, total
        if j == len(tokens) - 1:
            return
        back, again = j + 1, 0
        while overlap > 0 and back - 1 > i and again + tokens[back - 1] <= overlap:
            back -= 1
            again += tokens[back]
        i = back


def _cut(data: bytes, start: int, ideal: int) -> int:
    """Where to end a piece that should end at ``ideal``: after a sentence or before white space in the last
    quarter, else there."""
    low = ideal - (ideal - start) // 4
    sentence = max(data.rfind(mark, low, ideal) for mark in (b". ", b"! ", b"? "))
    if sentence >= 0:
        return sentence + 1
    space = -1
    for m in _SPACES.finditer(data, low, ideal):
        space = m.start()
    return space if space >= 0 else ideal


def prose_cuts(data: bytes, start: int, end: int, cfg: ChunkConfig) -> Iterator[tuple[int, int, int]]:
    """Pieces ``(start, end, tokens)`` of a span without fences; budgets become bytes by the span's own ratio."""
    ratio = float(end - start) / float(max(cfg.estimate(data[start:end]), 1))
    window, overlap = max(int(float(cfg.budget) * ratio), 1), max(int(float(cfg.overlap) * ratio), 0)
    at = start
    while at < end:
        stop = end if at + window >= end else _cut(data, at, at + window)
        stop = rune_floor(data, stop, at)
        if stop <= at:
            stop = rune_ceil(data, at + 1)
        yield at, stop, cfg.estimate(data[at:stop])
        if stop >= end:
            return
        at = rune_ceil(data, max(stop - overlap, at + 1))


def fenced_regions(data: bytes, start: int, end: int) -> list[tuple[int, int, bool]]:
    """A region for each fenced block, from its opening line through its closing one or the end, and for each
    other line."""
    regions: list[tuple[int, int, bool]] = []
    opened: Fence | None = None
    for a, b, line in lines(data, start, end):
        if opened:
            regions[-1] = (regions[-1][0], b, True)
            opened = None if closes(line, opened) else opened
        else:
            opened = fence_of(line)
            regions.append((a, b, opened is not None))
    return regions


def _pack_parts(data: bytes, parts: list[tuple[int, int, bool]], cfg: ChunkConfig) -> Iterator[tuple[int, int, int]]:
    tokens = [cfg.estimate(data[a:b]) for a, b, _ in parts]
    for i, j, total in packed(tokens, cfg.budget, cfg.overlap):
        a, b, fenced = parts[i]
        if total >= 0:
            yield a, parts[j][1], total
        elif fenced:
            yield from _pack_parts(data, [(x, y, False) for x, y, _ in lines(data, a, b)], cfg)
        else:
            yield from prose_cuts(data, a, b, cfg)


def hard_cuts(data: bytes, start: int, end: int, cfg: ChunkConfig) -> Iterator[tuple[int, int, int]]:
    """Pieces of a span that is over the budget."""
    if any(fence_of(line) for _, _, line in lines(data, start, end)):
        yield from _pack_parts(data, fenced_regions(data, start, end), cfg)
    else:
        yield from prose_cuts(data, start, end, cfg)


def split(text: str | None, cfg: ChunkConfig | None = None, units: list[Span] | None = None) -> list[Chunk]:
    """The chunks of ``text``; none of a null or blank one. Spans are bytes of ``text`` as given.

    ``units`` (byte spans of the trimmed text) or ``cfg.boundaries`` segment it; a segmentation that isn't
    valid counts as one unit.
    """
    cfg = cfg or ChunkConfig()
    text = text or ""
    body = text.lstrip(WHITE_SPACE)
    off = len(text[: len(text) - len(body)].encode("utf-8"))
    data = body.rstrip(WHITE_SPACE).encode("utf-8", "surrogatepass")
    if not data:
        return []
    spans = units if units is not None else (cfg.boundaries or paragraphs)(data)
    if not valid_spans(data, spans):
        spans = [(0, len(data))]
    tokens = [cfg.estimate(data[a:b]) for a, b in spans]
    found: list[tuple[int, int, int]] = []
    for i, j, total in packed(tokens, cfg.budget, cfg.overlap):
        if total >= 0:
            found.append((spans[i][0], spans[j][1], total))
        else:
            found += hard_cuts(data, *spans[i], cfg)
    return [Chunk(k, data[a:b].decode("utf-8", "surrogatepass"), a + off, b + off, n) for k, (a, b, n) in enumerate(found)]
