"""Pages of PDF documents: word tables, geometry and assembled text."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from statistics import median

# Limits and the header of the word table.
MAX_LINE = 1 << 20
MAX_GAP_SPACES = 32
TSV_HEADER = "level page_num par_num block_num line_num word_num left top width height conf text".split()
_PAGE_LEVEL, _WORD_LEVEL = 1, 5


def round_half_away(x: float) -> int:
    """Nearest integer of a finite number, halves away from zero."""
    return int(Decimal(x).to_integral_value(ROUND_HALF_UP))


def clamp_conf(conf: float) -> int:
    """-1 for negative confidences, at most 100, else rounded."""
    return -1 if conf < 0 else 100 if conf > 100 else round_half_away(conf)


def split_pages(text: str) -> list[tuple[int, str]]:
    """Pages by form feeds, numbered from 1; one empty page at the end isn't one, others keep their place."""
    pages = text.split("\f")
    if pages[-1] == "":
        pages.pop()
    return list(enumerate(pages, 1))


def _integer(value: str, name: str) -> int:
    if not re.fullmatch(r"[+-]?[0-9]+", value):
        raise ValueError(f"bad {name} {value!r}")
    return int(value)


def _finite(value: str, name: str) -> float:
    try:
        number = float(value) if "_" not in value and value == value.strip() else math.nan
    except ValueError:
        number = math.nan
    if not math.isfinite(number):
        raise ValueError(f"bad {name} {value!r}")
    return number


def parse_tsv(output: str) -> list[tuple[int, list[dict]]]:
    """Words of each page of a word table. Whatever can't be trusted is an error.

    Blocks and lines are numbered within a page by their first appearance.
    """
    lines = output.split("\n")
    if lines[-1] == "":
        lines.pop()
    lines = [ln.removesuffix("\r") for ln in lines]
    if not lines:
        raise ValueError("tsv: empty output")
    if any(len(ln.encode()) >= MAX_LINE for ln in lines):
        raise ValueError(f"tsv: line longer than {MAX_LINE} bytes")
    if lines[0] != "\t".join(TSV_HEADER):
        raise ValueError(f"tsv: unexpected header {lines[0]!r}")
    pages: list[tuple[int, list[dict]]] = []
    blocks: dict[tuple, int] = {}
    rows: dict[tuple, int] = {}
    for number, line in enumerate(lines[1:], 2):
        fields = line.split("\t", len(TSV_HEADER) - 1)
        if len(fields) != len(TSV_HEADER):
            raise ValueError(f"tsv line {number}: {len(fields)} fields")
        level, page, par, block, row, _ = (_integer(v, n) for v, n in zip(fields, TSV_HEADER[:6]))
        left, top, width, height, conf = (_finite(v, n) for v, n in zip(fields[6:11], TSV_HEADER[6:11]))
        if not 1 <= level <= 5:
            raise ValueError(f"tsv line {number}: unknown level {level}")
        if width < 0 or height < 0:
            raise ValueError(f"tsv line {number}: negative size")
        right, bottom = left + width, top + height
        if math.isinf(right) or math.isinf(bottom):
            raise ValueError(f"tsv line {number}: box overflows")
        if level == _PAGE_LEVEL:
            if page != len(pages) + 1:
                raise ValueError(f"tsv line {number}: page {page} out of order")
            pages.append((page, []))
            blocks, rows = {}, {}
        elif level == _WORD_LEVEL:
            if not pages or page != pages[-1][0]:
                raise ValueError(f"tsv line {number}: word outside its page")
            pages[-1][1].append(
                {
                    "text": fields[11],
                    "box": {"x0": left, "y0": top, "x1": right, "y1": bottom},
                    "block": blocks.setdefault((par, block), len(blocks)),
                    "line": rows.setdefault((par, block, row), len(rows)),
                    "conf": clamp_conf(conf),
                }
            )
    return pages


# -- geometry ------------------------------------------------------------------------------------------

_PAGES_LINE = re.compile(r"Pages:\s+(\d+)\s*\Z", re.A)
_ROW = re.compile(r"Page\s+(\d+)\s+(rot|CropBox):\s+(.*?)\s*\Z", re.A)


def parse_rotation(value: str) -> int:
    turn = _integer(value, "rotation")
    if turn % 90:
        raise ValueError(f"rotation {turn} isn't a multiple of 90")
    return turn % 360


def parse_box(value: str) -> tuple[float, float]:
    fields = value.split()
    if len(fields) != 4:
        raise ValueError(f"bad box {value!r}")
    x0, y0, x1, y1 = (_finite(f, "box") for f in fields)
    size = abs(x1 - x0), abs(y1 - y0)
    if not all(0 < s < math.inf for s in size):
        raise ValueError(f"bad box {value!r}")
    return size


def parse_geometry(output: str, first: int, last: int) -> tuple[int, list[dict]]:
    """Number of pages and the displayed size and rotation of pages ``first`` to ``last``.

    A missing, repeated or unreadable line is an error, as document titles may imitate the lines.
    """
    total: int | None = None
    seen: dict[tuple[int, str], object] = {}
    for line in output.split("\n"):
        if m := _PAGES_LINE.match(line):
            if total is not None:
                raise ValueError("more than one Pages line")
            total = int(m[1])
        elif m := _ROW.match(line):
            key = int(m[1]), m[2]
            if key in seen:
                raise ValueError(f"more than one {m[2]} line of page {m[1]}")
            seen[key] = parse_rotation(m[3]) if m[2] == "rot" else parse_box(m[3])
    if total is None:
        raise ValueError("no Pages line")
    wanted = range(first, min(last, total) + 1)
    if {n for n, _ in seen} != set(wanted):
        raise ValueError(f"pages {sorted({n for n, _ in seen})}, wanted {first} to {min(last, total)} of {total}")
    pages = []
    for n in wanted:
        turn, size = seen.get((n, "rot")), seen.get((n, "CropBox"))
        if turn is None or size is None:
            raise ValueError(f"page {n} has no size or rotation")
        width, height = size if turn in (0, 180) else size[::-1]
        pages.append({"number": n, "width": width, "height": height, "rotation": turn})
    return total, pages


# -- assembly ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class AssembleOptions:
    """Overlap that puts words on one row (over 0, at most 1) and the widest gap in spaces (1 to 32)."""

    row_overlap: float = 0.5
    max_gap_spaces: int = 8

    def __post_init__(self) -> None:
        overlap = self.row_overlap
        if math.isnan(overlap) or overlap <= 0:
            overlap = 0.5 if math.isnan(overlap) else math.ulp(0.0)
        object.__setattr__(self, "row_overlap", min(overlap, 1.0))
        object.__setattr__(self, "max_gap_spaces", min(max(self.max_gap_spaces, 1), MAX_GAP_SPACES))


class _Writer:
    """Text of words with separators that are written only between words that aren't empty."""

    def __init__(self, n: int) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.owed = ""
        self.spans: list[dict] = [{"start": 0, "end": 0} for _ in range(n)]

    def owe(self, separator: str) -> None:
        """Of several separators that are owed the one with more line ends stays, then the longer."""
        self.owed = max(self.owed, separator, key=lambda s: (s.count("\n"), len(s)))

    def put(self, index: int, text: str) -> None:
        if text:
            if self.size:
                self.parts.append(self.owed)
                self.size += len(self.owed.encode())
            self.owed = ""
        start = self.size
        if text:
            self.parts.append(text)
            self.size += len(text.encode("utf-8", "surrogatepass"))
        self.spans[index] = {"start": start, "end": self.size}

    def page(self) -> tuple[str, list[dict]]:
        return "".join(self.parts), self.spans


def assemble_reading_order(words: list[dict]) -> tuple[str, list[dict]]:
    """Words in the engine's order: a blank between words, a line end between lines, a blank line between blocks."""
    out = _Writer(len(words))
    for k, w in enumerate(words):
        if k:
            before = words[k - 1]
            out.owe("\n\n" if w["block"] != before["block"] else "\n" if w["line"] != before["line"] else " ")
        out.put(k, w["text"])
    return out.page()


def finite(x: float) -> float:
    """0 for no number."""
    return 0.0 if math.isnan(x) else x


def char_unit(words: list[dict]) -> float:
    """Median width of a character of a row's words, at least one point."""
    widths = ((finite(w["box"]["x1"]) - finite(w["box"]["x0"]), len(w["text"])) for w in words if w["text"])
    usable = [x / n for x, n in widths if 0 < x < math.inf]
    return max(median(usable), 1.0) if usable else 1.0


def gap_spaces(gap: float, unit: float, most: int) -> int:
    ratio = gap / unit
    if math.isnan(ratio):
        return 1
    return most if ratio >= most else 1 if ratio <= 1 else min(max(round_half_away(ratio), 1), most)


def assemble_rows(words: list[dict], options: AssembleOptions = AssembleOptions()) -> tuple[str, list[dict]]:
    """Words by rows from top to bottom, gaps within a row as blanks in proportion.

    From the top down, a word joins the latest row if they overlap by enough of the shorter one's height; the
    row then reaches as far as the word.
    """
    boxes = [_extent(w["box"]) for w in words]
    out = _Writer(len(words))
    for r, row in enumerate(rows_of(boxes, options.row_overlap)):
        # A page's rows may be set in different sizes, so each has its own unit.
        unit = char_unit([words[k] for k in row])
        end = None
        if r:
            out.owe("\n")
        for k in row:
            text = words[k]["text"]
            if text and end is not None:
                out.owe(" " * gap_spaces(boxes[k][0] - end, unit, options.max_gap_spaces))
            out.put(k, text)
            if text:
                end = boxes[k][2]
    return out.page()


def units_of(words: list[dict], options: AssembleOptions = AssembleOptions()) -> list[float]:
    """The width of a character of each row."""
    rows = rows_of([_extent(w["box"]) for w in words], options.row_overlap)
    return [char_unit([words[k] for k in row]) for row in rows]


def _extent(b: dict) -> tuple[float, float, float, float, float]:
    y0, y1 = finite(b["y0"]), finite(b["y1"])
    return finite(b["x0"]), min(y0, y1), finite(b["x1"]), max(y0, y1), y0


def rows_of(boxes: list[tuple[float, float, float, float, float]], least: float) -> list[list[int]]:
    """Places of the words of each row, rows from the top, words from the left."""
    rows: list[list[int]] = []
    top = bottom = 0.0
    for k in sorted(range(len(boxes)), key=lambda k: boxes[k][4]):
        _, a, _, b, _ = boxes[k]
        overlap = min(bottom, b) - max(top, a)
        if rows and overlap >= 0 and overlap >= least * min(bottom - top, b - a):
            rows[-1].append(k)
            top, bottom = min(top, a), max(bottom, b)
        else:
            rows.append([k])
            top, bottom = a, b
    return [sorted(row, key=lambda k: boxes[k][0]) for row in rows]
