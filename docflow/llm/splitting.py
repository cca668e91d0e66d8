"""Oversized items cut into pieces at natural boundaries, with overlap.

Agglomerative merging: a text is taken as atomic segments divided by boundaries of rising strength
(white space, clause, sentence, line, paragraph). Adjacent pairs lie in a heap, the weakest boundary
first, and are merged while their size plus the overlap fits. A span that fits as a whole is merged
fully before any stronger boundary comes up, so such spans enter the heap as one segment and only the
others are broken down; the outcome is the same.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from docflow.functions.media import essence
from docflow.functions.text import estimate_tokens

#: Code points a token of the default estimate.
CHARS_PER_TOKEN = 4
#: A table of limits above this many rows is refused: it is configuration, sent to every task.
MAX_LIMIT_ROWS = 10_000

# Boundaries from strong to weak; a match's end divides. The last resort keeps a letter with its accents.
_BOUNDARIES = [
    regex.compile(r"\n[^\S\n]*\n\s*"),
    regex.compile(r"\n(?=[ ]{0,3}#{1,6}[ \t])|(?<=\n)(?=[ ]{0,3}(?:```|~~~))|\n"),
    regex.compile(r"""[.!?…]+["'”’»)\]]*\s+|[。！？]+[”’」』]*"""),
    regex.compile(r"[;:,—–]\s+|[，、；：]"),
    regex.compile(r"\s+"),
    regex.compile(r"\X"),
]
_OVERLAP_START = regex.compile(r"(?<=\s)(?=\S)")

PIECE_FIELDS = [
    StructField("piece_no", IntegerType()),
    StructField("text", StringType()),
    StructField("start_byte", LongType()),
    StructField("end_byte", LongType()),
    StructField("token_count", IntegerType()),
]


def _atoms(text: str, start: int, end: int, level: int, room: int) -> Iterator[tuple[int, int, int]]:
    """Segments of at most ``room`` characters with the strength of the boundary before each."""
    if end - start <= room:
        yield start, end, level - 1
        return
    at, strength = start, level - 1
    cuts = [m.end() for m in _BOUNDARIES[level].finditer(text, start, end)]
    for cut in [*(c for c in cuts if c < end), end]:
        if cut == at:
            continue
        for k, (a, b, inner) in enumerate(_split_or_whole(text, at, cut, level, room)):
            yield a, b, strength if k == 0 else inner
        at, strength = cut, level


def _split_or_whole(text: str, start: int, end: int, level: int, room: int) -> Iterator[tuple[int, int, int]]:
    if end - start <= room or level + 1 == len(_BOUNDARIES):
        yield start, end, level
    else:
        yield from _atoms(text, start, end, level + 1, room)


def merge_segments(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int]]:
    """Spans covering ``text``, each with the overlap before it at most ``max_chars`` long.

    A cluster of one letter and its accents longer than the limit is cut inside: the limit comes first.
    """
    room = max_chars - overlap_chars
    atoms: list[tuple[int, int, int]] = []
    for a, b, level in _atoms(text, 0, len(text), 0, room):
        for at in range(a, b, room):
            atoms.append((at, min(b, at + room), level if at == a else len(_BOUNDARIES)))
    left = list(range(-1, len(atoms) - 1))
    right = [*range(1, len(atoms)), -1]
    begin, end = [a for a, _, _ in atoms], [b for _, b, _ in atoms]
    alive = [True] * len(atoms)
    # Of two boundaries of one kind that with the smaller neighbours goes first, then the earlier.
    heap = [(-atoms[k][2], end[k] - begin[k - 1], k, k - 1) for k in range(1, len(atoms))]
    heapq.heapify(heap)
    while heap:
        weak, size, k, j = heapq.heappop(heap)
        if not (alive[k] and alive[j]) or left[k] != j or size != end[k] - begin[j]:
            continue
        if size > (max_chars if begin[j] == 0 else room):
            continue
        end[j], alive[k] = end[k], False
        right[j] = right[k]
        if right[k] >= 0:
            n = right[k]
            left[n] = j
            heapq.heappush(heap, (-atoms[n][2], end[n] - begin[j], n, j))
        if left[j] >= 0:
            heapq.heappush(heap, (-atoms[j][2], end[j] - begin[left[j]], j, left[j]))
    return [(begin[k], end[k]) for k in range(len(atoms)) if alive[k]]


def split_text(text: str, max_tokens: int, overlap_tokens: int) -> list[tuple[int, int]]:
    """Spans of pieces within ``max_tokens``, in characters, the overlap included.

    The overlap goes back ``overlap_tokens``, from there to the next word's start if there is one before
    the cut. An overlap above half the limit counts as half, a limit below 1 as 1.
    """
    max_chars = max(max_tokens, 1) * CHARS_PER_TOKEN
    if len(text) <= max_chars:
        return [(0, len(text))] if text else []
    overlap = min(max(overlap_tokens, 0) * CHARS_PER_TOKEN, max_chars // 2)
    spans = []
    for a, b in merge_segments(text, max_chars, overlap):
        start = a
        if a and overlap:
            word = _OVERLAP_START.search(text, max(a - overlap, 0), a)
            start = word.start() if word else max(a - overlap, 0)
        spans.append((start, b))
    return spans


def pieces(text: str | None, base: int | None, max_tokens: int, overlap_tokens: int) -> list[tuple]:
    """Rows ``piece_no, text, start_byte, end_byte, token_count`` of one item.

    ``base`` is the item's own first byte; without it the pieces have no byte spans.
    """
    rows, char, byte = [], 0, 0
    for n, (a, b) in enumerate(split_text(text or "", max_tokens, overlap_tokens)):
        byte += len(text[char:a].encode()) if a >= char else -len(text[a:char].encode())
        char = a
        part = text[a:b]
        start = None if base is None else base + byte
        stop = None if base is None else start + len(part.encode())
        rows.append((n, part, start, stop, (len(part) + CHARS_PER_TOKEN - 1) // CHARS_PER_TOKEN))
    return rows


def _limits(chunk_limits: DataFrame) -> dict[str, tuple[int, int]]:
    rows = chunk_limits.select("media_type", "max_tokens", "overlap_tokens").limit(MAX_LIMIT_ROWS + 1).collect()
    if len(rows) > MAX_LIMIT_ROWS:
        raise ValueError(f"more than {MAX_LIMIT_ROWS} rows of limits")
    return {r.media_type: (r.max_tokens, r.overlap_tokens or 0) for r in rows if r.media_type and r.max_tokens}


def oversized(chunks: DataFrame, artifacts: DataFrame, chunk_limits: DataFrame) -> DataFrame:
    """Chunks over the limit of their artifact's media type: key, text, start_byte, the two limits.

    Chunks whose size is within the least of all limits leave before the join, so only the few others
    are shuffled with their texts. A repeated chunk counts once (of different rows under one key the
    smallest), as does an artifact; an unknown artifact or type has the limit of ``*``, and without that
    row no limit. Null texts are never over it.
    """
    limits = _limits(chunk_limits)
    schema = "artifact_id string, chunk_index int, text string, start_byte bigint, max_tokens int, overlap_tokens int"
    if not limits:
        return chunks.sparkSession.createDataFrame([], schema)
    least = min(m for m, _ in limits.values())
    big = (
        chunks.filter(estimate_tokens(F.col("text")) > least)
        .groupBy("artifact_id", "chunk_index")
        .agg(F.min(F.struct("start_byte", "text")).alias("row"))
    )
    types = (
        artifacts.filter(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("artifact_id"))
        .agg(F.min(essence(F.col("media_type"))).alias("media_type"))
    )
    of = F.create_map(*(F.lit(x) for k, (m, o) in limits.items() for x in (k, F.struct(F.lit(m), F.lit(o)))))
    chosen = F.coalesce(F.try_element_at(of, F.coalesce("media_type", F.lit("*"))), F.try_element_at(of, F.lit("*")))
    return (
        big.join(types, "artifact_id", "left")
        .select(
            "artifact_id",
            "chunk_index",
            "row.text",
            F.col("row.start_byte").cast("bigint").alias("start_byte"),
            chosen["col1"].alias("max_tokens"),
            chosen["col2"].alias("overlap_tokens"),
        )
        .filter(estimate_tokens(F.col("text")) > F.col("max_tokens"))
    )


def split_oversized(chunks: DataFrame, artifacts: DataFrame, chunk_limits: DataFrame) -> DataFrame:
    """The pieces of all oversized chunks: artifact_id, chunk_index and the piece's columns."""
    rows = oversized(chunks, artifacts, chunk_limits)
    keys = ["artifact_id", "chunk_index"]
    schema = StructType([*rows.select(*keys).schema.fields, *PIECE_FIELDS])

    def run(batches):
        for batch in batches:
            out = [
                (*(r[k] for k in keys), *piece)
                for r in batch.to_pylist()
                for piece in pieces(r["text"], r["start_byte"], r["max_tokens"], r["overlap_tokens"])
            ]
            columns = list(zip(*out)) or [()] * len(schema)
            types = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    return rows.mapInArrow(run, schema)
