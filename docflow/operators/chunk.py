"""Chunking as a DataFrame operator: one Arrow pass, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docflow.functions.text import estimate_tokens
from docflow.kernels.chunking import BOUNDARIES, Chunk, ChunkConfig, split
from docflow.kernels.utf8 import estimate as default_estimate

CHUNK_COLUMNS = "chunk_index int, text string, start_byte int, end_byte int, token_count int"
_UNITS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def segments(df: DataFrame, key: list[str], text: str = "text", boundaries: str | Callable[[bytes], list[tuple[int, int]]] = "paragraphs") -> DataFrame:
    """``key, unit, start, end``: byte spans of each text's units; none of a null or empty text."""
    cut = BOUNDARIES[boundaries] if isinstance(boundaries, str) else boundaries
    kept = [F.col(c).alias(f"__{k}") for k, c in enumerate(key)]
    inner = df.select(*kept, F.col(text).alias("__text"))
    numbers = [StructField(c, IntegerType()) for c in ("unit", "start", "end")]
    schema = StructType([*inner.drop("__text").schema.fields, *numbers])

    def run(batches):
        for batch in batches:
            rows = [(i, k, a, b) for i, t in enumerate(batch.column("__text").to_pylist()) for k, (a, b) in enumerate(cut((t or "").encode("utf-8", "surrogatepass")))]
            at, *found = zip(*rows) if rows else [()] * 4
            keys = [batch.column(f"__{k}").take(pa.array(at, pa.int64())) for k in range(len(key))]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(c, pa.int32()) for c in found)], names=schema.names)

    return inner.mapInArrow(run, schema).toDF(*key, "unit", "start", "end")


def line_marks(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """``key, n, atx, setext, fence`` of every line that may be a heading, an underline or a fence; in the JVM."""
    lines = df.select(*key, F.posexplode(F.split(text, r"\r?\n", -1)).alias("n", "line"))
    tick = "`"
    level = F.char_length(F.regexp_extract("line", r"\A {0,3}(#{1,6})(?:[ \t]|\z)", 1))
    return lines.select(
        *key, "n", level.alias("atx"), F.col("line").rlike(r"\A {0,3}(?:=+|-+)[ \t]*\z").alias("setext"),
        F.col("line").rlike(rf"\A {{0,3}}(?:{tick}{{3,}}[^{tick}]*\z|~{{3,}})").alias("fence"),
    ).filter("atx > 0 or setext or fence")


def integrity(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """``artifact_id, chunk_index, same``: whether each chunk's text is what its span of the artifact holds.

    Only chunks whose artifact (``id, text``) is there; a null span, or one outside of the text, isn't the same.
    """
    whole = texts.select(F.col("id").alias("artifact_id"), F.col("text").cast("binary").alias("__whole"))
    part = F.substring("__whole", F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte"))
    same = F.coalesce(part == F.col("text").cast("binary"), F.lit(False))
    return chunks.join(whole, "artifact_id").select("artifact_id", "chunk_index", same.alias("same"))


def chunk(
    df: DataFrame,
    key: list[str],
    text: str = "text",
    *,
    max_tokens: int = 0,
    overlap_tokens: int = 0,
    no_overlap: bool = False,
    boundaries: str | Callable[[bytes], list[tuple[int, int]]] = "paragraphs",
    units: str | None = None,
    estimate: Callable[[bytes], int] = default_estimate,
) -> DataFrame:
    """``key`` and the chunks' columns; blank and null texts have none.

    ``estimate`` gives the size in tokens of UTF-8 bytes, wherever one is needed.

    ``boundaries`` names a segmentation or is one; ``units`` names a column of byte spans (start, end) of the
    trimmed text, where the caller has its own, such as pages or turns. Wrong names fail at once, on the driver.
    """
    cut = BOUNDARIES[boundaries] if isinstance(boundaries, str) else boundaries
    cfg = ChunkConfig(max_tokens, overlap_tokens, no_overlap, cut, estimate)
    # The key may clash with the chunks' columns; its columns travel under other names.
    kept = [F.col(c).alias(f"__{k}") for k, c in enumerate(key)]
    inner = df.select(*kept, F.col(text).alias("__text"), *([F.col(units).alias("__units")] if units else []))
    chunk_schema = StructType.fromDDL(CHUNK_COLUMNS)
    schema = StructType([*inner.drop("__text", "__units").schema.fields, *chunk_schema.fields])

    def run(batches):
        types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            spans = batch.column("__units").to_pylist() if units else [None] * len(texts)
            rows: list[int] = []
            chunks: list[Chunk] = []
            for i, (t, u) in enumerate(zip(texts, spans)):
                found = split(t, cfg, None if u is None else [(x["start"], x["end"]) for x in u])
                rows += [i] * len(found)
                chunks += found
            at = pa.array(rows, pa.int64())
            columns = [pa.array(c, ty) for c, ty in zip(zip(*chunks) if chunks else [()] * 5, types)]
            keys = [batch.column(f"__{k}").take(at) for k in range(len(key))]
            yield pa.RecordBatch.from_arrays([*keys, *columns], names=schema.names)

    return inner.mapInArrow(run, schema).toDF(*key, *chunk_schema.names)


def turn_units(df: DataFrame, key: str | list[str], order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """``key, text, units``: pieces (pages, turns) put together in order, with their byte spans as units.

    Pieces are gathered by key, so a key's pieces should be one document's; empty pieces make no unit.
    """
    keys = [key] if isinstance(key, str) else key
    piece = F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("__p")).select(*keys, F.col("__p.t").alias("__p"))
    schema = StructType([*lists.drop("__p").schema.fields, StructField("text", StringType()), StructField("units", _UNITS)])
    gap = len(separator.encode())

    def run(batches):
        for batch in batches:
            texts, units = [], []
            for pieces in batch.column("__p").to_pylist():
                texts.append(separator.join(pieces))
                sizes = [len(p.encode("utf-8", "surrogatepass")) for p in pieces]
                starts = accumulate((n + gap for n in sizes), initial=0)
                units.append([{"start": a, "end": a + n} for a, n in zip(starts, sizes) if n])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(texts, pa.string()), pa.array(units, kind)], names=schema.names)

    return lists.mapInArrow(run, schema)


def small_chunks(df: DataFrame, text: str = "text", max_tokens: int = 512) -> DataFrame:
    """Texts that are one chunk by their size alone."""
    return df.filter(estimate_tokens(F.col(text)).between(1, max_tokens))
