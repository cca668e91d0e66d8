"""Encoding texts with a public tokenizer, by a local rank file.

The vocabulary is a tiktoken rank file (``base64(bytes) rank`` a line) at a path that is a parameter and
that every executor can read. Long texts are cut at places where the pre-tokenizer always ends a token,
so that the pieces' ids, put one after another, are the ids of the whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Where the public vocabulary files lie on this installation; every function takes another path.
RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer of the public byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts above this many characters are encoded in pieces of about this size.
PIECE_CHARS = 1 << 16

# A token always ends before white space that follows another character, between letters and digits,
# and between a letter or digit and a mark. Where white space itself is longer than one character only
# its beginning is safe, as the last blank joins the following word.
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])")


@lru_cache(maxsize=4)
def encoder(rank_file: str):
    """The tokenizer of a rank file, once a process."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut at safe places, each piece as long as ``size`` or up to the next safe place."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str | None, rank_file: str = RANK_FILE, size: int = PIECE_CHARS) -> list[int]:
    """Ids without special tokens; none for an empty or null text."""
    if not text:
        return []
    ordinary = encoder(rank_file).encode_ordinary
    if len(text) <= size:
        return ordinary(text)
    return list(chain.from_iterable(map(ordinary, safe_pieces(text, size))))


def decode(ids: Iterable[int] | None, rank_file: str = RANK_FILE) -> str:
    """Back from ids through their raw bytes: a character may be spread over several ids."""
    return encoder(rank_file).decode_bytes([int(i) for i in ids or ()]).decode("utf-8")


def encode_frame(
    df: DataFrame, text: str = "text", out: str = "ids", *, rank_file: str = RANK_FILE, keep: list[str] | None = None
) -> DataFrame:
    """``df``'s ``keep`` columns (all but ``text`` by default) and ``out``, the ids of ``text``.

    Row-local: no shuffle, one pass over the text column. Null and empty texts give an empty list; rows
    repeat as they come; a column named like ``out`` is replaced.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (out, text)]
    schema = df.select(*keep).schema.add(out, ArrayType(IntegerType()))

    def run(batches):
        for batch in batches:
            ids = [encode(t, rank_file) for t in batch.column("__text").to_pylist()]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(i) for i in ids], out=offsets[1:])
            values = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(offsets[-1]))
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], names=[*keep, out])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def count_frame(
    df: DataFrame, text: str = "text", out: str = "tokens", *, rank_file: str = RANK_FILE, keep: list[str] | None = None
) -> DataFrame:
    """Like :func:`encode_frame`, with the number of ids only."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in (out, text)]
    schema = df.select(*keep).schema.add(out, IntegerType())

    def run(batches):
        for batch in batches:
            counts = pa.array([len(encode(t, rank_file)) for t in batch.column("__text").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), counts], names=[*keep, out])

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode_frame(df: DataFrame, ids: str = "ids", out: str = "text", *, rank_file: str = RANK_FILE) -> DataFrame:
    """``df`` with ``out``, the text of the ``ids``; null ids give an empty text."""
    keep = [c for c in df.columns if c not in (ids, out)]
    schema = df.select(*keep).schema.add(out, StringType())

    def run(batches):
        for batch in batches:
            texts = pa.array([decode(i, rank_file) for i in batch.column("__ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], names=[*keep, out])

    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)
