"""Embedding batches: packing, calling a client, isolating what it refuses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np

# Default limits of a batch.
MAX_BATCH_INPUTS, MAX_BATCH_TOKENS = 96, 20_000
_FNV_OFFSET, _FNV_PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


@dataclass(frozen=True)
class EmbedConfig:
    """Limits of 0 or less mean the defaults; the rest is passed on to the client.

    ``estimate`` is an expression over a column of texts (Column to Column) for inputs that bring no token count.
    """

    max_batch_inputs: int = 0
    max_batch_tokens: int = 0
    task: str = ""
    purpose: str = "embedding"
    dimensions: int = 0
    disable_bisect: bool = False
    estimate: Callable | None = None

    @property
    def inputs(self) -> int:
        return self.max_batch_inputs if self.max_batch_inputs > 0 else MAX_BATCH_INPUTS

    @property
    def tokens(self) -> int:
        return self.max_batch_tokens if self.max_batch_tokens > 0 else MAX_BATCH_TOKENS


@dataclass(frozen=True)
class Request:
    """``inputs`` are ``(id, text, title)``."""

    inputs: list[tuple[str, str, str]]
    purpose: str = "embedding"
    dimensions: int = 0
    task: str = ""


class ClientError(Exception):
    """A client's refusal of a request."""

    def __init__(self, message: str, retryable: bool = False):
        super().__init__(message)
        self.retryable = retryable


class RunCancelled(Exception):
    """The whole run is given up; what is done stays."""


class EmbeddingClient(Protocol):
    def embed(self, request: Request) -> list[tuple[str, list[float]]]: ...

    def model(self) -> tuple[str, str]: ...


def pack_batches(sizes: Iterable[tuple[int, int]], cfg: EmbedConfig) -> Iterator[tuple[int, int]]:
    """``(pos, batch)`` for ``(pos, tokens)`` in order: a batch is closed before the input that would take it
    over a limit; an input over the token limit is alone in its batch."""
    batch, n, total = 0, 0, 0
    for pos, tokens in sizes:
        if n and (n >= cfg.inputs or total + tokens > cfg.tokens):
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + tokens
        yield pos, batch


@dataclass
class BatchResult:
    vectors: dict[int, list[float]] = field(default_factory=dict)
    failures: list[tuple[list[int], str, str, bool]] = field(default_factory=list)
    calls: int = 0


def embed_batch(client: EmbeddingClient, batch: list[tuple[int, str, str]], cfg: EmbedConfig, out: BatchResult | None = None) -> BatchResult:
    """Vectors by position and failures ``(positions, code, message, retryable)`` of ``(pos, text, title)``.

    A refused batch is halved until the refused inputs are alone, unless that is disabled. An answer that
    doesn't name each input just once fails the whole batch and isn't tried again.
    """
    out = out or BatchResult()
    positions = [pos for pos, _, _ in batch]
    request = Request([(f"in-{pos}", text, title) for pos, text, title in batch], cfg.purpose, cfg.dimensions, cfg.task)
    out.calls += 1
    try:
        answer = client.embed(request)
    except RunCancelled:
        raise
    except Exception as e:
        if len(batch) > 1 and not cfg.disable_bisect:
            half = len(batch) // 2
            embed_batch(client, batch[:half], cfg, out)
            return embed_batch(client, batch[half:], cfg, out)
        out.failures.append((positions, "CLIENT_ERROR", str(e), bool(getattr(e, "retryable", False))))
        return out
    found = dict(answer)
    if len(found) != len(answer) or found.keys() != {i for i, _, _ in request.inputs}:
        out.failures.append((positions, "EMBED_RESPONSE_MISMATCH", "the answer doesn't have one vector an input", False))
        return out
    out.vectors.update((pos, found[f"in-{pos}"]) for pos in positions)
    return out


def hash_vector(text: str, dims: int = 8) -> list[float]:
    """A vector made of a text's hashes, the same everywhere; for tests and demonstrations."""
    state = _FNV_OFFSET
    for byte in text.encode("utf-8", "surrogatepass"):
        state = ((state ^ byte) * _FNV_PRIME) & _MASK
    out = []
    for k in range(dims):
        h = state
        for byte in str(k).encode():
            h = ((h ^ byte) * _FNV_PRIME) & _MASK
        out.append(float(np.float32(h % 2000) / np.float32(1000) - np.float32(1)))
    return out


class HashEmbedder:
    """A client without a model. ``fail`` may refuse a request, ``corrupt`` change an answer."""

    def __init__(
        self,
        dims: int = 8,
        fail: Callable[[Request], Exception | None] | None = None,
        corrupt: Callable[[list], list] | None = None,
    ):
        self.dims, self.fail, self.corrupt = dims, fail, corrupt
        self.requests: list[Request] = []

    @property
    def calls(self) -> int:
        return len(self.requests)

    def model(self) -> tuple[str, str]:
        return "local", "hash"

    def embed(self, request: Request) -> list[tuple[str, list[float]]]:
        self.requests.append(request)
        error = self.fail(request) if self.fail else None
        if error is not None:
            raise error
        answer = [(i, hash_vector(text, request.dimensions or self.dims)) for i, text, _ in request.inputs]
        return self.corrupt(answer) if self.corrupt else answer
