"""Stores over Hadoop's connectors, a store in memory for tests, and bounded reads that can be given up."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

from docflow.errors import DocflowError
from docflow.kernels.process import Cancelled
from docflow.sources import files
from docflow.sources.objects import MAX_COMPOSE_SOURCES

_BLOCK = 1 << 20
CONTENT = StructType(
    [StructField("key", StringType()), StructField("content", BinaryType()), StructField("size", LongType()), StructField("created", TimestampType())]
)


class Store:
    """A bucket read and listed through a session's connectors.

    A store that made its session (:func:`connect`) ends it when closed; one over a given session leaves it open.
    """

    def __init__(self, bucket: str, spark: SparkSession, backend: str = "gcs", owned: bool = False):
        if not bucket:
            raise ValueError("the bucket is empty")
        if spark is None:
            raise ValueError("a session is needed")
        files.store_uri(backend, bucket)
        self.bucket, self.backend, self.spark, self.owned = bucket, backend, spark, owned

    def uri(self, key: str = "") -> str:
        return files.store_uri(self.backend, self.bucket, key)

    def scan(self, prefix: str = "", **options) -> tuple[DataFrame, DataFrame]:
        return files.scan(self.spark, self.uri(prefix), **options)

    def listing(self, prefix: str = "") -> DataFrame:
        return files.listing(self.spark, self.uri(prefix))

    def close(self) -> None:
        """End the session if it is the store's own; closing twice is fine."""
        if self.owned and self.spark is not None:
            self.spark.stop()
        if self.owned:
            self.spark = None


def connect(bucket: str, backend: str = "gcs", conf: dict[str, str] | None = None) -> Store:
    """A store with a session of its own, which must not be there yet; credentials are the environment's or in ``conf``."""
    if not bucket:
        raise ValueError("the bucket is empty")
    if SparkSession.getActiveSession() is not None:
        raise RuntimeError("there is a session already; give it to Store")
    builder = SparkSession.builder
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    return Store(bucket, builder.getOrCreate(), backend, owned=True)


def connect_emulator(bucket: str, endpoint: str, backend: str = "gcs") -> Store:
    """A store over an emulator, without credentials; not for real stores."""
    return connect(bucket, backend, files.emulator_conf(endpoint))


class MemoryStore:
    """Objects in memory for tests; ``now`` is the clock that dates what is put and composed."""

    def __init__(self, now: Callable[[], datetime] | None = None):
        self.now = now or (lambda: datetime.now(timezone.utc))
        self.objects: dict[str, tuple[bytes, datetime]] = {}

    def _there(self, key: str) -> bytes:
        if key not in self.objects:
            raise DocflowError("OBJECT_NOT_FOUND", key)
        return self.objects[key][0]

    def put(self, key: str, content: bytes) -> None:
        self.objects[key] = (bytes(content), self.now())

    def get(self, key: str) -> bytes:
        return self._there(key)

    def get_range(self, key: str, offset: int, length: int) -> bytes:
        if offset < 0:
            raise DocflowError("INVALID_ARGUMENT", f"offset {offset}")
        content = self._there(key)
        if offset >= len(content):
            raise DocflowError("RANGE_NOT_SATISFIABLE", f"offset {offset} of {len(content)}")
        return content[offset:] if length < 0 else content[offset : offset + length]

    def compose(self, key: str, sources: list[str]) -> None:
        if not 1 <= len(sources) <= MAX_COMPOSE_SOURCES:
            raise DocflowError("INVALID_ARGUMENT", f"{len(sources)} sources")
        self.put(key, b"".join([self._there(s) for s in sources]))

    def delete(self, key: str) -> None:
        self._there(key)
        del self.objects[key]

    def exists(self, key: str) -> bool:
        return key in self.objects

    def table(self, spark: SparkSession) -> DataFrame:
        """The objects as a table for :mod:`docflow.sources.objects`."""
        rows = [(k, bytearray(c), len(c), t) for k, (c, t) in sorted(self.objects.items())]
        return spark.createDataFrame(rows, CONTENT)


def read_all(stream: BinaryIO, limit: int | None = None, cancelled: Callable[[], bool] = lambda: False) -> bytes:
    """All bytes of a stream. Over ``limit`` it is a failure, never a cut; ``cancelled`` is asked before each read."""
    blocks, left = [], None if limit is None else limit + 1
    while True:
        if cancelled():
            raise Cancelled("the read was given up")
        block = stream.read(_BLOCK if left is None else min(_BLOCK, left))
        if not block:
            return b"".join(blocks)
        blocks.append(block)
        if left is not None:
            left -= len(block)
            if left <= 0:
                raise DocflowError("SOURCE_TOO_LARGE", f"source is over {limit} bytes")
