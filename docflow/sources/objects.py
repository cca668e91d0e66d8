"""Object-store semantics over tables of objects: get, put, delete, ranges, compose, list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from docflow.errors import error_column

#: Fixed value: sources of one compose request.
MAX_COMPOSE_SOURCES = 32


def get(requests: DataFrame, objects: DataFrame, key: str = "key") -> DataFrame:
    """Each request with its object's columns, or ``error`` OBJECT_NOT_FOUND."""
    found = objects.withColumn("__there", F.lit(True))
    joined = requests.join(found, key, "left")
    return joined.withColumn("error", F.when(F.col("__there").isNull(), "OBJECT_NOT_FOUND")).drop("__there")


def exists(requests: DataFrame, objects: DataFrame, key: str = "key") -> DataFrame:
    """Each request with ``exists``."""
    there = objects.select(key).distinct().withColumn("exists", F.lit(True))
    return requests.join(there, key, "left").fillna(False, ["exists"])


def put(objects: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """Objects after the new ones took the place of those with their keys. ``new`` has each key once."""
    return objects.join(new.select(key), key, "left_anti").unionByName(new)


def delete(objects: DataFrame, requests: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Objects left, and the requests that found nothing, with ``error``."""
    keys = requests.select(key).distinct()
    missing = keys.join(objects.select(key), key, "left_anti").withColumn("error", F.lit("OBJECT_NOT_FOUND"))
    return objects.join(keys, key, "left_anti"), missing


def delete_if_exists(objects: DataFrame, requests: DataFrame, key: str = "key") -> DataFrame:
    """Objects left; requests that find nothing are fine."""
    return delete(objects, requests, key)[0]


def list_objects(objects: DataFrame, prefix: str = "", limit: int | None = None, key: str = "key") -> DataFrame:
    """Objects under a prefix by key in order of bytes; a ``limit`` stops early."""
    found = objects.filter(F.startswith(F.col(key), F.lit(prefix))).orderBy(key)
    return found if limit is None else found.limit(limit)


def each_object(objects: DataFrame, prefix: str, call: Callable[[Row], None], key: str = "key") -> None:
    """Hand the objects under a prefix to ``call``, one after another by key; what it raises ends the listing.

    Partitions come to the driver one at a time, and none after the last that is needed.
    """
    for row in list_objects(objects, prefix, key=key).toLocalIterator(prefetchPartitions=False):
        call(row)


def range_error(size: Column, offset: Column, length: Column) -> Column:
    """Why a range can't be read: a negative offset before a missing object (null size) before the range."""
    return error_column((offset < 0, "INVALID_ARGUMENT"), (size.isNull(), "OBJECT_NOT_FOUND"), (offset >= size, "RANGE_NOT_SATISFIABLE"))


def range_bytes(content: Column, offset: Column, length: Column) -> Column:
    """Bytes from ``offset`` on, as many as there are up to ``length``; a negative length means to the end.

    Null where the range can't be read. ``content`` is binary.
    """
    size = F.octet_length(content)
    left = size - offset
    take = F.when((length < 0) | (length > left), left).otherwise(length)
    fits = (offset >= 0) & (offset < size)
    return F.when(fits, F.substring(content, (offset + 1).cast("int"), take.cast("int")))


def compose(objects: DataFrame, requests: DataFrame, key: str = "key", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """New contents ``key, content`` and failures ``key, error`` of requests ``key, ord, src``.

    A request joins 1 to 32 sources in order; one source may come twice, the target may be a source. With any
    source missing nothing is written. Ask for more by composing in levels, see :func:`compose_levels`.
    """
    there = objects.select(F.col(key).alias("src"), F.col(content).cast("binary").alias("__data"))
    # Requests are counted before any content is looked at: what is gathered has at most 32 pieces.
    counts = requests.groupBy(key).agg(F.count("*").alias("n"))
    fits = F.col("n").between(1, MAX_COMPOSE_SOURCES)
    parts = requests.join(counts.filter(fits), key).join(there, "src", "left")
    piece = F.struct("ord", F.hex("__data").alias("h"))
    gathered = parts.groupBy(key, "n").agg(F.count("__data").alias("found"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    whole = F.col("found") == F.col("n")
    done = gathered.filter(whole).select(key, F.unhex(F.array_join(F.col("pieces.h"), "")).alias(content))
    refused = counts.filter(~fits).select(key, F.lit("INVALID_ARGUMENT").alias("error"))
    return done, refused.union(gathered.filter(~whole).select(key, F.lit("OBJECT_NOT_FOUND").alias("error")))


def compose_levels(parts: DataFrame, key: str = "key", content: str = "content") -> DataFrame:
    """``key, content`` of any number of parts ``key, ord, content`` (``ord`` from 0 without gaps), 32 at a time."""
    level = parts.select(key, F.col("ord").cast("bigint").alias("ord"), F.col(content).cast("binary").alias(content))
    most = (level.agg(F.max("ord")).first()[0] or 0) + 1
    while most > 1:
        piece = F.struct("ord", F.hex(content).alias("h"))
        group = F.floor(F.col("ord") / MAX_COMPOSE_SOURCES)
        level = level.groupBy(key, group.alias("up")).agg(F.array_sort(F.collect_list(piece)).alias("p"))
        level = level.select(key, F.col("up").alias("ord"), F.unhex(F.array_join(F.col("p.h"), "")).alias(content))
        most = -(-most // MAX_COMPOSE_SOURCES)
    return level.select(key, content)
