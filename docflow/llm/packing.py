"""Filling containers of fixed capacity: minimum bin slack over the multiset of lengths.

Which items of one length go where doesn't matter, so the packing is planned on the histogram of lengths,
which has at most ``capacity`` rows however many items there are. Windows are filled one after another: the
longest remaining length is the seed, a bitset subset-sum finds the sum of remaining lengths closest to the
room left, and the counts are found by going back through the bitsets. A filling is used as often as the
remaining counts allow. Items then take their places by their rank within their length; ranks are counted
within salted parts of a length, so that a length that holds much of all rows is spread over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from docflow.functions.text import estimate_tokens, is_blank
from docflow.session import Stage

#: Items of one length that are ranked together in one task, at most about.
RANK_GROUP = 200_000


@dataclass(frozen=True)
class Filling:
    """``times`` containers, each with ``counts[length]`` items of each length."""

    counts: dict[int, int]
    times: int


def best_filling(hist: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum within ``room``; of equals one with longer items."""
    reached, steps = 1, []
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    for length in sorted((x for x in hist if x <= room and hist[x] > 0), reverse=True):
        left, part = min(hist[length], room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & mask
            left -= take
            part *= 2
            if reached & goal:
                break
        if reached & goal:
            break
    total = reached.bit_length() - 1
    counts: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            counts[length] = counts.get(length, 0) + take
            total -= length * take
    return counts


def plan_fillings(hist: dict[int, int], capacity: int) -> list[Filling]:
    """Fillings that together use every item of the histogram once. Lengths are 1 to ``capacity``."""
    if any(not 0 < x <= capacity for x in hist):
        raise ValueError("a length is outside 1..capacity")
    left = {x: n for x, n in hist.items() if n > 0}
    plan = []
    while left:
        seed = max(left)
        left[seed] -= 1
        counts = best_filling(left, capacity - seed)
        left[seed] += 1
        counts[seed] = counts.get(seed, 0) + 1
        times = min(left[x] // n for x, n in counts.items())
        for x, n in counts.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
        plan.append(Filling(counts, times))
    return plan


def _places(plan: list[Filling]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, items a container and first container of each run of ranks."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    container = 0
    for filling in plan:
        for length, n in filling.counts.items():
            runs.setdefault(length, []).append((used.get(length, 0), n, container))
            used[length] = used.get(length, 0) + n * filling.times
        container += filling.times
    return {x: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for x, r in runs.items()}


def pack(items: DataFrame, keys: list[str], size: str, capacity: int, *, stage: Stage | None = None) -> DataFrame:
    """Containers for ``items``: keys, piece, pieces, size of the piece, ``batch_id``.

    ``keys`` name an item and must be unique. An item above ``capacity`` is cut into pieces of just the
    capacity and a rest; all others stay whole. Items whose size is null or below 1 count as 1. The driver
    gets the histogram, at most ``capacity`` rows.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    stage = stage or Stage(items.sparkSession)
    sized = items.select(*keys, F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1)).cast("int").alias("__n"))
    pieces = F.ceil(F.col("__n") / F.lit(capacity)).cast("int")
    rows = stage.put(
        sized.withColumn("pieces", pieces)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("size", F.least(F.lit(capacity), F.col("__n") - F.col("piece") * capacity))
        .drop("__n")
    )
    hist = {r["size"]: r["n"] for r in rows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    places = _places(plan_fillings(hist, capacity))
    parts = max(1, -(-sum(hist.values()) // RANK_GROUP))
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*keys, "piece"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        salted.groupBy("size", "__salt")
        .agg(F.count("*").alias("__rows"))
        .select("size", "__salt", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    )
    within = Window.partitionBy("size", "__salt").orderBy(*keys, "piece")
    ranked = (
        salted.withColumn("__in", F.row_number().over(within) - 1)
        .join(offsets, ["size", "__salt"])
        .select(*keys, "piece", "pieces", "size", (F.col("__before") + F.col("__in")).alias("__rank"))
    )
    names = [*keys, "piece", "pieces", "size", "batch_id"]
    schema = StructType([*ranked.drop("__rank").schema.fields]).add("batch_id", LongType())

    def place(batches):
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            ranks = batch.column("__rank").to_numpy(zero_copy_only=False)
            out = np.empty(len(sizes), dtype=np.int64)
            for x in np.unique(sizes):
                first, each, base = places[int(x)]
                at = np.flatnonzero(sizes == x)
                run = np.searchsorted(first, ranks[at], side="right") - 1
                out[at] = base[run] + (ranks[at] - first[run]) // each[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(out)], names=names)

    return ranked.mapInArrow(place, schema)


def capacity_of(pack_limits: DataFrame) -> int:
    """The single capacity of ``pack_limits``; of several rows the smallest."""
    least = pack_limits.agg(F.min("max_batch_tokens")).first()[0]
    if least is None:
        raise ValueError("pack_limits has no capacity")
    return int(least)


def valid_input() -> Column:
    """Inputs with artifact, source, text that isn't blank and an index that isn't negative."""
    text, index = F.col("chunk.text"), F.coalesce(F.col("chunk.index"), F.lit(0))
    ids = (F.coalesce("artifact_id", F.lit("")) != "") & (F.coalesce("source_id", F.lit("")) != "")
    return F.col("pos").isNotNull() & ids & ~is_blank(text) & (index >= 0)


def pack_inputs(inputs: DataFrame, pack_limits: DataFrame) -> DataFrame:
    """Batches of the chunks of valid inputs: pos, piece, pieces, size, batch_id.

    The size is that of the text, as stored counts may be missing or out of date. A repeated input counts
    once, of different rows under one ``pos`` the smaller. Piece ``k`` of an input above the capacity has
    its code points from ``4 * capacity * k`` on.
    """
    sizes = inputs.filter(valid_input()).select("pos", estimate_tokens(F.col("chunk.text")).alias("__size"))
    items = sizes.groupBy("pos").agg(F.min("__size").alias("__size"))
    return pack(items, ["pos"], "__size", capacity_of(pack_limits))


def pack_records(records: DataFrame, pack_limits: DataFrame) -> DataFrame:
    """Batches of records by their ``token_count``, where that is null or below 1 by their text's size."""
    count = F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(estimate_tokens(F.col("text")))
    items = records.filter(F.col("pos").isNotNull()).select("pos", count.alias("__size"))
    items = items.groupBy("pos").agg(F.min("__size").alias("__size"))
    return pack(items, ["pos"], "__size", capacity_of(pack_limits))


def fill_report(batches: DataFrame, capacity: int) -> DataFrame:
    """One row: batches, pieces, size, the fewest batches that could hold it, share of room used."""
    used = batches.groupBy("batch_id").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    total = F.coalesce(F.sum("used"), F.lit(0))
    return used.agg(
        F.count("*").alias("batches"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("pieces"),
        total.cast("bigint").alias("size"),
        F.ceil(total / F.lit(capacity)).cast("bigint").alias("least_batches"),
        F.coalesce(F.max("used"), F.lit(0)).cast("bigint").alias("largest"),
        F.try_divide(total, F.count("*") * F.lit(capacity)).alias("fill"),
    )
