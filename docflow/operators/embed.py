"""Embedding runs: validation, batches over the global order, calls on the executors, records and failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType

from docflow.errors import error_column
from docflow.functions.text import estimate_tokens, is_blank
from docflow.kernels.embedding import EmbedConfig, EmbeddingClient, RunCancelled, embed_batch
from docflow.session import Stage

#: Inputs of one stretch of the global order that one task packs, at most about.
STRETCH = 500_000


def input_error() -> Column:
    """The first thing wrong with an embedding input, or null. Null counts as empty, a null index as 0."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return error_column(
        (empty("artifact_id"), "EMBED_MISSING_ARTIFACT_ID"),
        (empty("source_id"), "EMBED_MISSING_SOURCE_ID"),
        (is_blank(F.col("chunk.text")), "EMBED_EMPTY_TEXT"),
        (F.col("chunk.index") < 0, "EMBED_NEGATIVE_INDEX"),
    )


def input_tokens(estimate: Callable[[Column], Column] | None = None) -> Column:
    """The chunk's own count if it is positive, else its text's size by ``estimate``."""
    count = F.col("chunk.token_count")
    return F.when(count > 0, count).otherwise((estimate or estimate_tokens)(F.col("chunk.text")))


def distinct_inputs(inputs: DataFrame) -> DataFrame:
    """Each ``pos`` once; of different rows under one the smallest (maps aren't compared)."""
    order = F.struct("source_id", "artifact_id", "chunk", "title")
    one = inputs.filter(F.col("pos").isNotNull()).groupBy("pos").agg(F.min_by(F.struct(*[c for c in inputs.columns if c != "pos"]), order).alias("r"))
    return one.select("pos", "r.*")


def _pack_stretch(tokens: np.ndarray, n: int, total: int, cfg: EmbedConfig) -> tuple[list[int], int, int]:
    """Places where a new batch begins, and count and tokens of the batch open at the end."""
    starts = []
    for k, t in enumerate(tokens.tolist()):
        if n and (n >= cfg.inputs or total + t > cfg.tokens):
            starts.append(k)
            n = total = 0
        n += 1
        total += t
    return starts, n, total


def batch_ids(sizes: DataFrame, cfg: EmbedConfig = EmbedConfig(), stage: Stage | None = None) -> DataFrame:
    """``pos, tokens, batch_id`` for unique ``pos, tokens``: batches packed greedily in the order of ``pos``.

    The order is cut into stretches. Where the first batch of a stretch begins depends on what is open before,
    but lies within its first ``cfg.inputs`` places; for each of these every stretch tells in advance what will be
    open at its end. The driver only follows these few states from stretch to stretch, then all stretches are
    numbered at once. The result is that of one pass over everything.
    """
    stage = stage or Stage(sizes.sparkSession)
    slim = sizes.select("pos", F.col("tokens").cast("bigint").alias("tokens"))
    count = slim.count()
    parts = max(1, -(-count // STRETCH))
    ordered = stage.put(slim.repartitionByRange(parts, "pos").withColumn("stretch", F.spark_partition_id()))
    together = ordered.repartition(parts, "stretch").sortWithinPartitions("stretch", "pos")
    ahead_schema = StructType(
        [
            StructField("stretch", IntegerType()),
            StructField("first_pos", LongType()),
            StructField("head", ArrayType(LongType())),
            StructField("begins", ArrayType(LongType())),
            StructField("n", ArrayType(LongType())),
            StructField("total", ArrayType(LongType())),
        ]
    )

    def foresee(batches):
        for stretch, pos, tokens in _stretches(batches):
            head = min(len(tokens), cfg.inputs)
            begins, ns, totals = [], [], []
            # From one entry on, later entries mostly meet the same batches; each is followed until it does.
            memo: dict[int, tuple[int, int, int]] = {}
            for entry in range(head, -1, -1):
                b, n, t = _follow(tokens, entry, cfg, memo)
                begins.append(b)
                ns.append(n)
                totals.append(t)
            columns = [[stretch], [int(pos[0])], [tokens[:head].tolist()], [begins[::-1]], [ns[::-1]], [totals[::-1]]]
            from pyspark.sql.pandas.types import to_arrow_type

            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, ahead_schema)], names=ahead_schema.names)

    states = sorted(together.mapInArrow(foresee, ahead_schema).collect(), key=lambda r: r.first_pos)
    enter: dict[int, tuple[int, int, int]] = {}
    batch, n, total = 0, 0, 0
    for s in states:
        enter[s.stretch] = (batch, n, total)
        if n == 0:  # only at the very beginning: the first batch begins here
            batch, n, total = batch + s.begins[0], s.n[0], s.total[0]
            continue
        entry = None
        for k, t in enumerate(s.head):
            if n and (n >= cfg.inputs or total + t > cfg.tokens):
                entry = k
                break
            n, total = n + 1, total + t
        if entry is not None:
            # A batch begins at the entry; what follows was foreseen.
            batch, n, total = batch + 1 + s.begins[entry], s.n[entry], s.total[entry]
    schema = StructType([StructField("pos", LongType()), StructField("tokens", LongType()), StructField("batch_id", LongType())])

    def number(batches):
        for stretch, pos, tokens in _stretches(batches):
            base, n, total = enter[stretch]
            starts, _, _ = _pack_stretch(tokens, n, total, cfg)
            step = np.zeros(len(tokens), dtype=np.int64)
            step[starts] = 1
            yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(tokens), pa.array(base + np.cumsum(step))], names=schema.names)

    return together.mapInArrow(number, schema)


def _follow(tokens: np.ndarray, entry: int, cfg: EmbedConfig, memo: dict) -> tuple[int, int, int]:
    """Batches begun after the one that begins at ``entry``, and what is open at the end."""
    path, at = [], entry
    n = total = 0
    while at < len(tokens) and at not in memo:
        path.append(at)
        n, total, k = 1, int(tokens[at]), at + 1
        while k < len(tokens) and n < cfg.inputs and total + int(tokens[k]) <= cfg.tokens:
            n, total, k = n + 1, total + int(tokens[k]), k + 1
        at = k
    result = memo.get(at, (-1, n, total))
    for p in reversed(path):
        result = (result[0] + 1, result[1], result[2])
        memo[p] = result
    return memo.get(entry, (0, 0, 0))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of one stretch after another, from batches sorted by stretch."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    current = None
    for batch in batches:
        ids = batch.column("stretch").to_numpy()
        pos, tokens = batch.column("pos").to_numpy(), batch.column("tokens").to_numpy()
        cuts = np.flatnonzero(np.diff(ids)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(ids)]):
            if a == b:
                continue
            if current is not None and ids[a] != current:
                yield current, *map(np.concatenate, zip(*held))
                held = []
            current = int(ids[a])
            held.append((pos[a:b], tokens[a:b]))
    if held:
        yield current, *map(np.concatenate, zip(*held))


@dataclass
class EmbedRun:
    """What a run gave: ``records``, ``failures``, and whether a call was cancelled.

    Both tables are read from one written result, so that no call is made twice.
    """

    result: DataFrame
    model: tuple[str, str]

    @property
    def records(self) -> DataFrame:
        """Records in the order of ``pos`` when sorted by it."""
        provider, name = self.model
        rows = self.result.filter("vector is not null")
        return rows.select(
            "pos", "source_id", "artifact_id", F.col("chunk.index").alias("chunk_index"), F.col("chunk.text").alias("text"), "vector",
            F.struct(F.lit(provider).alias("provider"), F.lit(name).alias("name")).alias("model"), "tokens", "metadata",
        ).withColumnRenamed("tokens", "token_count")

    @property
    def failures(self) -> DataFrame:
        """``first_pos, inputs, error_code, error_message, retryable``: one row a failed batch or invalid input."""
        rows = self.result.filter("error_code is not null and error_code != 'CANCELLED'")
        each = F.struct("pos", "source_id", "artifact_id", "chunk", "title")
        grouped = rows.groupBy("failure").agg(
            F.array_sort(F.collect_list(each)).alias("inputs"), F.first("error_code").alias("error_code"),
            F.first("error_message").alias("error_message"), F.first("retryable").alias("retryable"),
        )
        return grouped.withColumnRenamed("failure", "first_pos")

    @property
    def cancelled(self) -> bool:
        return not self.result.filter("error_code = 'CANCELLED'").isEmpty()


def _bounds(sizes: DataFrame, cfg: EmbedConfig, stage: Stage) -> np.ndarray:
    """Positions at which some of the batches over the order of ``pos`` begin: a few for each core, in order."""
    starts = stage.put(batch_ids(sizes, cfg, stage).groupBy("batch_id").agg(F.min("pos").alias("pos")))
    groups = 4 * sizes.sparkSession.sparkContext.defaultParallelism
    step = max(1, -(-starts.count() // groups))
    found = [r.pos for r in starts.filter(F.col("batch_id") % step == 0).select("pos").collect()]
    stage.drop(starts)
    return np.array(sorted(found), dtype=np.int64)


def embed_run(
    inputs: DataFrame, client_factory: Callable[[], EmbeddingClient], cfg: EmbedConfig = EmbedConfig(), *, scope: str = "global", stage: Stage | None = None
) -> EmbedRun:
    """Embed ``inputs`` (``pos, source_id, artifact_id, chunk, title, metadata``).

    Invalid inputs never reach the client; each is a failure of its own. ``scope="global"`` packs batches over
    the order of ``pos``; ``scope="block"`` packs each block of ``max_batch_inputs`` positions by itself, which needs
    no look at the order: same records, other batches. A cancelled call ends its task's run; what is done stays.

    Texts are shuffled twice, to be distinct and to come together in runs of batches. Runs are cut where a batch
    begins, so packing each from its start gives the batches of the whole order.
    """
    if scope not in ("global", "block"):
        raise ValueError(f"unknown scope {scope!r}")
    stage = stage or Stage(inputs.sparkSession)
    rows = distinct_inputs(inputs).withColumns({"error": input_error(), "tokens": input_tokens(cfg.estimate)})
    rows = stage.put(rows.select("pos", "source_id", "artifact_id", "chunk", "title", "metadata", "error", "tokens"))
    valid = rows.filter("error is null").drop("error")
    if scope == "global":
        bounds = _bounds(valid.select("pos", "tokens"), cfg, stage)

        @F.pandas_udf(LongType())
        def run_of(pos: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(bounds, pos.to_numpy(), side="right").astype(np.int64))

        run = run_of("pos")
    else:
        run = F.floor(F.col("pos") / cfg.inputs)
    carried = ["pos", "source_id", "artifact_id", "chunk", "title", "metadata", "tokens"]
    extra = [
        StructField("vector", ArrayType(FloatType())), StructField("error_code", StringType()), StructField("error_message", StringType()),
        StructField("retryable", BooleanType()), StructField("failure", LongType()),
    ]
    schema = StructType([*valid.select(*carried).schema.fields, *extra])

    def call(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in extra]
        client = client_factory()
        stopped = False
        for table in _packs(batches, cfg):
            texts, titles = table.column("chunk").combine_chunks().field("text").to_pylist(), table.column("title").to_pylist()
            positions = table.column("pos").to_pylist()
            out = {p: (None, "CANCELLED", "the run was cancelled", False, p) for p in positions}
            if not stopped:
                try:
                    result = embed_batch(client, list(zip(positions, texts, [t or "" for t in titles])), cfg)
                    out.update((p, (v, None, None, None, None)) for p, v in result.vectors.items())
                    for failed, code, message, retryable in result.failures:
                        out.update((p, (None, code, message, retryable, min(failed))) for p in failed)
                except RunCancelled:
                    stopped = True
            columns = [pa.array(c, t) for c, t in zip(zip(*(out[p] for p in positions)), types)]
            kept = [table.column(c).combine_chunks() for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=schema.names)

    together = valid.withColumn("__run", run).repartition("__run").sortWithinPartitions("__run", "pos")
    done = together.select(*carried, "__run").mapInArrow(call, schema)
    invalid = rows.filter("error is not null").select(
        *carried, F.lit(None).cast("array<float>").alias("vector"), F.col("error").alias("error_code"), F.col("error").alias("error_message"),
        F.lit(False).alias("retryable"), F.col("pos").alias("failure"),
    )
    result = stage.put(done.unionByName(invalid))
    stage.drop(rows)
    return EmbedRun(result, client_factory().model())


def _packs(batches: Iterator[pa.RecordBatch], cfg: EmbedConfig) -> Iterator[pa.Table]:
    """Embedding batches of rows sorted by ``__run`` and ``pos``; each run begins with a new one."""
    held: list[pa.RecordBatch] = []
    n = total = 0
    current = None
    for batch in batches:
        first = 0
        for k, (run, tokens) in enumerate(zip(batch.column("__run").to_pylist(), batch.column("tokens").to_pylist())):
            if n and (run != current or n >= cfg.inputs or total + tokens > cfg.tokens):
                if k > first:
                    held.append(batch.slice(first, k - first))
                yield pa.Table.from_batches(held)
                held, first, n, total = [], k, 0, 0
            current, n, total = run, n + 1, total + tokens
        if batch.num_rows > first:
            held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)
