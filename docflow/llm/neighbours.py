"""The most similar vectors of every vector: NN-descent by Spark joins, and greedy search of its graph.

Equal vectors form one class, so copies cost nothing and are put back at the end. The graph is started by
sorting all classes along codes of random hyperplanes and comparing them within blocks of neighbours in that
order, a few times over; then neighbours of neighbours are joined until few entries change: every node gathers
the nodes it points to and some that point to it, compares them with each other and offers each the others.
Searching works on vectors of one byte a number; the final order is computed from the given numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, LongType, StructField, StructType

from docflow.session import Stage

#: Vectors from which the hyperplanes are drawn.
SAMPLE = 4096
#: Orders along random hyperplanes, bits of a code, vectors compared in one block.
ORDERS, BITS, BLOCK = 6, 30, 512
#: Neighbours kept for a vector while searching (a parameter: more find more, at quadratic cost), and offers to a
#: node that one join sends on.
KEEP, OFFERS = 16, 6
#: Nodes that a search keeps in view, nodes it looks behind in one step, and steps at most.
VIEW, EXPAND, STEPS = 32, 4, 12
#: Rounds of joins at most, and the share of changed entries at which they end.
ROUNDS, SETTLED = 8, 0.005
#: What is kept and the orders where they grow with the number of vectors: up to GROWN_FROM vectors, and added for
#: each ten times more.
GROWN_FROM, GROWN_KEEP, GROWN_ORDERS = 12_500, (28, 16), (6, 6)
#: What the one-byte similarity may be off, at most.
SLACK = 0.02

_EDGE = StructType([StructField("v", LongType()), StructField("s", FloatType())])


def grown(count: int, least: int, more: int) -> int:
    """``least`` for up to ``GROWN_FROM`` vectors, ``more`` added for each ten times more."""
    return least + round(more * max(0.0, math.log10(max(count, 1) / GROWN_FROM)))


def usable(vector: Column, dims: int) -> Column:
    """Vectors of ``dims`` finite numbers that aren't all zero."""
    finite = F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")) & x.isNotNull())
    return F.coalesce((F.size(vector) == dims) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(flat: np.ndarray, dims: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dims)
    x /= np.abs(x).max(axis=1, keepdims=True)  # tiny and huge numbers squared would leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _bytes_of(unit: np.ndarray) -> np.ndarray:
    return np.rint(unit * (127 / np.abs(unit).max(axis=1, keepdims=True))).astype(np.int8)


def _floats(codes: np.ndarray, dims: int) -> np.ndarray:
    x = codes.reshape(-1, dims).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    width = data.shape[1] if data.ndim == 2 else 1
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(data), [None, pa.py_buffer(data.tobytes())]
    ).cast(pa.binary())


def _flat_bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column's values, one after another."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.int8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.int8)


def top_edges(row: np.ndarray, v: np.ndarray, s: np.ndarray, keep: int) -> np.ndarray:
    """Indexes of the ``keep`` best of each row, in order; of a repeated ``v`` the best counts."""
    by_v = np.lexsort((-s, v, row))
    first = np.ones(len(by_v), dtype=bool)
    first[1:] = (row[by_v][1:] != row[by_v][:-1]) | (v[by_v][1:] != v[by_v][:-1])
    kept = by_v[first]
    kept = kept[np.lexsort((v[kept], -s[kept], row[kept]))]
    starts = np.flatnonzero(np.r_[True, row[kept][1:] != row[kept][:-1]]) if len(kept) else np.empty(0, int)
    rank = np.arange(len(kept)) - np.repeat(starts, np.diff(np.r_[starts, len(kept)]))
    return kept[rank < keep]


def _half(keep: int) -> int:
    return max(4, keep // 2)


def _taken(edges: pa.Array, keep: int) -> np.ndarray:
    """Which entries the last join took, or an earlier one: those not new and the first half of the new ones."""
    sizes = np.nan_to_num(edges.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    fresh = edges.flatten().field("fresh").to_numpy(zero_copy_only=False).astype(bool)
    before = np.cumsum(fresh) - fresh
    first = np.repeat((np.r_[0, np.cumsum(fresh)])[np.cumsum(sizes) - sizes], sizes) if len(fresh) else before
    return ~fresh | (before - first < _half(keep))


class NeighbourGraph:
    """The graph over ``rows`` (``pos bigint, vector array<float>``), searched with NN-descent.

    Rows whose vector isn't usable are left out. A repeated ``pos`` counts once, of different vectors under one
    ``pos`` the smallest. Fewer of the true neighbours are found among more vectors; with ``keep`` or ``orders``
    of None that number grows with the vectors.
    """

    def __init__(self, rows: DataFrame, *, dims: int = 64, keep: int | None = KEEP, orders: int | None = ORDERS, stage: Stage | None = None, seed: int = 5):
        self.spark, self.dims, self.seed = rows.sparkSession, dims, seed
        self.stage = stage or Stage(self.spark)
        good = rows.filter(F.col("pos").isNotNull() & usable(F.col("vector"), dims)).select("pos", "vector")
        one = good.groupBy("pos").agg(F.min("vector").alias("vector"))
        self.rows = self.stage.put(one.withColumn("cid", F.xxhash64("vector")))
        self.vectors = self.stage.put(self.rows.groupBy("cid").agg(F.min("vector").alias("vector")))
        self.count = self.vectors.count()
        self.keep = grown(self.count, *GROWN_KEEP) if keep is None else keep
        self.orders = grown(self.count, *GROWN_ORDERS) if orders is None else orders
        self.graph = self._descend(self._start()) if self.count else None

    # -- start ---------------------------------------------------------------------------------------

    def _planes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hyperplanes between pairs of a bounded sample, and the sample's medians along them."""
        rng = np.random.default_rng(self.seed)
        # The sample is spread by hash, so that it is the same on every run.
        part = max(1, self.count // SAMPLE)
        picked = self.vectors.filter(F.pmod(F.xxhash64("cid"), F.lit(part)) == 0).limit(2 * SAMPLE)
        sample = _unit(np.array([r.vector for r in picked.collect()] or np.ones((1, self.dims))), self.dims)
        a, b = rng.integers(0, len(sample), (2, self.orders * BITS))
        planes = sample[a] - sample[b] + 0.05 * rng.standard_normal((self.orders * BITS, self.dims))
        return planes, np.median(sample @ planes.T, axis=0)

    def _codes(self, vectors: DataFrame, extra: list[str]) -> DataFrame:
        planes, medians = self._planes()
        dims, orders, weights = self.dims, self.orders, (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        schema = StructType(vectors.select("cid", *extra).schema.fields)
        schema = schema.add("part", LongType()).add("code", LongType()).add("q", BinaryType())

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                unit = _unit(batch.column("vector").flatten().to_numpy(zero_copy_only=False), dims)
                bits = (unit @ planes.T > medians).reshape(len(unit), orders, BITS)
                codes, q = bits @ weights, _binary(_bytes_of(unit))
                for k in range(orders):
                    part = pa.array(np.full(len(unit), k, dtype=np.int64))
                    kept = [batch.column(c) for c in ("cid", *extra)]
                    yield pa.RecordBatch.from_arrays([*kept, part, pa.array(codes[:, k]), q], names=schema.names)

        return vectors.select("cid", "vector", *extra).mapInArrow(run, schema)

    def _start(self) -> DataFrame:
        """``u, q, edges``: the best neighbours within the blocks of all orders."""
        dims, keep = self.dims, self.keep
        codes = self.stage.put(self._codes(self.vectors, []))
        schema = StructType([StructField("u", LongType()), StructField("edges", ArrayType(_EDGE))])

        def compare(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            n, k = len(ids), min(keep, len(ids) - 1)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            best = np.argpartition(-s, max(k - 1, 0), axis=1)[:, :k]
            return _edges_batch(["u"], [pa.array(ids)], np.full(n, k), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel())

        def run(batches: Iterator[pa.RecordBatch]):
            ids, q, part = [], [], []
            held = 0
            for batch in batches:
                ids.append(batch.column("cid").to_numpy())
                q.append(_flat_bytes(batch.column("q")))
                held += batch.num_rows
                while held >= 2 * BLOCK:
                    all_ids, all_q = np.concatenate(ids), np.concatenate(q)
                    yield compare(all_ids[:BLOCK], _floats(all_q[: BLOCK * dims], dims))
                    ids, q, held = [all_ids[BLOCK:]], [all_q[BLOCK * dims :]], held - BLOCK
            if held > 1:
                all_ids, all_q = np.concatenate(ids), np.concatenate(q)
                step = -(-held // -(-held // BLOCK))
                for at in range(0, held, step):
                    if min(step, held - at) > 1:
                        yield compare(all_ids[at : at + step], _floats(all_q[at * dims : (at + step) * dims], dims))

        ordered = codes.repartitionByRange("part", "code", "cid").sortWithinPartitions("part", "code", "cid")
        found = ordered.select("cid", "q").mapInArrow(run, schema)
        own = codes.filter("part = 0").select(F.col("cid").alias("u"), "q")
        offers = found.select("u", F.explode("edges").alias("e")).select("u", "e.v", "e.s")
        state = own.withColumn("edges", F.array().cast(_STATE_EDGES)).select("u", "q", "edges")
        started = self.stage.put(self._merge(state, offers.filter("u != v")))
        self.stage.drop(codes)
        return started

    # -- descent -------------------------------------------------------------------------------------

    def _merge(self, state: DataFrame, offers: DataFrame) -> DataFrame:
        """``state`` with the offers taken in; entries that the last join took are no longer new."""
        schema, keep = StructType(state.schema.fields), self.keep
        lists = offers.groupBy("u").agg(F.collect_list(F.struct("v", "s")).alias("offers"))
        both = state.join(lists, "u", "left")

        def run(batches: Iterator[pa.RecordBatch]):
            for batch in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
                have, more = batch.column("edges"), batch.column("offers")
                rows, vs, ss, old, there = [], [], [], [], []
                seen = _taken(have, keep)
                for column, is_old in ((have, True), (more, False)):
                    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                    flat = column.flatten()
                    rows.append(np.repeat(np.arange(batch.num_rows), sizes))
                    vs.append(flat.field("v").to_numpy(zero_copy_only=False))
                    ss.append(flat.field("s").to_numpy(zero_copy_only=False))
                    old.append(seen if is_old else np.zeros(len(flat), dtype=bool))
                    there.append(np.full(len(flat), is_old))
                row, v, s, was, here = map(np.concatenate, (rows, vs, ss, old, there))
                # An entry that is there already stays what it is: it comes first among equals.
                s = np.where(here, s + np.float32(1e-4), s)
                pick = top_edges(row, v, s, keep)
                out = np.where(here[pick], s[pick] - np.float32(1e-4), s[pick]).astype(np.float32)
                counts = np.bincount(row[pick], minlength=batch.num_rows)
                yield _edges_batch(["u", "q"], [batch.column("u"), batch.column("q")], counts, v[pick], out, ~was[pick])

        return both.select("u", "q", "edges", "offers").mapInArrow(run, schema)

    def _descend(self, state: DataFrame) -> DataFrame:
        for _ in range(ROUNDS):
            new_state = self.stage.put(self._merge(state, self._join(state)))
            self.stage.drop(state)
            state = new_state
            changed = state.select(F.sum(F.size(F.filter("edges", lambda e: e.fresh)))).first()[0] or 0
            if changed <= SETTLED * self.keep * self.count:
                break
        return state

    def _join(self, state: DataFrame) -> DataFrame:
        """``u, v, s``: what nodes that meet at a third are to each other, where that improves their lists."""
        dims, half = self.dims, _half(self.keep)
        last = F.when(F.size("edges") >= self.keep, F.element_at("edges", -1)["s"]).otherwise(F.lit(-2.0)).cast("float")
        nodes = state.select(F.col("u").alias("m"), "q", last.alias("kth"))
        # Of a node's entries half are taken that are new and half that aren't, the closest first; of the entries that
        # point to a node likewise. So far only ids are sent.
        part = lambda fresh: F.slice(F.filter("edges", lambda e: e.fresh == F.lit(fresh)), 1, half)
        own = F.transform(F.concat(part(True), part(False)), lambda e: F.struct(e.v.alias("m"), e.fresh.alias("fresh")))
        ahead = state.select(F.col("u").alias("w"), own.alias("ahead"))
        edges = ahead.select(F.col("w").alias("m"), F.posexplode("ahead").alias("rank", "e")).select("m", "rank", F.col("e.m").alias("w"), "e.fresh")
        order = Window.partitionBy("w", "fresh").orderBy("rank", F.xxhash64("m", "w"))
        back = edges.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= half)
        behind = back.groupBy("w").agg(F.collect_list(F.struct("m", "fresh")).alias("behind"))
        met = ahead.join(behind, "w", "left").select("w", F.concat("ahead", F.coalesce("behind", F.array().cast("array<struct<m:bigint,fresh:boolean>>"))).alias("l"))
        # Vectors go only where something new meets something.
        met = met.filter(F.exists("l", lambda x: x.fresh) & (F.size("l") > 1)).select("w", F.explode("l").alias("e")).select("w", "e.m", "e.fresh")
        lists = met.join(nodes, "m").groupBy("w").agg(F.collect_list(F.struct("m", "q", "kth", "fresh")).alias("l")).select("l")
        schema = StructType([StructField("u", LongType()), *_EDGE.fields])
        # As many comparisons at a time, however many entries are kept.
        step = max(1, 1_024_000 // (2 * self.keep) ** 2)

        def run(batches: Iterator[pa.RecordBatch]):
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    column = whole.column("l").slice(at, step)
                    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    flat = column.flatten()
                    widest = int(sizes.max())
                    row = np.repeat(np.arange(len(sizes)), sizes)
                    col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    x = np.zeros((len(sizes), widest, dims), dtype=np.float32)
                    x[row, col] = _floats(_flat_bytes(flat.field("q")), dims)
                    ids = np.zeros((len(sizes), widest), dtype=np.int64)
                    ids[row, col] = flat.field("m").to_numpy(zero_copy_only=False)
                    kth = np.full((len(sizes), widest), 9, dtype=np.float32)
                    kth[row, col] = flat.field("kth").to_numpy(zero_copy_only=False)
                    fresh = np.zeros((len(sizes), widest), dtype=bool)
                    fresh[row, col] = flat.field("fresh").to_numpy(zero_copy_only=False)
                    s = np.matmul(x, x.transpose(0, 2, 1))
                    there = kth < 9
                    fits = (s > kth[:, :, None]) & (fresh[:, :, None] | fresh[:, None, :]) & there[:, None, :]
                    fits &= ids[:, :, None] != ids[:, None, :]
                    g, i, j = np.nonzero(fits)
                    if len(g):
                        pick = top_edges(g * widest + i, ids[g, j], s[g, i, j], OFFERS)
                        g, i, j = g[pick], i[pick], j[pick]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[g, i]), pa.array(ids[g, j]), pa.array(s[g, i, j], pa.float32())], names=schema.names
                    )

        return lists.mapInArrow(run, schema)

    # -- search --------------------------------------------------------------------------------------

    def _entries(self, queries: DataFrame) -> DataFrame:
        """``u, q, view``: for each query the best nodes of the blocks that it falls into, in all orders."""
        dims = self.dims
        mark = lambda df, f: self._codes(df, []).withColumn("asks", F.lit(f))
        both = self.stage.put(mark(self.vectors, False).union(mark(queries.select(F.col("u").alias("cid"), "vector"), True)))
        schema = StructType([StructField("u", LongType()), StructField("edges", ArrayType(_EDGE))])

        def look(ids: np.ndarray, x: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
            mine, nodes = np.flatnonzero(asks), np.flatnonzero(~asks)
            s = x[mine] @ x[nodes].T
            k = min(8, len(nodes))
            best = np.argsort(-s, axis=1)[:, :k]
            return _edges_batch(["u"], [pa.array(ids[mine])], np.full(len(mine), k), ids[nodes][best].ravel(), np.take_along_axis(s, best, 1).ravel())

        def run(batches: Iterator[pa.RecordBatch]):
            held: list[tuple] = []
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    held.append((part.column("cid").to_numpy(), _flat_bytes(part.column("q")), part.column("asks").to_numpy(zero_copy_only=False)))
                    ids, q, asks = (np.concatenate(c) for c in zip(*held[-2:]))
                    if asks.any():
                        yield look(ids, _floats(q, dims), asks)
                    held = held[-1:]

        ordered = both.repartitionByRange("part", "code", "cid").sortWithinPartitions("part", "code", "cid")
        found = ordered.select("cid", "q", "asks").mapInArrow(run, schema)
        asked = both.filter("asks and part = 0").select(F.col("cid").alias("u"), "q")
        offers = found.select("u", F.explode("edges").alias("e")).select("u", "e.v", "e.s")
        view = self._view(asked.withColumn("edges", F.array().cast(_STATE_EDGES)), offers)
        self.stage.drop(both)
        return view

    def _view(self, state: DataFrame, offers: DataFrame) -> DataFrame:
        keep, self.keep = self.keep, VIEW
        try:
            return self.stage.put(self._merge(state, offers))
        finally:
            self.keep = keep

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``id, neighbour, cosine, rank`` for queries ``id, vector``: the ``k`` most similar rows found greedily.

        Each query keeps the best nodes seen in view and looks behind the best ones not looked behind yet, until
        none of its view is left or the steps are used up. Queries that aren't usable have no rows.
        """
        fine = queries.filter(F.col("id").isNotNull() & usable(F.col("vector"), self.dims))
        fine = self.stage.put(fine.groupBy("id").agg(F.min("vector").alias("vector")).select(F.col("id").alias("u"), "vector"))
        if not self.count or fine.isEmpty():
            return self.spark.createDataFrame([], "id bigint, neighbour bigint, cosine double, rank int")
        dims = self.dims
        view = self._entries(fine)
        ahead = self.graph.select(F.col("u").alias("v"), F.transform("edges", lambda e: e.v).alias("next"))
        codes = self.graph.select(F.col("u").alias("v"), F.col("q").alias("qv"))
        behind = None
        schema = StructType([StructField("u", LongType()), *_EDGE.fields])

        def compare(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                x, y = _floats(_flat_bytes(b.column("q")), dims), _floats(_flat_bytes(b.column("qv")), dims)
                yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array((x * y).sum(axis=1), pa.float32())], names=schema.names)

        for _ in range(STEPS):
            each = view.select("u", "q", F.posexplode("edges").alias("rank", "e")).select("u", "q", "rank", "e.v")
            if behind is not None:
                each = each.join(behind, ["u", "v"], "left_anti")
            order = Window.partitionBy("u").orderBy("rank")
            chosen = self.stage.put(each.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= EXPAND).select("u", "q", "v"))
            if chosen.isEmpty():
                break
            done, before = chosen.select("u", "v"), behind
            behind = self.stage.put(done if before is None else before.union(done))
            if before is not None:
                self.stage.drop(before)
            new = chosen.join(ahead, "v").select("u", "q", F.explode("next").alias("v")).distinct()
            offers = new.join(codes, "v").select("u", "v", "q", "qv").mapInArrow(compare, schema)
            old, view = view, self._view(view, offers)
            self.stage.drop(old, chosen)
        pairs = view.select("u", F.explode(F.slice("edges", 1, 2 * k)).alias("e")).select("u", "e.v")
        left = fine.select("u", F.col("vector").alias("x"))
        right = self.vectors.select(F.col("cid").alias("v"), F.col("vector").alias("y"))
        exact = pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(_cosines(dims), _COSINE)
        ordinal = F.row_number().over(Window.partitionBy("cid").orderBy("pos"))
        first = self.rows.select("cid", "pos").withColumn("n", ordinal).filter(F.col("n") <= k)
        rows = exact.join(first.select(F.col("cid").alias("v"), F.col("pos").alias("neighbour")), "v")
        best = Window.partitionBy("u").orderBy(F.desc("cosine"), "neighbour")
        ranked = rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        return ranked.select(F.col("u").alias("id"), "neighbour", "cosine", "rank")

    # -- results -------------------------------------------------------------------------------------

    def _exact(self, pairs: DataFrame) -> DataFrame:
        """``u, v, cosine`` for pairs ``u < v`` of classes, from the given numbers."""
        left = self.vectors.select(F.col("cid").alias("u"), F.col("vector").alias("x"))
        right = self.vectors.select(F.col("cid").alias("v"), F.col("vector").alias("y"))
        return pairs.join(left, "u").join(right, "v").select("u", "v", "x", "y").mapInArrow(_cosines(self.dims), _COSINE)

    def neighbours(self, k: int, least: float | None = None) -> DataFrame:
        """``pos, neighbour, cosine, rank``: the ``k`` most similar rows of each row, on a tie smaller ``pos``
        first; only those of at least ``least``, if given."""
        if not self.count:
            return self.spark.createDataFrame([], "pos bigint, neighbour bigint, cosine double, rank int")
        edges = self.graph.select("u", F.explode("edges").alias("e")).select("u", "e.v", "e.s")
        if least is not None:
            edges = edges.filter(F.col("s") >= least - SLACK)
        pairs = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        exact = self.stage.put(self._exact(pairs))
        if least is not None:
            exact = exact.filter(F.col("cosine") >= least)
        both = exact.union(exact.select(F.col("v").alias("u"), F.col("u").alias("v"), "cosine"))
        ordinal = F.row_number().over(Window.partitionBy("cid").orderBy("pos"))
        first = self.rows.select("cid", "pos").withColumn("n", ordinal).filter(F.col("n") <= k + 1).drop("n")
        first = self.stage.put(first)
        near = both.join(first.select(F.col("cid").alias("v"), F.col("pos").alias("neighbour")), "v")
        alike = first.select(F.col("cid").alias("u"), F.col("pos").alias("neighbour"), F.lit(1.0).alias("cosine"))
        offered = near.select("u", "neighbour", "cosine").union(alike)
        best = Window.partitionBy("u").orderBy(F.desc("cosine"), "neighbour")
        best = offered.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
        lists = best.groupBy(F.col("u").alias("cid")).agg(
            F.array_sort(F.collect_list(F.struct("n", "neighbour", "cosine"))).alias("l")
        )
        mine = self.rows.select("cid", "pos").join(lists, "cid")
        others = F.slice(F.filter("l", lambda x: x.neighbour != F.col("pos")), 1, k)
        out = mine.select("pos", F.posexplode(others).alias("rank", "x"))
        return out.select("pos", "x.neighbour", "x.cosine", (F.col("rank") + 1).alias("rank"))

    def similar_pairs(self, k: int, least: float) -> DataFrame:
        """``a, b``: pairs of which one is among the ``k`` most similar of the other, with at least ``least``."""
        near = self.neighbours(k, least)
        return near.select(F.least("pos", "neighbour").alias("a"), F.greatest("pos", "neighbour").alias("b")).distinct()


_COSINE = StructType([StructField("u", LongType()), StructField("v", LongType()), StructField("cosine", DoubleType())])


def _cosines(dims: int):
    """Cosines of ``x`` and ``y`` in double precision."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x = _unit(b.column("x").flatten().to_numpy(zero_copy_only=False), dims)
            y = _unit(b.column("y").flatten().to_numpy(zero_copy_only=False), dims)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array((x * y).sum(axis=1))], names=_COSINE.names)

    return run


_STATE_EDGES = "array<struct<v:bigint,s:float,fresh:boolean>>"


def _edges_batch(names, columns, counts, v, s, fresh=None) -> pa.RecordBatch:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    fields = [pa.array(v, pa.int64()), pa.array(s, pa.float32())]
    labels = ["v", "s"]
    if fresh is not None:
        fields.append(pa.array(fresh, pa.bool_()))
        labels.append("fresh")
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=labels))
    return pa.RecordBatch.from_arrays([*columns, lists], names=[*names, "edges"])
