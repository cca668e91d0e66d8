"""Mixing sources to target weights by iterative proportional fitting and calibrated sampling.

Topics are clusters of the documents themselves, by the tokens they use beyond what their language uses. The tokens
of each cell (source, language, topic) are raked to three margins: the target weights of the sources, and the
languages' and topics' own shares of the corpus. A cell never gets more than its tokens times the source's cap on
repeats; the source margin is met last and so exactly. Every document of a cell is then taken with the cell's
expected number of copies, by systematic sampling along (cell, length class), whose running totals are kept in
whole millionths, so that no document exceeds the cap. What a source's tokens then differ from its target is made
good document by document in running totals, so each source ends within one document's tokens of its weight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType

from docflow.functions.text import utrim
from docflow.llm.tokens import RANK_FILE, encode
from docflow.operators.content import running_total
from docflow.session import Stage

#: More target rows than this are refused: they are configuration and go to the driver.
MAX_TARGETS = 10_000
#: Parts of one expected copy.
UNIT = 1_000_000
#: Documents of one stratum that are ranked together in one task, at most about.
STRATUM_GROUP = 100_000

#: Clusters that are taken as topics, steps in which they are found at most, numbers of a document's sketch.
TOPICS, ROUNDS, SKETCH = 8, 20, 48
#: Parts of one in which sums of sketches are counted.
PART = 1 << 24
#: Times that a source's tokens are brought nearer to its target.
TURNS = 2
#: Token ids are hashed into so many rows of random numbers.
TOPIC_ROWS = 1 << 14


@dataclass(frozen=True)
class Cell:
    source: str
    lang: str
    topic: str


def source_key(source: Column) -> Column:
    """One spelling of a source: trimmed, lower case, words joined by underscores."""
    return F.regexp_replace(F.lower(utrim(source)), r"[\s_-]+", "_")


def lang_key(lang: Column) -> Column:
    """Two-letter primary language tag; ``und`` for anything else, so that there are few values."""
    tag = F.regexp_extract(F.lower(utrim(lang)), r"\A([a-z]{2})(?:[-_].*)?\z", 1)
    return F.when(F.coalesce(tag, F.lit("")) != "", tag).otherwise(F.lit("und"))


def sketch_of(ids: list[int], table: np.ndarray) -> np.ndarray:
    """A document's tokens as a short vector: each token's random numbers, often used ones damped."""
    rows, counts = np.unique(np.asarray(ids, dtype=np.int64) % TOPIC_ROWS, return_counts=True)
    vector = np.sqrt(counts) @ table[rows]
    return vector / max(np.linalg.norm(vector), 1e-9)


def _table() -> np.ndarray:
    return np.random.default_rng(29).standard_normal((TOPIC_ROWS, SKETCH)).astype(np.float32)


def _sketches(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sketch").drop_null().to_pylist()), dtype=np.float32).reshape(-1, SKETCH)


def measured(documents: DataFrame, rank_file: str = RANK_FILE) -> DataFrame:
    """``doc_id, source, lang, tokens, sketch`` of each document, in one pass over the texts; a sketch is the bytes of its
    numbers, and a document without tokens has none."""
    keep = ["doc_id", "source", "lang"]
    slim = documents.select(
        "doc_id", source_key(F.col("source")).alias("source"), lang_key(F.col("lang")).alias("lang"), "text"
    )
    schema = slim.select(*keep).schema.add("tokens", IntegerType()).add("sketch", BinaryType())

    def run(batches):
        table = _table()
        for batch in batches:
            ids = [encode(t, rank_file) for t in batch.column("text").to_pylist()]
            sketches = pa.array([sketch_of(x, table).astype(np.float32).tobytes() if x else None for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(map(len, ids), pa.int32()), sketches], names=schema.names)

    return slim.mapInArrow(run, schema)


class Topics:
    """Clusters of all documents' sketches, each language's mean taken off, so that languages aren't the topics.

    Found by spherical k-means over the whole table, which each step goes through where it lies. The driver gets sums:
    a row a language, once, and a row a task and cluster in each step. They are whole numbers, so that their order
    doesn't matter.
    """

    def __init__(self, sizes: DataFrame, seed: int = 7):
        rows = sizes.filter("sketch is not null").select("doc_id", "lang", "sketch")
        self.means, self.overall = self._language_means(rows)
        centres = self._first(rows, seed)
        self.centres = centres
        while 0 < len(centres) < TOPICS:  # each next one is far from those there are
            another = self._far(rows, centres, seed + len(centres))
            if another is None:
                break
            self.centres = centres = np.vstack([centres, another])
        for _ in range(ROUNDS if len(centres) else 0):
            sums = self._sums(rows, centres)
            there = sums.any(axis=1, keepdims=True)
            self.centres = np.where(there, sums / np.linalg.norm(sums, axis=1, keepdims=True).clip(1e-9), centres).astype(np.float32)
            if np.allclose(self.centres, centres, rtol=0, atol=1e-6):
                break
            centres = self.centres

    @staticmethod
    def _language_means(rows: DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The mean sketch of each language and of all."""

        def run(batches):
            sums: dict[str, np.ndarray] = {}
            counts: dict[str, int] = {}
            for batch in batches:
                langs = np.array(batch.column("lang").to_pylist(), dtype=object)
                x = np.rint(_sketches(batch) * PART).astype(np.int64)
                for lang in set(langs.tolist()):
                    own = langs == lang
                    sums[lang] = sums.get(lang, 0) + x[own].sum(axis=0)
                    counts[lang] = counts.get(lang, 0) + int(own.sum())
            if sums:
                columns = [np.array(c) for c in zip(*sums.values())]
                yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([counts[v] for v in sums], pa.int64()), *map(pa.array, columns)], names=names)

        names = ["lang", "n", *(f"s{k}" for k in range(SKETCH))]
        parts = rows.select("lang", "sketch").mapInArrow(run, "lang string, " + ", ".join(f"{c} bigint" for c in names[1:]))
        found = sorted(parts.groupBy("lang").agg(*(F.sum(c).alias(c) for c in names[1:])).collect(), key=lambda r: r.lang)
        total = np.array([list(r)[2:] for r in found], dtype=float).reshape(-1, SKETCH)
        means = {r.lang: (x / PART / r.n).astype(np.float32) for r, x in zip(found, total)}
        n = sum(r.n for r in found)
        return means, (total.sum(axis=0) / PART / max(n, 1)).astype(np.float32)

    def _first(self, rows: DataFrame, seed: int) -> np.ndarray:
        """The sketch of the document with the smallest hash."""
        first = rows.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").select("lang", "sketch").limit(1).collect()
        x = np.frombuffer(b"".join(bytes(r.sketch) for r in first), dtype=np.float32).reshape(-1, SKETCH)
        return self.centred(x, [r.lang for r in first])

    def _far(self, rows: DataFrame, centres: np.ndarray, seed: int) -> np.ndarray | None:
        """One document's sketch, drawn from all with chances by the distance from the nearest of ``centres``: of
        exponential waiting times with these rates the shortest. None if every document lies on one of them."""

        def run(batches):
            best = None
            for batch in batches:
                x = self.centred(_sketches(batch), batch.column("lang").to_pylist())
                far = (1 - (x @ centres.T).max(axis=1)).astype(float)
                wait = np.where(far > 1e-4, -np.log(batch.column("u").to_numpy()) / far.clip(1e-9), np.inf)
                k = int(wait.argmin()) if len(wait) else 0
                if len(wait) and np.isfinite(wait[k]) and (best is None or wait[k] < best[0]):
                    best = float(wait[k]), x[k].astype(np.float32).tobytes()
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]], pa.float64()), pa.array([best[1]], pa.binary())], names=["wait", "x"])

        uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        drawn = rows.select("lang", "sketch", uniform.alias("u")).mapInArrow(run, "wait double, x binary").collect()
        return np.frombuffer(min(drawn, key=lambda r: r.wait).x, dtype=np.float32) if drawn else None

    def _sums(self, rows: DataFrame, centres: np.ndarray) -> np.ndarray:
        """The sum of the documents that are nearest to each of ``centres``."""

        def run(batches):
            sums = np.zeros(centres.shape, dtype=np.int64)
            for batch in batches:
                x = self.centred(_sketches(batch), batch.column("lang").to_pylist())
                own = (x @ centres.T).argmax(axis=1)
                x = np.rint(x * PART).astype(np.int64)
                for k in set(own.tolist()):
                    sums[k] += x[own == k].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        parts = rows.select("lang", "sketch").mapInArrow(run, "sums binary").collect()
        return sum((np.frombuffer(r.sums, dtype=np.int64).reshape(centres.shape) for r in parts), np.zeros(centres.shape, np.int64)) / PART

    def centred(self, x: np.ndarray, langs) -> np.ndarray:
        x = x - np.array([self.means.get(v, self.overall) for v in langs], dtype=np.float32).reshape(-1, SKETCH)
        return x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-9)

    def of(self, sizes: DataFrame) -> DataFrame:
        """``sizes`` with ``topic`` in place of the sketch; ``none`` without tokens."""
        keep = ["doc_id", "source", "lang", "tokens"]
        schema = sizes.select(*keep).schema.add("topic", StringType())

        def run(batches):
            for batch in batches:
                column = batch.column("sketch")
                there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
                topics = np.full(batch.num_rows, "none", dtype=object)
                if len(there) and len(self.centres):
                    x = _sketches(batch)
                    langs = [batch.column("lang")[int(k)].as_py() for k in there]
                    topics[there] = [f"t{k}" for k in (self.centred(x, langs) @ self.centres.T).argmax(axis=1)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(topics, pa.string())], names=schema.names)

        return sizes.select(*keep, "sketch").mapInArrow(run, schema)


def _fill(x: np.ndarray, cap: np.ndarray, target: float) -> np.ndarray:
    """``min(cap, factor * x)`` with the factor that gives the sum ``target``, or all of ``cap``."""
    if cap.sum() <= target:
        return cap.copy()
    x = np.maximum(x, 1e-12 * np.maximum(cap, 1e-300))
    order = np.argsort(cap / x)
    x_left = x.sum()
    full = 0.0
    for k in order:
        factor = (target - full) / x_left
        if cap[k] >= factor * x[k]:
            return np.minimum(cap, factor * x)
        full += cap[k]
        x_left -= x[k]
    return cap.copy()


def rake(
    cells: list[tuple[Cell, int]], weights: dict[str, float], caps: dict[str, int], total: float | None = None, rounds: int = 50
) -> tuple[dict[Cell, float], float]:
    """Expected copies of a document of each cell, and the mixture's size in tokens.

    Without ``total`` the largest size is taken at which every source can have its weight. Sources of the
    targets without any tokens get nothing, the others share by their weights. With a ``total`` beyond the
    reach of a source that source gives all it may.
    """
    cells = [(c, n) for c, n in cells if weights.get(c.source, 0) > 0 and caps.get(c.source, 0) > 0 and n > 0]
    if not cells:
        return {}, 0.0
    tokens = np.array([n for _, n in cells], dtype=float)
    cap = tokens * np.array([caps[c.source] for c, _ in cells], dtype=float)
    groups = {}
    for axis in ("source", "lang", "topic"):
        names = [getattr(c, axis) for c, _ in cells]
        groups[axis] = {v: np.flatnonzero([n == v for n in names]) for v in sorted(set(names))}
    share = {s: weights[s] for s in groups["source"]}
    whole = sum(share.values())
    share = {s: w / whole for s, w in share.items()}
    reach = {s: cap[at].sum() for s, at in groups["source"].items()}
    size = min(reach[s] / share[s] for s in share) if total is None else total
    x = tokens * size / tokens.sum()
    for _ in range(rounds):
        for axis in ("lang", "topic"):
            for at in groups[axis].values():
                x[at] = _fill(x[at], cap[at], size * tokens[at].sum() / tokens.sum())
        for s, at in groups["source"].items():
            x[at] = _fill(x[at], cap[at], size * share[s])
    return {c: float(min(v / n, caps[c.source])) for (c, n), v in zip(cells, x)}, float(size)


def targets_of(mix_targets: DataFrame) -> tuple[dict[str, float], dict[str, int]]:
    """Weights and caps by source; of repeated sources the weights of equal rows count once."""
    rows = mix_targets.select(source_key(F.col("source")).alias("source"), "weight", "max_repeats").distinct()
    rows = rows.filter(F.col("source").isNotNull() & (F.col("weight") > 0)).limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    weights: dict[str, float] = {}
    caps: dict[str, int] = {}
    for r in rows:
        weights[r.source] = weights.get(r.source, 0.0) + r.weight
        caps[r.source] = max(caps.get(r.source, 0), 1 if r.max_repeats is None else r.max_repeats)
    return weights, caps


def mix(sizes: DataFrame, mix_targets: DataFrame, *, total: float | None = None, seed: int = 17, stage: Stage | None = None) -> DataFrame:
    """The mixture of ``sizes`` (``doc_id, source, lang, topic, tokens``): those and ``copies``.

    Only documents with at least one copy come out. Documents without tokens, of no source or of a source
    outside the targets are not part of it. The driver gets one row a cell: sources of the targets times at
    most 677 languages times the topics.
    """
    spark = sizes.sparkSession
    stage = stage or Stage(spark)
    weights, caps = targets_of(mix_targets)
    wanted = sizes.filter((F.col("tokens") > 0) & F.col("source").isin(*weights)) if weights else sizes.limit(0)
    axes = ["source", "lang", "topic"]
    cells = wanted.groupBy(*axes).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
    expected, _ = rake([(Cell(r.source, r.lang, r.topic), r.tokens) for r in cells], weights, caps, total)
    rows = [(c.source, c.lang, c.topic, round(e * UNIT), caps[c.source]) for c, e in expected.items()]
    rates = spark.createDataFrame(rows, "source string, lang string, topic string, rate bigint, cap int")
    salts = max(1, -(-max((r.n for r in cells), default=1) // STRATUM_GROUP))
    strata = [*axes, "length", "salt"]
    # One row a cell, as many as the driver just gathered: small enough to send to every task.
    drawn = (
        wanted.join(F.broadcast(rates), axes)
        .withColumn("length", F.floor(F.log2("tokens") * 2).cast("int"))
        .withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(salts)).cast("int"))
    )
    by_source = Window.partitionBy("source").orderBy("lang", "topic", "length", "salt")
    start = F.coalesce(F.sum("__sum").over(by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(UNIT))
    offsets = drawn.groupBy(*strata).agg(F.sum("rate").alias("__sum")).select(*strata, (start + first).alias("__start"))
    within = Window.partitionBy(*strata).orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    upto = F.col("__start") + F.sum("rate").over(within.rowsBetween(Window.unboundedPreceding, 0))
    copies = (F.floor(upto / UNIT) - F.floor((upto - F.col("rate")) / UNIT)).cast("int")
    first_draw = stage.put(drawn.join(offsets, strata).select("doc_id", *axes, "tokens", "rate", "cap", copies.alias("copies")))
    draw = first_draw
    for turn in range(TURNS):
        draw = stage.put(_calibrated(draw, seed + turn))
    stage.drop(first_draw)
    return draw.select("doc_id", *axes, "tokens", "copies").filter(F.col("copies") > 0)


def _calibrated(drawn: DataFrame, seed: int) -> DataFrame:
    """``drawn`` with single copies taken away or added until each source has its expected tokens, but for less than
    one document's: documents that aren't too large are gone through in an order of hashes, with running totals in
    parts. What is left after one turn is less than the largest of them, and the next turn takes smaller ones."""
    token_copies = F.col("tokens").cast("bigint") * F.col("copies")
    over = drawn.groupBy("source").agg((F.sum(token_copies) - F.round(F.sum(F.col("tokens") * F.col("rate") / UNIT)).cast("bigint")).alias("over"))
    marked = drawn.join(F.broadcast(over), "source")  # one row a source of the targets
    small = F.col("tokens") <= F.abs("over")
    may = small & (((F.col("over") > 0) & (F.col("copies") > 0)) | ((F.col("over") < 0) & (F.col("copies") < F.col("cap"))))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed + 2)), 1)
    ordered = marked.withColumns({"place": place, "weight": F.when(may, F.col("tokens")).otherwise(0)})
    total = running_total(ordered, ["source"], "place", "weight", "before", width=1 << 53)
    moved = (F.col("weight") > 0) & (F.col("before") + F.col("weight") <= F.abs("over"))
    copies = F.when(moved, F.col("copies") - F.signum(F.col("over")).cast("int")).otherwise(F.col("copies"))
    return total.withColumn("copies", copies).select(*drawn.columns)


def shares(mixture: DataFrame, sizes: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """For each source of the targets: its weight (of all weights), real share, tokens, documents, copies."""
    weights, caps = targets_of(mix_targets)
    whole = sum(weights.values())
    rows = [(s, w / whole, caps[s]) for s, w in weights.items()]
    targets = sizes.sparkSession.createDataFrame(rows, "source string, weight double, max_repeats int")
    got = mixture.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("tokens"),
        F.count("*").alias("documents"),
        F.sum("copies").alias("copies"),
        F.max("copies").alias("most_copies"),
    )
    there = sizes.filter("tokens > 0").groupBy("source").agg(F.sum("tokens").alias("available"))
    zero = {c: 0 for c in ("tokens", "documents", "copies", "most_copies", "available")}
    full = targets.join(got, "source", "left").join(there, "source", "left").fillna(zero)
    all_tokens = F.sum("tokens").over(Window.partitionBy())  # one row a source
    return full.withColumn("share", F.coalesce(F.try_divide("tokens", all_tokens), F.lit(0.0)))


def margins(mixture: DataFrame, sizes: DataFrame, mix_targets: DataFrame) -> DataFrame:
    """For languages and topics: share of the targets' corpus, which is the aim, and share of the mixture."""
    weights, _ = targets_of(mix_targets)
    corpus = sizes.filter((F.col("tokens") > 0) & F.col("source").isin(*weights)) if weights else sizes.limit(0)

    def by(df: DataFrame, tokens: Column, out: str) -> DataFrame:
        pair = F.explode(F.array(F.struct(F.lit("lang").alias("axis"), F.col("lang").alias("value")), F.struct(F.lit("topic").alias("axis"), F.col("topic").alias("value"))))
        sums = df.select(pair.alias("p"), tokens.alias("t")).groupBy("p.axis", "p.value").agg(F.sum("t").alias("t"))
        return sums.select("axis", "value", F.try_divide("t", F.sum("t").over(Window.partitionBy("axis"))).alias(out))

    have = by(corpus, F.col("tokens"), "aim")
    got = by(mixture, F.col("tokens") * F.col("copies"), "share")
    return have.join(got, ["axis", "value"], "left").fillna({"share": 0.0})


def mixture_stages(documents: DataFrame, mix_targets: DataFrame, *, rank_file: str = RANK_FILE, stage: Stage | None = None):
    """``(mixture, sizes)``; the sizes are written once, as the texts are read and encoded only once."""
    stage = stage or Stage(documents.sparkSession)
    sketches = stage.put(measured(documents, rank_file))
    sizes = stage.put(Topics(sketches).of(sketches))
    stage.drop(sketches)
    return mix(sizes, mix_targets, stage=stage), sizes
