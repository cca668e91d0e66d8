"""Near-duplicate texts by min-max hashing, with exact verification.

Each permutation gives two signature values, the smallest and the largest hash, so half the hash evaluations
are needed; minima and maxima are banded alike. Texts with one and the same set of shingles form a class, and
everything after that works on classes. Two classes that meet in a band are a candidate pair, whose similarity
is then computed from the whole sets.

A band bucket with more than ``HOT_BUCKET`` classes isn't expanded: its classes are compared by their rarest
shingles instead (prefix filter), which loses no pair at the threshold and doesn't meet in shared boilerplate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from docflow.llm.shingles import mix64, shingle_sets_of
from docflow.session import Stage

#: Rows of a band and bands: of pairs with a similarity of 0.6 one in 800 shares no band. With fewer rows
#: unrelated texts would meet so often that candidates grew with the square of the collection.
BAND_ROWS, BANDS = 4, 48
#: Classes of one bucket up to which its pairs are listed directly.
HOT_BUCKET = 200
#: Rows up to which a list of buckets or of texts' keys is sent to every task; beyond, the join is shuffled.
BROADCAST_KEYS = 200_000


def _multipliers() -> np.ndarray:
    """Odd multipliers of the permutations, the same on every machine."""
    return np.random.default_rng(20240229).integers(0, 1 << 31, BAND_ROWS * BANDS // 2, dtype=np.uint32) * 2 + 1


def signature(shingles: np.ndarray, multipliers: np.ndarray | None = None) -> np.ndarray:
    """Smallest and largest value under each permutation, minima first."""
    multipliers = _multipliers() if multipliers is None else multipliers
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    values = low[None, :] * multipliers[:, None]
    return np.concatenate([values.min(axis=1), values.max(axis=1)])


def band_keys(signatures: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """One 64-bit key a band for each row of signatures; minima and maxima take turns within a band."""
    n = len(signatures)
    rows = signatures.reshape(n, 2, -1).transpose(0, 2, 1).reshape(n, BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)[None, :] + (salts.astype(np.uint64) * np.uint64(1000) + np.uint64(1))[:, None]
    for k in range(BAND_ROWS):
        keys = mix64((keys ^ rows[:, :, k]) * np.uint64(0x9E3779B97F4A7C15))
    return keys.view(np.int64)


def _set_id(shingles: np.ndarray, salt: int) -> int:
    """64 bits that name a set of shingles; two sets get one name with probability 2**-64."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=salt)).view(np.int64))


def signatures(docs: DataFrame, width: int, least: int) -> DataFrame:
    """``field, key, cid, n, bands`` of the texts with at least ``least`` distinct shingles.

    ``docs`` has ``field int, key string, text string``. The class ``cid`` stands for the set of shingles and
    the field, so that texts of different fields never meet.
    """
    schema = docs.select("field", "key").schema.add("cid", LongType()).add("n", IntegerType())
    schema = schema.add("bands", ArrayType(LongType()))

    def run(batches):
        multipliers = _multipliers()
        for batch in batches:
            fields = batch.column("field").to_pylist()
            rows, ids, sizes, signed = [], [], [], []
            for i, shingles in enumerate(shingle_sets_of(batch.column("text").to_pylist(), width)):
                if len(shingles) < least:
                    continue
                rows.append(i)
                ids.append(_set_id(shingles, fields[i]))
                sizes.append(len(shingles))
                signed.append(signature(shingles, multipliers))
            salts = np.array([fields[i] for i in rows], dtype=np.int64)
            bands = band_keys(np.stack(signed), salts) if rows else np.empty(0, np.int64)
            at = pa.array(rows, pa.int64())
            flat = pa.array(bands.ravel())
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("field").take(at),
                    batch.column("key").take(at),
                    pa.array(ids, pa.int64()),
                    pa.array(sizes, pa.int32()),
                    pa.ListArray.from_arrays(offsets, flat),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """``cid, shingles`` of texts given as ``cid, field, text``; only texts whose set is that of the class.

    32 bits of each shingle are enough within a pair: that two of a few hundred agree by chance changes one
    count in ten thousand pairs by one.
    """
    schema = texts.select("cid").schema.add("shingles", ArrayType(IntegerType()))

    def run(batches):
        for batch in batches:
            sets, rows = [], []
            ids, fields = batch.column("cid").to_pylist(), batch.column("field").to_pylist()
            for i, shingles in enumerate(shingle_sets_of(batch.column("text").to_pylist(), width)):
                if _set_id(shingles, fields[i]) == ids[i]:
                    rows.append(i)
                    sets.append((shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
            offsets = np.zeros(len(sets) + 1, dtype=np.int32)
            np.cumsum([len(s) for s in sets], out=offsets[1:])
            flat = np.concatenate(sets) if sets else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(rows, pa.int64())), lists], names=schema.names)

    return texts.select("cid", "field", "text").mapInArrow(run, schema)


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs that can reach ``threshold``, found by their rarest shingles.

    With shingles in order of rarity, two sets of that similarity share one among the first
    ``n - ceil(threshold * n) + 1`` of either.
    """
    each = sets.select("cid", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    rarity = each.groupBy("s").agg(F.count("*").alias("df"))
    order = Window.partitionBy("cid").orderBy("df", "s")  # one text's shingles
    ranked = each.join(rarity.filter("df > 1"), "s", "left").fillna({"df": 1})
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    prefix = ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).filter("df > 1")
    prefix = prefix.withColumn("parts", _parts(F.col("df")))
    left = _dealt(prefix, "cid").select("s", "part", F.col("cid").alias("a"), F.col("n").alias("na"))
    right = _repeated(prefix).select("s", "part", F.col("cid").alias("b"), F.col("n").alias("nb"))
    near = (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
    return left.join(right, ["s", "part"]).filter((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _parts(members: Column) -> Column:
    """Parts into which one side of a group of so many members is dealt, that no task joins a whole large group."""
    return F.ceil(members / HOT_BUCKET).cast("int")


def _dealt(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64(by), F.col("parts")).cast("int"))


def _repeated(df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


class NearDuplicates:
    """The steps of a near-duplicate search over ``docs`` (``field int, key string, text string``).

    ``members``: ``field, key, cid`` of every text with enough shingles; ``links``: ``a, b, similarity`` of
    classes. Null, empty and short texts have no shingles and are in neither. A key that repeats counts once,
    of different texts under one key the smallest.
    """

    def __init__(self, docs: DataFrame, *, width: int, threshold: float, least: int = 1, stage: Stage | None = None):
        self.stage = stage or Stage(docs.sparkSession)
        self.width, self.threshold = width, threshold
        docs = docs.filter(F.col("text").isNotNull() & F.col("key").isNotNull()).select("field", "key", "text")
        self.docs = docs
        signed = self.stage.put(signatures(docs, width, least))
        # Copies of a row have one class; a key with several keeps the smallest.
        self.members = self.stage.put(signed.groupBy("field", "key").agg(F.min("cid").alias("cid")))
        self.links = self._links(signed)

    @staticmethod
    def _small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df

    def _links(self, signed: DataFrame) -> DataFrame:
        stage = self.stage
        buckets = signed.select("cid", F.explode("bands").alias("band"))
        # Copies have equal bands and classes, so they go no further than the task that reads them.
        met = buckets.groupBy("band").agg(F.min("cid").alias("a"), F.max("cid").alias("b"))
        met = stage.put(met.filter("a != b").select("band"))
        many = stage.put(buckets.join(self._small(met), "band").distinct())
        stage.drop(met)
        stage.drop(signed)
        sizes = many.groupBy("band").agg(F.count("*").alias("m"))
        hot_bands = stage.put(sizes.filter(F.col("m") > HOT_BUCKET))
        few = many.join(F.broadcast(hot_bands) if hot_bands.count() <= BROADCAST_KEYS else hot_bands, "band", "left_anti")
        crossed = few.select("band", F.col("cid").alias("a")).join(few.select("band", F.col("cid").alias("b")), "band")
        pairs = stage.put(crossed.filter("a < b").select("a", "b").distinct())
        hot = many.join(hot_bands.select("band"), "band", "left_semi").select("cid").distinct()
        ids = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).union(hot).distinct()
        first = self.members.groupBy("cid").agg(F.min("key").alias("key"), F.min("field").alias("field"))
        wanted = stage.put(first.join(ids, "cid", "left_semi"))
        text = self.docs.join(self._small(wanted), ["field", "key"])
        # Of repeated rows and of a key with several texts only one set has the class's name.
        sets = stage.put(shingle_sets(text, self.width).dropDuplicates(["cid"]))
        if not hot_bands.isEmpty():
            pairs = pairs.union(_prefix_pairs(sets.join(hot, "cid", "left_semi"), self.threshold)).distinct()
        left = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        similarity = both / (F.size("sa") + F.size("sb") - both)
        scored = pairs.join(left, "a").join(right, "b").select("a", "b", similarity.alias("similarity"))
        links = stage.put(scored.filter(F.col("similarity") >= self.threshold))
        stage.drop(sets)
        return links

    def pairs(self) -> DataFrame:
        """Every pair of keys, the smaller first: copies with each other and the members of linked classes."""
        left = self.members.select("field", F.col("key").alias("a"), F.col("cid").alias("ca"))
        right = self.members.select("field", F.col("key").alias("b"), F.col("cid").alias("cb"))
        sizes = self.members.groupBy("cid").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("cid").alias("c"), _parts(F.col("m")).alias("parts"))
        one = _dealt(left.join(sizes, left.ca == sizes.c), "a").select("field", "c", "part", "a")
        other = _repeated(right.join(sizes, right.cb == sizes.c)).select("field", "c", "part", "b")
        copies = one.join(other, ["field", "c", "part"]).filter("a < b").select("field", "a", "b")
        linked = self.links.select(F.col("a").alias("ca"), F.col("b").alias("cb")).join(left, "ca")
        linked = linked.join(right.drop("field"), "cb")
        return copies.union(linked.select("field", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    def groups(self) -> DataFrame:
        """One row a text: ``field, key, class_key, group_key, copies, links``.

        The class's and the group's key is the smallest of their members; groups are the connected components
        of the links; ``links`` counts the other classes near this one.
        """
        ends = self.links.select(F.col("a").alias("cid")).union(self.links.select(F.col("b").alias("cid")))
        degree = ends.groupBy("cid").agg(F.count("*").alias("links"))
        roots = components(self.links.select("a", "b"), self.stage)
        classes = self.members.groupBy("cid").agg(F.min("key").alias("class_key"), F.count("*").alias("copies"))
        classes = classes.join(roots, "cid", "left").join(degree, "cid", "left")
        classes = classes.withColumn("root", F.coalesce("root", "cid")).fillna({"links": 0})
        tops = classes.groupBy("root").agg(F.min("class_key").alias("group_key"))
        classes = classes.join(tops, "root").drop("root")
        return self.members.join(classes, "cid").select("field", "key", "class_key", "group_key", "copies", "links")


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """``cid, root`` of every node of ``edges`` (``a, b``): root is the smallest node it is connected with.

    Alternating large and small stars: in each round every node hangs its larger (its smaller) neighbours on
    the smallest, until nothing changes. A round is two aggregations; no neighbourhood is ever gathered.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        kept = both if larger else both.filter("b < a")
        least = kept.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        hung = kept.join(least, "a")
        if larger:
            out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter("a != b").distinct()

    e = stage.put(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    check = None
    while True:
        new = stage.put(star(star(e, True), False))
        stage.drop(e)
        e = new
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if check == now:
            break
        check = now
    return e.select(F.col("a").alias("cid"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("cid"), F.col("b").alias("root")).distinct()
    )


#: The two fields of the project's texts.
FIELDS = {0: "artifact", 1: "chunk"}


def artifact_and_chunk_texts(artifacts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Both fields' texts as ``field, key, text``; a chunk's key is ``artifact_id#chunk_index``."""
    left = artifacts.select(F.lit(0).alias("field"), F.col("id").alias("key"), "text")
    key = F.concat("artifact_id", F.lit("#"), F.col("chunk_index").cast("string"))
    return left.union(chunks.select(F.lit(1).alias("field"), key.alias("key"), "text"))


def field_name(field: Column) -> Column:
    return F.when(field == 0, FIELDS[0]).otherwise(FIELDS[1])
