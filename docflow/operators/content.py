"""The content model: sources, artifacts derived from them, validation and provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

from docflow.errors import error_column
from docflow.functions.text import sha256_hex
from docflow.session import Stage


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


_S, _I, _L, _D = StringType(), IntegerType(), LongType(), DoubleType()
HANDLE = _struct(backend=_S, key=_S)
METADATA = MapType(_S, _S)
SOURCE = _struct(id=_S, media_type=_S, hash=_S, raw=HANDLE, metadata=METADATA)
ARTIFACT = _struct(id=_S, media_type=_S, derived_from=_S, text=_S, blob=HANDLE, metadata=METADATA)
CHUNK = _struct(artifact_id=_S, chunk_index=_I, text=_S, start_byte=_I, end_byte=_I, token_count=_I)
CHUNK_VALUE = _struct(text=_S, index=_I, token_count=_I)
INPUT = _struct(pos=_L, source_id=_S, artifact_id=_S, chunk=CHUNK_VALUE, title=_S, metadata=METADATA)
MODEL = _struct(provider=_S, name=_S)
RECORD = _struct(
    pos=_L, source_id=_S, artifact_id=_S, chunk_index=_I, text=_S, vector=ArrayType(FloatType()), model=MODEL, token_count=_I, metadata=METADATA
)
BOX = _struct(x0=_D, y0=_D, x1=_D, y1=_D)
WORD = _struct(text=_S, box=BOX, block=_I, line=_I, conf=_I)
PAGE_LAYOUT = _struct(number=_I, width=_D, height=_D, rotation=_I, words=ArrayType(WORD))
LAYOUT = _struct(version=_I, engine=_S, box=_S, pages=ArrayType(PAGE_LAYOUT))
PAGE_TEXT = _struct(text=_S, spans=ArrayType(_struct(start=_I, end=_I)))
OBJECT_INFO = _struct(key=_S, size=_L, created=TimestampType())


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def validate_sources(sources: DataFrame) -> DataFrame:
    """``sources`` with ``error``: the code of the first thing missing, null for a valid one. Null counts as empty."""
    error = error_column((_empty(F.col("id")), "MISSING_ID"), (_empty(F.col("media_type")), "MISSING_MEDIA_TYPE"))
    return sources.withColumn("error", error)


def validate_artifacts(artifacts: DataFrame) -> DataFrame:
    """``artifacts`` with ``error``; the payload isn't looked at."""
    error = error_column(
        (_empty(F.col("id")), "MISSING_ID"),
        (_empty(F.col("media_type")), "MISSING_MEDIA_TYPE"),
        (_empty(F.col("derived_from")), "MISSING_PARENT"),
    )
    return artifacts.withColumn("error", error)


def hashed(df: DataFrame, value: str = "text") -> DataFrame:
    """``df`` with ``hash`` and ``n_bytes`` of a text or binary column."""
    return df.withColumns({"hash": sha256_hex(F.col(value)), "n_bytes": F.octet_length(value)})


def text_artifact(parent: Column, text: Column) -> Column:
    """A plain-text artifact's struct; its id is the caller's to give."""
    return F.struct(
        F.lit("").alias("id"), F.lit("text/plain").alias("media_type"), parent.alias("derived_from"), text.alias("text"),
        F.lit(None).cast(HANDLE).alias("blob"), F.lit(None).cast(METADATA).alias("metadata"),
    )


def text_artifacts(artifacts: DataFrame) -> DataFrame:
    """Artifacts that are text and not empty."""
    return artifacts.filter(F.col("blob").isNull() & ~_empty(F.col("text")))


def single_text_artifact(artifacts: DataFrame) -> DataFrame:
    """For each parent its only text artifact, or why there isn't just one: derived_from, n, text, error."""
    is_text = F.col("blob").isNull() & ~_empty(F.col("text"))
    n = F.sum(F.when(is_text, 1).otherwise(0))
    counted = artifacts.groupBy("derived_from").agg(n.alias("n"), F.min(F.when(is_text, F.col("text"))).alias("text"))
    error = error_column((F.col("n") == 0, "NO_TEXT_ARTIFACT"), (F.col("n") > 1, "MULTIPLE_TEXT_ARTIFACTS"))
    return counted.select("derived_from", "n", F.when(F.col("n") == 1, F.col("text")).alias("text"), error.alias("error"))


def children(artifacts: DataFrame) -> DataFrame:
    """``parent, children``: distinct artifacts derived directly from a source or artifact."""
    pairs = artifacts.filter(~_empty(F.col("derived_from"))).select(F.col("derived_from").alias("parent"), "id").distinct()
    return pairs.groupBy("parent").agg(F.count("*").alias("children"))


def provenance(artifacts: DataFrame) -> DataFrame:
    """``id, root, depth`` of every artifact: the ancestor that isn't an artifact itself, and the steps to it.

    Paths double in each round (an artifact's parent's path is taken over whole), so a tree of depth d takes
    log2(d) joins. What still moves once paths are longer than there are artifacts hangs on a cycle and has a null
    root. Repeated rows count once; of several parents under one id the smallest counts.
    """
    stage = Stage(artifacts.sparkSession)
    parents = artifacts.filter(~_empty(F.col("id"))).groupBy("id").agg(F.min(F.coalesce("derived_from", F.lit(""))).alias("up"))
    paths = stage.put(parents.select("id", "up", F.lit(1).cast("bigint").alias("depth"), F.lit(True).alias("moved")))
    reach, count = 1, paths.count()
    while reach <= count:
        above = paths.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = paths.join(above, "up", "left")
        moved = stage.put(
            joined.select(
                "id", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")
            )
        )
        stage.drop(paths)
        paths, reach = moved, reach * 2
        if paths.filter("moved").isEmpty():
            break
    known = paths.select(F.col("id").alias("up"), F.lit(True).alias("cyclic"))
    fine = F.col("cyclic").isNull()
    done = paths.join(known, "up", "left")
    return done.select("id", F.when(fine, F.col("up")).alias("root"), F.when(fine, F.col("depth")).cast("int").alias("depth"))


def running_total(df: DataFrame, key: list[str], order: str, value: str, out: str, width: int = 1000) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the key's rows before each in the order of the integer ``order``.

    A key's rows are added up in parts of ``width`` places, and only the parts' sums in one go, so that no task has
    to order a whole large key. Rows of one key need different places; null values count as 0.
    """
    part = df.withColumns({"__part": F.floor(F.col(order) / width), "__value": F.coalesce(F.col(value), F.lit(0)).cast("bigint")})
    sums = part.groupBy(*key, "__part").agg(F.sum("__value").alias("__sum"))
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*key, "__part", F.coalesce(F.sum("__sum").over(before(key, "__part")), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum("__value").over(before([*key, "__part"], order)), F.lit(0))
    joined = part.withColumn("__within", within).join(base, [*key, "__part"])
    return joined.withColumn(out, F.col("__base") + F.col("__within")).select(*df.columns, out)
