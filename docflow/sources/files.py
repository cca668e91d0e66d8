"""Files as sources and sinks: scans bounded by size, addresses of stores, atomic replacement."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.operators.extract import MAX_SOURCE_BYTES

_SCHEMES = {"gcs": "gs", "gs": "gs", "s3": "s3a", "s3a": "s3a", "fs": "file", "file": "file"}


def store_uri(backend: str, bucket: str, key: str = "") -> str:
    """The address of an object or prefix for Hadoop's connectors; credentials are the cluster's configuration."""
    if backend not in _SCHEMES:
        raise ValueError(f"unknown backend {backend!r}")
    if not bucket:
        raise ValueError("the bucket is empty")
    path = quote(key.lstrip("/"), safe="/~!$&'()*+,;=:@-._")
    return f"file:///{bucket.strip('/')}/{path}" if _SCHEMES[backend] == "file" else f"{_SCHEMES[backend]}://{bucket}/{path}"


def emulator_conf(endpoint: str) -> dict[str, str]:
    """Hadoop settings for a store emulator, to be given to the session's builder."""
    if not endpoint:
        raise ValueError("the endpoint is empty")
    return {"spark.hadoop.fs.gs.storage.root.url": endpoint, "spark.hadoop.fs.gs.auth.type": "UNAUTHENTICATED", "spark.hadoop.fs.s3a.endpoint": endpoint}


def scan(spark: SparkSession, path: str, *, glob: str | None = None, max_bytes: int = MAX_SOURCE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files ``key, size, created, content`` up to ``max_bytes``, and ``key, size, error`` of larger ones.

    The limit is pushed into the scan: the bytes of larger files are never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    files = reader.load(path)
    named = files.withColumnsRenamed({"path": "key", "length": "size", "modificationTime": "created"})
    fine = named.filter(F.col("size") <= max_bytes).select("key", "size", "created", "content")
    large = named.filter(F.col("size") > max_bytes).select("key", "size", F.lit("SOURCE_TOO_LARGE").alias("error"))
    return fine, large


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``key, size, created`` of the files under a path; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("created"))


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as parquet in place of what is at ``path``: readers see the old table until the new one is whole."""
    spark = df.sparkSession
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = fs.exists(hadoop(path))
    if there and not fs.rename(hadoop(path), hadoop(old)):
        raise OSError(f"can't move {path}")
    if not fs.rename(hadoop(staged), hadoop(path)):
        if there:
            fs.rename(hadoop(old), hadoop(path))
        raise OSError(f"can't move {staged}")
    if there:
        fs.delete(hadoop(old), True)
