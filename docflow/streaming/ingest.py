"""The batch transforms on streams of files: extraction, chunking, embedding as sources arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docflow.functions.text import sha256_hex
from docflow.kernels.embedding import EmbedConfig, EmbeddingClient
from docflow.operators.chunk import chunk
from docflow.operators.embed import embed_run
from docflow.operators.extract import Registry, extract
from docflow.session import Stage

#: Media types by file extension.
EXTENSIONS = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "pdf": "application/pdf"}


def file_stream(spark: SparkSession, path: str, *, media_types: dict[str, str] = EXTENSIONS, watermark: str = "1 hour", files_per_trigger: int = 1000) -> DataFrame:
    """New files as sources ``id, media_type, content, hash, created``.

    A content that comes again within the watermark of modification times is dropped; state older than that is
    let go, and later files behind the watermark count as late.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    files = stream.load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kinds = F.create_map(*(F.lit(x) for pair in media_types.items() for x in pair))
    sources = files.select(
        F.col("path").alias("id"), F.coalesce(F.try_element_at(kinds, extension), F.lit("application/octet-stream")).alias("media_type"),
        "content", sha256_hex(F.col("content")).alias("hash"), F.col("modificationTime").alias("created"),
    )
    return sources.withWatermark("created", watermark).dropDuplicatesWithinWatermark(["hash"])


def chunk_stream(sources: DataFrame, registry: Registry, **options) -> DataFrame:
    """Chunks of a stream's (or a table's) sources; all steps are row-local, so they run in any output mode."""
    artifacts = extract(sources, registry).filter("error is null")
    return chunk(artifacts, ["derived_from", "ordinal"], **options)


def embed_sink(
    chunks: DataFrame, client_factory: Callable[[], EmbeddingClient], records_path: str, failures_path: str, checkpoint: str, cfg: EmbedConfig = EmbedConfig()
) -> DataStreamWriter:
    """A writer that embeds each micro-batch of chunks and appends records and failures.

    A micro-batch that is run again writes the folder of its number again. Positions only tell a micro-batch's
    chunks apart; they are given where the chunks lie and written with them, so no task sees all of them.
    """

    def write(batch: DataFrame, number: int) -> None:
        stage = Stage(batch.sparkSession)
        numbered = stage.put(batch.withColumn("pos", F.monotonically_increasing_id()))
        inputs = numbered.select(
            "pos", F.col("derived_from").alias("source_id"),
            F.concat_ws("#", "derived_from", F.col("ordinal").cast("string")).alias("artifact_id"),
            F.struct("text", F.col("chunk_index").alias("index"), "token_count").alias("chunk"),
            F.lit(None).cast("string").alias("title"), F.lit(None).cast("map<string,string>").alias("metadata"),
        )
        run = embed_run(inputs, client_factory, cfg, stage=stage)
        run.records.write.mode("overwrite").parquet(f"{records_path}/batch={number}")
        run.failures.write.mode("overwrite").parquet(f"{failures_path}/batch={number}")
        stage.clear()

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
