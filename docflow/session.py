"""Session helpers: table access, shared staging folder, bounded broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is at most this many bytes.
BROADCAST_LIMIT_BYTES = 8 << 20
#: Fixed value: the setting by which Spark removes a query's shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(app: str = "docflow", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the cluster names none (tests on one machine) a temporary folder takes its place.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docflow-"))
    return spark.sparkContext.getCheckpointDir()


class Stage:
    """Tables written to the shared folder to cut lineage.

    Written parquet survives the loss of executors, keeps its columns compressed and has sizes that
    the planner can use. Everything still there is removed when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/docflow-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.clear)

    def put(self, df: DataFrame, *, partition_by: Iterable[str] = ()) -> DataFrame:
        """Write ``df`` and read it back. What was shuffled for it leaves the executors' disks when it is written."""
        self.count += 1
        path = f"{self.root}/{self.count:04d}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.staged_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        for df in tables:
            path = df.__dict__.pop("staged_at", None)
            if path:
                self._delete(path)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone already; the folder belongs to the cluster
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def plan_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """A broadcast hint only where the plan's size estimate is within ``limit``; else a shuffled join."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df
