"""Session helpers: a tuned session for local runs, and the shared folder of a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(app: str = "reviewlake", cores: str = "8", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_fallback: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    A local session without the setting, as in tests, gets a temporary folder; on a cluster that would be a folder
    of each machine, so there the setting must be there.
    """
    global _fallback
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="reviewlake-")
        spark.sparkContext.setCheckpointDir(_fallback)
    return _fallback


def run_folder(spark: SparkSession, name: str) -> str:
    """A new sub-folder of the shared folder, one per call."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = run_folder(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
