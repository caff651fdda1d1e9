"""Session helpers: one configured SparkSession, table reading and lineage cuts in shared storage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution on. On a cluster pass the master and a partition count that fits it."""
    builder = (
        SparkSession.builder.master(master)
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the setting is absent, a local session makes one of its own
    (tests); a cluster must name one, as its executors see no folder of the driver."""
    found = spark.sparkContext.getConf().get(CHECKPOINT) or spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT} must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone already
        pass


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Lineage ends there, so a lost executor costs a re-read and never a re-run of the stages above. Files are
    removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphloom-{os.getpid()}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, columns: list[str]) -> int:
    """Size of ``columns`` by the planner's statistics, or by one aggregate where the planner has none."""
    known = int(str(df.select(*columns)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if known < 1 << 50:
        return known
    from pyspark.sql import functions as F

    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0))
    return int(df.agg(F.sum(size)).first()[0] or 0)
