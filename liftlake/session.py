"""Session settings and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast by hint only when its row count was checked against this bound.
MAX_BROADCAST_ROWS = 200_000


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf) -> SparkSession:
    """Session for local runs; on a cluster the same code runs in the session spark-submit gives.

    ``shuffle_partitions`` is only the starting point there: adaptive execution
    coalesces small partitions and splits skewed ones.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName("liftlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        # Text matching is bound by CPU: coalescing must not leave cores idle.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """Fresh folder for checkpoints and written tables, visible to every executor.

    The cluster names the parent in ``spark.checkpoint.dir``. Only a session
    without that setting (local tests) falls back to a temporary folder.
    """
    base = _checkpoint_base(spark)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _checkpoint_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    base = tempfile.mkdtemp(prefix="liftlake-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_checkpoint_base(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as Parquet files of the shared folder, for results that several parts of a job read."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Add a broadcast hint after counting at most ``max_rows + 1`` rows.

    Beyond the bound the frame is returned as it is and Spark shuffles the join.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
