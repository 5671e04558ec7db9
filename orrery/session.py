"""Session, table loading, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it holds at most so many rows; beyond that the join shuffles.
BROADCAST_ROWS = 200_000


def session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; on a cluster pass an own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orrery")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that the cluster names in spark.checkpoint.dir.

    Only a local session may leave it unset, as tests do; it gets a temporary folder then.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is not None:
        named = sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        named = tempfile.mkdtemp(prefix="orrery-ckpt-", dir=os.environ.get("TMPDIR"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else as it is. The count is cut off at the limit."""
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def null_safe_key(c):
    """Loosely spelled identifiers are compared without surrounding space and letter case."""
    return F.upper(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))
