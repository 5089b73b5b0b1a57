"""Session helpers: lineage cuts and the size checks behind broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast by hand only below this many bytes; see `small_enough`.
BROADCAST_BYTES = 256 << 20


def session(app: str = "evenkeel", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for cut tables: the session's `spark.checkpoint.dir`.

    A machine-local folder is made only in local mode with the setting unset.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    Ends the lineage, survives the loss of executors, and gives the optimizer
    the true size, so that later joins pick broadcast or shuffle on facts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sorted_join(df: DataFrame) -> DataFrame:
    """Hint that a join with `df` sorts both sides.

    A written table of few distinct values takes far fewer bytes in its files than in memory, so
    by its file size the planner would send millions of rows through the driver as a broadcast.
    """
    return df.hint("merge")


def small_enough(rows: int, bytes_per_row: int) -> bool:
    return rows * bytes_per_row <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame, bytes_per_row: int) -> DataFrame:
    """Hint a broadcast when the counted size allows it; otherwise let Spark shuffle."""
    return F.broadcast(df) if small_enough(df.count(), bytes_per_row) else df
