"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "quadrille") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUADRILLE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """``rows`` marked for broadcast if they are counted to be at most ``most``; else they are joined by shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; where it is unset, one of our own, but only if all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own
