"""Session helpers shared by the entry points, the bench and the tests."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parley")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config(SPREAD, str(shuffle_partitions))
        .getOrCreate()
    )


#: A session setting: into so many parts `table` deals what it reads. A caller sets it where tables are single files of one row
#: group, which are one task each; unset, as on a cluster, tables stay as they are stored.
SPREAD = "spark.parley.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    rows, parts = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")), spark.conf.get(SPREAD, None)
    return rows.repartition(int(parts)) if parts else rows


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir; only a local session without one gets a
    temporary folder."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set, and executors share no other folder")
        root = tempfile.mkdtemp(prefix="parley-shared-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, where the lineage ends."""
    shared_root(df.sparkSession)
    return df.checkpoint()
