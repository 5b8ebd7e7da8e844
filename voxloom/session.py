"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Removes the shuffle files of a query at its end.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` wins.  Only a local master may fall back to a temporary folder; on a cluster
    a missing setting is an error, since a machine-local folder is lost with its executor.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="voxloom-checkpoint-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_lineage_and_shuffles(df: DataFrame) -> DataFrame:
    """``cut_lineage`` that also removes the shuffle files of ``df``, for steps that are repeated over large tables."""
    spark = df.sparkSession
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        return cut_lineage(df.select("*"))  # the setting counts when a frame is made
    finally:
        spark.conf.unset(_SHUFFLE_CLEANUP) if before is None else spark.conf.set(_SHUFFLE_CLEANUP, before)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-bound Python stages enough tasks.

    Only inputs with fewer partitions than half the cores are redistributed: those are small by
    definition (one split each), so the exchange moves little; large inputs keep their scan splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
