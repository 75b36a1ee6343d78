"""Cutting lineage so that lost executors cost one stage, not the whole job."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` of the session; a local folder only where it is unset.

    On a cluster the setting names a folder that all executors share. The local
    fallback serves tests in local mode and is refused anywhere else.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        shared = tempfile.mkdtemp(prefix="commitloom-ckpt-")
    sc.setCheckpointDir(shared)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` read back from a reliable checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)
