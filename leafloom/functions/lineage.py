"""Cutting a plan's lineage in the folder that all machines share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed under ``spark.checkpoint.dir``. A local session that names no
    such folder gets a temporary one; on a cluster that is an error, since machines share no such folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
