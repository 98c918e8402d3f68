"""Cutting lineage in iterative plans."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the folder that the cluster shares and read it back, so that lost executors cost no recomputation."""
    return df.sparkSession.read.schema(df.schema).parquet(store(df, label))


def store(df: DataFrame, label: str) -> str:
    """Write df to a new folder below the one that the cluster shares, and say where.

    The folder is spark.checkpoint.dir. Only where that is unset and Spark runs on this machine alone, as in tests, a folder of this machine
    is used; a cluster without it is an error.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "weblens-checkpoints")
    path = f"{base.rstrip('/')}/weblens/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path
