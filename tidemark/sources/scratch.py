"""Intermediate tables in the folder that the session names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Where none is set, a local session takes a new folder of its own; on a cluster each
    machine would have another one, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named is None and current is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
    if current is None:
        sc.setCheckpointDir(named)
    return named or current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and go on from its files.

    Unlike ``checkpoint()``, which keeps the size *estimate* of the plan it replaces
    (in a loop of joins that estimate squares every round), the files carry their real
    size, so later joins choose broadcast or shuffle by fact.
    """
    path = new_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
