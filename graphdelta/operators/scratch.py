"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local folder if the master is local (tests), else an error: executors of a cluster
    would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return (found or "file://" + os.path.join(tempfile.gettempdir(), f"graphdelta-shared-{os.getpid()}")).rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Written as Parquet and read back: cuts the lineage of loops, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graphdelta/op-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: merged, never broadcast. Catalyst goes by the size of compressed files, of which a
    few MB can be hundreds once they reach the driver."""
    return df.hint("merge")
