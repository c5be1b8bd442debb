"""Tables for a while, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def base_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it. Where that is unset, /tmp/checkpoints, but only if all of Spark runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (base or "/tmp/checkpoints").rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{base_dir(spark)}/loomtext-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and written as Parquet; a lost executor takes nothing with it, and what is random or depends on the layout stays as it is."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
