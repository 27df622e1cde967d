"""Tables and folders for data in between, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where the session names none, a folder of our own
    serves a local master, as in tests; a cluster gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints-{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder: several readers share it, each reads its own columns only,
    and a lost executor costs no more than reading it again."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
