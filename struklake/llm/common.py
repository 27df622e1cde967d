"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: maximal runs of anything but the ASCII white space characters.
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as spark.checkpoint.dir names it. Where the session names none, a
    folder of our own serves a local master, as in tests; a cluster gets an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints-{uuid.uuid4().hex}")
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts the lineage and
    keeps results readable after the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def drop_clashing(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that would clash with columns an operator adds."""
    lowered = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lowered])
