"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from struklake import schemas


def read_tokens(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Raw OCR hits, with the schema given rather than inferred."""
    return spark.read.schema(schemas.TOKENS).format(fmt).load(path)


def read_manifest(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).format(fmt).load(path)


def read_lines(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.LINES).format(fmt).load(path)


def read_permissive(spark: SparkSession, path: str, schema: str, raw: str = "raw") -> DataFrame:
    """JSON rows of the schema; of rows that cannot be read all columns are null but `raw`, which keeps the text."""
    rows = spark.read.schema(f"{schema}, {raw} string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", raw).json(path)
    return rows.select(*[F.when(F.col(raw).isNull(), F.col(c)).alias(c) for c in rows.columns if c != raw], raw)


def complete(lines: DataFrame) -> DataFrame:
    """Lines with all columns of the table: those that are absent are null, and each use fills in its own default."""
    kinds = dict(part.strip().split(" ") for part in schemas.LINES.split(","))
    return lines.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in lines.columns})


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A metric log: one JSON document, an array of epochs or an object of arrays."""
    return spark.read.option("multiLine", True).json(path)


def read_label_map(spark: SparkSession, path: str, field: str = "idx2label") -> DataFrame:
    """(id, label) of a JSON label dictionary."""
    raw = spark.read.option("multiLine", True).schema(f"{field} map<string,string>").json(path)
    return raw.select(F.explode(field).alias("id", "label")).withColumn("id", F.col("id").cast("int"))


def label_name(index: Column, names: tuple[str, ...] = schemas.LINE_CLASSES) -> Column:
    """Class name of a model's output index; null outside the list."""
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def write_results(results: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """The response record of every receipt: success, store, date, items and total."""
    item = lambda i: F.struct(i["name"].alias("name"), i["qty"].alias("qty"), i["price"].alias("price"))
    results.select(
        "receipt_id", "success", "store", "date", F.transform("items", item).alias("items"), "total"
    ).write.format(fmt).mode(mode).save(path)


def write_audit(audit: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All lines, one folder per class, so that a class is read without the others."""
    audit.write.partitionBy("class").mode(mode).parquet(path)
