"""Dictionaries and label lists as tables: joins that broadcast only what has been measured.

Defined results: entries with a null key are left out, of several for one key the smallest value holds; rows that
find no entry keep what they have (words) or get null (labels); null texts stay null; an empty dictionary
changes nothing; empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from struklake.functions import text as t

#: A dictionary of at most so many rows and bytes of text is broadcast; a larger one is joined by sorting.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 8 << 20


def entries(table: DataFrame, key: Column, value: Column) -> DataFrame:
    """(__entry, __value), one row for each key."""
    return table.select(key.alias("__entry"), value.alias("__value")).filter("__entry is not null").groupBy("__entry").agg(
        F.min("__value").alias("__value"))


def is_small(table: DataFrame) -> bool:
    """Whether the measured size of `entries` is within the bounds of a broadcast."""
    size = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    rows, size_of_all = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size("__entry") + size("__value")), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size_of_all <= BROADCAST_BYTES


def looked_up(rows: DataFrame, key: Column, table: DataFrame) -> DataFrame:
    """`rows` with `__value`, the value of the key's entry, or null."""
    side = F.broadcast(table) if is_small(table) else table.hint("merge")
    keyed = rows.withColumn("__key", key)
    return keyed.join(side, keyed["__key"] == side["__entry"], "left").drop("__key", "__entry")


def correct_words(rows: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """`rows` with the words of a text column corrected by a dictionary of (word, correction): whole words in any
    case, whose case is restored. Words are joined one by one and put together in their order."""
    others = [c for c in rows.columns if c != text]
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    words = numbered.select(
        "__row", *others, F.posexplode_outer(F.split(t.squeeze(F.col(text)), " ")).alias("__pos", "__word"))
    fixed = looked_up(words, F.lower("__word"), entries(dictionary, F.lower("word"), F.col("correction"))).withColumn(
        "__word", F.coalesce(t.restore_case(F.col("__word"), F.col("__value")), F.col("__word")))
    ordered = F.transform(F.sort_array(F.collect_list(F.when(F.col("__pos").isNotNull(), F.struct("__pos", "__word")))), lambda w: w["__word"])
    joined = F.when(F.count("__pos") > 0, F.array_join(ordered, " "))
    return fixed.groupBy("__row").agg(*[F.first(c).alias(c) for c in others], joined.alias(text)).select(*rows.columns)


def label_names(rows: DataFrame, index: Column, labels: DataFrame) -> DataFrame:
    """`rows` with `label`, the name that the table of (id, label) gives to an index."""
    found = looked_up(rows.drop("label"), index.cast("int"), entries(labels, F.col("id").cast("int"), F.col("label")))
    return found.withColumnRenamed("__value", "label")
