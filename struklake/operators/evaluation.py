"""Quality of recognition and labelling, and summaries of metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Confidence from which a detection counts.
DETECTED = 0.5


def text_quality(pairs: DataFrame) -> DataFrame:
    """One row over (truth, predicted): character error rate and exact matches. Nulls are empty."""
    truth, got = F.coalesce("truth", F.lit("")), F.coalesce("predicted", F.lit(""))
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.levenshtein(truth, got)), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.char_length(truth)), F.lit(0)).cast("long").alias("characters"),
        F.count_if(truth == got).alias("exact"),
    ).select(
        "n", "errors", "characters", F.try_divide("errors", "characters").alias("cer"),
        F.try_divide("exact", "n").alias("exact_rate"),
    )


def confusion(labels: DataFrame) -> DataFrame:
    """Rows per (label, predicted)."""
    return labels.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


def label_recall(labels: DataFrame) -> DataFrame:
    """Rows, hits and recall per label."""
    return labels.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").eqNullSafe(F.col("predicted"))).alias("hits"),
    ).withColumn("recall", F.col("hits") / F.col("n"))


def detection_summary(images: DataFrame, classes: list[str]) -> DataFrame:
    """Per class of a wide table of confidences: mean, detections and images."""
    return images.unpivot([], classes, "class", "confidence").groupBy("class").agg(
        F.avg("confidence").alias("mean_confidence"),
        F.count_if(F.col("confidence") >= DETECTED).alias("detected"), F.count(F.lit(1)).alias("images"),
    )


def best_epoch(log: DataFrame, metric: str = "val_accuracy") -> DataFrame:
    """The log's row with the highest metric, the earliest of equal ones."""
    return log.agg(F.max_by(F.struct("*"), F.struct(metric, -F.col("epoch"))).alias("r")).select("r.*")


def history_rows(history: DataFrame) -> DataFrame:
    """Parallel arrays per metric to one row per epoch, from 1."""
    zipped = F.arrays_zip(*history.columns)
    return history.select(F.posexplode(zipped).alias("i", "m")).select(
        (F.col("i") + 1).alias("epoch"), *[F.col(f"m.{c}").alias(c) for c in history.columns])


def reliability(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Per bin of the confidence (from 0): rows, hits, mean confidence and share of hits. A null confidence counts as 0."""
    confidence = F.coalesce("confidence", F.lit(0.0))
    at = F.least(F.greatest(F.floor(confidence * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return predictions.groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label").eqNullSafe(F.col("predicted"))).alias("hits"),
        F.avg(confidence).alias("mean_confidence"),
    ).withColumn("hit_rate", F.col("hits") / F.col("n"))
