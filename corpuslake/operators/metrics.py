"""Retrieval-quality metrics as arithmetic over verdict rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sums

METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
#: Those that need a ground truth.
GROUNDED = ("context_precision", "context_recall")


def evaluable(items: DataFrame, question: str = "question") -> DataFrame:
    return items.where(F.coalesce(F.col(question), F.lit("")) != "")


def active_metrics(ground_truth: Column) -> Column:
    return F.when(ground_truth.isNotNull(), F.lit(",".join(METRICS))).otherwise(F.lit(",".join(m for m in METRICS if m not in GROUNDED)))


def share(verdicts: DataFrame, key: str, verdict: str, name: str) -> DataFrame:
    """Share of positive verdicts by ``key``: faithfulness over statements, recall over ground-truth statements."""
    return verdicts.groupBy(key).agg((F.sum(F.col(verdict).cast("double")) / F.count(verdict)).alias(name))


def context_precision(verdicts: DataFrame, key: str, rank: str, verdict: str) -> DataFrame:
    """Mean of precision@rank over the ranks with a positive verdict; 0 without any."""
    rows = verdicts.select(key, rank, F.col(verdict).cast("double").alias("__hit"), F.lit(1).alias("__n"))
    rows = running_sums(rows, key, rank, ["__hit", "__n"]).withColumn("__p", F.col("upto___hit") / F.col("upto___n"))
    return rows.groupBy(key).agg(F.coalesce(F.sum(F.col("__p") * F.col("__hit")) / F.nullif(F.sum("__hit"), F.lit(0.0)), F.lit(0.0)).alias("context_precision"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean of each metric, without nulls and NaN."""
    return rows.agg(*[F.avg(F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))).alias(m) for m in metrics])
