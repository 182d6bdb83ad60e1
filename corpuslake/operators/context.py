"""Contexts under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running_sums

#: Queries whose cuts are broadcast at most.
SMALL = 100_000


def reachable(hits: DataFrame, query_key: str, rank: str, tokens: Column, available: int) -> DataFrame:
    """The rows of ``hits`` up to the first of each query that no longer fits ``available`` tokens.

    ``contexts`` gives the same from these rows as from all. It sorts a query's hits in one task, which suits
    ranked hits; this is for groups of any size. Only keys, ranks and counts are shuffled, not the texts.
    """
    counted = hits.select(query_key, rank, tokens.alias("__tokens"))
    over = running_sums(counted, query_key, rank, ["__tokens"]).where(F.col("upto___tokens") > available)
    cut = over.groupBy(F.col(query_key).alias("__query")).agg(F.min(rank).alias("__last"))
    if cut.count() <= SMALL:
        cut = F.broadcast(cut)
    met = hits.join(cut, F.col(query_key).eqNullSafe(F.col("__query")), "left")
    return met.where(F.col("__last").isNull() | F.col(rank).isNull() | (F.col(rank) <= F.col("__last"))).select(hits.columns)


def contexts(hits: DataFrame, query_key: str, rank: str, text: str, tokens: str, available) -> DataFrame:
    """Per query the longest prefix of its hits, by rank, that fits ``available`` tokens.

    Result: ``query_key``, ``n_used``, ``context_tokens``, ``truncated``, ``context`` (texts joined by blank
    lines; leading empty texts add none). Queries none of whose hits fits have an empty context.
    """
    running = F.sum(tokens).over(Window.partitionBy(query_key).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    rows = hits.withColumn("__sum", running).withColumn("__fits", F.col("__sum") <= available)
    used = F.sort_array(F.collect_list(F.when(F.col("__fits"), F.struct(F.col(rank).alias("r"), F.col(text).alias("t")))))
    joined = F.aggregate(used, F.lit(""), lambda s, x: F.when(s == "", x["t"]).otherwise(F.concat(s, F.lit("\n\n"), x["t"])))
    return rows.groupBy(query_key).agg(
        F.count_if("__fits").alias("n_used"),
        F.coalesce(F.sum(F.when(F.col("__fits"), F.col(tokens))), F.lit(0)).cast("long").alias("context_tokens"),
        F.bool_or(~F.col("__fits")).alias("truncated"),
        joined.alias("context"),
    )
