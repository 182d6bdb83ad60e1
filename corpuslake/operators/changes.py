"""New and changed files, batches and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def changed_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """``files`` (path, md5) that the ledger lacks or holds with another hash, with ``is_new``; a path may stand in it more than once."""
    known = ledger.groupBy("path").agg(F.max("md5").alias("known"), F.lit(True).alias("listed"))
    return files.join(known, "path", "left").where(F.col("listed").isNull() | ~F.col("known").eqNullSafe(F.col("md5"))).select("path", "md5", F.col("listed").isNull().alias("is_new"))


def touched_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files of a ``listing`` (path, length, modified) that the ledger lacks or holds with another length or time: ``path``, ``is_new``, ``known`` (its hash there).

    Whether they changed only their contents tell; all other files need not be read. A path may stand in the ledger more than once: its last time counts.
    """
    last = ledger.groupBy("path").agg(F.max_by(F.struct("length", "modified", "md5"), "modified").alias("l"), F.lit(True).alias("listed"))
    met = listing.join(last, "path", "left")
    same = F.col("l.length").eqNullSafe(F.col("length")) & F.col("l.modified").eqNullSafe(F.col("modified"))
    return met.where(F.col("listed").isNull() | ~same).select("path", F.col("listed").isNull().alias("is_new"), F.col("l.md5").alias("known"))


def event_kinds(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """File events with ``kind``: ``modified`` if the ledger has the path, else ``created``."""
    known = ledger.select(F.col("path").alias("__path")).distinct()
    met = events.join(known, F.col("path") == F.col("__path"), "left")
    return met.withColumn("kind", F.when(F.col("__path").isNull(), "created").otherwise("modified")).drop("__path")


def explicit_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """All of ``files``, whatever their hashes, with ``is_new``."""
    known = ledger.select("path").distinct().withColumn("known", F.lit(True))
    return files.join(known, "path", "left").select("path", "md5", F.col("known").isNull().alias("is_new"))


def in_batches(files: DataFrame, size: int = 100) -> DataFrame:
    """``batch`` numbers from 1, new files first, then by path.

    Ranks come from counts by range partition, so no task sorts all files.
    """
    return batched(files.withColumn("__new", (~F.col("is_new")).cast("int")), ["__new", "path"], size).drop("__new")


def batched(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``batch``, numbered from 1 in ``order``, ``size`` rows each."""
    return _ranked(rows, order).withColumn("batch", (F.floor((F.col("rank") - 1) / size) + 1).cast("long")).drop("rank")


def reindexed(rows: DataFrame, order: str) -> DataFrame:
    """Dense positions from 0 in ascending ``order``."""
    return _ranked(rows, [order]).withColumn("position", F.col("rank") - 1).drop("rank")


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    local = dealt.withColumn("__local", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    local = checkpointed(local)  # ranges are sampled; both uses below must see the same ones
    sizes = local.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row per partition
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return local.join(F.broadcast(before), "__part").withColumn("rank", F.col("__local") + F.col("__before")).drop("__part", "__local", "__before")
