"""Running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def running_sums(rows: DataFrame, key: str, order: str, sums: list[str]) -> DataFrame:
    """``key``, ``order``, the columns ``sums`` and for each of them ``upto_<name>``: its sum over the group's rows up to this one.

    Rows are dealt by ranges of key and order, so a group that holds much of the table is summed by many tasks.
    What lies in the ranges before is added from one row a range and group. Rows of equal order follow each
    other in any order; null keys are a group; nulls add nothing.
    """
    # What the sums are of is computed once: dealing by ranges looks at its input twice.
    dealt = checkpointed(rows.select(key, order, *sums)).repartitionByRange(key, order).withColumn("__part", F.spark_partition_id())
    upto = Window.partitionBy("__part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # Ranges are sampled; both uses below must see the same ones.
    local = checkpointed(dealt.select("*", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"__own_{c}") for c in sums]))
    totals = local.groupBy("__part", key).agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = totals.select(F.col("__part").alias("__range"), F.col(key).alias("__group"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__before_{c}") for c in sums])
    met = local.join(before, (F.col("__part") == F.col("__range")) & F.col(key).eqNullSafe(F.col("__group")))
    return met.select(key, order, *sums, *[(F.col(f"__own_{c}") + F.col(f"__before_{c}")).alias(f"upto_{c}") for c in sums])
