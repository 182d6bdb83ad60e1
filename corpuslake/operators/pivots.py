"""Exact nearest neighbours without comparing every row: rings around pivots, skipped by the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, shared_folder
from .vectors import BLOCK, STORED, closest, matrix

#: Rows that pivots are chosen from, pivots, and rings around a pivot at most; together they bound what the driver holds. Only the share of rows that is skipped depends on them.
SAMPLE, PIVOTS, RINGS = 4096, 256, 64
#: Relative error granted to a computed distance before a ring may be skipped.
SLACK = 1e-9
#: The pivot of rows whose distances are not finite; every query meets them.
ODD = -1


def far_apart(rows: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` different rows, each one the farthest from those before it."""
    rows = rows[np.isfinite(rows).all(axis=1)]
    if not len(rows):
        return np.zeros((0, rows.shape[1]))
    chosen, gap = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def to_pivots(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, one pivot at a time, so that no difference is taken of large squares."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in pivots], axis=1) if len(pivots) else np.full((len(rows), 0), np.nan)


class PivotIndex:
    """Rows of ``store`` in a shared folder by pivot, each with its distance to it, and the reach of each ring.

    A row belongs to its nearest pivot. The rows of a pivot are cut into rings of equal width, about one for each ``STORED`` rows, and a
    ring that holds more is dealt out in parts by the hash of the key, so copies of one vector don't fill a task. Null vectors are left
    out; vectors with components that are null or not finite are in a ring of their own, which every query meets. Keys may be null,
    repeat and be of any type. All vectors, queries too, have one length. An empty store gives an index without rows.
    """

    def __init__(self, store: DataFrame, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.key = store.sparkSession, key
        rows = store.select(F.col(key).alias("x"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
        self.kind = rows.schema["x"].dataType.simpleString()
        self.n = rows.count()
        sample = rows.orderBy(F.xxhash64("x", "v")).limit(SAMPLE).select("v").toArrow()
        pivots = self.pivots = far_apart(matrix(sample.column("v")), min(PIVOTS, max(1, int(self.n**0.5))))

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = to_pivots(matrix(batch.column("v")), pivots)
                near = np.nan_to_num(d, nan=np.inf)
                home = near.argmin(axis=1) if len(pivots) else np.zeros(len(d), np.int64)
                gap = near[np.arange(len(d)), home] if len(pivots) else np.full(len(d), np.inf)
                home, gap = np.where(np.isfinite(gap), home, ODD), np.where(np.isfinite(gap), gap, 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home, pa.int32()), pa.array(gap)], ["x", "v", "pivot", "gap"])

        near = checkpointed(rows.mapInArrow(placed, f"x {self.kind}, v array<double>, pivot int, gap double"))
        reach = near.groupBy("pivot").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.least(F.ceil(F.count("*") / STORED), F.lit(RINGS)).cast("int").alias("rings"))
        ring = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("gap") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("rings")), F.col("rings") - 1)).otherwise(0)
        ringed = near.join(F.broadcast(reach), "pivot").withColumn("ring", ring.cast("int")).select("x", "v", "pivot", "gap", "ring")
        rings = ringed.groupBy("pivot", "ring").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count("*").alias("n"))
        self.rings = rings.withColumn("parts", F.ceil(F.col("n") / STORED).cast("int")).orderBy("pivot", "ring").toPandas()  # PIVOTS * RINGS rows at most, and the odd ones'
        self.folder = shared_folder(self.spark, "pivots")
        parts = F.broadcast(self.spark.createDataFrame(self.rings[["pivot", "ring", "parts"]], "pivot int, ring int, parts int"))
        dealt = ringed.join(parts, ["pivot", "ring"]).withColumn("part", F.expr("cast(pmod(xxhash64(x, v), parts) as int)"))
        dealt.select("x", "v", "ring", "part", "pivot").repartition("pivot", "ring", "part").write.partitionBy("pivot").parquet(self.folder)
        #: Share of all pairs of queries and rows whose distances the last search asked for.
        self.share = None

    def search(self, queries: DataFrame, k: int = 4, query_key: str = "query_id", vector: str = "embedding", places: int | None = None) -> DataFrame:
        """The ``k`` nearest rows of each query, as ``nearest`` gives them: ``query_key``, ``rank``, the key, ``distance``.

        A query first meets the rings that may be nearest, as many as hold ``k`` rows. The ``k``-th distance found there is a bound: of
        the other rings it meets those that may hold a row within it. Partitions of pivots that no query meets are not read.
        Queries with a null vector have no rows; with components that are not finite they meet every ring.
        """
        asked = queries.select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
        asked = checkpointed(asked.withColumn("i", F.monotonically_increasing_id()))
        n = asked.count()
        first = checkpointed(self._visits(asked.withColumn("bound", F.lit(None).cast("double")), k, places, True))
        near = checkpointed(self._met(first, n, k, places))
        order = Window.partitionBy("i").orderBy("distance", "x")
        bounds = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("i", F.col("distance").alias("bound"))
        rest = checkpointed(self._visits(asked.join(bounds, "i", "left"), k, places, False))
        self.share = (first.unionByName(rest).agg(F.sum("n")).first()[0] or 0) / max(1, n * self.n)
        found = near.unionByName(self._met(rest, n, k, places)).join(asked.select("i", "q"), "i")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "x")))
        return ranked.where(F.col("rank") <= k).select(F.col("q").alias(query_key), "rank", F.col("x").alias(self.key), "distance")

    def _visits(self, asked: DataFrame, k: int, places: int | None, first: bool) -> DataFrame:
        """Queries by ring that they meet: ``i``, ``v``, ``pivot``, ``ring``, ``parts``, ``n``; the first ones, or all others within the ``bound``."""
        pivots, rings = self.pivots, self.rings
        pivot, low, high, n = (rings[c].to_numpy() for c in ("pivot", "low", "high", "n"))
        number, parts = rings["ring"].to_numpy(), rings["parts"].to_numpy()
        extra = 0.0 if places is None else 10.0**-places

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 64):
                    part = batch.slice(at, 64)
                    d = np.concatenate([to_pivots(matrix(part.column("v")), pivots), np.full((len(part), 1), np.nan)], axis=1)[:, pivot]  # the odd ring's comes last
                    least = np.nan_to_num(np.maximum(np.maximum(d - high, low - d), 0) - SLACK * (d + high), nan=-np.inf)
                    order = np.lexsort((np.nan_to_num(d, nan=np.inf), np.maximum(least, 0)), axis=1)
                    held = np.cumsum(n[order], axis=1) - n[order]
                    met = np.zeros(d.shape, bool)
                    np.put_along_axis(met, order, held < k, axis=1)
                    if not first:
                        bound = np.nan_to_num(part.column("bound").to_numpy(zero_copy_only=False).astype(float), nan=np.inf)
                        met = ~met & (np.maximum(least, 0) ** 2 <= (bound * (1 + SLACK) + extra)[:, None])
                    a, b = np.nonzero(met)
                    taken = (part.column(c).take(pa.array(a, pa.int64())) for c in ("i", "v"))
                    yield pa.RecordBatch.from_arrays([*taken, pa.array(pivot[b], pa.int32()), pa.array(number[b], pa.int32()), pa.array(parts[b], pa.int32()), pa.array(n[b], pa.int64())], ["i", "v", "pivot", "ring", "parts", "n"])

        return asked.select("i", "v", "bound").mapInArrow(of, "i long, v array<double>, pivot int, ring int, parts int, n long")

    def _met(self, visits: DataFrame, asked: int, k: int, places: int | None) -> DataFrame:
        """The ``k`` nearest rows of each query in each part of the rings that it meets: ``i``, ``x``, ``distance``. A task gets a part and a block of queries."""
        blocks = max(1, -(-asked // BLOCK))
        visits = visits.withColumn("block", F.expr(f"cast(pmod(xxhash64(i), {blocks}) as int)"))
        wanted = visits.select("pivot", "ring", "block").distinct()
        wanted = F.broadcast(wanted) if blocks * len(self.rings) <= 1_000_000 else wanted
        pivots = [r["pivot"] for r in visits.select("pivot").distinct().collect()]  # PIVOTS at most, and the odd one
        rows = self.spark.read.schema(f"x {self.kind}, v array<double>, ring int, part int, pivot int").parquet(self.folder) if self.n else self.spark.createDataFrame([], f"x {self.kind}, v array<double>, ring int, part int, pivot int")
        own = rows.where(F.col("pivot").isin(pivots)).join(wanted, ["pivot", "ring"]).select("pivot", "ring", "part", "block", F.lit(None).cast("long").alias("i"), "x", "v")
        asks = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("pivot", "ring", "part", "block", "i", F.lit(None).cast(self.kind).alias("x"), "v")

        def best(table: pa.Table) -> pa.Table:
            one, other = table.filter(pc.is_valid(table["i"])), table.filter(pc.is_null(table["i"]))
            found = closest(one["i"].combine_chunks(), matrix(one["v"]), other["x"].combine_chunks(), matrix(other["v"]), k, places)
            return found.rename_columns(["i", "x", "distance"])

        return asks.unionByName(own).groupBy("pivot", "ring", "part", "block").applyInArrow(best, f"i long, x {self.kind}, distance double")
