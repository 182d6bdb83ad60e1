"""The vector table: replace by source, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries that are broadcast at most, or form a block; rows of a block of the store.
BLOCK, STORED = 2_000, 20_000


def named_sources(rows: DataFrame) -> DataFrame:
    """Distinct sources that are neither null nor empty; only those replace anything."""
    return rows.select("source").where((F.col("source").isNotNull()) & (F.col("source") != "")).distinct()


def without_sources(store: DataFrame, sources: DataFrame) -> DataFrame:
    return store.join(sources, "source", "left_anti").select(store.columns)


def upserted(store: DataFrame, rows: DataFrame) -> DataFrame:
    """``store`` with all rows of the new rows' sources replaced by the new rows."""
    return without_sources(store, named_sources(rows)).unionByName(rows)


def nearest(store: DataFrame, queries: DataFrame, k: int = 4, key: str = "vec_id", query_key: str = "query_id", vector: str = "embedding", places: int | None = None) -> DataFrame:
    """The ``k`` nearest rows of each query by squared Euclidean distance: ``query_key``, ``rank``, ``key``, ``distance``.

    Keys may be of any type. Up to ``BLOCK`` queries are broadcast and the store is read where it lies. More
    are dealt out in blocks, the store too, and every block of one meets every block of the other in a task.
    Each task keeps its own ``k`` best per query (ties: smaller key first), so at most ``k`` rows a query and
    task go on. With fewer than ``k`` rows all come back; null vectors never do. ``places`` rounds distances
    before they are ranked, so that rows at the same distance tie whatever the order of summation.
    """
    asked = queries.select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    rows = store.select(F.col(key).alias("x"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    kind = f"q {asked.schema['q'].dataType.simpleString()}, x {rows.schema['x'].dataType.simpleString()}, distance double"
    n = asked.count()
    if n <= BLOCK:
        own = asked.toArrow()
        shared = store.sparkSession.sparkContext.broadcast((own.column("q").combine_chunks(), matrix(own.column("v"))))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from closest(*shared.value, batch.column("x"), matrix(batch.column("v")), k, places).to_batches()

        found = rows.mapInArrow(best, kind)
    else:
        qs, xs = -(-n // BLOCK), max(1, -(-rows.count() // STORED))
        block = lambda name, count: F.expr(f"cast(pmod(xxhash64({name}), {count}) as int)")
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        none = lambda name, df: F.lit(None).cast(df.schema[name].dataType).alias(name)
        asks = asked.select(block("q", qs).alias("a"), every(xs).alias("b"), "q", none("x", rows), "v", F.lit(True).alias("asks"))
        own = rows.select(every(qs).alias("a"), block("x", xs).alias("b"), none("q", asked), "x", "v", F.lit(False).alias("asks"))

        def met(table: pa.Table) -> pa.Table:
            asks = table["asks"].combine_chunks()
            one, other = table.filter(asks), table.filter(pc.invert(asks))
            return closest(one["q"].combine_chunks(), matrix(one["v"]), other["x"].combine_chunks(), matrix(other["v"]), k, places)

        found = asks.unionByName(own).groupBy("a", "b").applyInArrow(met, kind)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "x")))
    return ranked.where(F.col("rank") <= k).select(F.col("q").alias(query_key), "rank", F.col("x").alias(key), "distance")


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows; null components are NaN."""
    if not len(vectors):
        return np.zeros((0, 1))
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


#: Queries whose distances are computed together, and pairs whose exact distances are.
TOGETHER, PAIRS = 128, 100_000


def closest(q: pa.Array, wanted: np.ndarray, x: pa.Array, rows: np.ndarray, k: int, places: int | None) -> pa.Table:
    """The ``k`` nearest rows of each query, ties by the smaller key.

    A matrix product gives distances that are off by rounding; rows that could be among the nearest within twice that error get their
    distances computed directly, and those count.
    """
    which, at, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    if len(x):
        order = pc.sort_indices(x).to_numpy()
        rows = rows[order]
        squares = (rows * rows).sum(axis=1)
        largest = squares.max(initial=0, where=np.isfinite(squares))
        for begin in range(0, len(wanted), TOGETHER):
            some = wanted[begin : begin + TOGETHER]
            own = (some * some).sum(axis=1)
            with np.errstate(invalid="ignore"):
                near = np.nan_to_num(own[:, None] + squares - 2 * (some @ rows.T), nan=np.inf)
            slack = 1e-13 * rows.shape[1] * (own + largest) + (0 if places is None else 10.0**-places)
            last = np.partition(near, k - 1, axis=1)[:, k - 1] if k < len(rows) else np.full(len(some), np.inf)
            i, j = np.nonzero(near <= (last + slack)[:, None])
            d = np.concatenate([np.zeros(0), *(((rows[j[p : p + PAIRS]] - some[i[p : p + PAIRS]]) ** 2).sum(axis=1) for p in range(0, len(i), PAIRS))])
            d = d if places is None else np.round(d, places)
            best = np.lexsort((j, d, i))
            i, j, d = i[best], j[best], d[best]
            top = np.arange(len(i)) - np.searchsorted(i, i) < k
            which.append(i[top] + begin)
            at.append(order[j[top]])
            distance.append(d[top])
    return pa.table({"q": q.take(pa.array(np.concatenate(which), pa.int64())), "x": x.take(pa.array(np.concatenate(at).astype(np.int64))), "distance": np.concatenate(distance)})
