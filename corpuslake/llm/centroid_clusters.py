"""K-means over integer vectors, exact, with candidates from an annulus around each vector's norm.

Centroids are sorted by norm. By the triangle inequality a centroid whose norm differs from a vector's by more
than ``u`` is farther than ``u`` from it. So the centroid whose norm is nearest gives an upper bound ``u``, two binary
searches find the centroids whose norms lie within it, and only those are compared, in integers. The annulus is
widened by more than the rounding of the norms, so centroids on its border, and with them all ties, are compared too.

Each round is one pass over the stored vectors: a task keeps one batch and sums for each centroid, at most
``k * size`` partial sums a task are shuffled, and ``k * size`` sums reach the driver. A lost executor costs its tasks of
one pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, written

#: Integer components beyond this are not taken: squared distances of 64 of them would not fit 64 bits.
LARGEST = 1 << 27
#: Rows whose distances are computed together.
ROWS = 4096


def integer_vectors(rows: DataFrame, size: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of the rows that can be used, ``v`` being ``floor(scale * x)`` of each component."""
    kind = rows.schema[id_col].dataType

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(vectors), size), False))
            flat = batch.column(1).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # nulls become NaN
            with np.errstate(invalid="ignore", over="ignore"):
                v = np.floor(scale * x)
                good = (np.abs(v) <= LARGEST).all(axis=1)
            whole = pa.array(v[good].astype(np.int64).ravel(), pa.int64())
            at = pa.array(np.arange(0, len(whole) + 1, size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(at, whole)], ["id", "v"])
        let_go()

    chosen = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return chosen.mapInArrow(each, f"id {kind.simpleString()}, v array<long>")


def nearest_centroids(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row of ``x``; ties go to the smaller number."""
    lengths = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
    order = np.argsort(lengths, kind="stable")
    lengths, centres = lengths[order], centroids[order]
    own = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    # The bound: the distance of the centroid whose norm is nearest.
    right = np.clip(np.searchsorted(lengths, own), 1, max(1, len(lengths) - 1))
    left = right - 1
    right = np.minimum(right, len(lengths) - 1)
    start = np.where(own - lengths[left] <= lengths[right] - own, left, right)
    best = ((x - centres[start]) ** 2).sum(axis=1)
    number = order[start]
    u = np.sqrt(best.astype(np.float64))
    slack = 1e-9 * (own + u + lengths[-1]) + 1e-6
    low, high = np.searchsorted(lengths, own - u - slack, "left"), np.searchsorted(lengths, own + u + slack, "right")
    step, rows = 0, np.flatnonzero(low < high)
    while len(rows):
        at = low[rows] + step
        d, n = ((x[rows] - centres[at]) ** 2).sum(axis=1), order[at]
        better = (d < best[rows]) | ((d == best[rows]) & (n < number[rows]))
        best[rows[better]], number[rows[better]] = d[better], n[better]
        step += 1
        rows = rows[low[rows] + step < high[rows]]
    return number, best


def _parts(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, part.column(part.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``<seed>:<id>``; equal hashes by the vectors, null ids last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select(mark.alias("mark"), "v").orderBy(F.asc_nulls_last("mark"), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; one without vectors stays."""
    k, size = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x in _parts(batch, size):
                number, _ = nearest_centroids(x, centroids)
                for c in np.unique(number):
                    mine = number == c
                    total[c] += x[mine].sum(axis=0)
                    count[c] += mine.sum()
        full = np.flatnonzero(count)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, size)), pa.array(np.tile(np.arange(size), len(full))), pa.array(np.repeat(count[full], size)), pa.array(total[full].ravel())], ["c", "i", "n", "s"])
        let_go()

    found = vectors.select("v").mapInArrow(sums, "c long, i long, n long, s long")
    new = centroids.copy()
    for r in found.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        new[r["c"], r["i"]] = int(r["s"]) // r["n"]
    return new


def clustered(rows: DataFrame, k: int = 8, size: int = 64, scale: int = 1024, rounds: int = 10, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Rows ``id_col``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``; and the centroids.

    Left out: null vectors, those of another length than ``size``, those with null or non-finite components, and those with a component
    whose integer is beyond ``LARGEST`` (its distances need not fit a long). Repeated rows count, and come back, as often as they are
    there; an id on several vectors keeps them all. Fewer than ``k`` vectors make as many centroids; an empty table gives no rows and no
    centroids. Equal centroids leave the one of larger number empty; it stays where it is. Sums that don't fit a long are null.
    Columns of other names in ``rows`` play no part.
    """
    vectors = written(integer_vectors(rows, size, scale, id_col, vector_col), "integers")
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        new = moved(vectors, centroids)
        if (new == centroids).all():
            break  # every later round would give the same
        centroids = new
    kind = vectors.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _parts(batch, size):
                number, d = nearest_centroids(x, centroids)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number.astype(np.int32)), pa.array(d)], ["id", "cluster", "distance"])
        let_go()

    found = written(vectors.mapInArrow(assign, f"id {kind}, cluster int, distance long"), "clusters")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    own = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(whole.alias("s")).collect()}  # k rows
    total = sum(own.values())
    per = F.coalesce(*[F.when(F.col("cluster") == c, F.lit(int(s)) if s < 1 << 63 else F.lit(None).cast("long")) for c, s in sorted(own.items())], F.lit(None).cast("long"))
    result = found.select(F.col("id").alias(id_col), "cluster", "distance", per.cast("long").alias("cluster_inertia"), F.lit(int(total) if total < 1 << 63 else None).cast("long").alias("inertia"))
    return result, centroids


def centroid_digests(rows: DataFrame, **options) -> DataFrame:
    """``clustered`` with ``centroid_sha256``: the hash of the final centroid's components, as decimals joined by commas."""
    found, centroids = clustered(rows, **options)
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return found.withColumn("centroid_sha256", F.element_at(F.array(*map(F.lit, marks)), F.col("cluster") + 1) if marks else F.lit(None).cast("string"))
