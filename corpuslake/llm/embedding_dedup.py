"""Near duplicates of embeddings by product quantisation over inverted lists, reranked exactly.

1. Vectors that are bit for bit equal form a class; one stands for it. Vectors are scaled to length 1.
2. On a sample, k-means finds the centres of the coarse lists (in two levels) and, in each of ``PARTS``
   subspaces, the codewords of the residuals. Lists grow with the root of the number of vectors, the
   sample with the lists. Every vector is coded once and the code is stored.
3. As a query a vector goes, whole, to its nearest list only. Its code is posted in every list whose border is
   near enough for a linked query to lie beyond it: a difference of the radius's length moves a vector by
   about the radius over the root of the dimensions toward any border, and ``REACH`` times that is covered
   (dimensions as the residuals of the sample fill them), however many lists that are; the ``PROBES``
   nearest borders are covered up to the whole radius. Lists are dealt out in blocks; a task gets the queries
   and the codes of one block pair. The product of a query with a coded vector is a sum of table entries
   (asymmetric). The coding error is known, so a bound tells which codes could still lie within the
   radius: coding loses nothing.
4. Only queries and members that such a candidate touches fetch their vectors; exact cosines in double
   precision judge them. A task returns, for each vector, the weight of its links (class sizes), and a
   spanning forest of the links, never the pairs themselves.

Vectors of each length are searched among themselves, all lengths in the same jobs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut, written
from .components import connected_components

PARTS, WORDS, PROBES = 16, 256, 8
#: Standard deviations of a random difference of the radius's length that lists are posted for.
REACH = 1.5
#: Vectors of the sample to a list, bytes of the sample (as 32-bit numbers), vectors that codewords are fitted on, iterations of k-means.
PER_LIST, SAMPLE, FITTED, ROUNDS = 20, 1 << 26, 20_000, 8
#: Queries and codes of a list in a block.
QUERIES, MEMBERS = 2_048, 16_384
#: Queries whose products are held at a time.
ROWS = 128
#: Distances to centres that are held at a time, and residuals that the dimensions are taken from.
HELD, SPREAD = 1 << 22, 2_000
#: What rounding to 32 bits may change in a product.
SLACK = 1e-4


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        near = nearest(x, centres, 1)[:, 0]
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the ``k`` nearest centres of each row, nearest first."""
    k, out = min(k, len(centres)), []
    for at in range(0, max(len(x), 1), 4096):
        d = (centres**2).sum(axis=1) - 2 * x[at : at + 4096] @ centres.T
        some = np.argpartition(d, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, axis=1), axis=1, kind="stable"), axis=1))
    return np.concatenate(out)


def filled(rest: np.ndarray) -> float:
    """How many dimensions rows fill: the squared sum of the eigenvalues of their products over the sum of their squares (few rows: rather too few)."""
    return max(1.0, float((rest.astype(np.float64) ** 2).sum()) ** 2 / max(float(((rest.astype(np.float64) @ rest.T.astype(np.float64)) ** 2).sum()), 1e-300))


class Quantiser:
    """Lists and codewords for vectors of one length; its lists are numbered from ``first``."""

    def __init__(self, sample: np.ndarray, n: int, first: int = 0, seed: int = 5):
        rng = np.random.default_rng(seed)
        sample, lists = sample.astype(np.float32), int(max(1, min(n**0.5, len(sample) / PER_LIST)))
        self.first, self.centres = first, k_means(sample, int(max(1, lists**0.5)) if lists > 64 else lists, rng)
        if lists > 64:
            cell = nearest(sample, self.centres, 1)[:, 0]
            own = [sample[cell == c] for c in range(len(self.centres))]
            self.centres = np.concatenate([k_means(x, max(1, round(lists * len(x) / len(sample))), rng) for x in own if len(x)])
        fitted = sample[:FITTED]
        rest = fitted - self.centres[nearest(fitted, self.centres, 1)[:, 0]]
        self.cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).astype(int)
        self.dimensions = filled(rest[:SPREAD])
        self.books = [k_means(rest[:, a:b], min(WORDS, len(rest)), rng) for a, b in zip(self.cuts, self.cuts[1:])]

    def posts(self, x: np.ndarray, radius: float) -> list[np.ndarray]:
        """Lists of each row, its home (the nearest) first.

        A query within the radius has its home in another list only if it lies beyond the border between
        that list and this home, so a border farther than the radius is never needed.
        """
        out, norms = [], (self.centres**2).sum(axis=1)
        reach = min(radius, REACH * radius / self.dimensions**0.5) + SLACK
        rows, k = max(1, HELD // len(norms)), min(PROBES, len(norms))
        for at in range(0, len(x), rows):
            away = norms - 2 * x[at : at + rows] @ self.centres.T
            home = away.argmin(axis=1)
            each = np.arange(len(home))
            apart = norms + norms[home, None] - 2 * self.centres[home] @ self.centres.T
            border = (away - away[each, home][:, None]) / (2 * np.sqrt(np.maximum(apart, 1e-12)))
            near = border <= reach
            first = np.argpartition(border, k - 1, axis=1)[:, :k]
            near[each[:, None], first] |= np.take_along_axis(border, first, axis=1) <= radius + SLACK
            near[each, home] = False
            r, c = np.nonzero(near)
            others = np.split(c, np.cumsum(np.bincount(r, minlength=len(home)))[:-1])
            out += [np.concatenate([[h], o]) for h, o in zip(home, others)]
        return out

    def code(self, x: np.ndarray, least: float) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Lists to be posted in (the first is home), codes, and the product with the coded vector that a link needs at least."""
        radius = (2 - 2 * least) ** 0.5
        lists = self.posts(x, radius)
        home = self.centres[[own[0] for own in lists]]
        rest = x - home
        codes = np.stack([nearest(rest[:, a:b], book, 1)[:, 0] for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)
        coded = home + np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)
        error = np.sqrt(((x - coded) ** 2).sum(axis=1))
        # With y = coded + e: q.y <= q.coded + |e|, and |q - coded| <= |q - y| + |e|.
        needed = np.maximum(least - error, (1 + (coded**2).sum(axis=1) - (radius + error) ** 2) / 2)
        return [(own + self.first).astype(np.int32) for own in lists], codes, needed - SLACK

    def products(self, queries: np.ndarray, home: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Products of coded members (rows) with queries (columns), from tables."""
        kinds, which = np.unique(home - self.first, return_inverse=True)
        total = (self.centres[kinds] @ queries.T)[which]
        for k, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            total += (book @ queries[:, a:b].T)[codes[:, k]]
        return total


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; very small and very large components neither vanish nor overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def stacked(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """A column of equally long binary values as the rows of a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1)


def candidates(key: tuple, table: pa.Table, quantisers: dict[int, Quantiser]) -> pa.Table:
    """Queries and members of a block pair that a possible link touches."""
    asks = table["asks"].to_numpy(zero_copy_only=False)
    nodes = table["node"].to_numpy()
    asking, own = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
    touched = np.zeros(len(nodes), bool)
    if asking.num_rows and own.num_rows:
        quantiser = quantisers[asking["d"][0].as_py()]
        q, codes = stacked(asking["data"], np.float32), stacked(own["data"], np.uint8)
        needed, home = own["needed"].to_numpy()[:, None], own["home"].to_numpy()
        q_hit, x_hit = np.zeros(len(q), bool), np.zeros(len(codes), bool)
        for at in range(0, len(q), ROWS):
            part = slice(at, at + ROWS)
            close = (quantiser.products(q[part], home, codes) >= needed) & (nodes[~asks][:, None] != nodes[asks][part])
            x_hit |= close.any(axis=1)
            q_hit[part] = close.any(axis=0)
        touched[asks], touched[~asks] = q_hit, x_hit
    n = int(touched.sum())
    place = [pa.array(np.full(n, k.as_py()), pa.int32()) for k in key]
    return pa.table([*place, pa.array(nodes[touched]), pa.array(asks[touched])], ["at", "q", "x", "node", "asks"])


def joined(group: np.ndarray, close: np.ndarray) -> None:
    """Gives the columns of each row of ``close`` one number in ``group``, and all that had their numbers before."""
    for row in close:
        found = group[row]
        first = found.min()
        if (found != first).any():
            merged = np.zeros(len(group), bool)
            merged[found] = True
            group[merged[group]] = first


def posted_in(lists: pa.ChunkedArray, homes: np.ndarray) -> np.ndarray:
    """For each row, which of the sorted ``homes`` are among its lists."""
    lists = pa.concat_arrays(lists.chunks) if lists.num_chunks != 1 else lists.chunk(0)
    rows, values = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
    at = np.minimum(np.searchsorted(homes, values), len(homes) - 1)
    found = np.zeros((len(lists), len(homes)), bool)
    ok = homes[at] == values
    found[rows[ok], at[ok]] = True
    return found


def links_in(table: pa.Table, kind, least: float) -> pa.Table:
    """Link weights of vectors, and the smallest node each reaches (a forest edge), between the queries and the members of one block pair.

    Links are added up slice by slice, so memory is that of the vectors and of one slice's products.
    """
    asks = table["asks"].to_numpy(zero_copy_only=False)
    asking, own = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
    qi, xi = asking["node"].to_numpy(), own["node"].to_numpy()
    qn, xn = asking["n"].to_numpy(), own["n"].to_numpy()
    weight_q, weight_x = np.zeros(len(qi), np.int64), np.zeros(len(xi), np.int64)
    label_q, label_x = qi.copy(), xi.copy()
    if len(qi) and len(xi):
        q, x = unit(stacked(asking["vec"], kind)), unit(stacked(own["vec"], kind))
        # A link is seen from both sides if the query is posted in the member's home, too; else it counts for both here.
        homes, home = np.unique([v[0].as_py() for v in own["lists"]], return_inverse=True)
        group, anchor = np.arange(len(xi)), np.full(len(qi), -1)
        for at in range(0, len(qi), ROWS):
            part = slice(at, at + ROWS)
            close = q[part] @ x.T >= least
            close &= qi[part, None] != xi
            weight_q[part] = close @ xn
            linked = np.flatnonzero(close.any(axis=1))
            anchor[at + linked] = close[linked].argmax(axis=1)
            joined(group, close[linked])
            close &= ~posted_in(asking["lists"].slice(at, ROWS), homes)[:, home]
            weight_x += qn[part] @ close
        low = np.full(len(xi), np.iinfo(np.int64).max)
        np.minimum.at(low, group, xi)
        has = anchor >= 0
        np.minimum.at(low, group[anchor[has]], qi[has])
        label_x = low[group]
        label_q[has] = low[group[anchor[has]]]
    nodes, labels, weights = np.concatenate([qi, xi]), np.concatenate([label_q, label_x]), np.concatenate([weight_q, weight_x])
    said = (weights > 0) | (labels != nodes)
    return pa.table({"node": pa.array(nodes[said], pa.int64()), "other": pa.array(labels[said], pa.int64()), "weight": pa.array(weights[said], pa.int64())})


def embedding_duplicates(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Vectors are linked if their cosine is ``least`` or more. Vectors that are null, empty, zero or hold null
    or non-finite components, and those of a null id, link with nothing and stay. Vectors of each
    length, however long, are searched among themselves. An empty table gives an empty table; other columns
    are not read. Rows that repeat an id count as links of it, each by its own vector.
    """
    column = vectors.schema[vector_col].dataType
    single = isinstance(column, ArrayType) and isinstance(column.elementType, FloatType)
    kind = np.float32 if single else np.float64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            sizes = np.array(lists.value_lengths().fill_null(0), np.int64)
            ends = np.cumsum(sizes)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0)  # null: not a number; -0: 0
            out = []
            for known, a, b in zip(ids.is_valid().to_pylist(), ends - sizes, ends):
                v = values[a:b]
                good = known and b > a and np.isfinite(v).all() and v.any()
                out.append((hashlib.blake2b(v.tobytes(), digest_size=16).digest(), b - a, v.tobytes()) if good else (None, None, None))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([ids, *columns], ["id", "key", "d", "vec"])

    chosen = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    rows = written(chosen.mapInArrow(read, "id long, key binary, d int, vec binary"), "vectors")
    grouped = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("d").alias("d"), F.first("vec").alias("vec"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = _searched(classes, kind, least)

    placed = classes.select("node", "key", "id").join(found, "node")
    smallest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = placed.join(smallest, "component", "left").select("key", "links", "component_id")
    named = classes.select("key", "id", "n").join(linked, "key", "left").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    judged = rows.select("id", "key").where("key is not null").join(named, "key").select("id", "n_links", "component_id")
    rest = rows.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return judged.unionByName(rest).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def quantisers_for(classes: DataFrame, kind) -> dict[int, Quantiser]:
    """A quantiser for each length that more than one vector has, fitted on a sample of ``SAMPLE`` bytes over all lengths."""
    counts = {r["d"]: r["count"] for r in classes.groupBy("d").count().where("count > 1").collect()}  # a row a length
    if not counts:
        return {}
    wanted = {d: min(n, PER_LIST * n**0.5) for d, n in counts.items()}
    scale = min(1.0, SAMPLE / sum(4 * d * w for d, w in wanted.items()))
    shares = classes.sparkSession.createDataFrame([(d, scale * wanted[d] / n) for d, n in counts.items()], "d int, share double")
    picked = classes.join(F.broadcast(shares), "d").where(F.expr("pmod(xxhash64(node), 1073741824) < share * 1073741824"))
    sample: dict[int, list] = {}
    for row in picked.select("d", "node", "vec").orderBy("d", "node").collect():
        sample.setdefault(row["d"], []).append(row["vec"])
    made, first = {}, 0
    for d in sorted(sample):
        x = unit(stacked(pa.array(sample[d], pa.binary()), kind))
        made[d] = Quantiser(np.random.default_rng(1).permutation(x), counts[d], first)
        first += len(made[d].centres)
    return made


def _searched(classes: DataFrame, kind, least: float) -> DataFrame:
    """``(node, links, component)`` of vectors that link with another class."""
    spark = classes.sparkSession
    quantisers = quantisers_for(classes, kind)
    if not quantisers:
        return spark.createDataFrame([], "node long, links long, component long")
    shared = spark.sparkContext.broadcast(quantisers)  # at most SAMPLE / PER_LIST bytes of centres

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ds = batch.column("d").to_numpy()
            for d in np.unique(ds).tolist():
                if d not in shared.value:
                    continue
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096).filter(pa.array(ds[at : at + 4096] == d))
                    if not part.num_rows:
                        continue
                    x = unit(stacked(part.column("vec"), kind))
                    lists, codes, needed = shared.value[d].code(x, least)
                    home = pa.array([v[0] for v in lists], pa.int32())
                    bits = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (codes, x.astype(np.float32))]
                    columns = [part.column("node"), part.column("n"), part.column("d"), home, pa.array(lists, pa.list_(pa.int32())), bits[0], pa.array(needed.astype(np.float32)), bits[1]]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "n", "d", "home", "lists", "code", "needed", "unit"])

    placed = written(classes.select("node", "n", "d", "vec").mapInArrow(coded, "node long, n long, d int, home int, lists array<int>, code binary, needed float, unit binary"), "codes")
    # Blocks of a list: queries and codes are cut by hash; every block of one meets every block of the other.
    posted = placed.select("node", "d", "home", "code", "needed", F.explode("lists").alias("at"))
    asking = placed.groupBy(F.col("home").alias("at")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qs"))
    blocks = F.broadcast(posted.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("xs")).join(asking, "at"))  # a row a list
    none = F.lit(None)
    queries = placed.withColumn("at", F.col("home")).join(blocks, "at").select("at", F.expr("cast(pmod(xxhash64(node), qs) as int)").alias("q"), F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("x"), F.lit(True).alias("asks"), "node", "d", none.cast("int").alias("home"), none.cast("float").alias("needed"), F.col("unit").alias("data"))
    members = posted.join(blocks, "at").select("at", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), F.expr("cast(pmod(xxhash64(node), xs) as int)").alias("x"), F.lit(False).alias("asks"), "node", "d", "home", "needed", F.col("code").alias("data"))

    def touched(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return candidates(key, table, shared.value)

    def links(table: pa.Table) -> pa.Table:
        return links_in(table, kind, least)

    hits = written(queries.unionByName(members).groupBy("at", "q", "x").applyInArrow(touched, "at int, q int, x int, node long, asks boolean"), "candidates")
    exact = hits.join(classes.select("node", "vec"), "node").join(placed.select("node", "n", "lists"), "node")
    said = cut(exact.groupBy("at", "q", "x").applyInArrow(links, "node long, other long, weight long"))
    components = connected_components(said.select(F.col("node").alias("src"), F.col("other").alias("dst")))
    weights = said.groupBy("node").agg(F.sum("weight").alias("links"))
    return weights.join(components, "node", "left").select("node", "links", F.coalesce("component", "node").alias("component"))
