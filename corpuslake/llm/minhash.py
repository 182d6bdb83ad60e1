"""Near duplicates by an inverted join over MinHash signatures, confirmed on full shingle sets.

1. Each text becomes its set of distinct word shingles (64-bit hashes), a digest of the set and a
   signature of ``COORDINATES`` minima. Documents of equal sets form a class; from here on one
   document stands for it.
2. Each (coordinate, value) is a posting list. A document whose signature has fewer than ``MATCHES``
   values that any other document shares can't reach the match threshold and is skipped. Of the others
   only the prefix is posted: the rarest of the shared values, so many that two documents of
   ``MATCHES`` collisions meet in at least ``SEEN`` lists.
3. Lists are merged. In lists of up to ``SHORT`` documents collisions are counted pair by pair; pairs seen
   in ``SEEN`` of them become candidates. A longer list joins all its documents to its first one, so
   its length costs no more than its rows. What is joined forms a group.
4. In a large group all are compared with its most central document first, row by row. Only documents that
   are not linked with it then ask the others.
5. A task gets some small groups, or two blocks of a large one. It walks lists of rare shingles from their
   most central member, skips pairs already connected, asks for ``MATCHES`` collisions, and confirms on
   full sets. It returns a spanning forest of its links, never the pairs of a group.
6. Components of the links, spread over the classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, by_text, cut, few, held, mixed, sliced, text_of, without, written
from .components import connected_components

WORDS, COORDINATES = 5, 48
#: Collisions that a pair needs to be compared; at a similarity of 0.75, 36 are expected and under 16 have a probability of 2.3e-10.
MATCHES = 16
#: Lists in which a pair must be seen, and documents in a list whose pairs are counted.
SEEN, SHORT = 4, 32
#: Shingles in a block of a large group; documents of a small group, and of the small groups that go to a task together.
BLOCK, FEW = 600_000, 200
#: Documents in a block of a large group, while that makes at most so many blocks.
PART, MOST = 300, 16
#: Shingles of central documents that are broadcast at most (32 MB).
CENTRAL = 4_000_000

_RNG = np.random.default_rng(20)
_FACTORS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _hashes(words: list[bytes]) -> tuple[np.ndarray]:
    return (np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64),)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; with fewer words, of the whole sequence."""
    table = held("shingles", None, lambda: WordTable(_hashes, 200_000))
    found = text.encode().lower().split()  # bytes: A-Z only, and ASCII white space
    if not found:
        return np.zeros(0, np.uint64)
    h = table.numbers(found)
    h = table.columns[0][h]
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), len(h))], np.uint64)
    total = np.zeros(len(h) - words + 1, np.uint64)
    for k in range(words):
        total += mixed(h[k : len(total) + k] * _STEPS[k])
    return np.unique(mixed(total))


def signature(found: np.ndarray) -> np.ndarray:
    low = np.full(COORDINATES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(found), 4096):
        low = np.minimum(low, ((found[at : at + 4096, None] * _FACTORS) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32)


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _sketches(batches) -> Iterator[list]:
    for ids, texts in batches:
        out = []
        for text in texts:
            found = shingles(text)
            out.append((len(found), digest(found), signature(found).view(np.int32)) if len(found) else (0, None, None))
        yield [ids, *map(list, zip(*out))]


def _postings(values: DataFrame) -> DataFrame:
    """Documents that share at least ``MATCHES`` values with others: ``node`` and those values with their numbers of documents, rarest first."""
    shared = values.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return values.join(shared, "value").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("posted")).where(F.size("posted") >= MATCHES)


def _met(posted: DataFrame) -> DataFrame:
    """Edges ``(src, dst)`` that connect every two documents of ``MATCHES`` collisions.

    Of their shared values the ``SEEN`` rarest are in both prefixes. If all of these lists are short, the
    pair is counted in each; else a long one joins both.
    """
    prefix = posted.select("node", F.explode(F.slice("posted", F.lit(1), F.size("posted") - MATCHES + SEEN)).alias("p")).select("node", "p.value", "p.n")
    lists = prefix.where(F.col("n") <= SHORT).groupBy("value").agg(F.array_sort(F.collect_list("node")).alias("nodes"))  # SHORT nodes at most
    pairs = F.flatten(F.transform("nodes", lambda a, i: F.transform(F.slice("nodes", i + 2, F.lit(SHORT)), lambda b: F.struct(a.alias("src"), b.alias("dst")))))
    seen = lists.select(F.explode(pairs).alias("p")).groupBy("p.src", "p.dst").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SEEN)
    long = prefix.where(F.col("n") > SHORT)
    first = long.groupBy("value").agg(F.min("node").alias("first"))
    stars = long.join(first, "value").where("node != first").select(F.col("node").alias("src"), F.col("first").alias("dst"))
    return seen.select("src", "dst").unionByName(stars)


def forest(values: np.ndarray, sizes: np.ndarray, signatures: np.ndarray, core: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among documents whose sets lie one after the other in ``values``.

    Documents marked ``core`` are connected already. Each document posts its rarest shingles, as many as
    two linked documents must share one of. From the most central one on, each document outside the core is
    compared with those that it meets in its lists, unless both are connected or have met before. A
    list whose members are all connected is closed and not walked again.
    """
    n = len(sizes)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(n), sizes)
    _, code, held = np.unique(values, return_inverse=True, return_counts=True)
    order = np.lexsort((code, held[code], owner))
    code = code[order].astype(np.int32)  # the shingles of each document, rarest first
    rank = np.arange(len(code)) - np.repeat(ends - sizes, sizes)
    posted = (rank < np.repeat(sizes - (3 * sizes + 3) // 4 + 1, sizes)) & (held[code] > 1)
    kinds, own, lengths = np.unique(code[posted], return_inverse=True, return_counts=True)
    members = np.split(owner[posted][np.argsort(own, kind="stable")], np.cumsum(lengths)[:-1]) if len(kinds) else []
    lists_of = np.split(own, np.cumsum(np.bincount(owner[posted], minlength=n))[:-1])
    closed, here, met = np.zeros(len(kinds), bool), np.zeros(len(held), bool), np.zeros(n, bool)
    label, waiting, out = np.arange(n), np.ones(n, bool), []
    if core.any():
        label[core] = np.flatnonzero(core)[0]
    for a in np.argsort(-_popular(signatures), kind="stable").tolist():
        if core[a]:
            continue
        waiting[a] = False
        walked = []
        for k in lists_of[a].tolist():
            if not closed[k]:
                labels = label[members[k]]
                if (labels == labels[0]).all():
                    closed[k] = True
                else:
                    walked.append(members[k])
        if not walked:
            continue
        met[:] = False
        met[np.concatenate(walked)] = True
        other = np.flatnonzero(met & waiting & (label != label[a]))
        small, large = np.minimum(sizes[other], sizes[a]), np.maximum(sizes[other], sizes[a])
        other = other[100 * small >= 75 * large]
        other = other[(signatures[other] == signatures[a]).sum(axis=1) >= MATCHES]
        if not len(other):
            continue
        mine = code[ends[a] - sizes[a] : ends[a]]
        here[mine] = True
        for at in range(0, len(other), 512):
            part = other[at : at + 512]
            starts = np.cumsum(sizes[part]) - sizes[part]
            both = np.add.reduceat(here[np.concatenate([code[ends[b] - sizes[b] : ends[b]] for b in part])], starts, dtype=np.int64)
            for b in part[100 * both >= 75 * (sizes[part] + sizes[a] - both)].tolist():
                if label[b] != label[a]:
                    out.append((a, b))
                    label[label == label[b]] = label[a]
        here[mine] = False
    return out


def _links(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    nodes, at = np.unique(table["node"].to_numpy(), return_index=True)  # a row that repeats comes once
    table = table.take(pa.array(at))
    sets, signatures = table["shingles"].combine_chunks(), table["coordinates"].combine_chunks()
    sizes = np.diff(sets.offsets.to_numpy())
    found = forest(sets.flatten().to_numpy(), sizes, signatures.flatten().to_numpy().reshape(-1, COORDINATES), table["core"].to_numpy(zero_copy_only=False))
    pairs = nodes[np.array(found, np.int64).reshape(-1, 2)]
    return pa.table({"src": pa.array(pairs[:, 0], pa.int64()), "dst": pa.array(pairs[:, 1], pa.int64())})


def _popular(signatures: np.ndarray) -> np.ndarray:
    """For each row, how many rows share its values, summed over the coordinates."""
    total = np.zeros(len(signatures), np.int64)
    for column in signatures.T:
        _, where, counts = np.unique(column, return_inverse=True, return_counts=True)
        total += counts[where]
    return total


def _central_links(large: DataFrame) -> DataFrame:
    """Documents of large groups with ``core``: whether they are linked with the group's most central document, ``central``."""
    central = cut(large.groupBy("group").agg(F.max(F.struct("popularity", "node"))["node"].alias("central")))
    lead = written(large.join(central.select(F.col("central").alias("node"), "central"), "node").dropDuplicates(["group"]).select("group", "central", F.col("shingles").alias("own")), "central")
    if (lead.agg(F.sum(F.size("own"))).first()[0] or 0) <= CENTRAL:
        lead = F.broadcast(lead)
    both = F.size(F.array_intersect("shingles", "own"))
    core = 100 * both >= 75 * (F.size("shingles") + F.size("own") - both)
    return large.join(lead, "group").withColumn("core", core).drop("own")


def _dealt(large: DataFrame) -> DataFrame:
    """Documents of large groups by task ``(group, lo, hi)``: two blocks of documents outside the core, or one of these and one of the core.

    Groups that are all core need no task. Blocks hold ``BLOCK`` shingles at most, and where that is less
    than ``MOST`` blocks ``PART`` documents, so that a group's work is dealt out.
    """
    sums = [F.sum(F.when(c, v)).alias(name) for c, side in ((~F.col("core"), "u"), (F.col("core"), "c")) for v, name in ((F.lit(1), f"{side}_docs"), (F.size("shingles"), f"{side}_shingles"))]
    sizes = large.groupBy("group").agg(*sums).where("u_docs > 0")
    ask, core = (F.greatest(F.ceil(F.col(f"{side}_shingles") / BLOCK), F.least(F.ceil(F.col(f"{side}_docs") / PART), F.lit(MOST))) for side in "uc")
    blocks = cut(sizes.select("group", ask.cast("int").alias("us"), F.coalesce(core, F.lit(0)).cast("int").alias("cs")))
    placed = large.join(few(blocks), "group").withColumn("at", F.expr("cast(if(core, us + pmod(xxhash64(node), cs), pmod(xxhash64(node), us)) as int)"))
    alone = F.expr("us + cs = 1")
    asks = F.filter(F.sequence(F.lit(0), F.expr("us + cs - 1")), lambda j: alone | (j != F.col("at")))
    tasks = F.when(F.col("core"), F.sequence(F.lit(0), F.col("us") - 1)).otherwise(asks)
    return placed.withColumn("with", F.explode(tasks)).select("group", F.least("at", "with").alias("lo"), F.greatest("at", "with").alias("hi"), "node", "core", "coordinates", "shingles")


def _links_of(members: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` within the groups of ``members`` (group, node, popularity, coordinates, shingles)."""
    sizes = cut(members.groupBy("group").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("shingles")).alias("total")))
    little = (F.col("docs") <= FEW) & (F.col("total") <= BLOCK)
    row = sizes.where(little).agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
    bins = max(1, -(-(row["docs"] or 0) // FEW), -(-(row["total"] or 0) * 2 // BLOCK))
    many = cut(sizes.where(~little).select("group"))
    small = members.join(few(many), "group", "left_anti")
    tasks = small.select((-1 - F.expr(f"pmod(xxhash64(group), {bins})")).alias("group"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), "node", F.lit(False).alias("core"), "coordinates", "shingles")
    central = None
    if not many.isEmpty():
        large = written(_central_links(members.join(few(many), "group")), "large-groups")
        central = large.where("core and node != central").select(F.col("node").alias("src"), F.col("central").alias("dst"))
        tasks = tasks.unionByName(_dealt(large))
    links = tasks.groupBy("group", "lo", "hi").applyInArrow(_links, "src long, dst long")
    return links.unionByName(central) if central is not None else links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Texts are linked if their sets of 5-word shingles (A-Z lower-cased, ASCII white space) have a Jaccard
    similarity of 0.75 or more; a component holds what is linked directly or through others and is
    named by its smallest id, whose row stays. Null and white-space texts have no shingles and no links.
    Very long texts are read whole. Rows of a null id are linked with nothing, have a null component and
    stay. Rows that share an id are each judged by their own text. An empty table gives an empty table;
    other columns of ``docs`` are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    sketch = written(by_text(texts, _sketches, "id long, n_shingles long, digest binary, coordinates array<int>", "id", "text"), "sketches")
    sets = sketch.where("id is not null and digest is not null")
    grouped = sets.groupBy("digest").agg(F.min("id").alias("id"), F.first("coordinates").alias("coordinates"))
    classes = written(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")

    values = classes.select("node", F.posexplode("coordinates").alias("at", "v")).select("node", (F.col("at").cast("long") * F.lit(1 << 32) + F.col("v")).alias("value"))
    posted = cut(_postings(values))
    posted = cut(_postings(posted.select("node", F.explode("posted.value").alias("value"))))  # again, without those skipped
    groups = connected_components(_met(posted))
    placed = groups.withColumnRenamed("component", "group").join(posted.select("node", F.aggregate("posted", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("popularity")), "node")
    members = cut(classes.select("node", "id", "digest").join(placed, "node"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            # An id may stand on other texts, too.
            own = [k for k, (f, d) in enumerate(zip(found, batch.column("digest").to_pylist())) if digest(f) == d]
            made = pa.array([signature(found[k]).view(np.int32) for k in own], pa.list_(pa.int32())), pa.array([found[k].view(np.int64) for k in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(own, pa.int32())) for c in ("node", "group", "popularity")), *made], ["node", "group", "popularity", "coordinates", "shingles"])

    asked = texts.join(few(members), "id").select("node", "group", "popularity", "digest", "text")
    full = written(asked.mapInArrow(shingled, "node long, group long, popularity long, coordinates array<int>, shingles array<long>"), "sets")
    components = connected_components(_links_of(full))

    placed = classes.select("node", "id", "digest").join(components, "node")
    smallest = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = classes.select("digest", "id").join(placed.join(smallest, "component").select("digest", "component_id"), "digest", "left")
    # Written, so that the join stands on two plain shuffles, and many copies of one text can be split.
    named = written(named.select("digest", F.coalesce("component_id", "id").alias("component_id")), "named")
    rows = sets.select("id", "n_shingles", "digest").join(named, "digest").drop("digest")
    rest = sketch.where("id is null or digest is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return rows.unionByName(rest).select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, but for ids none of whose rows ``near_duplicates`` keeps."""
    found = near_duplicates(docs, id_col, text_col)
    return without(docs, found.groupBy(id_col).agg(F.bool_or("kept").alias("stays")).where("not stays"), id_col)
