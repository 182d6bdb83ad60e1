"""Token counts by byte pairs, as joins over distinct pieces.

Texts are split into pieces by the vocabulary's pattern, in Spark. Distinct pieces and how often they stand in all texts are a table;
each is merged once, however often it stands. Frequent pieces, as many as may be broadcast, are counted by the tasks that read the texts;
only the others are shuffled, so neither a piece that is everywhere nor the number of distinct pieces is a bottleneck.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens
from ..session import checkpointed

#: Fixed value: how a text is cut into pieces (letters, digits, other signs, white space), with Unicode's white space.
PATTERN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose counts are broadcast at most (some 60 bytes each), the most frequent ones.
SMALL = 300_000


class Vocabulary:
    """Ranks of byte strings, from lines of a base64 token and its rank; smaller than a broadcast (some ten MB at 200,000 tokens)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        self.path, self.pattern = path, pattern

    @property
    def ranks(self) -> dict[bytes, int]:
        return _ranks(self.path)


@lru_cache(4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


#: Vocabularies by the beginning of a model's name; the empty beginning is for all others.
KNOWN: dict[str, Vocabulary] = {}


def register_vocabulary(model: str, vocabulary: Vocabulary) -> None:
    KNOWN[model] = vocabulary


def vocabulary_for(model: str) -> Vocabulary | None:
    """That of the longest registered beginning of the model's name; None (words are counted) without any."""
    fits = [name for name in KNOWN if model.startswith(name)]
    return KNOWN[max(fits, key=len)] if fits else None


def pieces_of(text: Column, pattern: str = PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def merged_length(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of one piece, by a heap of pairs; for pieces of any length."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after, before, n = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), len(parts)
    pair = lambda i, j: (ranks[parts[i] + parts[j]], i, j, parts[i], parts[j])
    heap = [pair(i, i + 1) for i in range(n - 1) if parts[i] + parts[i + 1] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, j, left, right = heapq.heappop(heap)
        if parts[i] != left or parts[j] != right or after[i] != j:
            continue
        parts[i], parts[j], n = left + right, None, n - 1
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and parts[a] + parts[b] in ranks:
                heapq.heappush(heap, pair(a, b))
    return n


def piece_counts(pieces: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``pieces`` (a column ``piece``, distinct) with ``n``: the tokens of each."""
    shared = pieces.sparkSession.sparkContext.broadcast(vocabulary.ranks)
    at, names = pieces.columns.index("piece"), [*pieces.columns, "n"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [merged_length(x.as_py().encode(), shared.value) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.mapInArrow(each, f"{kinds}, n int")


def _frequent(counts: DataFrame) -> DataFrame:
    """Those of ``counts`` (piece, times, n) that stand most often, ``SMALL`` at most: from some power of two of times on."""
    levels = sorted((r["level"], r["count"]) for r in counts.groupBy(F.floor(F.log2("times")).alias("level")).count().collect())  # 64 at most
    total, least = 0, None
    for level, n in reversed(levels):
        total += n
        if total > SMALL:
            break
        least = level
    return counts.where(F.floor(F.log2("times")) >= least) if least is not None else counts.limit(0)


def with_token_counts(docs: DataFrame, vocabulary: Vocabulary | None, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with ``into``: the tokens of the text under ``vocabulary`` (words between white space without one); null and empty texts have none.

    Counts are made once for each distinct text; repeated rows and texts each keep their row. A long text, or a long piece, is one row.
    """
    if vocabulary is None:
        return docs.withColumn(into, F.coalesce(count_tokens(F.col(text)), F.lit(0)).cast("long"))
    digest = F.unhex(F.sha2(F.col(text), 256))
    texts = docs.select(digest.alias("__digest"), F.col(text))  # a select of its own: once a text, not once a piece
    pieces = F.explode(pieces_of(F.col(text), vocabulary.pattern)).alias("piece")
    counts = checkpointed(piece_counts(docs.select(pieces).groupBy("piece").agg(F.count(F.lit(1)).alias("times")), vocabulary)).select("piece", "times", "n")
    known = F.broadcast(_frequent(counts).select(F.col("piece").alias("__piece"), "n"))
    said = texts.select("__digest", pieces).join(known, F.col("piece") == F.col("__piece"), "left")
    # One row a text for all frequent pieces, and one for each other piece.
    sums = checkpointed(said.groupBy("__digest", F.when(F.col("n").isNull(), F.col("piece")).alias("piece")).agg(F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__times")))
    others = sums.where("piece is not null").join(counts, "piece").select("__digest", (F.col("n") * F.col("__times")).alias("__n"))
    rows = texts.groupBy("__digest").agg(F.count(F.lit(1)).alias("__rows"))
    whole = sums.where("piece is null").select("__digest", "__n").unionByName(others).groupBy("__digest").agg(F.sum("__n").alias("__n")).join(rows, "__digest")
    whole = whole.select(F.col("__digest").alias("__known"), F.expr("__n div __rows").alias(into))  # copies were summed together
    met = docs.drop(into).withColumn("__digest", digest).join(whole, F.col("__digest") == F.col("__known"), "left")
    return met.withColumn(into, F.coalesce(into, F.lit(0)).cast("long")).drop("__digest", "__known")
