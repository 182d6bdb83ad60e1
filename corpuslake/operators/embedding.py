"""An embedder that needs no provider: signed feature hashing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose hashes a worker keeps.
KEPT = 200_000


@lru_cache(KEPT)
def word_hash(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:8], 16)


def hash_embedded(docs: DataFrame, key: str, text: str = "text", dimension: int = 64) -> DataFrame:
    """``key`` and ``embedding`` (array<double>): hashed lower-case words, signed, scaled to length 1.

    A vector is made from its row alone, where the row is read; nothing is shuffled. Texts that are null or hold no word get all zeros.
    """
    rows = docs.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros((batch.num_rows, dimension))
            for i, said in enumerate(batch.column(1)):
                h = np.fromiter(map(word_hash, re.findall("[a-z0-9]+", said.as_py() or "")), np.int64)
                made[i] = np.bincount(h % dimension, np.where(h // dimension % 2 == 0, 1.0, -1.0), dimension)
            lengths = np.sqrt((made * made).sum(axis=1, keepdims=True))
            made = np.divide(made, lengths, out=np.zeros_like(made), where=lengths > 0)
            at = pa.array(np.arange(0, made.size + 1, dimension, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(made.ravel()))], [key, "embedding"])

    return rows.mapInArrow(each, f"`{key}` {rows.schema['key'].dataType.simpleString()}, embedding array<double>")
