"""Labelled rows for the classifiers: a bounded sample to fit on, the classes' true shares, and scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, let_go, sliced, text_of, written


def fold(id_col: str, parts: int):
    """crc32 of the id as text, modulo ``parts`` (null for a null id)."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


#: Characters of the training texts of a class that are fitted on at most.
CHARACTERS = 50_000_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep, per_class: int, id_col: str = "doc_id", text_col: str = "text", characters: int = CHARACTERS) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of at most ``per_class`` rows of each class, and the log odds of label 1 over all training labels.

    Rows are those of ``labels`` for which ``keep`` holds, with label 0 or 1; of a document labelled
    more than once the larger label counts, of an id on more than one row of ``docs`` the smallest text.
    The sample is the rows with the smallest hashes of their ids, as many of a class as together hold
    ``characters`` at most; texts in it are whole. The side that is broadcast has at most ``2 * per_class`` ids.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = known.where(keep("id")).groupBy("id").agg(F.max("y").alias("y"))
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    found = written(texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")), "training")
    first = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)  # per_class rows at most
    fits = found.select("id", F.sum(F.length("text")).over(first).alias("upto")).where(F.col("upto") <= characters)
    found = sorted(found.join(F.broadcast(fits), "id").select("id", "text", "y").collect())
    odds = math.log((shares.get(1, 0) + 1) / (shares.get(0, 0) + 1))
    return [r["text"] for r in found], np.array([r["y"] for r in found], np.int64), odds


def scored(docs: DataFrame, model, score: Callable, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` ids with ``score`` and ``predicted``; ``score(model, texts)`` yields log odds text by text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches) -> Iterator[list]:
        for ids, texts in batches:
            z = np.clip(np.fromiter(score(shared.value, texts), np.float64, len(texts)), -700, 700)
            p = 1 / (1 + np.exp(-z))
            yield [ids, pa.array(p), pa.array((p >= threshold).astype(np.int32))]

    return by_text(docs, rows, "id long, score double, predicted int", id_col, text_col).withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model, score: Callable, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    line = math.log(threshold / (1 - threshold))

    def rows(batches):
        for batch in sliced(batches):
            texts = (t or "" for t in batch.column(at).to_pylist())
            yield batch.filter(pa.array([z >= line for z in score(shared.value, texts)], pa.bool_()))
        let_go()

    return docs.mapInArrow(rows, docs.schema)
