"""The pivot index against the search that compares every row."""

from __future__ import annotations

import numpy as np
import pytest

from corpuslake.operators import pivots
from corpuslake.operators.vectors import nearest

KIND = "vec_id long, embedding array<double>"


def both(spark, rows, asked, k, **settings):
    store, queries = spark.createDataFrame(rows, KIND), spark.createDataFrame(asked, "query_id long, embedding array<double>")
    index = pivots.PivotIndex(store)
    found = index.search(queries, k, **settings)
    plain = nearest(store, queries, k, **settings)
    as_rows = lambda df: sorted(map(repr, df.select("query_id", "rank", "vec_id", "distance").collect()))
    assert as_rows(found) == as_rows(plain)
    return index, len(as_rows(plain))


def clustered(n, seed=0, centres=40, length=16):
    r = np.random.default_rng(seed)
    at = r.normal(size=(centres, length)) * 10
    return [(i, v.tolist()) for i, v in enumerate(at[r.integers(0, centres, n)] + r.normal(size=(n, length)))]


def test_clustered_vectors_are_mostly_skipped(spark):
    rows = clustered(6000)
    index, n = both(spark, rows, [(i, v) for i, v in rows if i % 100 == 0], 4)
    print("share of distances computed:", index.share)
    assert n == 240 and index.share < 0.2


def test_parts_rings_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(pivots, "STORED", 50)
    monkeypatch.setattr(pivots, "BLOCK", 7)
    rows = clustered(1500, 1, 5) + [(10_000 + i, [1.0] * 16) for i in range(400)]  # a third of the ring are copies
    index, _ = both(spark, rows, rows[::60] + [(-1, [1.0] * 16), (-2, [500.0] * 16)], 6)
    assert index.rings["parts"].max() > 1 and index.rings["ring"].max() > 0


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ties_repeats_and_rounding(spark, k):
    rows = [(i % 9, [float(i % 4), 0.0]) for i in range(30)] + [(100, None)]
    asked = [(1, [0.0, 0.0]), (1, [3.0, 0.0]), (2, [1.5, 0.0]), (3, None)]
    both(spark, rows, asked, k)
    both(spark, [(i, [float(i) * 1e-9, 0.0]) for i in range(20)], asked, k, places=6)


def test_unstructured_and_empty(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=24).tolist()) for i in range(500)]
    both(spark, rows, rows[:20], 5)
    both(spark, [], rows[:2], 3)
    both(spark, rows, [], 3)


def test_components_that_are_not_finite(spark):
    rows = clustered(300, 4, 6) + [(900, [float("nan")] + [0.0] * 15), (901, [float("inf")] + [0.0] * 15), (902, [None] + [0.0] * 15)]
    both(spark, rows, rows[::50], 4)
