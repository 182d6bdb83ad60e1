"""The log table: bytes a change writes, versions, merging, writers at once, keys of every kind."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from corpuslake.sources.log_table import LogTable
from corpuslake.sources.shared_files import SharedFiles
from corpuslake.sources.vector_table import VectorTable

KIND = "k string, a int"


def rows(spark, *given):
    return spark.createDataFrame(list(given), KIND)


def held(table, **options):
    return sorted((tuple(r) for r in table.read(**options).collect()), key=str)


def test_a_change_writes_what_it_brings(spark, tmp_path):
    """100 of 20,000 sources are replaced: bytes follow the batch, not the table."""
    table = VectorTable(spark, str(tmp_path / "t"), 8)
    made = lambda n, at: spark.range(n).select(F.concat(F.lit("s"), (F.floor(F.col("id") / 5) + at).cast("string")).alias("source"), F.col("id").cast("string").alias("chunk_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit(9).cast("long").alias("n_tokens"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.rand(3).cast("float")).alias("embedding"))
    table.add(made(100_000, 0))
    files = SharedFiles(spark, str(tmp_path / "t"))
    before = files.size("data") + files.size("gone")
    table.add(made(500, 700))
    added = files.size("data") + files.size("gone") - before
    assert added < before / 50
    assert table.count() == 100_000
    again = table.read(keys=["s700", "s3", "none"])
    assert again.groupBy("source").count().count() == 2 and again.count() == 10
    plan = again._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_model_of_many_changes(spark, tmp_path):
    """Against a dictionary, through merges, with null and empty keys, repeated rows and removals."""
    rng = random.Random(4)
    table, plain = LogTable(spark, str(tmp_path / "t"), KIND, "k", buckets=3, fan=3), []
    merged = 0
    for step in range(14):
        names = [rng.choice(["a", "b", "c", "d", "", None]) for _ in range(rng.randint(0, 4))]
        given = [(k, step) for k in names]
        if step % 5 == 4:
            gone = {"a", "c"}
            table.remove(spark.createDataFrame([("a",), ("c",), (None,)], "k string"))
            plain = [r for r in plain if r[0] not in gone]
        elif step == 10:
            table.clear()
            plain = []
        else:
            table.upsert(rows(spark, *given), rows(spark, ("d", 0)) if step == 6 else None)
            gone = {k for k in names if k} | ({"d"} if step == 6 else set())
            plain = [r for r in plain if r[0] not in gone] + given
        merged += table.merge(table._state()[1][-2:]) is not None if step in (3, 8) else 0
        assert held(table) == sorted(plain, key=str), step
    assert merged == 2 and len(table._state()[1]) < 6


def test_merges_grow_with_the_logarithm(spark):
    table = LogTable.__new__(LogTable)
    table.fan = 4
    batches, written = [], 0
    for i in range(200):
        batches.append({"id": i, "bytes": 10})
        run = table.due(batches)
        if run:
            total = sum(b["bytes"] for b in run)
            written += total
            batches = [*batches[: -len(run)], {"id": -i, "bytes": total}]
    assert len(batches) < 12 and written < 2000 * 6


def test_readers_keep_their_version(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), KIND, "k")
    table.upsert(rows(spark, ("a", 1), ("b", 1)))
    old = table.read()
    table.upsert(rows(spark, ("a", 2)))
    table.merge(table._state()[1])
    assert sorted(map(tuple, old.collect())) == [("a", 1), ("b", 1)]
    assert held(table) == [("a", 2), ("b", 1)] and held(table, version=1) == [("a", 1), ("b", 1)]


def test_writers_at_once_all_land(spark, tmp_path):
    """Disjoint keys all stay; of one key the later version stays, whole."""
    tables = [LogTable(spark, str(tmp_path / "t"), KIND, "k", keep=20) for _ in range(4)]
    landed = {}

    def write(i):
        landed[i] = tables[i].upsert(rows(spark, (f"own{i}", i), ("all", i), ("all", i)))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(landed.values()) == [1, 2, 3, 4]
    last = max(landed, key=landed.get)
    assert held(tables[0]) == sorted([("all", last)] * 2 + [(f"own{i}", i) for i in range(4)])


def test_merge_gives_way_to_a_change(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), KIND, "k")
    for i in range(3):
        table.upsert(rows(spark, ("a", i), (f"b{i}", i)))
    run = table._state()[1]
    other = LogTable(spark, str(tmp_path / "t"), KIND, "k")
    written = table._written

    def slow(*given):
        found = written(*given)
        other.upsert(rows(spark, ("a", 9)))  # lands behind: the merged batch goes below it
        return found

    table._written = slow
    assert table.merge(run) == 5 and held(other) == [("a", 9), ("b0", 0), ("b1", 1), ("b2", 2)]
    run = table._state()[1]

    def slower(*given):
        found = written(*given)
        other.clear()
        return found

    table._written = slower
    assert table.merge(run) is None and held(other) == []


def test_small_files_beyond_the_local_file_system(spark, tmp_path):
    """The rename that never replaces, through Hadoop's interface."""
    files = SharedFiles(spark, str(tmp_path))
    files._stored("x")
    files._renamed(files._stored("one"), "v", "NONE")
    with pytest.raises(Exception, match="FileAlreadyExists|already exists"):
        files._renamed(files._stored("two"), "v", "NONE")
    assert files.text("v") == "one" and files.text("none") is None
    assert files.created("w", "a") and not files.created("w", "b") and files.text("w") == "a"
    files.replace("w", "c")
    assert files.text("w") == "c" and files.names("[vw]") == ["v", "w"]
