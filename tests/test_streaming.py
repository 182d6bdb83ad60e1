"""File events, debounced triggers and a stream's published state."""

from __future__ import annotations

import json
import os
import time
from types import SimpleNamespace

import pandas as pd
from conftest import DATA
from pyspark.sql import functions as F

from corpuslake.plans.ingest import Ingestion
from corpuslake.streaming import debounce, events
from corpuslake.streaming.progress import Progress
from corpuslake.streaming.watch import STATE, watched
from test_pipeline import Counting, pdf


def until(said, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if found := said():
            return found
        time.sleep(0.3)
    raise AssertionError("it did not happen in time")


def test_reader_of_events(tmp_path):
    for name, t in (("a.pdf", 5), ("b.pdf", 5), ("c.PDF", 7), ("d.txt", 8), ("new.pdf", None)):
        (tmp_path / name).write_text("x")
        if t:
            os.utime(tmp_path / name, (t, t))
    (tmp_path / "folder.pdf").mkdir()
    reader = events.EventReader(str(tmp_path), "*.[pP][dD][fF]", 3600)
    zero, latest = reader.initialOffset(), reader.latestOffset()
    assert latest == {"modified": "7000000000", "path": str(tmp_path / "c.PDF")}  # the new file has not settled
    names = lambda start, end: [os.path.basename(p) for part in reader.partitions(start, end) for p, _, _ in part.files]
    assert names(zero, latest) == ["a.pdf", "b.pdf", "c.PDF"] and names(latest, latest) == []
    middle = {"modified": "5000000000", "path": str(tmp_path / "a.pdf")}
    assert names(zero, middle) == ["a.pdf"] and names(middle, latest) == ["b.pdf", "c.PDF"]
    os.utime(tmp_path / "a.pdf", (9, 9))
    assert names(latest, reader.latestOffset()) == ["a.pdf"]
    assert events.local_path("file:///x/y/") == events.local_path("file:/x/y") == "/x/y"


def test_events_of_a_folder_and_a_restart(spark, tmp_path):
    """A file rewritten in place gives one event, a restart from the checkpoint none."""
    docs, seen = tmp_path / "in", []
    docs.mkdir()
    (docs / "a.pdf").write_text("1")
    (docs / "b.pdf").write_text("22")

    def started():
        stream = events.folder_events(spark, str(docs), settle=0.2)
        note = lambda batch, _: seen.extend((os.path.basename(r["path"]), r["length"]) for r in batch.collect())
        return stream.writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(note).trigger(processingTime="0.3 seconds").start()

    query = started()
    until(lambda: len(seen) >= 2)
    (docs / "a.pdf").write_text("333")
    until(lambda: len(seen) >= 3)
    time.sleep(1.5)
    query.stop()
    assert sorted(seen[:2]) == [("a.pdf", 1), ("b.pdf", 2)] and seen[2:] == [("a.pdf", 3)]
    query = started()
    time.sleep(3)
    assert len(seen) == 3
    (docs / "c.pdf").write_text("4444")
    until(lambda: len(seen) >= 4)
    query.stop()
    assert seen[3:] == [("c.pdf", 4)]


def test_closed_sessions_equal_the_batch(spark, tmp_path):
    """The events table replayed in order, a slice a micro-batch: what has closed is what the sessions of the whole table say."""
    table = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for i, part in enumerate(table.orderBy("ts").randomSplit([1.0])):
        rows = part.orderBy("ts").collect()
    step = -(-len(rows) // 4)
    for i in range(4):
        spark.createDataFrame(rows[i * step : (i + 1) * step], table.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in order of time
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fired = debounce.debounced(stream, "user_id", "event_type", 6 * 3600, ts="ts")
    query = fired.writeStream.option("checkpointLocation", str(tmp_path / "check")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    query.awaitTermination()
    last = max(r["ts"] for r in rows)
    whole = debounce.sessions(table, "user_id", "event_type", gap="6 hours").withColumn("key", F.col("user_id").cast("string"))
    closed = whole.where(F.col("last") + F.expr("interval 6 hours") < F.lit(last))
    names = ["key", "first", "last", "n_events", "n_pending"]
    found, wanted = (sorted(map(tuple, df.select(names).collect())) for df in (spark.read.parquet(str(tmp_path / "out")), closed))
    assert len(wanted) > 100 and found == wanted


class Kept:
    """State and timers of one key, kept in memory."""

    def __init__(self):
        self.value, self.paths, self.timers = None, set(), set()
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.discard
        self.exists, self.get = lambda: self.value is not None, lambda: self.value
        self.containsKey, self.updateValue = self.paths.__contains__, lambda key, _: self.paths.add(key)

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None
        self.paths.clear()


def test_a_slow_micro_batch_is_no_quiet():
    """By the clock events are seen when their micro-batch starts; one that comes late starts the timer anew, as it hasn't run out yet."""
    kept, one = Kept(), debounce.Debounce(3000, event_time=False)
    one.init(kept)
    seen = lambda at, *paths: list(one.handleInputRows(("in",), iter([pd.DataFrame({"key": "in", "path": list(paths)})]), SimpleNamespace(getCurrentProcessingTimeInMs=lambda: at)))
    ran_out = lambda at: list(one.handleExpiredTimer(("in",), None, SimpleNamespace(getExpiryTimeInMs=lambda: at)))
    assert seen(1300, "a") == [] and kept.timers == {4301}
    assert seen(5000, "b", "c") == [] and kept.timers == {8001}  # the micro-batch of "a" took longer than the gap
    assert ran_out(4301) == []
    (fired,) = ran_out(8001)
    assert fired[["n_events", "n_pending"]].values.tolist() == [[3, 3]] and not kept.exists()


def test_ingestion_waits_for_quiet(spark, tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    job = Ingestion(spark, str(docs), str(tmp_path / "out"), Counting())
    ran = []
    run = job.run_incremental
    job.run_incremental = lambda: ran.append(time.time()) or run()
    query = watched(job, str(tmp_path / "check"), forever=True, every=0.3, quiet=3.0)
    for i in range(4):  # files come one after the other, none is taken up before the last
        (docs / f"{i}.pdf").write_bytes(pdf(f"Text {i}."))
        last = time.time()
        time.sleep(1.2)
    until(lambda: job.last_status()["status"] == "complete")
    assert len(ran) == 1 and ran[0] - last >= 3.0 and job.store.count() == 4
    state = json.loads(job.files.text(STATE))
    assert state["state"] in ("started", "running", "waiting")
    # A failure of the ingestion ends the stream and is published.
    job.run_incremental = lambda: 1 / 0
    (docs / "bad.pdf").write_bytes(pdf("More."))
    until(lambda: not query.isActive)
    assert job.last_status()["status"] == "error" and "division" in job.last_status()["error_message"]
    assert "division" in until(lambda: (s := json.loads(job.files.text(STATE)))["state"] == "error" and s["error_message"])


def test_states_of_a_stream(spark, tmp_path):
    said = []
    spark.streams.addListener(Progress("told", lambda state, **more: said.append((state, more))))
    stream = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    for name in ("told", "other"):
        query = stream.writeStream.queryName(name).format("noop").trigger(processingTime="0.3 seconds").start()
        until(lambda: query.lastProgress and query.lastProgress["batchId"] > 2)
        query.stop()
    until(lambda: said and said[-1][0] == "stopped")
    assert said[0] == ("started", {}) and sum(more.get("rows", 0) for _, more in said) > 0
    assert [s for s, _ in said].count("started") == 1
