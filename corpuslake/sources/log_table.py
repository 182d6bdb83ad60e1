"""Tables whose rows are replaced by key, kept as a log of batches that are merged when read.

A change writes a batch: data files of its rows, dealt by a hash of the key, and the keys whose earlier rows go. Nothing older is
rewritten, so a change costs what it brings. Numbered manifests list the batches in order; a version is there once its
manifest is, which is created exclusively. A row lives if no later batch names its key.

A writer that finds its number taken takes the next one: it lists its batch behind those that came in between, which is right whatever
they hold, as a batch is told by its keys alone and the later one wins. Merging writes old batches again as one, in sizes that at
least double, so a row is rewritten a logarithmic number of times; it gives way to whoever changed the batches it read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared_files import SharedFiles

#: Keys that are broadcast at most when a table is read.
SMALL = 500_000


class LogTable:
    """A table under ``folder``; the last ``keep`` versions can be read, and ``fan`` small batches are merged.

    ``schema`` has no columns ``batch`` and ``bucket``. Rows without a key (null or empty) are added and never replaced.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 16, keep: int = 3, fan: int = 8):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key
        self.buckets, self.keep, self.fan = buckets, keep, fan
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]
        self._files = SharedFiles(spark, self.folder)

    def versions(self) -> list[int]:
        return [int(n[2:]) for n in self._files.names("v-*")]

    def _batches(self, version: int) -> list[dict] | None:
        found = self._files.text(f"v-{version:08d}")
        return None if found is None else json.loads(found)["batches"]

    def _state(self, version: int | None = None) -> tuple[int, list[dict]]:
        """A version and its batches; the latest one (0 before any) without ``version``."""
        while True:
            number = version if version is not None else max(self.versions(), default=0)
            batches = [] if number == 0 else self._batches(number)
            if batches is not None:
                return number, batches
            if version is not None:
                raise ValueError(f"version {version} is not kept")  # else it went just now: look again

    def read(self, version: int | None = None, keys: list[str] | None = None) -> DataFrame:
        """The rows of a version, the latest without one; with ``keys`` only theirs, from their buckets alone."""
        live = self._live(self._state(version)[1])
        if keys is not None:
            live = live.where(F.col("bucket").isin(*[self._bucket(F.lit(k)) for k in keys]) & F.col(self.key).isin(*keys))
        return live.select(self.columns)

    def _bucket(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _load(self, kind: str, batches: list[dict], schema: str) -> DataFrame:
        """Files of batches, with ``batch`` and the number ``born`` of each."""
        rows = self.spark.read.option("basePath", f"{self.folder}/{kind}").schema(schema).parquet(*[f"{self.folder}/{kind}/batch={b['id']}" for b in batches])
        born = F.create_map(*[F.lit(x) for b in batches for x in (b["id"], b["born"])])
        return rows.withColumn("born", F.element_at(born, F.col("batch")))

    def _gone(self, batches: list[dict]) -> DataFrame | None:
        """Keys that batches name, with the number of the last one that does; None if there are none."""
        named = [b for b in batches if b["gone"]]
        if not named:
            return None
        return self._load("gone", named, f"`{self.key}` string, batch string").groupBy(F.col(self.key).alias("__key")).agg(F.max("born").alias("__died"))

    def _live(self, batches: list[dict]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], f"{self.schema}, bucket int")
        rows = self._load("data", batches, f"{self.schema}, batch string, bucket int")
        gone = self._gone(batches[1:])  # nothing is older than the first one
        if gone is None:
            return rows
        if sum(b["gone"] for b in batches[1:]) <= SMALL:
            gone = F.broadcast(gone)
        met = rows.join(gone, F.col(self.key) == F.col("__key"), "left")
        return met.where(F.col("__died").isNull() | (F.col("born") >= F.col("__died"))).drop("__key", "__died")

    def _written(self, rows: DataFrame, gone: DataFrame | None, own_keys: bool) -> dict:
        """Files of a batch that no manifest lists yet."""
        batch = f"b{uuid.uuid4().hex}"
        data = f"data/batch={batch}"
        rows.select(self.columns).withColumn("bucket", self._bucket(F.col(self.key))).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{data}")
        keys = gone.select(F.col(self.key).cast("string").alias(self.key)) if gone is not None else None
        if own_keys:
            own = self.spark.read.schema(f"`{self.key}` string").parquet(f"{self.folder}/{data}").select(self.key)
            keys = own if keys is None else keys.unionByName(own)
        n = 0
        if keys is not None:
            where = f"{self.folder}/gone/batch={batch}"
            keys.where(F.col(self.key).isNotNull() & (F.col(self.key) != "")).distinct().write.parquet(where)
            n = self.spark.read.schema(f"`{self.key}` string").parquet(where).count()
        return {"id": batch, "gone": n, "bytes": self._files.size(data)}

    def _publish(self, change) -> int | None:
        """Creates the next manifest from the batches of the latest; ``change(batches, number)`` may return None to give up."""
        while True:
            number, batches = self._state()
            new = change(batches, number + 1)
            if new is None:
                return None
            if self._files.created(f"v-{number + 1:08d}", json.dumps({"batches": new})):
                self._vacuum()
                return number + 1

    def _vacuum(self) -> None:
        """Deletes manifests beyond the last ``keep``, and batches that only they list; batches of writers at work are listed by none."""
        versions = self.versions()
        kept = {b["id"] for v in versions[-self.keep :] for b in self._batches(v) or []}
        for old in versions[: -self.keep]:
            for b in self._batches(old) or []:
                if b["id"] not in kept:
                    self._files.delete(f"data/batch={b['id']}")
                    self._files.delete(f"gone/batch={b['id']}")
            self._files.delete(f"v-{old:08d}")

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Replaces all rows of the keys of ``rows``, and of ``gone`` (a column of the key's name), by ``rows``; the version."""
        batch = self._written(rows, gone, True)
        version = self._publish(lambda batches, number: [*batches, batch | {"born": number}])
        self.merge()
        return version

    def remove(self, gone: DataFrame) -> int:
        """Drops all rows of the keys in ``gone``; the version."""
        batch = self._written(self.spark.createDataFrame([], self.schema), gone, False)
        return self._publish(lambda batches, number: [*batches, batch | {"born": number}])

    def clear(self) -> int:
        return self._publish(lambda batches, number: [])

    def due(self, batches: list[dict]) -> list[dict]:
        """The newest batches that are to be one: each no larger than those behind it together, ``fan`` of them at least."""
        run, total = [], 0
        for b in reversed(batches):
            if run and b["bytes"] > total:
                break
            run.insert(0, b)
            total += b["bytes"]
        return run if len(run) >= self.fan else []

    def merge(self, run: list[dict] | None = None) -> int | None:
        """Writes the batches of ``run`` (those that are due) as one; None if there was nothing to do, or others changed them meanwhile."""
        batches = self._state()[1]
        run = self.due(batches) if run is None else run
        if len(run) < 2:
            return None
        ids = [b["id"] for b in run]
        first = batches[0]["id"] == ids[0]
        try:
            older = None if first else self._gone(run)  # keys still count for what is older
            one = self._written(self._live(run), older.withColumnRenamed("__key", self.key) if older is not None else None, False)
        except PySparkException:
            if set(ids) <= {b["id"] for b in self._state()[1]}:
                raise
            return None

        def put(batches: list[dict], number: int) -> list[dict] | None:
            known = [b["id"] for b in batches]
            if ids[0] not in known or known[(at := known.index(ids[0])) : at + len(ids)] != ids:
                return None
            return [*batches[:at], one | {"born": run[-1]["born"]}, *batches[at + len(ids) :]]

        return self._publish(put)

    def count(self) -> int:
        return self.read().count()
