"""What the operators of this subpackage share: shared storage, caches of per-word values, stable ids."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space, as the contracts of this subpackage name it (a regular expression class).
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors both reach.

    It lies in ``spark.checkpoint.dir``; where that is unset and Spark runs on one machine (tests) a
    temporary folder is made and set as the checkpoint folder. On a cluster it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_by_hand = spark.sparkContext.getCheckpointDir()
        if not set_by_hand and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = set_by_hand.rsplit("/", 1)[0] if set_by_hand else "file://" + tempfile.mkdtemp(prefix="corpuslake-")
        if not set_by_hand:
            spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed now and kept in the shared checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "cut"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written as Parquet in the shared folder and read again."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows. ``createDataFrame`` would start Python workers on every executor for it, beside those that run functions."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)])


def text_of(column: str = "text"):
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Arrow types of the column types that ``by_text`` can return.
ARROW = {
    "long": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<int>": pa.list_(pa.int32()),
    "array<long>": pa.list_(pa.int64()),
}


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts of few rows, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def by_text(docs: DataFrame, made: Callable[[Iterator[tuple[pa.Array, list[str]]]], Iterator[list]], kind: str, id_col: str, text_col: str) -> DataFrame:
    """Rows that ``made`` yields from batches of ids and texts (null: empty), column by column in order of ``kind``.

    Ids stay 64-bit integers in Arrow arrays, so they are exact beside nulls too.
    """
    names, types = zip(*((name, ARROW[t]) for name, t in (c.split(" ", 1) for c in kind.split(", "))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in made((b.column(0), b.column(1).to_pylist()) for b in sliced(batches)):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types)], names)
        let_go()

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return chosen.mapInArrow(each, kind)


def let_go() -> None:
    """Gives back what a worker's Arrow buffers took: workers outlive tasks, and what they keep adds to the JVM's own memory."""
    pa.default_memory_pool().release_unused()


#: Ids are broadcast up to so many (16 MB); beyond, the other side is shuffled.
SMALL = 1_000_000


def few(table: DataFrame) -> DataFrame:
    """A table of ids that was computed already, to be broadcast if it has at most ``SMALL`` rows."""
    return F.broadcast(table) if table.count() <= SMALL else table


def without(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is not among the distinct ``ids`` (a column of the same name)."""
    return docs.join(few(cut(ids.select(id_col))), id_col, "left_anti").select(docs.columns)


_HELD: dict = {}


def held(kind: str, key, make: Callable):
    """A worker's large cache. Workers outlive tasks, so that of an operator which ran before is let go."""
    found = _HELD.get((kind, key))
    if found is None:
        _HELD.clear()
        gc.collect()
        found = _HELD[kind, key] = make()
    return found


class Memo(dict):
    """A cache in two generations: what was asked for lately survives, memory stays bounded."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 200:
                return value
        self[key] = value
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
        return value


class WordTable(dict):
    """Numbers words in order of arrival and keeps arrays of values for them.

    ``describe`` gets a list of new words and returns a tuple of arrays, one value (or row)
    per word. The table is emptied once it holds more than ``limit`` words, so a worker's
    memory stays bounded; results do not depend on that.
    """

    def __init__(self, describe: Callable[[list], tuple[np.ndarray, ...]], limit: int = 400_000):
        super().__init__()
        self.describe, self.limit = describe, limit
        self.fresh: list = []
        self.filled = 0
        self.columns: list[np.ndarray] = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.fresh.append(word)
        return number

    def numbers(self, words: Iterable) -> np.ndarray:
        """Numbers of the words of one text; ``columns`` then hold their values."""
        if len(self) > self.limit:
            self.clear()
            self.fresh, self.filled, self.columns = [], 0, []
        found = np.fromiter(map(self.__getitem__, words), np.int64)
        if self.fresh:
            self._add(self.describe(self.fresh))
            self.fresh = []
        return found

    def _add(self, values: tuple[np.ndarray, ...]) -> None:
        need = self.filled + len(values[0])
        if not self.columns:
            self.columns = [np.zeros((max(1024, 2 * need), *v.shape[1:]), v.dtype) for v in values]
        elif need > len(self.columns[0]):
            self.columns = [np.concatenate([c, np.zeros_like(c, shape=(max(need, len(c)), *c.shape[1:]))]) for c in self.columns]
        for column, value in zip(self.columns, values):
            column[self.filled : need] = value
        self.filled = need


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants of SplitMix64) for arrays of unsigned hashes."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h
