"""Exact deduplication as a stateful stream.

Each run writes its rows (identifier, digest of the normalised text, the text) under a numbered folder
of the journal. A stream over the journal, without the texts, keeps one entry per digest in a
disk-backed state store (RocksDB), without expiry: the smallest identifier seen, the locator of its
content (run and row), and a count. Another run with the same ``state`` folder carries on from
there: its texts are grouped with those of earlier runs. Where a digest was hit, the full texts are
compared with the one that the entry's locator leads to, in whatever run it lies; texts that differ in
spite of equal digests are grouped by their bytes.

Only DataFrame and SQL functions run on rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, few, no_rows, shared_dir, text_of, without, written

#: Many partitions hold little state each, so their logs take no disk in advance; an executor's stores share a bounded cache.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}
#: A single blank needs no replacing, so the pattern passes it by.
RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
ROWS = "id long, row long, digest string"
FIRST = "struct<none: boolean, id: long, run: int, row: long>"


def normalised(column: str = "text") -> Column:
    """A text with each run of ASCII white space as one blank; null as empty."""
    return F.regexp_replace(text_of(column), RUN, " ")


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def first_of_all() -> Column:
    """The row that stays: with an identifier, the smallest one, of the earliest run."""
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "run", "row"))


def journalled(spark: SparkSession, journal: str, schema: str) -> DataFrame:
    """Rows of all runs, with ``run``; none if nothing was written yet."""
    try:
        return spark.read.schema(schema + ", run int").parquet(journal)
    except AnalysisException:  # no such folder
        return no_rows(spark, schema + ", run int")


def absorb(spark: SparkSession, state: str) -> DataFrame:
    """Streams what is new in the journal into the state; all groups so far: ``digest``, ``first``, ``n``.

    Each micro-batch writes the groups it changed in a folder of its own number, so a batch that runs
    again overwrites itself.
    """
    kind = f"digest string, first {FIRST}, n long"
    no_rows(spark, kind).write.mode("overwrite").parquet(f"{state}/groups/batch=-1")
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)
    try:
        groups = spark.readStream.schema(ROWS + ", run int").parquet(f"{state}/journal").groupBy("digest").agg(first_of_all().alias("first"), F.count(F.lit(1)).alias("n"))

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{state}/groups/batch={number}")

        groups.writeStream.outputMode("update").option("checkpointLocation", f"{state}/stream").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
    return spark.read.schema(kind + ", batch int").parquet(f"{state}/groups").groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", state: str | None = None, run: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal if they are after each run of ASCII white space became one blank; null counts as
    empty, very long texts are taken whole. Of equal texts the row with the smallest id stays; of rows that
    repeat id and text, one stays; a row without id stays only if no equal text has one. An empty table gives
    an empty table; other columns of ``docs`` are not read.

    With ``state``, a folder that is kept, all rows of earlier runs count too (a row of an earlier run stays
    before one that repeats its id). ``run`` numbers a run, by default as the next one; a number that was
    used already is not written again: its rows are judged anew against all that has come since.
    """
    spark = docs.sparkSession
    state = state or shared_dir(spark, "exact")
    journal, schema = f"{state}/journal", ROWS + ", text string"
    known = {r["run"] for r in journalled(spark, journal, ROWS).select("run").distinct().collect()}
    run = max(known, default=0) + 1 if run is None else run
    if run not in known:
        source = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), normalised(text_col).alias("text"))
        source.select("id", "row", digest_of(F.col("text")).alias("digest"), "text").write.mode("overwrite").parquet(f"{journal}/run={run}")
    groups = written(absorb(spark, state), "groups")
    rows = journalled(spark, journal, schema)
    own = rows.where(F.col("run") == run)
    found = own.join(groups, "digest").select("id", "row", "digest", "first", F.col("n").alias("group_size"))
    odd = _differing(rows, own, groups)
    if not odd.isEmpty():
        found = _regrouped(found, rows, own, odd)
    kept = (F.col("first.run") == run) & (F.col("first.row") == F.col("row"))
    return found.select(F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def _differing(rows: DataFrame, own: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests, one a row, under which a text of this run differs from the one that the group's locator leads to."""
    hit = groups.where("n > 1").select("digest", F.col("first.run").alias("run"), F.col("first.row").alias("row"))
    hit = written(hit.join(own.select("digest").distinct(), "digest", "left_semi"), "hits")
    runs = [r["run"] for r in hit.select("run").distinct().collect()]  # one number a run
    located = rows.where(F.col("run").isin(runs)).join(few(hit.select("run", "row")), ["run", "row"]).select("digest", F.col("text").alias("kept_text"))
    # Both sides are written, so that the join stands on two plain shuffles, and a large group can be split.
    located = written(located, "kept-texts")
    touched = cut(own.select("row", "digest").join(hit.select("digest"), "digest", "left_semi").select("row"))
    texts = written(own.join(few(touched), "row", "left_semi").select("digest", "text"), "hit-texts")
    return written(texts.join(located, "digest").where(F.col("text") != F.col("kept_text")).select("digest"), "differing")


def _regrouped(found: DataFrame, rows: DataFrame, own: DataFrame, odd: DataFrame) -> DataFrame:
    """``found`` with the rows of the digests ``odd`` grouped by their bytes, over all runs."""
    odd = cut(odd.distinct())
    groups = rows.join(odd, "digest", "left_semi").groupBy("digest", "text").agg(first_of_all().alias("first"), F.count(F.lit(1)).alias("group_size"))
    right = own.join(odd, "digest", "left_semi").join(groups, ["digest", "text"]).select("id", "row", "digest", "first", "group_size")
    return found.join(odd, "digest", "left_anti").unionByName(right)


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_duplicates`` keeps.

    Rows that share an id and a text are one row here, whichever of them comes; null ids and ids on
    several texts are told apart by their texts. Other columns are carried along, whatever their names.
    """
    found = written(exact_duplicates(docs, id_col, text_col), "exact")
    ids = found.groupBy(id_col).agg(F.count_if("kept").alias("stay"), F.count_if(~F.col("kept")).alias("go")).where("go > 0")
    unclear = cut(ids.where(F.col("stay").cast("boolean") | F.col(id_col).isNull()).select(F.col(id_col).alias("id")))
    rest = without(docs, ids.where(F.col(id_col).isNotNull()), id_col)
    if unclear.isEmpty():
        return rest
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"), F.col(id_col).cast("long").alias("id"), digest_of(normalised(text_col)).alias("digest"))
    stay = found.where("kept").select(F.col(id_col).alias("stays"), F.col("text_sha256").alias("sha")).distinct()
    some = held.join(unclear.select(F.col("id").alias("open")), F.col("id").eqNullSafe(F.col("open")), "left_semi")
    some = some.join(stay, F.col("id").eqNullSafe(F.col("stays")) & (F.col("digest") == F.col("sha")), "left_semi").dropDuplicates(["id", "digest"])
    if not unclear.where("id is null").isEmpty():
        rest = rest.where(F.col(id_col).isNotNull())
    return rest.unionByName(some.select(*[F.col(f"held.`{c}`").alias(c) for c in docs.columns]))
