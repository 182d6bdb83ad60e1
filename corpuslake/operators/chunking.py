"""Sentence-aware chunks with overlap, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bounded_sentences, count_tokens, sentences


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, n: s + n)


def chunk_spans(counts: Column, budget: int) -> Column:
    """For token counts of a text's sentences, the chunks as ``struct(start, n)`` of sentences (from 1): sentences join while they fit the budget.

    An array is only copied where a chunk ends.
    """
    kind = "array<struct<start: int, n: int>>"
    begin = F.struct(F.lit(1).alias("start"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("used"), F.expr(f"cast(array() as {kind})").alias("out"))
    ended = lambda s: F.concat(s["out"], F.array(F.struct(s["start"].alias("start"), s["n"].alias("n"))))

    def step(s: Column, n: Column) -> Column:
        fits = (s["used"] == 0) | (s["used"] + n <= budget)
        grown = F.struct(s["start"].alias("start"), (s["n"] + 1).alias("n"), (s["used"] + n).alias("used"), s["out"].alias("out"))
        fresh = F.struct((s["start"] + s["n"]).alias("start"), F.lit(1).alias("n"), n.alias("used"), ended(s).alias("out"))
        return F.when(fits, grown).otherwise(fresh)

    return F.aggregate(counts, begin, step, lambda s: F.when(s["n"] > 0, ended(s)).otherwise(s["out"]))


def carried(counts: Column, overlap: int) -> Column:
    """How many of a chunk's last sentences hold at most ``overlap`` tokens together."""
    begin = F.struct(F.lit(0).cast("long").alias("used"), F.lit(True).alias("open"), F.lit(0).alias("n"))

    def step(s: Column, n: Column) -> Column:
        good = s["open"] & (s["used"] + n <= overlap)
        return F.struct(F.when(good, s["used"] + n).otherwise(s["used"]).alias("used"), good.alias("open"), F.when(good, s["n"] + 1).otherwise(s["n"]).alias("n"))

    return F.aggregate(F.reverse(counts), begin, step, lambda s: s["n"])


def chunks(text: Column, size: int = 1024, overlap: int = 50) -> Column:
    """The chunks of a text, in order, as ``struct(chunk_index, text, n_tokens)``; null and empty texts have none."""

    def of(parts: Column) -> Column:
        return let(F.transform(parts, count_tokens), lambda counts: let(chunk_spans(counts, size - overlap), lambda spans: F.transform(spans, lambda c, i: one(parts, counts, spans, c, i))))

    def one(parts: Column, counts: Column, spans: Column, c: Column, i: Column) -> Column:
        before = F.when(i > 0, let(F.get(spans, i - 1), lambda p: carried(F.slice(counts, p["start"], p["n"]), overlap))).otherwise(0)
        return let(before, lambda k: F.struct(i.alias("chunk_index"), F.array_join(F.slice(parts, c["start"] - k, c["n"] + k), "").alias("text"), total(F.slice(counts, c["start"] - k, c["n"] + k)).alias("n_tokens")))

    return let(F.coalesce(bounded_sentences(text, size - overlap), F.expr("cast(array() as array<string>)")), of)


def checked(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")


def split_sentences(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """One row per sentence: ``key``, ``position``, ``sentence``."""
    return docs.select(key, F.posexplode(sentences(F.col(text_col))).alias("position", "sentence"))


def split_text(text: Column, size: int = 1024, overlap: int = 50) -> Column:
    """The texts of a text's chunks (array<string>)."""
    checked(size, overlap)
    return F.transform(chunks(text, size, overlap), lambda c: c["text"])


def split_documents(docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = 1024, overlap: int = 50, source: str | None = "source") -> DataFrame:
    """Chunks of at most ``size`` tokens: ``key``, ``chunk_index``, ``source``, ``text``, ``n_tokens``.

    The core of a chunk holds at most ``size - overlap`` tokens; before it stand the last sentences of the
    previous core that fit into ``overlap`` tokens. A sentence that is longer than a core is cut into windows of words. Null
    and empty texts have no chunks; a null source becomes ``unknown``.
    """
    checked(size, overlap)
    name = F.coalesce(F.col(source), F.lit("unknown")) if source else F.lit("unknown")
    cut = docs.select(F.col(key).alias("__key"), name.alias("__source"), F.explode(chunks(F.col(text_col), size, overlap)).alias("__chunk"))
    return cut.select(F.col("__key").alias(key), "__chunk.chunk_index", F.col("__source").alias("source"), "__chunk.text", "__chunk.n_tokens")


def split_strides(docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = 64, overlap: int = 8) -> DataFrame:
    """Fixed windows of words: ``key``, ``chunk_index``, ``text``, ``n_tokens``."""
    checked(size, overlap)
    words = docs.select(F.col(key).alias("__key"), F.regexp_extract_all(text_col, F.lit(r"[^ \t\r\n\f\x0B]+"), F.lit(0)).alias("w")).where(F.size("w") > 0)
    last = F.floor((F.greatest(F.size("w") - overlap, F.lit(1)) - 1) / (size - overlap)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * (size - overlap) + 1, F.lit(size)))
    each = words.select("__key", F.posexplode(windows).alias("chunk_index", "part"))
    return each.select(F.col("__key").alias(key), "chunk_index", F.array_join("part", " ").alias("text"), F.size("part").cast("long").alias("n_tokens"))
