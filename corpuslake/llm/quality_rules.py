"""Quality rules: counts within a document, and lines that stand in too many documents of a host.

Lines are hashed in normal form (ASCII letters lower-cased, white space collapsed). For every host, distinct documents with a line are
counted; copies of one text are one document, so that a page held many times doesn't make its own lines frequent. A line in more
documents than the limits allow is removed, and a document that loses too much is rejected. All of it is built-in functions.

Texts are read where they lie and never shuffled by the query. What is shuffled are line hashes, one row for each host and distinct text
with arrays of 64-bit hashes and word counts, then partial counts by host and line, so a line or host that is everywhere is
counted by each task for itself first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_of, written

WORD = f"[^{SPACE}]+"
#: The symbols, the window, and the base limits.
SYMBOLS, WINDOW, FEWEST_WORDS, REPEATED_PERCENT = "[#*$%&|<>]", 8, 20, 30
#: A line is removed if it stands in at least so many distinct documents of its host, and in more than this share of them.
LEAST, SHARE = 20, 0.02
#: A document is depleted if it loses more than this share of its words.
DEPLETED = 0.5
#: Frequent lines, hosts and depleted documents are broadcast up to so many (some 50 bytes each).
SMALL = 300_000
CAPITALS, LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def line_hash(line: Column) -> Column:
    """Hash of a line in normal form."""
    return F.xxhash64(F.regexp_replace(F.translate(F.btrim(line, F.lit("\t\n\x0b\x0c\r ")), CAPITALS, LETTERS), f"[{SPACE}]+", " "))


def filled_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows of ``window`` words that stand twice or more in the array, the first included.

    Windows are compared by 64-bit hashes: of a million windows some two differing ones agree with a probability of 3e-8. Only arrays
    with an equal pair are sorted.
    """

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s, e, j: F.get(s, j)["h"] == e["h"]
        found = let(placed, lambda s: F.filter(s, lambda e, j: F.coalesce(F.when(j > 0, same(s, e, j - 1)), F.lit(False)) | F.coalesce(same(s, e, j + 1), F.lit(False))))
        at = let(F.sort_array(F.transform(found, lambda e: e["i"])), lambda p: F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))))
        return F.aggregate(at, F.lit(0).cast("long"), lambda s, x: s + x)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(window))))
    once = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))
    return F.when(F.size(words) > window, let(windows, once)).otherwise(F.lit(0).cast("long"))


def counted(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``."""
    rows = docs.withColumn("__text", text_of(text_col)).withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    lines = filled_lines(F.col("__text"))
    rows = rows.withColumns({
        "n_words": F.size("__words").cast("long"), "word_chars": F.length(F.array_join("__words", "")).cast("long"), "n_symbols": F.regexp_count("__text", F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"), "n_repeat_words": repeated_words(F.col("__words")),
    })
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("__text", "__words")


def document_lines(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """``(host, digest, lines)``, a row for each distinct text of a host; lines are ``(h, n)``: hash and words, once for each place."""
    count = lambda x: F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)))
    lines = F.transform(filled_lines(F.col("text")), lambda x: F.struct(line_hash(x).alias("h"), count(x).alias("n")))
    rows = docs.select(host_of(host_col).alias("host"), text_of(text_col).alias("text"))
    rows = rows.select("host", digest_of(F.col("text")).alias("digest"), lines.alias("lines")).where(F.size("lines") > 0)
    return written(rows.groupBy("host", "digest").agg(F.first("lines").alias("lines")), "lines")


def host_of(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(""))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= SMALL else table


def frequent_lines(lines: DataFrame, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """``(host, h)``: the lines above both limits."""
    hosts = written(lines.groupBy("host").agg(F.count(F.lit(1)).alias("documents")), "hosts")
    counts = lines.select("host", F.explode(F.array_distinct(F.col("lines.h"))).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return written(counts.join(few(hosts), "host").where(F.col("n") > share * F.col("documents")).select("host", "h"), "frequent")


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", least: int = LEAST, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``removed_words``, ``kept`` and ``clean_text``, the text without its frequent lines.

    Null texts count as empty: no words, so ``base_failed``. A null host is the empty one. Repeated rows and ids each keep their row; copies
    of a text get equal results and count as one document of their host. Texts of any length are read whole. An empty table gives no rows.
    Counts that ``docs`` has under the names of these columns are replaced. Without ``clean_text`` in the result no text is shuffled.
    """
    given = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "removed_lines", "kept", "clean_text")
    lines = document_lines(docs, text_col, host_col)
    frequent = frequent_lines(lines, least, share)
    hit = lines.select("host", "digest", F.explode("lines").alias("line")).select("host", "digest", F.col("line.h").alias("h"), F.col("line.n").alias("n")).join(few(frequent), ["host", "h"])
    lost = hit.groupBy("host", "digest").agg(F.sum("n").alias("removed_words"), F.collect_set("h").alias("removed_lines"))
    lost = written(lost.select(F.col("host").alias("__host"), F.col("digest").alias("__digest"), "removed_words", "removed_lines"), "lost")
    rows = counted(given, text_col).withColumns({"__h": host_of(host_col), "__d": digest_of(text_of(text_col))})
    met = rows.join(few(lost), (F.col("__h") == F.col("__host")) & (F.col("__d") == F.col("__digest")), "left")
    removed = F.coalesce("removed_words", F.lit(0).cast("long"))
    stays = lambda x: ~F.coalesce(F.array_contains(F.col("removed_lines"), line_hash(x)), F.lit(False)) | ~x.rlike(f"[^{SPACE}]")
    clean = F.when(F.col("removed_lines").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(F.split(text_of(text_col), "\n"), stays), "\n"))
    met = met.withColumns({"removed_words": removed, "clean_text": clean, "kept": ~F.col("base_failed") & (removed <= depleted * F.col("n_words"))})
    return met.drop("__h", "__d", "__host", "__digest", "removed_lines")
