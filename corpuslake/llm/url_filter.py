"""URL filter: rules first, then a ratio of two character language models.

Rules name a host and a path prefix. URLs that no rule fits are judged by two smoothed variable-order
Markov models over characters, one fitted to the URLs that rules allow and one to those that rules
block. Each character is predicted from up to ``ORDER`` characters before it; counts of longer
contexts are interpolated with those of shorter ones. The score is the difference of the two
log-likelihoods by character.

The threshold is calibrated on scores that are held back: URLs with a rule are dealt into two halves by
their hash, and each half is scored by models fitted to the other. It lies between the mean scores of
accepted and rejected URLs, nearer to those that scatter less. Models fitted to both halves judge the rest.

Counts are exact and cover all URLs, so the tables grow with the corpus. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ORDER = 4
#: Weight of the shorter context against counts of the longer one.
BACK = 2.0
#: Characters that the empty context spreads its weight over.
ALPHABET = 256.0
START, END = "\u0002", "\u0003"
#: Verdict and rule.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``struct(verdict, rule)``; null if none does."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        one = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        found = F.when(fits, one) if found is None else found.when(fits, one)
    return found


def grams(urls: DataFrame) -> DataFrame:
    """Each character of each ``text`` with the ``ORDER`` characters before it: ``gram``."""
    padded = F.concat(F.lit(START * ORDER), "text", F.lit(END))
    pieces = F.transform(F.sequence(F.lit(1), F.length("text") + 1), lambda i: padded.substr(i, F.lit(ORDER + 1)))
    return urls.withColumn("gram", F.explode(pieces))


#: Counts of a gram: of the URLs that rules allow and block, in each of the two halves.
COUNTS = ("yes0", "no0", "yes1", "no1")


def model(counted: DataFrame) -> DataFrame:
    """Log ratios of each ``gram`` (accepted over rejected) by the models of each half and of the whole: ``halves``, ``ratio``.

    Interpolated from the empty context up: p = (count + BACK * shorter p) / (context's count + BACK). Each
    order's table of distinct strings is joined with that of the next shorter ones, so a key meets at
    most as many rows as there are characters, however often it occurs.
    """
    shorter = None
    for k in range(ORDER + 1):
        seen = counted.groupBy(F.expr(f"right(gram, {k + 1})").alias("seen")).agg(*[F.sum(c).alias(c) for c in COUNTS])
        seen = seen.withColumn("context", F.expr(f"substring(seen, 1, {k})"))
        totals = seen.groupBy("context").agg(*[F.sum(c).alias(f"all_{c}") for c in COUNTS])
        rows = seen.join(totals, "context")
        if shorter is None:
            rows = rows.withColumn("p", F.array(*[F.lit(1.0 / ALPHABET)] * 6))
        else:
            rows = rows.withColumn("tail", F.expr("substring(seen, 2)")).join(shorter, "tail")
        chances = []
        for i, parts in enumerate([("yes0",), ("no0",), ("yes1",), ("no1",), ("yes0", "yes1"), ("no0", "no1")]):
            of, all_of = (sum(F.col(f"{prefix}{c}") for c in parts) for prefix in ("", "all_"))
            chances.append((of + BACK * F.col("p")[i]) / (all_of + BACK))
        shorter = rows.select(F.col("seen").alias("tail"), F.array(*chances).alias("p"))
    ratio = lambda i: F.log(F.col("p")[i]) - F.log(F.col("p")[i + 1])
    return shorter.select(F.col("tail").alias("gram"), F.array(ratio(0), ratio(2)).alias("halves"), ratio(4).alias("ratio"))


def scored(each: DataFrame, counted: DataFrame) -> DataFrame:
    """Mean ``ratio`` of the grams of each ``key``; a URL of a rule gets that of the half that it is not in as ``held``.

    Grams that stand for more than a thousandth of all occurrences (so fewer than a thousand of them) are
    broadcast; the others are joined by shuffle, and none of them is hot.
    """
    table = written(model(counted).join(counted.select("gram", "n"), "gram"), "url-model")
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total / 1000
    points = each.select("key", "half", "gram")
    common = F.broadcast(table.where(hot).drop("n"))
    joined = points.join(common, "gram").unionByName(points.join(F.broadcast(table.where(hot).select("gram")), "gram", "left_anti").join(table.where(~hot).drop("n"), "gram"))
    other = F.when(F.col("half") == 0, F.col("halves")[1]).otherwise(F.col("halves")[0])
    return joined.groupBy("key").agg(F.avg("ratio").alias("score"), F.avg(other).alias("held"))


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: ``id_col``, ``host``, ``path``, ``rule``, ``verdict`` and the model's ``score``.

    Null URLs and such without ``://`` have an empty host and path and are scored as their text (null: the
    empty text); very long URLs are read whole. Where rules allow nothing or block nothing the models agree or
    lean one way, and scores at the threshold are allowed. Equal URLs are scored once; null ids and repeated
    rows come out as they are; an empty table gives an empty table; other columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"))
    rows = rows.withColumn("host", host).withColumn("path", path).withColumn("of", ruled(F.col("host"), F.col("path"), rules))
    # The scheme says nothing; the rest is what the models read.
    distinct = rows.select("url", F.col("of.verdict").alias("verdict")).distinct()
    at = F.instr("url", "://")
    distinct = distinct.withColumn("text", F.when(at > 0, F.col("url").substr(at + 3, F.length("url"))).otherwise(F.col("url")))
    distinct = distinct.withColumn("key", F.unhex(F.md5("url"))).withColumn("half", F.when(F.md5("url") < "8", 0).otherwise(1))
    # A stated number of tasks, so that few bytes of URLs do not become very many grams in one task.
    distinct = written(distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "url"), "urls")

    each = grams(distinct)
    of = lambda verdict, half: F.count_if((F.col("verdict") == verdict) & (F.col("half") == half))
    counts = [of("allow", 0), of("block", 0), of("allow", 1), of("block", 1)]
    counted = written(each.groupBy("gram").agg(*[c.alias(name) for c, name in zip(counts, COUNTS)], F.count(F.lit(1)).alias("n")), "url-grams")
    scores = written(distinct.select("url", "verdict", "key").join(scored(each, counted), "key").drop("key"), "url-scores")

    stats = {r["verdict"]: r for r in scores.where("verdict is not null").groupBy("verdict").agg(F.avg("held").alias("mean"), F.coalesce(F.stddev("held"), F.lit(0.0)).alias("spread")).collect()}
    line = threshold(stats.get("allow"), stats.get("block"))
    found = rows.join(scores.select("url", "score"), "url", "left")
    verdict = F.coalesce("of.verdict", F.when(F.coalesce("score", F.lit(0.0)) >= line, "allow").otherwise("block"))
    return found.select(F.col("id").alias(id_col), "host", "path", F.col("of.rule").alias("rule"), verdict.alias("verdict"), "score")


def threshold(allowed, blocked) -> float:
    """Where the held-back scores of both sets lie as many spreads away; without one of the sets, zero."""
    if allowed is None or blocked is None:
        return 0.0
    a, b = allowed["spread"] + 1e-6, blocked["spread"] + 1e-6
    return (allowed["mean"] * b + blocked["mean"] * a) / (a + b)
