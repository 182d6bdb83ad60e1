"""The catalogue of queries over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import changes, chunking, context, embedding, metrics, pivots, token_counts, vectors
from ..session import shared_folder
from ..sources.log_table import LogTable
from ..streaming import debounce

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        FOUND[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


DISTANCE = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))"


def _knn_sql(wanted: str, k: int, store: str = "embeddings") -> str:
    return f"""
SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM (
  SELECT b.vec_id AS query_id, a.vec_id, {DISTANCE} AS d, row_number() OVER (PARTITION BY b.vec_id ORDER BY {DISTANCE}, a.vec_id)::INT AS rank
  FROM {store} a, (SELECT * FROM embeddings WHERE {wanted}) b) WHERE rank <= {k}"""


def _knn(store: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    found = vectors.nearest(store, wanted.select(F.col("vec_id").alias("query_id"), "embedding"), k)
    return found.withColumn("distance", F.round("distance", 6))


#: Queries of every search: the rows whose id is divisible by 100.
ASKED = "vec_id % 100 = 0"
CENTRES = """(SELECT label AS vec_id, list(v ORDER BY i) AS embedding FROM (
    SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""


@query(_knn_sql(ASKED, 4))
def q_knn_l2(spark, d):
    e = read(spark, d, "embeddings")
    return _knn(e, e.where(ASKED), 4)


@query(_knn_sql(ASKED, 4))
def q_knn_pruned(spark, d):
    """The same rows by rings around pivots, of which those too far away are skipped."""
    e = read(spark, d, "embeddings")
    found = pivots.PivotIndex(e).search(e.where(ASKED).select(F.col("vec_id").alias("query_id"), "embedding"), 4)
    return found.withColumn("distance", F.round("distance", 6))


@query(_knn_sql(ASKED, 1))
def q_knn_single(spark, d):
    e = read(spark, d, "embeddings")
    return _knn(e, e.where(ASKED), 1)


@query(_knn_sql(ASKED, 50, CENTRES))
def q_knn_k_gt_n(spark, d):
    """Against the mean vector of each label, of which there are fewer than ``k``."""
    e = read(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias("embedding"))
    return _knn(centres.withColumnRenamed("label", "vec_id").withColumn("vec_id", F.col("vec_id").cast("int")), e.where(ASKED), 50)


@query("SELECT 'embeddings' AS store, count(*) AS n FROM embeddings UNION ALL SELECT 'documents', count(*) FROM documents")
def q_store_count(spark, d):
    return read(spark, d, "embeddings").agg(F.count("*").alias("n")).select(F.lit("embeddings").alias("store"), "n").union(read(spark, d, "documents").agg(F.count("*").alias("n")).select(F.lit("documents").alias("store"), "n"))


NEW_ROWS = "SELECT doc_id + 1000000 AS doc_id, source, 'new ' || text AS text FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'"


@query(f"SELECT doc_id, source, md5(text) AS text_md5 FROM (SELECT doc_id, source, text FROM documents WHERE source NOT IN (SELECT source FROM ({NEW_ROWS})) UNION ALL {NEW_ROWS})")
def q_upsert_by_source(spark, d):
    store = read(spark, d, "documents").select("doc_id", "source", "text")
    new = read(spark, d, "documents").where("source in ('src1', 'src2') and lang = 'en'").select((F.col("doc_id") + 1000000).alias("doc_id"), "source", F.concat(F.lit("new "), "text").alias("text"))
    table = LogTable(spark, shared_folder(spark, "upsert"), "doc_id long, source string, text string", "source")
    table.upsert(store)
    table.upsert(new)
    return table.read().select("doc_id", "source", F.md5("text").alias("text_md5"))


@query("SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src3', 'src4') GROUP BY source")
def q_remove_by_sources(spark, d):
    gone = spark.createDataFrame([("src3",), ("src4",)], "source string")
    return vectors.without_sources(read(spark, d, "documents").select("doc_id", "source"), gone).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents WHERE source <> 'src3'")
def q_reindex(spark, d):
    return changes.reindexed(read(spark, d, "documents").where("source <> 'src3'").select("doc_id"), "doc_id")


SENTENCES = r"regexp_extract_all(text, '[^.!?\n]+[.!?\n]*')"
WORDS = r"'[^ \t\r\n\f\x0B]+'"
SPACED = r"'[ \t\r\n\f\x0B]*[^ \t\r\n\f\x0B]+[ \t\r\n\f\x0B]*'"


@query(f"SELECT doc_id, unnest(range(len({SENTENCES})))::INT AS position, md5(unnest({SENTENCES})) AS sentence_md5 FROM documents")
def q_split_text(spark, d):
    return chunking.split_sentences(read(spark, d, "documents"), "doc_id").select("doc_id", "position", F.md5("sentence").alias("sentence_md5"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, {WORDS})) AS n_tokens FROM documents")
def q_count_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary's file: in $TOKENIZERS_DIR, or beside the installed package."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@query(None)  # the pattern looks ahead and merging is iterative; tested against a tokenizer over all documents
def q_byte_pair_tokens(spark, d):
    known = token_counts.Vocabulary(vocabulary("byte_bpe_50k.tiktoken"))
    return token_counts.with_token_counts(read(spark, d, "documents").select("doc_id", "text"), known).select("doc_id", "n_tokens")


def _chunk_sql(core: int, overlap: int) -> str:
    """Chunks of sentences; each but the first repeats the last sentences of the one before that fit into ``overlap``."""
    return f"""
WITH RECURSIVE b AS (SELECT doc_id, flatten(list_transform({SENTENCES}, lambda x: CASE WHEN len(regexp_extract_all(x, {WORDS})) <= {core} THEN [x]
  ELSE list_transform(range(0, (len(regexp_extract_all(x, {SPACED})) + {core - 1}) // {core}), lambda i: array_to_string(regexp_extract_all(x, {SPACED})[i * {core} + 1:i * {core} + {core}], '')) END)) AS s FROM documents),
s AS (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(x, {WORDS}))) AS n FROM b),
g(doc_id, i, chunk, used) AS (
  SELECT doc_id, 1, 0, n[1] FROM s WHERE len(s) > 0
  UNION ALL
  SELECT g.doc_id, i + 1, CASE WHEN used = 0 OR used + n[i + 1] <= {core} THEN chunk ELSE chunk + 1 END, CASE WHEN used = 0 OR used + n[i + 1] <= {core} THEN used + n[i + 1] ELSE n[i + 1] END
  FROM g JOIN s USING (doc_id) WHERE i < len(s)),
c AS (SELECT g.doc_id, chunk, i, s[i] AS t, n[i] AS n, sum(n[i]) OVER (PARTITION BY g.doc_id, chunk ORDER BY i DESC) AS tail, max(chunk) OVER (PARTITION BY g.doc_id) AS last FROM g JOIN s USING (doc_id)),
x AS (SELECT doc_id, chunk, i, t, n FROM c UNION ALL SELECT doc_id, chunk + 1, i, t, n FROM c WHERE {overlap} > 0 AND tail <= {overlap} AND chunk < last)
SELECT doc_id, chunk::INT AS chunk_index, md5(string_agg(t, '' ORDER BY i)) AS text_md5, sum(n)::BIGINT AS n_tokens FROM x GROUP BY doc_id, chunk"""


@query(_chunk_sql(128, 0))
def q_chunk_sentences(spark, d):
    return chunking.split_documents(read(spark, d, "documents"), size=128, overlap=0).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), "n_tokens")


@query(_chunk_sql(974, 50))
def q_chunk_overlap(spark, d):
    return chunking.split_documents(read(spark, d, "documents")).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), "n_tokens")


@query(f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, {WORDS}) AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, ((greatest(len(w) - 8, 1) - 1) // 56 + 1)::BIGINT)) AS c FROM w WHERE len(w) > 0)
SELECT doc_id, c::INT AS chunk_index, md5(array_to_string(w[c * 56 + 1:c * 56 + 64], ' ')) AS text_md5, len(w[c * 56 + 1:c * 56 + 64])::BIGINT AS n_tokens FROM c""")
def q_chunk_stride(spark, d):
    return chunking.split_strides(read(spark, d, "documents")).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"), "n_tokens")


BUDGET = f"""
WITH t AS (SELECT source, doc_id, text, len(regexp_extract_all(text, {WORDS})) AS n FROM documents),
r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM t)
SELECT source, count(*) FILTER (s <= 4096) AS n_used, coalesce(sum(n) FILTER (s <= 4096), 0)::BIGINT AS context_tokens, bool_or(s > 4096) AS truncated,
  md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY doc_id) FILTER (s <= 4096), '')) AS context_md5
FROM r GROUP BY source"""


def _contexts(spark, d):
    n = T.count_tokens(F.col("text"))
    docs = context.reachable(read(spark, d, "documents").select("source", "doc_id", "text"), "source", "doc_id", n, 4096)
    return context.contexts(docs.withColumn("n", n), "source", "doc_id", "text", "n", 4096)


@query(BUDGET)
def q_context_budget(spark, d):
    return _contexts(spark, d).select("source", "n_used", "context_tokens", "truncated", F.md5("context").alias("context_md5"))


_BEFORE, _, _REST = T.PROMPT.partition("{context}")
_BETWEEN, _, _AFTER = _REST.partition("{question}")


@query(f"""
SELECT item_id, md5('{_BEFORE}' || d.text || '{_BETWEEN}' || b.text || '{_AFTER}') AS prompt_md5
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id""")
def q_prompt(spark, d):
    pairs = read(spark, d, "benchmark").withColumnRenamed("text", "question").join(read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    return pairs.select("item_id", F.md5(T.prompt(F.col("text"), F.col("question"))).alias("prompt_md5"))


@query("SELECT doc_id, list_transform(range(8), lambda i: 0.1::FLOAT) AS embedding FROM documents")
def q_mock_embed(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_repeat(F.lit(0.1).cast("float"), 8).alias("embedding"))


@query("SELECT doc_id, md5(text) AS md5 FROM documents UNION ALL SELECT page_id, md5(html) FROM pages")
def q_md5(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5("text").alias("md5")).union(read(spark, d, "pages").select("page_id", F.md5("html")))


FILES = "(SELECT '/in/' || doc_id || '.pdf' AS path, md5(text) AS md5, doc_id, source FROM documents)"
LEDGER = f"(SELECT path, CASE WHEN doc_id % 5 = 1 THEN 'old' ELSE md5 END AS md5 FROM {FILES} WHERE doc_id % 3 <> 0)"


def _files(spark, d):
    files = read(spark, d, "documents").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), F.md5("text").alias("md5"), "doc_id", "source")
    return files, files.where("doc_id % 3 <> 0").select("path", F.when(F.col("doc_id") % 5 == 1, "old").otherwise(F.col("md5")).alias("md5"))


@query(f"SELECT f.path, f.md5, l.path IS NULL AS is_new FROM {FILES} f LEFT JOIN {LEDGER} l ON l.path = f.path WHERE l.path IS NULL OR l.md5 <> f.md5")
def q_changed_files(spark, d):
    """Against a ledger of three versions: an old hash of every path, then what it holds now, then some files gone."""
    files, now = _files(spark, d)
    ledger = LogTable(spark, shared_folder(spark, "ledger"), "path string, md5 string", "path", buckets=1)
    ledger.upsert(files.select("path", F.lit("older").alias("md5")))
    ledger.upsert(now)
    ledger.remove(files.where("doc_id % 3 = 0").select("path"))
    return changes.changed_files(files, ledger.read())


@query(f"SELECT f.path, f.md5, l.path IS NULL AS is_new FROM {FILES} f LEFT JOIN {LEDGER} l ON l.path = f.path WHERE f.source IN ('src5', 'src6')")
def q_explicit_files(spark, d):
    files, ledger = _files(spark, d)
    return changes.explicit_files(files.where("source in ('src5', 'src6')"), ledger)


@query(f"SELECT f.path, f.md5, l.path IS NULL AS is_new, ((row_number() OVER (ORDER BY CASE WHEN l.path IS NULL THEN 0 ELSE 1 END, f.path) - 1) // 100 + 1)::BIGINT AS batch FROM {FILES} f LEFT JOIN {LEDGER} l ON l.path = f.path WHERE l.path IS NULL OR l.md5 <> f.md5")
def q_file_batches(spark, d):
    return changes.in_batches(changes.changed_files(*_files(spark, d)), 100)


@query(f"SELECT count(*) AS files, count(*) FILTER (WHERE l.path IS NULL) AS new_files, count(*) FILTER (WHERE l.path IS NOT NULL) AS updated_files FROM {FILES} f LEFT JOIN {LEDGER} l ON l.path = f.path WHERE l.path IS NULL OR l.md5 <> f.md5")
def q_ingest_stats(spark, d):
    return changes.changed_files(*_files(spark, d)).agg(F.count("*").alias("files"), F.count_if("is_new").alias("new_files"), F.count_if(~F.col("is_new")).alias("updated_files"))


@query(r"SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '(\.[^./]+)$', 1)) = '.html'")
def q_discover_filter(spark, d):
    return read(spark, d, "pages").where(T.suffix(F.col("url")) == ".html").select("page_id", "url").orderBy("url", "page_id")


@query("SELECT page_id, CASE WHEN octet_length(encode(html)) > 4000 THEN 'too large' WHEN NOT starts_with(html, '<!DOCTYPE') THEN 'wrong type' ELSE 'ok' END AS verdict FROM pages")
def q_validate_file(spark, d):
    from ..sources.files import admitted

    return read(spark, d, "pages").select("page_id", admitted(F.encode("html", "utf-8"), 4000, b"<!DOCTYPE").alias("verdict"))


@query(r"SELECT page_id, regexp_replace(string_split(url, '/')[-1], '[^\p{L}\p{N}_\-.]', '_', 'g') AS name FROM pages")
def q_sanitize(spark, d):
    return read(spark, d, "pages").select("page_id", T.sanitized(F.col("url")).alias("name"))


@query("SELECT page_id, replace(replace(url, '/', '_'), '-', '_') AS stem FROM pages")
def q_store_path(spark, d):
    return read(spark, d, "pages").select("page_id", T.store_name(F.col("url")).alias("stem"))


@query("SELECT doc_id, md5(substr(text, 1, 500) || '...') AS preview_md5 FROM documents")
def q_preview(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.preview(F.col("text"))).alias("preview_md5"))


@query("""
WITH e AS (SELECT user_id, event_type, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n_events, count(DISTINCT event_type) AS n_pending FROM s GROUP BY user_id, s""")
def q_debounce(spark, d):
    found = debounce.sessions(read(spark, d, "events"), "user_id", "event_type", gap="6 hours")
    return found.withColumn("first", F.col("first").cast("timestamp_ntz")).withColumn("last", F.col("last").cast("timestamp_ntz"))


@query("SELECT item_id FROM (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN '' WHEN item_id % 4 = 1 THEN NULL ELSE text END AS q FROM benchmark) WHERE coalesce(q, '') <> ''")
def q_eval_filter(spark, d):
    items = read(spark, d, "benchmark").withColumn("question", F.when(F.col("item_id") % 4 == 0, "").when(F.col("item_id") % 4 != 1, F.col("text")))
    return metrics.evaluable(items).select("item_id")


@query("SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'faithfulness,answer_relevancy,context_precision,context_recall' ELSE 'faithfulness,answer_relevancy' END AS metrics FROM benchmark")
def q_metric_gate(spark, d):
    return read(spark, d, "benchmark").select("item_id", metrics.active_metrics(F.when(F.col("item_id") % 2 == 0, F.col("text"))).alias("metrics"))


@query("SELECT round(avg(quality), 6) AS quality, round(avg(CASE WHEN doc_id % 3 <> 0 THEN toxic END), 6) AS toxic FROM labels")
def q_eval_summary(spark, d):
    rows = read(spark, d, "labels").withColumn("toxic", F.when(F.col("doc_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("toxic").cast("double")))
    return metrics.summary(rows, ["quality", "toxic"]).select(F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


def _verdicts(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "source"), "doc_id")


VERDICTS = "labels JOIN documents USING (doc_id)"


@query(f"SELECT source, round(sum(quality) / count(quality), 6) AS faithfulness FROM {VERDICTS} GROUP BY source")
def q_faithfulness(spark, d):
    return metrics.share(_verdicts(spark, d), "source", "quality", "faithfulness").withColumn("faithfulness", F.round("faithfulness", 6))


@query(f"SELECT source, round(sum(1 - toxic) / count(toxic), 6) AS context_recall FROM {VERDICTS} GROUP BY source")
def q_context_recall(spark, d):
    return metrics.share(_verdicts(spark, d).withColumn("v", 1 - F.col("toxic")), "source", "v", "context_recall").withColumn("context_recall", F.round("context_recall", 6))


@query(f"""
WITH r AS (SELECT source, quality AS v, sum(quality) OVER w / count(*) OVER w AS p FROM {VERDICTS} WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, round(coalesce(sum(p * v) / nullif(sum(v), 0), 0), 6) AS context_precision FROM r GROUP BY source""")
def q_context_precision(spark, d):
    return metrics.context_precision(_verdicts(spark, d), "source", "doc_id", "quality").withColumn("context_precision", F.round("context_precision", 6))


@query("""
SELECT a.label, round(avg(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS answer_relevancy
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY a.label""")
def q_answer_relevancy(spark, d):
    e = read(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").groupBy("label").agg(F.round(F.avg(metrics.cosine(F.col("embedding"), F.col("other"))), 6).alias("answer_relevancy"))


@query("SELECT conv_id, count(*) AS n, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS messages_md5 FROM conversations GROUP BY conv_id")
def q_chat_prompt(spark, d):
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(m["role"], F.lit(": "), m["text"]))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.md5(F.array_join(said, "\n")).alias("messages_md5"))


@query("""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents),
h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM w),
c AS (SELECT doc_id, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM h GROUP BY ALL),
v AS (SELECT doc_id, sqrt(sum(v * v)) AS n, map_from_entries(list((i, v))) AS m FROM c GROUP BY doc_id)
SELECT doc_id, list_transform(range(64), lambda i: CASE WHEN n > 0 THEN round(coalesce(list_extract(map_extract(m, i), 1), 0) / n, 6) ELSE 0.0::DOUBLE END) AS embedding FROM documents LEFT JOIN v USING (doc_id)""")
def q_hash_embed(spark, d):
    found = embedding.hash_embedded(read(spark, d, "documents"), "doc_id")
    return found.select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("""
WITH x AS (SELECT doc_id AS id, text, FALSE AS asks FROM documents UNION ALL SELECT item_id, text, TRUE FROM benchmark),
w AS (SELECT id, asks, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM x),
c AS (SELECT id, asks, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM w),
v AS (SELECT id, asks, h % 64 AS i, sum(CASE WHEN (h // 64) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0 END) AS v FROM c GROUP BY ALL),
n AS (SELECT id, asks, sqrt(sum(v * v)) AS n FROM v GROUP BY ALL),
u AS (SELECT v.id, v.asks, i, CASE WHEN n > 0 THEN v / n ELSE 0 END AS v FROM v JOIN n ON v.id = n.id AND v.asks = n.asks),
l AS (SELECT x.id, x.asks, coalesce(sum(u.v * u.v), 0) AS l FROM x LEFT JOIN u ON u.id = x.id AND u.asks = x.asks GROUP BY ALL),
p AS (SELECT a.id AS item_id, b.id AS doc_id, sum(a.v * b.v) AS dot FROM u a JOIN u b ON a.i = b.i WHERE a.asks AND NOT b.asks GROUP BY ALL),
d AS (SELECT a.id AS item_id, b.id AS doc_id, round(a.l + b.l - 2 * coalesce(dot, 0), 6) AS distance FROM l a JOIN l b ON a.asks AND NOT b.asks LEFT JOIN p ON p.item_id = a.id AND p.doc_id = b.id)
SELECT item_id, rank, doc_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id)::INT AS rank FROM d) WHERE rank <= 4""")
def q_retrieve_text(spark, d):
    store = embedding.hash_embedded(read(spark, d, "documents"), "doc_id")
    asked = embedding.hash_embedded(read(spark, d, "benchmark"), "item_id")
    return vectors.nearest(store, asked, 4, key="doc_id", query_key="item_id", places=6)
