"""From questions to answers, for a whole table of questions at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import load_config, resolved, setting
from ..functions import text as T
from ..operators.context import contexts
from ..operators.token_counts import Vocabulary, vocabulary_for, with_token_counts
from ..sources import providers
from ..sources.vector_table import VectorTable
from .ingest import store_of, token_overhead


def retrieved(questions: DataFrame, store: VectorTable, embedder, k: int | None = None) -> DataFrame:
    """The ``k`` nearest chunks of each (``query_id``, ``question``)."""
    asked = providers.embedded(questions.select("query_id", "question"), embedder, "question")
    return store.search(asked.select("query_id", "embedding"), k)


def prompts(questions: DataFrame, hits: DataFrame, max_tokens: int = 4096, template: str = T.PROMPT, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``query_id``, ``question``, ``context``, ``context_tokens``, ``truncated``, ``prompt``.

    What the template and the question take is off the budget; a question without hits, or without room,
    has an empty context. Tokens are words, or byte pairs of a ``vocabulary``.
    """
    if vocabulary is None:
        asked = questions.withColumn("available", max_tokens - token_overhead(F.col("question"), template))
    else:
        shell = questions.withColumn("__shell", T.prompt(F.lit(""), F.col("question"), template))
        asked = with_token_counts(shell, vocabulary, "__shell", "__taken").withColumn("available", max_tokens - F.col("__taken")).drop("__shell", "__taken")
        hits = with_token_counts(hits, vocabulary)
    joined = hits.join(asked.select("query_id", "available"), "query_id")
    found = contexts(joined, "query_id", "rank", "text", "n_tokens", F.col("available"))
    full = asked.join(found, "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return full.select("query_id", "question", "context", F.coalesce("context_tokens", F.lit(0)).alias("context_tokens"), F.coalesce("truncated", F.lit(False)).alias("truncated"), T.prompt(F.col("context"), F.col("question"), template).alias("prompt"))


def answers(questions: DataFrame, store: VectorTable, embedder, llm, k: int | None = None, max_tokens: int = 4096, template: str = T.PROMPT, vocabulary: Vocabulary | None = None, **settings) -> DataFrame:
    """``query_id``, ``question``, ``response``, ``contexts`` (texts by rank), ``truncated``."""
    hits = retrieved(questions, store, embedder, k)
    said = providers.answered(prompts(questions, hits, max_tokens, template, vocabulary), llm, **settings)
    listed = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda h: h["text"]).alias("contexts"))
    return said.join(listed, "query_id", "left").select("query_id", "question", "response", F.coalesce("contexts", F.expr("cast(array() as array<string>)")).alias("contexts"), "truncated")


class Retrieval:
    """Questions to answers over one vector table."""

    def __init__(self, store: VectorTable, embedder, llm, k: int = 4, max_tokens: int = 4096, template: str = T.PROMPT, vocabulary: Vocabulary | None = None):
        self.vocabulary = vocabulary
        self.store, self.embedder, self.llm, self.k, self.max_tokens, self.template = store, embedder, llm, k, max_tokens, template

    def retrieve(self, questions: DataFrame) -> DataFrame:
        return retrieved(questions, self.store, self.embedder, self.k)

    def query(self, questions: DataFrame, **settings) -> DataFrame:
        return answers(questions, self.store, self.embedder, self.llm, self.k, self.max_tokens, self.template, self.vocabulary, **settings)


def get_retrieval_pipeline(spark: SparkSession, config_path: str | None = None) -> Retrieval:
    """As the settings file describes it."""
    config = load_config(config_path)
    embedder = providers.embedder_from(config)
    store = store_of(spark, resolved(config, setting(config, "storage.directory", "storage")), embedder, setting(config, "embedding.model", "default"))
    return Retrieval(store, embedder, providers.llm_from(config), setting(config, "retrieval.top_k", 4), setting(config, "retrieval.max_context_tokens", 4096), setting(config, "retrieval.context_template", T.PROMPT), vocabulary_for(setting(config, "llm.model", "")))
