"""Byte-pair token counts against a tokenizer."""

from __future__ import annotations

import base64
import random

import pytest
import tiktoken
from conftest import DATA

from corpuslake.functions import text as T
from corpuslake.operators import token_counts as C
from corpuslake.plans import retrieve
from corpuslake.plans.queries import FOUND, vocabulary

WIDE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoding(path):
    return tiktoken.Encoding("own", pat_str=WIDE, mergeable_ranks=C.Vocabulary(path).ranks, special_tokens={})


def test_all_documents(spark):
    own = encoding(vocabulary("byte_bpe_50k.tiktoken"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = FOUND["q_byte_pair_tokens"](spark, DATA).collect()
    assert len(found) == len(texts) and {r["doc_id"]: r["n_tokens"] for r in found} == {i: len(own.encode_ordinary(t)) for i, t in texts.items()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_odd_texts(spark, name, monkeypatch):
    own, known = encoding(vocabulary(name)), C.Vocabulary(vocabulary(name))
    rng = random.Random(1)
    alphabet = ["the", " ", "  ", "\n", "\t", "'s", "'LL", "é", "ß", "中文", "\U0001f600", "á", " ", " ", "1", "23", "½", "!!", "====", "aaaa", "abab", "\x00", "<x>", "_"]
    texts = ["", None, " ", "x" * 3000, "=" * 500, "aaaaaaa", "ab" * 40] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    texts += texts[3:20]
    docs = spark.createDataFrame([(i % 200, t, "mine", 5) for i, t in enumerate(texts)], "doc_id int, text string, piece string, n_tokens int").repartition(3)
    wanted = sorted((i % 200, t or "", len(own.encode_ordinary(t or ""))) for i, t in enumerate(texts))
    for small in (C.SMALL, 60, 0):
        monkeypatch.setattr(C, "SMALL", small)
        found = C.with_token_counts(docs, known).collect()
        assert sorted((r["doc_id"], r["text"] or "", r["n_tokens"]) for r in found) == wanted
    assert C.with_token_counts(docs.limit(0), known).count() == 0


def test_merging_in_order_of_rank():
    """Also where a token is part of one of a smaller rank."""
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"cab": 3, b"ca": 9, b"ab": 5, b"abab": 4, b"ba": 6}
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(300)}

    def plain(word):
        parts = [c.encode() for c in word]
        while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return len(parts)

    assert {w: plain(w) for w in words} == {w: C.merged_length(w.encode(), ranks) for w in words}


def test_vocabulary_by_model(spark, monkeypatch):
    monkeypatch.setattr(C, "KNOWN", {})
    assert C.vocabulary_for("any") is None
    docs = spark.createDataFrame([("two words",), (None,)], "text string")
    assert {r["n_tokens"] for r in C.with_token_counts(docs, None).collect()} == {2, 0}
    one, other = C.Vocabulary("one"), C.Vocabulary("other")
    C.register_vocabulary("", one)
    C.register_vocabulary("gpt-4", other)
    assert C.vocabulary_for("gpt-4-small") is other and C.vocabulary_for("gpt-3") is one


def test_prompts_under_a_byte_pair_budget(spark):
    known = C.Vocabulary(vocabulary("byte_bpe_50k.tiktoken"))
    own = encoding(known.path)
    asked = spark.createDataFrame([(1, "Who?"), (2, "Unrelatedness?")], "query_id long, question string")
    hits = spark.createDataFrame([(1, 1, "antidisestablishmentarianism", 1), (1, 2, "zyx " * 40, 1)], "query_id long, rank int, text string, n_tokens long")
    shell = len(own.encode_ordinary(T.PROMPT.format(context="", question="Who?")))
    room = shell + len(own.encode_ordinary("antidisestablishmentarianism"))
    found = {r["query_id"]: r for r in retrieve.prompts(asked, hits, room, vocabulary=known).collect()}
    assert (found[1]["context"], found[1]["truncated"], found[1]["context_tokens"]) == ("antidisestablishmentarianism", True, room - shell)
    assert found[2]["context"] == "" and retrieve.prompts(asked, hits, room - 1, vocabulary=known).where("context <> ''").count() == 0
