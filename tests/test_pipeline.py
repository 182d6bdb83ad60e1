"""Files to answers: sources, providers, the vector table, ingestion, streams, evaluation, settings."""

from __future__ import annotations

import os
import time
from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslake import config
from corpuslake.functions import text as T
from corpuslake.operators import changes, chunking, context, embedding, metrics, running, vectors
from corpuslake.plans import evaluate, get_retrieval_pipeline, load_dataset, retrieve, run_ingestion
from corpuslake.plans.ingest import Ingestion
from corpuslake.plans.judge import create_judge
from corpuslake.sources import files as S
from corpuslake.sources import providers as P
from corpuslake.sources.log_table import LogTable
from corpuslake.sources.vector_table import VectorTable
from corpuslake.streaming.watch import watched


class Counting:
    """Vectors of three counts; needs no network."""

    dimension, batch = 3, 2

    def embed_batch(self, texts):
        assert len(texts) <= self.batch
        return [[float(len(t)), float(t.count("a")), float(t.count("b"))] for t in texts]


def pdf(text: str) -> bytes:
    return b"%PDF-1.4\n1 0 obj\nstream\nBT (" + text.encode() + b") Tj ET\nendstream\nendobj\n%%EOF"


def test_loader_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        S.load_folder(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="No files found"):
        S.load_folder(spark, str(tmp_path))


def test_ingestion_modes(spark, tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    (docs / "a.pdf").write_bytes(pdf("Alpha one. Alpha two."))
    (docs / "b.PDF").write_bytes(pdf("Beta."))
    (docs / "bad.pdf").write_bytes(b"no pdf")
    (docs / "c.txt").write_text("not a document")
    job = Ingestion(spark, str(docs), str(tmp_path / "out"), Counting(), "org/some-model")
    first = job.run_incremental()
    assert (first["new_files"], first["failed"], first["total_vectors"]) == (2, 1, 2)
    again = job.run_incremental()
    assert (again["files"], again["failed"], again["total_vectors"]) == (0, 1, 2)  # the broken one is tried again
    (docs / "a.pdf").write_bytes(pdf("Alpha changed."))
    (docs / "bad.pdf").write_bytes(pdf("Mended."))
    third = job.run_streaming()
    assert (third["new_files"], third["updated_files"], third["total_vectors"]) == (1, 1, 3)
    assert {r["text"] for r in job.store.read().collect()} == {"Alpha changed.", "Beta.", "Mended."}
    (docs / "bad.pdf").unlink()
    job.prune()
    assert job.store.count() == 2
    assert job.run(force=True)["total_vectors"] == 2
    assert job.run_files(["a.pdf"])["updated_files"] == 1


def test_a_tick_over_unchanged_files_reads_no_content(spark, tmp_path):
    """By a listing of 10,000 files: their contents could be anything, and are, behind the same length and time."""
    docs = tmp_path / "in"
    docs.mkdir()
    for i in range(10_000):
        (docs / f"f{i}.pdf").write_bytes(b"x")
    spark.conf.set("spark.sql.files.openCostInBytes", "64k")
    try:
        job = Ingestion(spark, str(docs), str(tmp_path / "out"), Counting())
        job.ledger.upsert(S.listed(spark, str(docs)).withColumn("md5", F.lit("never looked at")))
        assert job.touched().count() == 0
        plan = job.touched()._jdf.queryExecution().executedPlan().toString()
        assert "content" not in plan
        assert job.run_incremental() == {"files": 0, "failed": 0, "new_files": 0, "updated_files": 0, "chunks": 0, "total_vectors": 0}
        (docs / "f7.pdf").write_bytes(pdf("Seven."))
        assert [(r["path"].rsplit("/", 1)[1], r["is_new"]) for r in job.touched().collect()] == [("f7.pdf", False)]
        found = job.run_incremental()
        assert (found["files"], found["updated_files"], found["chunks"]) == (1, 1, 1)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_files_touched_but_not_changed(spark, tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    for name in ("a [1]{x}*.pdf", "b?.pdf"):  # what looks like a pattern is a name
        (docs / name).write_bytes(pdf(f"Text of {name[0]}."))
    (docs / "empty.pdf").write_bytes(b"%PDF-1.4 nothing")
    job = Ingestion(spark, str(docs), str(tmp_path / "out"), Counting())
    first = job.run_incremental()
    assert (first["new_files"], first["failed"], first["chunks"]) == (2, 1, 2)
    version = max(job.store.versions())
    os.utime(docs / "b?.pdf", (1, 1))
    assert job.touched().count() == 2  # and the one without text, which is tried again
    again = job.run_incremental()
    assert (again["files"], again["failed"], again["total_vectors"]) == (0, 1, 2) and max(job.store.versions()) == version
    assert {r["path"].rsplit("/", 1)[1] for r in job.touched().collect()} == {"empty.pdf"}
    assert {r["error"] for r in S.load_folder(spark, str(docs)).where("error is not null").collect()} == {"no text found"}


def test_loaders_and_splitters_of_ones_own(spark, tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    (docs / "a.pdf").write_bytes(b"one|two three")

    def split(texts, key, size, overlap, source):
        return texts.select(key, F.col(source).alias("source"), F.lit(0).alias("chunk_index"), F.upper("text").alias("text"), F.lit(1).cast("long").alias("n_tokens"))

    job = Ingestion(spark, str(docs), str(tmp_path / "out"), Counting(), parse=lambda data: data.decode().split("|"), split=split)
    assert job.run()["chunks"] == 2 and {r["text"] for r in job.store.read().collect()} == {"ONE", "TWO THREE"}


def test_touched_files_with_nulls_and_repeats(spark):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    files = spark.createDataFrame([("a", 1, t[0]), ("b", 1, t[0]), ("c", 2, t[1]), ("d", 1, t[0]), ("e", None, None)], "path string, length long, modified timestamp")
    ledger = spark.createDataFrame([("a", "1", 1, t[0]), ("b", "x", 1, t[2]), ("b", "y", 1, t[0]), ("c", "2", 2, None), ("e", None, None, None)], "path string, md5 string, length long, modified timestamp")
    found = {r["path"]: (r["is_new"], r["known"]) for r in changes.touched_files(files, ledger).collect()}
    assert found.pop("b") == (False, "x") and found.pop("d") == (True, None) and set(found) == {"c"}
    kinds = changes.event_kinds(spark.createDataFrame([("a",), ("z",), ("b",)], "path string"), ledger).collect()
    assert {r["path"]: r["kind"] for r in kinds} == {"a": "modified", "b": "modified", "z": "created"}


def test_stream_ingests(spark, tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    (docs / "a.pdf").write_bytes(pdf("One."))
    job = Ingestion(spark, str(docs), str(tmp_path / "out"), Counting())
    watched(job, str(tmp_path / "check")).awaitTermination()
    (docs / "b.pdf").write_bytes(pdf("Two."))
    watched(job, str(tmp_path / "check")).awaitTermination()
    assert job.store.count() == 2
    assert job.last_status()["status"] == "complete" and job.wait(1)["chunks"] == "1"
    # A file rewritten in place, with no new one beside it.
    (docs / "a.pdf").write_bytes(pdf("Another one."))
    query = watched(job, str(tmp_path / "check2"), forever=True, every=0.5)
    for _ in range(60):
        if "Another one." in {r["text"] for r in job.store.read().collect()}:
            break
        time.sleep(0.5)
    query.stop()
    assert {r["text"] for r in job.store.read().collect()} == {"Another one.", "Two."}


def test_status_without_a_job(spark, tmp_path):
    assert Ingestion(spark, str(tmp_path), str(tmp_path / "out"), Counting()).last_status() == {"status": "idle"}


def test_explicit_files_elsewhere(spark, tmp_path):
    for name, text in (("in", "Inside."), ("other", "Outside.")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.pdf").write_bytes(pdf(text))
    job = Ingestion(spark, str(tmp_path / "in"), str(tmp_path / "out"), Counting())
    job.run_files([str(tmp_path / "other" / "a.pdf")])
    assert [r["text"] for r in job.store.read().collect()] == ["Outside."]
    assert [r["text"] for r in S.load_file(spark, str(tmp_path / "in" / "a.pdf")).collect()] == ["Inside."]
    with pytest.raises(FileNotFoundError):
        job.run_files([str(tmp_path / "none.pdf")])


def test_log_table_survives_a_writer_that_dies(spark, tmp_path):
    table = LogTable(spark, str(tmp_path), "k string, a int", "k", keep=2)
    one = lambda k, a: spark.createDataFrame([(k, a)], "k string, a int")
    assert table.upsert(one("x", 1)) == 1
    broken = one("x", 1).select("k", F.raise_error(F.lit("lost")).cast("int").alias("a"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken)
    (tmp_path / ".writing-0").write_text("half a mani")  # died while it wrote a manifest
    assert [r["a"] for r in table.read().collect()] == [1]
    assert table.upsert(one("x", 3)) == 2 and [r["a"] for r in table.read().collect()] == [3]
    table.upsert(one("x", 4))
    assert table.versions() == [2, 3] and [r["a"] for r in table.read().collect()] == [4] and [r["a"] for r in table.read(2).collect()] == [3]
    with pytest.raises(ValueError):
        table.read(1)


def test_changed_files_with_nulls_and_repeats(spark):
    files = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3"), ("d", "4")], "path string, md5 string")
    ledger = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "2"), ("c", None)], "path string, md5 string")
    found = {r["path"]: r["is_new"] for r in changes.changed_files(files, ledger).collect()}
    assert found == {"b": False, "c": False, "d": True} and changes.explicit_files(files, ledger).count() == 4


def test_hash_embedding_by_row(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "three"), (None, "one two"), (2, None), (1, "three")], "k int, text string")
    found = [tuple(r["embedding"]) for r in embedding.hash_embedded(docs, "k").collect()]
    assert len(found) == 5 and len(set(found)) == 3 and sum(not any(v) for v in found) == 1


def test_closest_equals_all_distances():
    """Ties, far from the origin, where a matrix product alone rounds too coarsely; more wanted than there are."""
    rng = np.random.default_rng(7)
    for far, k, places in ((0.0, 5, None), (1e6, 3, None), (1e3, 4, 6), (0.0, 99, 6)):
        rows = far + rng.integers(0, 3, (60, 4)) * 0.5
        rows[:6], rows[6, 0] = rows[0], np.nan
        asked, keys = far + rng.integers(0, 3, (7, 4)) * 0.5, rng.permutation(60)
        found = vectors.closest(pa.array([f"q{i}" for i in range(7)]), asked, pa.array(keys), rows, k, places).to_pylist()
        for i in range(7):
            d = ((rows - asked[i]) ** 2).sum(axis=1)
            plain = sorted(zip(np.isnan(d), d if places is None else np.round(d, places), keys.tolist()))[:k]
            got = [(r["distance"], r["x"]) for r in found if r["q"] == f"q{i}"]
            assert [x for _, x in got] == [x for _, _, x in plain]
            assert all(a == b or nan for (a, _), (nan, b, _) in zip(got, plain))


def test_nearest_of_many_queries_is_one_plan(spark):
    store = spark.range(300).select(F.concat(F.lit("s"), "id").alias("name"), F.array(F.col("id").cast("double"), F.lit(0.0)).alias("v"))
    asked = spark.range(5000).select(F.concat(F.lit("q"), "id").alias("who"), F.array((F.col("id") % 300).cast("double"), F.lit(0.25)).alias("v"))
    found = vectors.nearest(store, asked, 2, "name", "who", "v")
    rows = found.where("rank = 1").collect()
    assert found.count() == 10_000 and all(r["name"] == f"s{int(r['who'][1:]) % 300}" and r["distance"] == 0.0625 for r in rows)


def rows(spark, *found):
    return spark.createDataFrame([(s, f"{s}-{i}", t, 1, v) for i, (s, t, v) in enumerate(found)], "source string, chunk_id string, text string, n_tokens long, embedding array<float>")


def test_vector_table(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path), 2)
    assert table.count() == 0
    table.add(rows(spark, ("a.pdf", "Doc 1", [0.1, 0.1]), ("b.pdf", "Doc 2", [0.5, 0.5]), (None, "Doc 0", [9.0, 9.0])))
    table.add(rows(spark, ("a.pdf", "Doc 3", [0.1, 0.2])))
    assert {r["text"] for r in table.read().collect()} == {"Doc 2", "Doc 3", "Doc 0"}
    found = table.search(spark.createDataFrame([(1, [0.1, 0.2])], "query_id long, embedding array<float>"), 9).orderBy("rank").collect()
    assert [r["text"] for r in found] == ["Doc 3", "Doc 2", "Doc 0"]
    assert "embedding" not in found[0] and found[2]["source"] == "unknown"
    with pytest.raises(ValueError):
        table.add(rows(spark, ("c.pdf", "Doc", [1.0])))
    table.delete_all()
    assert table.count() == 0


def test_nearest_ties_and_empty(spark):
    store = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)] + [(9, None)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r["vec_id"] for r in vectors.nearest(store, asked, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert vectors.nearest(store.limit(0), asked, 3).count() == 0
    assert vectors.nearest(store, asked.limit(0), 3).count() == 0


def test_chunks(spark):
    text = "This is a test sentence. " * 20
    docs = spark.createDataFrame([(1, text, None), (2, "", "s"), (3, None, "s")], "doc_id long, text string, source string")
    found = chunking.split_documents(docs, size=30, overlap=10).orderBy("chunk_index").collect()
    assert {r["doc_id"] for r in found} == {1} and all(r["n_tokens"] <= 30 and r["source"] == "unknown" for r in found)
    plain = chunking.split_documents(docs, size=30, overlap=0).orderBy("chunk_index").collect()
    assert "".join(r["text"] for r in plain) == text
    with pytest.raises(ValueError):
        chunking.split_documents(docs, size=10, overlap=10)


def test_chunks_keep_keys_of_any_name(spark):
    docs = spark.createDataFrame([(7, "One. Two.")], "n long, text string")
    assert [tuple(r) for r in chunking.split_documents(docs, "n", source=None).collect()] == [(7, 0, "unknown", "One. Two.", 2)]
    assert docs.select(chunking.split_text(F.col("text"), 2, 1).alias("t")).first()["t"] == ["One.", "One. Two."]


def test_chunks_of_many_sentences_take_linear_time(spark):
    docs = spark.createDataFrame([(1, "Some words stand here now. " * 20_000)], "doc_id long, text string")
    began = time.time()
    assert chunking.split_documents(docs, size=64, overlap=8, source=None).count() == 1819
    assert time.time() - began < 30


def test_long_sentence_is_cut(spark):
    text = "Short one. " + " word\t" * 95 + "end. Last one."
    docs = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    found = chunking.split_documents(docs, size=20, overlap=0).orderBy("chunk_index").collect()
    assert "".join(r["text"] for r in found) == text
    assert [r["n_tokens"] for r in found] == [2, 20, 20, 20, 20, 18]
    lapped = chunking.split_documents(docs, size=20, overlap=5).collect()
    assert max(r["n_tokens"] for r in lapped) <= 20


def test_budget_and_prompt(spark):
    hits = spark.createDataFrame([(1, 1, "", 0), (1, 2, "x", 5), (1, 3, "y", 9), (1, 4, "z", 1), (2, 1, "q", 99)], "query_id long, rank int, text string, n_tokens long")
    found = {r["query_id"]: r for r in context.contexts(hits, "query_id", "rank", "text", "n_tokens", 6).collect()}
    assert (found[1]["context"], found[1]["n_used"], found[1]["truncated"]) == ("x", 2, True)
    assert (found[2]["context"], found[2]["context_tokens"]) == ("", 0)
    said = spark.range(1).select(T.prompt(F.lit("has {question} in it"), F.lit("why"), "C {context} Q {question}").alias("p")).first()["p"]
    assert said == "C has {question} in it Q why"


def test_running_sums_of_a_hot_group(spark):
    given = [("hot" if i % 5 else None if i % 2 else f"k{i % 7}", i * 7919 % 1009, None if i % 11 == 0 else i % 4) for i in range(1000)]
    df = spark.createDataFrame(given, "q string, r int, n int").repartition(5)
    found = {(x["q"], x["r"]): x["upto_n"] for x in running.running_sums(df, "q", "r", ["n"]).collect()}
    sums: dict = {}
    for q, r, n in sorted(given, key=lambda x: x[1]):
        sums[q] = sums.get(q, 0) + (n or 0)
        assert found[q, r] == sums[q]
    assert running.running_sums(df.limit(0), "q", "r", ["n"]).count() == 0


def test_reachable_rows_give_the_same_contexts(spark):
    given = [("hot" if i % 3 else None if i % 2 else f"k{i % 5}", i * 7919 % 1009, f"t{i}", i % 4 if i % 100 else 500) for i in range(600)]
    df = spark.createDataFrame(given + [("huge", 1, "x", 9999), ("huge", 2, "y", 1)], "q string, r int, t string, n int")
    some = context.reachable(df, "q", "r", F.col("n"), 150)
    plain, own = (sorted(map(tuple, context.contexts(x, "q", "r", "t", "n", 150).collect()), key=repr) for x in (df, some))
    assert own == plain and some.count() < df.count() and some.columns == df.columns


def test_context_precision_with_nulls(spark):
    given = [("a", 1, 1), ("a", 2, 0), ("a", 3, 1), ("b", 1, 0), ("c", 1, None), ("c", 2, 1), (None, 1, 1)]
    found = dict(map(tuple, metrics.context_precision(spark.createDataFrame(given, "k string, r int, v int"), "k", "r", "v").collect()))
    assert found == {"a": pytest.approx((1 + 2 / 3) / 2), "b": 0.0, "c": 0.5, None: 1.0}


def test_answers_and_scores(spark, tmp_path):
    table = VectorTable(spark, str(tmp_path / "v"), 3)
    table.add(rows(spark, ("a", "aaa", [3.0, 3.0, 0.0]), ("b", "bbb", [3.0, 0.0, 3.0])))
    asked = spark.createDataFrame([(1, "aaa"), (2, "bbb")], "query_id long, question string")
    said = retrieve.answers(asked, table, Counting(), P.Echo(), k=1)
    assert {r["query_id"]: r["contexts"] for r in said.collect()} == {1: ["aaa"], 2: ["bbb"]}
    items = asked.withColumn("ground_truth", F.when(F.col("query_id") == 1, "t"))
    judge = lambda q, c, a, g: {"faithfulness": [1, 0], "context_precision": [0, 1], "context_recall": [1]}
    means = evaluate.run_batch_evaluation(items, said, judge, str(tmp_path / "e"))
    assert means == {"faithfulness": 0.5, "answer_relevancy": None, "context_precision": 0.5, "context_recall": 1.0}


def test_judge_and_dataset(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(ValueError):
        create_judge()

    def post(url, body, headers, timeout):
        if url.endswith("/embeddings"):
            return {"data": [{"embedding": [1.0, float(len(t) > 5)]} for t in body["input"]]}
        said = body["messages"][0]["content"]
        return {"choices": [{"message": {"content": 'Here: ["aaaaaaaa", "b"]' if "questions" in said else "[1, 0]"}}]}

    verdicts = create_judge(api_key="k", post=post)("long question", ["c {answer}", "d"], "a", "t")
    assert verdicts["faithfulness"] == verdicts["context_precision"] == verdicts["context_recall"] == [1.0, 0.0]
    assert [round(v, 3) for v in verdicts["answer_relevancy"]] == [1.0, 0.707]
    (tmp_path / "items.json").write_text('[{"question": "q", "ground_truth": "t"}, {"question": "r"}]')
    assert [(r["question"], r["ground_truth"]) for r in load_dataset(spark, str(tmp_path / "items.json")).collect()] == [("q", "t"), ("r", None)]


def test_retrieval_from_settings(spark, tmp_path):
    P.register_embedder("counting", lambda model: Counting())
    (tmp_path / "config.toml").write_text('[embedding]\nprovider = "counting"\nmodel = "a/b"\n[llm]\nprovider = "echo"\n[ingestion]\ndirectory = "in"\n[retrieval]\ntop_k = 1\n[storage]\ndirectory = "out"\n')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(pdf("Alpha."))
    assert run_ingestion(spark, str(tmp_path / "config.toml"))["chunks"] == 1
    job = get_retrieval_pipeline(spark, str(tmp_path / "config.toml"))
    said = job.query(spark.createDataFrame([(1, "What?")], "query_id long, question string")).first()
    assert said["contexts"] == ["Alpha."] and said["response"].endswith("Answer:")


def test_providers():
    sent = []

    def post(url, body, headers, timeout):
        sent.append((url, body, timeout))
        texts = body.get("input")
        if url.endswith("/embed") and "bad" in str(texts):
            raise P.RequestError("down")
        if url.endswith("/api/embeddings"):
            if body["prompt"] == "bad":
                raise P.RequestError("down")
            return {"embedding": [1.0]}
        if url.endswith("/api/embed"):
            return {"embeddings": [[0.5]] * len(texts)}
        if url.endswith("/embeddings"):
            return {"data": [{"embedding": [0.5]} for _ in texts]}
        if url.endswith("/completions"):
            return {"choices": [{"message": {"content": None}}]}
        return {"response": "r", "message": {"content": "m"}}

    local = P.create_embedder("ollama", "m", base_url="http://h/", post=post)
    assert local.embed_batch([]) == [] and len(local.embed_batch(["x"] * 501)) == 501 and local.dimension == 768
    assert [len(b["input"]) for u, b, _ in sent] == [500, 1] and sent[0][0] == "http://h/api/embed"
    with pytest.raises(RuntimeError, match=r"1/3 texts at indices \[1\]"):
        local.embed_batch(["x", "bad", "y"])
    assert P.create_embedder("openai", "text-embedding-3-large").dimension == 3072
    assert P.create_embedder("openai", post=post).embed("x") == [0.5]
    assert P.create_llm("openai", post=post).generate("p") == "" and sent[-1][1]["max_tokens"] is None and sent[-1][1]["temperature"] == 0.7
    chat = P.create_llm("ollama", "m", post=post)
    assert chat.generate("p", max_tokens=5) == "r" and sent[-1][1]["options"]["num_predict"] == 5 and sent[-1][1]["stream"] is False
    assert chat.chat([{"role": "user", "content": "p"}]) == "m" and "num_predict" not in sent[-1][1]["options"]
    assert P.create_embedder("nim", "m", api_key="k", post=post).dimension == 1
    with pytest.raises(ValueError, match="available"):
        P.create_llm("none")
    with pytest.raises(ValueError):
        P.create_embedder("nim", "m")
    P.register_llm("other", P.Echo)
    assert "other" in P.list_llm_providers() and "nim" in P.list_embedder_providers()


def test_config(tmp_path, monkeypatch):
    (tmp_path / "config.toml").write_text('[llm]\nmodel = "${MODEL:-small}"\nkeys = ["${KEY}", "${EMPTY:-x}"]\n[storage]\npath = "out"\n')
    monkeypatch.setenv("KEY", "k")
    monkeypatch.setenv("EMPTY", "")
    monkeypatch.chdir(tmp_path)
    found = config.load_config()
    assert config.setting(found, "llm.model") == "small" and config.setting(found, "llm.keys") == ["k", ""]
    assert config.setting(found, "llm.none.x", 3) == 3 and config.resolved(found, "out") == str(tmp_path / "out")
