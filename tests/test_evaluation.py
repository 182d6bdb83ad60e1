"""An evaluation that is taken up again."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from corpuslake.functions import text as T
from corpuslake.plans import Evaluation


def test_a_second_run_completes_the_first(spark, tmp_path):
    """The judge fails once for some questions; nothing is answered twice, nothing scored is judged twice."""
    notes = tmp_path / "notes"
    notes.mkdir()

    def answer(asked):
        for r in asked.collect():
            with open(notes / "answered", "a") as file:
                file.write(r["question"] + "\n")
        return asked.select("query_id", "question", F.concat(F.lit("to "), "question").alias("response"), F.array("question").alias("contexts"))

    def judge(question, contexts, said, truth):
        with open(notes / f"judged {question}", "a") as file:
            file.write("x")
        if question in ("q2", "q5") and (notes / f"judged {question}").read_text() == "x":
            raise RuntimeError("not now")
        return {"faithfulness": [1, 0], "answer_relevancy": [1.0], "context_precision": [1], "context_recall": [0]}

    items = spark.createDataFrame([(f"q{i}", "t" if i % 2 else None) for i in range(7)] + [("q1", "t"), ("", "t"), (None, "t")], "question string, ground_truth string")
    job = Evaluation(spark, str(tmp_path / "out"), answer, judge, batch=3)
    first = job.run(items)
    assert (first["evaluated"], first["failed"], first["faithfulness"], first["context_recall"]) == (5, 2, 0.5, 0.0)
    again = Evaluation(spark, str(tmp_path / "out"), answer, judge, batch=3).run(items)
    assert (again["evaluated"], again["failed"], again["context_precision"]) == (7, 0, 1.0)
    assert sorted((notes / "answered").read_text().split()) == [f"q{i}" for i in range(7)]
    assert {f"q{i}": len((notes / f"judged q{i}").read_text()) for i in range(7)} == {f"q{i}": 2 if i in (2, 5) else 1 for i in range(7)}
    assert {r["question"] for r in job.results.read().where("context_recall is null").collect()} == {"q0", "q2", "q4", "q6"}  # without a ground truth
    # A ground truth that comes later: judged anew, not answered.
    job.run(spark.createDataFrame([("q0", "now")], items.schema))
    assert len((notes / "judged q0").read_text()) == 2 and len((notes / "answered").read_text().split()) == 7
    assert job.results.count() == 7 and job.step(items.limit(0)) == 0


def test_items_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    answer = lambda asked: asked.select("query_id", "question", F.lit("a").alias("response"), F.array(F.lit("c")).alias("contexts"))
    job = Evaluation(spark, str(tmp_path / "out"), answer, lambda q, c, a, g: {"faithfulness": [1]})
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text("".join(json.dumps({"question": q, "ground_truth": None}) + "\n" for q in ("both", f"own{i}")))
        job.stream(str(tmp_path / "in"), str(tmp_path / "check")).awaitTermination()
    assert {r["question"]: r["faithfulness"] for r in job.results.read().collect()} == {"both": 1.0, "own0": 1.0, "own1": 1.0}


def test_scores_as_text(spark):
    rows = spark.createDataFrame([(0.12345,), (1.0,), (None,), (float("nan"),)], "v double")
    assert [r["t"] for r in rows.select(T.score_text(F.col("v")).alias("t")).collect()] == ["0.1235", "1.0000", "N/A", "N/A"]
