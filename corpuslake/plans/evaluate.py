"""Scores of answers from a judge's verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes, metrics
from ..session import checkpointed
from ..sources.log_table import LogTable


def scored(rows: DataFrame, judge: Callable[[str, list[str], str, str | None], dict[str, list[float]]]) -> DataFrame:
    """``rows`` (question, contexts, answer, ground_truth) with a column per metric and ``error``.

    ``judge`` returns verdicts by metric name: 0 or 1 by statement or by context in order of rank, cosines
    for relevancy. Metrics that need a ground truth are null without one. A row on which the judge fails
    has null metrics and its ``error``.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            verdicts, errors = [], []
            for q, c, a, g in zip(batch["question"], batch["contexts"], batch["answer"], batch["ground_truth"]):
                try:
                    verdicts.append({k: [float(v) for v in vs] for k, vs in judge(q, list(c), a, g).items()})
                    errors.append(None)
                except Exception as error:  # the row reports it
                    verdicts.append({})
                    errors.append(str(error))
            yield batch.assign(verdicts=verdicts, error=errors)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    judged = rows.mapInPandas(each, f"{kinds}, verdicts map<string, array<double>>, error string")
    out = []
    for name in metrics.METRICS:
        own = F.try_element_at("verdicts", F.lit(name))
        total = F.aggregate(own, F.lit(0.0), lambda s, v: s + v)
        value = total / F.nullif(F.size(own), F.lit(0))
        if name == "context_precision":
            upto = F.transform(own, lambda v, i: v * F.aggregate(F.slice(own, F.lit(1), i + 1), F.lit(0.0), lambda s, x: s + x) / (i + 1))
            value = F.when(total > 0, F.aggregate(upto, F.lit(0.0), lambda s, v: s + v) / total).otherwise(F.when(F.size(own) > 0, 0.0))
        out.append((F.when(F.col("ground_truth").isNotNull(), value) if name in metrics.GROUNDED else value).alias(name))
    return judged.select(*rows.columns, *out, "error")


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSON array of ``question`` and ``ground_truth``: those, and a number ``query_id``."""
    items = spark.read.schema("question string, ground_truth string").option("multiLine", True).json(path)
    return items.select(F.monotonically_increasing_id().alias("query_id"), "question", "ground_truth")


def run_batch_evaluation(items: DataFrame, answers: DataFrame, judge: Callable, folder: str) -> dict:
    """Scores answered ``items`` (query_id, question, ground_truth), writes rows and means as JSON under ``folder``; the means."""
    rows = metrics.evaluable(items).select("query_id", "ground_truth").join(answers.withColumnRenamed("response", "answer"), "query_id")
    result = scored(rows.select("query_id", "question", "contexts", "answer", "ground_truth"), judge)
    result.write.mode("overwrite").json(f"{folder}/evaluation_results")
    kept = result.sparkSession.read.schema(result.schema).json(f"{folder}/evaluation_results")
    means = metrics.summary(kept, list(metrics.METRICS))
    means.write.mode("overwrite").json(f"{folder}/evaluation_summary")
    return means.first().asDict()


RESULTS = "question string, ground_truth string, answer string, contexts array<string>, faithfulness double, answer_relevancy double, context_precision double, context_recall double, error string"


class Evaluation:
    """Items to scores, taken up again where a run ended.

    Results are a log table keyed by question, written ``batch`` items at a time. A question that has been answered is not answered again, one that has
    been judged is not judged again, and one whose judgement failed is judged in the next run. An item whose ground truth changed is judged anew.

    ``answer`` makes answers (``query_id``, ``question``, ``response``, ``contexts``) from a table of ``query_id`` and ``question``, as ``Retrieval.query`` does.
    """

    def __init__(self, spark: SparkSession, folder: str, answer: Callable[[DataFrame], DataFrame], judge: Callable, batch: int = 100):
        self.spark, self.folder, self.answer, self.judge, self.batch = spark, folder.rstrip("/"), answer, judge, batch
        self.results = LogTable(spark, f"{self.folder}/results", RESULTS, "question")

    def open_items(self, items: DataFrame) -> DataFrame:
        """``question``, ``ground_truth`` and, where there are any, ``answer`` and ``contexts`` of the items that have no scores yet; of a question that
        stands more than once the largest ground truth counts."""
        asked = metrics.evaluable(items).groupBy("question").agg(F.max("ground_truth").alias("ground_truth"))
        known = self.results.read().select("question", F.col("ground_truth").alias("__truth"), "answer", "contexts", "error")
        met = asked.join(known, "question", "left")
        scored_before = F.col("answer").isNotNull() & F.col("error").isNull() & F.col("__truth").eqNullSafe(F.col("ground_truth"))
        return met.where(~F.coalesce(scored_before, F.lit(False))).select("question", "ground_truth", "answer", "contexts")

    def step(self, items: DataFrame) -> int:
        """Answers and judges what is open among ``items``, a batch at a time; how many failed."""
        dealt = checkpointed(changes.batched(self.open_items(items), ["question"], self.batch))
        failed = 0
        for number in range(1, (dealt.agg(F.max("batch")).first()[0] or 0) + 1):
            part = dealt.where(F.col("batch") == number)
            new = part.where("answer is null").select("question").withColumn("query_id", F.monotonically_increasing_id())
            if not new.isEmpty():
                new = checkpointed(new)
                said = checkpointed(self.answer(new.select("query_id", "question")).select("question", F.col("response").alias("said"), F.col("contexts").alias("found")))
                part = part.join(F.broadcast(said), "question", "left").withColumns({"answer": F.coalesce("answer", "said"), "contexts": F.coalesce("contexts", "found")})
            rows = checkpointed(scored(part.select("question", "contexts", F.coalesce("answer", F.lit("")).alias("answer"), "ground_truth"), self.judge))
            self.results.upsert(rows.select(self.results.columns))
            failed += rows.where("error is not null").count()
        return failed

    def run(self, items: DataFrame) -> dict:
        """From items to means in one call: the mean of each metric, ``evaluated`` and ``failed``; rows and means go to ``folder`` as JSON too."""
        failed = self.step(items)
        asked = metrics.evaluable(items).select("question").distinct()
        rows = self.results.read().join(asked, "question", "left_semi")
        rows.write.mode("overwrite").json(f"{self.folder}/evaluation_results")
        means = metrics.summary(rows, list(metrics.METRICS))
        means.write.mode("overwrite").json(f"{self.folder}/evaluation_summary")
        return means.first().asDict() | {"evaluated": rows.where("error is null").count(), "failed": failed}

    def stream(self, path: str, checkpoint: str, files: int = 10):
        """Starts a stream that takes up the JSON files of items (a line an item) that come to ``path``, and ends when all are done."""
        items = self.spark.readStream.schema("question string, ground_truth string").option("maxFilesPerTrigger", files).json(path)
        return items.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: self.step(batch)).trigger(availableNow=True).start()
