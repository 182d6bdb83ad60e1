"""From a folder of files to the vector table: full, incremental, by list, in batches, or as a stream."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import load_config, resolved, setting
from ..functions import text as T
from ..operators import changes, chunking
from ..session import checkpointed
from ..sources import files as S
from ..sources import providers
from ..sources.log_table import LogTable
from ..sources.shared_files import SharedFiles
from ..sources.vector_table import VectorTable

LEDGER = "path string, md5 string, length long, modified timestamp"
STATUS = "ingestion_status.json"
#: Files that are taken up together at most; so many paths are on the driver at a time.
PATHS = 10_000


def store_of(spark: SparkSession, storage: str, embedder, model: str) -> VectorTable:
    """The vector table of a model under ``storage``."""
    return VectorTable(spark, f"{storage.rstrip('/')}/vectors-{model.replace('/', '_').replace('-', '_')}", embedder.dimension)


class Ingestion:
    """A file's path is its key: files of one name in other folders stay apart.

    A folder is listed first, without contents. Files whose length or time differ from the ledger's are read, by the tasks that parse
    them, and those whose hash differs as well are taken up. Only files that could be read enter the ledger, in every mode, so a broken file is
    tried again. A changed file's old rows go even if it has no chunks any more. ``parse`` makes pages from contents, ``split`` chunks from pages, with
    the signatures of ``pdf_text`` and ``split_documents``.
    """

    def __init__(self, spark: SparkSession, folder: str, storage: str, embedder, model: str = "default", size: int = 1024, overlap: int = 50, batch: int = 100, parse: Callable = S.pdf_text, split: Callable = chunking.split_documents):
        self.parse, self.split = parse, split
        self.spark, self.folder, self.storage, self.embedder = spark, folder, storage.rstrip("/"), embedder
        self.size, self.overlap, self.batch = size, overlap, batch
        self.store = store_of(spark, self.storage, embedder, model)
        self.ledger = LogTable(spark, f"{self.storage}/ledger", LEDGER, "path", buckets=1)
        self.files = SharedFiles(spark, self.storage)

    def run(self, force: bool = False) -> dict:
        """All files; ``force`` clears table and ledger first."""
        if force:
            self.store.delete_all()
            self.ledger.clear()
        return self._step(S.discovered(self.spark, self.folder), self._known()) | {"total_vectors": self.store.count()}

    def run_incremental(self) -> dict:
        """Files that are new or changed, ``PATHS`` at a time."""
        return self._in_parts(PATHS)

    def run_files(self, paths: list[str]) -> dict:
        """The files at ``paths``, wherever they lie, changed or not; a bare name is one of the folder."""
        return self._step(S.discovered(self.spark, [p if "/" in p else f"{self.folder}/{p}" for p in paths]), self._known()) | {"total_vectors": self.store.count()}

    def run_streaming(self) -> dict:
        """New and changed files, ``batch`` at a time, each batch a version of its own."""
        return self._in_parts(self.batch)

    def touched(self) -> DataFrame:
        """Files that differ from the ledger by the folder's listing."""
        return changes.touched_files(S.listed(self.spark, self.folder), self._known())

    def _in_parts(self, size: int) -> dict:
        dealt = checkpointed(changes.in_batches(self.touched(), size))
        last = dealt.agg(F.max("batch")).first()[0] or 0
        total = {"files": 0, "failed": 0, "new_files": 0, "updated_files": 0, "chunks": 0}
        for number in range(1, last + 1):
            part = dealt.where(F.col("batch") == number).select("path", "known")
            files = S.discovered(self.spark, [r["path"] for r in part.select("path").collect()])  # ``size`` paths at most
            one = self._step(files.join(F.broadcast(part), "path", "left"), part)
            total = {k: v + one[k] for k, v in total.items()}
        return total | {"total_vectors": self.store.count()}

    def prune(self) -> None:
        """Drops rows and ledger entries of files that are gone."""
        gone = checkpointed(self._known().join(S.listed(self.spark, self.folder), "path", "left_anti").select("path").distinct())
        self.store.remove(gone.withColumnRenamed("path", "source"))
        self.ledger.remove(gone)

    def status(self, state: str, **more) -> None:
        """Publishes the job's state; a reader sees this one or the one before."""
        self.files.replace(STATUS, json.dumps({"status": state, "at": datetime.now().isoformat()} | {k: str(v) for k, v in more.items()}))

    def last_status(self) -> dict:
        """The state published last; ``idle`` without one that can be read."""
        try:
            return json.loads(self.files.text(STATUS) or "")
        except ValueError:
            return {"status": "idle"}

    def wait(self, tries: int = 60, pause: float = 2.0) -> dict:
        """Asks for the state until it is neither ``processing`` nor ``idle``, or ``tries`` are over; the last one."""
        for _ in range(tries):
            found = self.last_status()
            if found["status"] not in ("processing", "idle"):
                break
            time.sleep(pause)
        return found

    def _known(self) -> DataFrame:
        """The ledger; one that can't be read counts as empty, so that all files are taken anew."""
        try:
            return checkpointed(self.ledger.read())
        except (PySparkException, ValueError):
            return self.spark.createDataFrame([], self.ledger.schema)

    def _step(self, files: DataFrame, known: DataFrame) -> dict:
        """Takes up ``files`` with their contents; ``known`` has the paths of the ledger (more or fewer don't matter), with a null hash for new ones or none at all."""
        pages = checkpointed(S.loaded(files, self.parse))
        failed = pages.where("error is not null").select("path").distinct().count()
        read = pages.where("error is null").select("path", "md5", "length", "modified", "same").distinct()
        hash_of = "known" if "known" in known.columns else "md5"
        old = known.where(F.col(hash_of).isNotNull()).select(F.col("path").alias("__path")).distinct()
        read = checkpointed(read.join(old, F.col("path") == F.col("__path"), "left").withColumn("is_new", F.col("__path").isNull()).drop("__path"))
        good = read.where(~F.col("same"))
        texts = pages.where("error is null and not same").select(F.concat_ws("#", "path", "page_label").alias("page"), "path", "text")
        chunks = self.split(texts, "page", size=self.size, overlap=self.overlap, source="path")
        rows = chunks.select("source", F.concat_ws("#", "page", F.col("chunk_index").cast("string")).alias("chunk_id"), "text", "n_tokens")
        rows = checkpointed(providers.embedded(rows, self.embedder))
        counts = good.agg(F.count("*").alias("files"), F.count_if("is_new").alias("new_files"), F.count_if(~F.col("is_new")).alias("updated_files")).first().asDict()
        if counts["files"]:
            self.store.add(rows, good.select(F.col("path").alias("source")))
        if counts["files"] or not read.isEmpty():
            self.ledger.upsert(read.select("path", "md5", "length", "modified"))  # of touched files that did not change, too: they are not read again
        return counts | {"failed": failed, "chunks": rows.count()}


def run_ingestion(spark: SparkSession, config_path: str | None = None, force: bool = False, incremental: bool = False, files: list[str] | None = None) -> dict:
    """An ingestion as the settings file describes it; contradicting switches are refused."""
    if sum([force, incremental, files is not None]) > 1:
        raise ValueError("force, incremental and files exclude each other")
    config = load_config(config_path)
    job = Ingestion(
        spark, resolved(config, setting(config, "ingestion.directory", "data/pdfs")), resolved(config, setting(config, "storage.directory", "storage")), providers.embedder_from(config),
        setting(config, "embedding.model", "default"), setting(config, "ingestion.chunk_size", 1024), setting(config, "ingestion.chunk_overlap", 50), setting(config, "ingestion.batch_size", 100),
    )
    if files is not None:
        return job.run_files(files)
    return job.run_incremental() if incremental else job.run(force)


def token_overhead(question, template: str = T.PROMPT):
    """Tokens of the prompt with an empty context."""
    return T.count_tokens(T.prompt(F.lit(""), question, template))
