"""Ingestion as a stream over a folder."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..plans.ingest import Ingestion
from ..sources.files import PDF
from .debounce import debounced
from .events import folder_events
from .progress import Progress

#: What the listener publishes, beside the job's own status.
STATE = "stream_status.json"


def watched(job: Ingestion, checkpoint: str, files: int = 100, forever: bool = False, every: float = 1.0, quiet: float = 5.0):
    """Starts a stream that ingests a folder's new and changed files; without ``forever`` it ends when all are done.

    With ``forever`` the folder's events are debounced: ingestion runs once no file has come or changed for ``quiet`` seconds. ``every`` is how
    often the folder is listed. A folder that is not mounted where the driver runs (of another scheme than ``file``) has no events; there ingestion runs at
    every tick. Either way the folder's listing is compared with the ledger, and contents are read only of files that differ, so a trigger too
    many costs a listing. Micro-batches run one after the other, so no trigger is lost; one that fails ends the stream, and a restart from
    the checkpoint tries again. The job's status goes to its storage, and so does the stream's own state, from a listener.
    """
    spark = job.spark
    if not forever:
        came = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", PDF).option("maxFilesPerTrigger", files).load(job.folder).select("path")
    elif "://" in job.folder and not job.folder.startswith("file://"):
        came = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    else:
        came = debounced(folder_events(spark, job.folder, glob=PDF).select(F.lit(job.folder).alias("folder"), "path"), "folder", "path", quiet)

    def ingest(batch, number: int) -> None:
        if forever and not batch.count():  # all of it is computed, as state is to be committed
            return  # no timer ran out
        job.status("processing", batch=number)
        try:
            job.status("complete", batch=number, **job.run_incremental())
        except Exception as error:
            job.status("error", batch=number, error_message=error)
            raise

    name = f"ingestion-{uuid.uuid4().hex[:8]}"
    spark.streams.addListener(Progress(name, lambda state, **more: job.files.replace(STATE, json.dumps({"state": state, "at": datetime.now().isoformat()} | more))))
    writer = came.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(ingest)
    return (writer.trigger(processingTime=f"{every} seconds") if forever else writer.trigger(availableNow=True)).start()
