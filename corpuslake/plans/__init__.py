"""Pipelines from files to answers and scores."""

from .evaluate import Evaluation, load_dataset, run_batch_evaluation, scored
from .ingest import Ingestion, run_ingestion
from .retrieve import Retrieval, answers, get_retrieval_pipeline, prompts, retrieved

__all__ = ["Evaluation", "Ingestion", "Retrieval", "answers", "get_retrieval_pipeline", "load_dataset", "prompts", "retrieved", "run_batch_evaluation", "run_ingestion", "scored"]
