"""The vector table: chunks with their vectors, replaced by source, searched exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import vectors
from .log_table import LogTable


class VectorTable(LogTable):
    def __init__(self, spark: SparkSession, folder: str, dimension: int, **options):
        super().__init__(spark, folder, "source string, chunk_id string, text string, n_tokens long, embedding array<float>", "source", **options)
        self.dimension = dimension

    def add(self, rows: DataFrame, sources: DataFrame | None = None) -> int:
        """Replaces all rows of the sources of ``rows`` (and of ``sources``, which may have none left) by ``rows``; the version."""
        if not rows.where(f"embedding is null or size(embedding) <> {self.dimension}").isEmpty():
            raise ValueError(f"vectors must have {self.dimension} components")
        return self.upsert(rows, sources)

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """``query_id``, ``rank``, ``chunk_id``, ``source``, ``text``, ``n_tokens``, ``distance``; without ``k``, 4."""
        keyed = self.read().selectExpr("to_json(struct(source, chunk_id)) as vec_id", "*")
        found = vectors.nearest(keyed, queries, 4 if k is None else k)
        wanted = found.join(keyed.select("vec_id", "chunk_id", "source", "text", "n_tokens"), "vec_id")
        return wanted.selectExpr("query_id", "rank", "chunk_id", "coalesce(source, 'unknown') as source", "text", "n_tokens", "distance")

    def remove_by_sources(self, sources: DataFrame) -> int:
        """Drops all rows of ``sources`` (a column ``source``); how many they were."""
        named = vectors.named_sources(sources)
        version = self.remove(named)
        return self.read(version - 1).join(named, "source", "left_semi").count() if version > 1 else 0

    def delete_all(self) -> None:
        self.clear()


#: The name under which a store of vectors is known where its kind does not matter.
VectorStore = VectorTable
