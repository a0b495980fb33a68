"""The read interface over a catalogue's tables: one method for each read, a DataFrame of payloads as its answer. A web layer only
has to turn rows into JSON; arguments out of range raise ValueError, unknown ids give no row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_key
from . import catalog, gram_index, rank, search, vectors


def within(name: str, value, least, most):
    if not least <= value <= most:
        raise ValueError(f"{name} must lie between {least} and {most}")


@dataclass
class Catalogue:
    """works, items, sources, embeddings (work_id, vector, source_id, is_title_only), factors (work_id, factors, n_patrons, trained_at)
    and, for searches by meaning, a function from a text to its unit vector. The trigram index of the works is built by the first
    exact search, if none is given, and kept."""

    works: DataFrame
    items: DataFrame
    sources: DataFrame
    embeddings: DataFrame
    factors: DataFrame
    encode: Callable[[str], Sequence[float]] | None = None
    weights: rank.Weights = field(default_factory=rank.Weights)
    grams: gram_index.GramIndex | None = None

    def _summary(self, works: DataFrame) -> DataFrame:
        return catalog.work_summary(works, self.items, self.sources)

    def _vectors(self, df: DataFrame) -> DataFrame:
        return vectors.of_live_works(df, self.works)

    def health(self) -> DataFrame:
        return catalog.health(self.works, self.items, self.embeddings, self.factors, self.sources)

    def coverage(self) -> DataFrame:
        return catalog.source_breakdown(self.sources, self.works, self.embeddings, self.factors)

    def work(self, id_: int) -> DataFrame:
        """id, payload."""
        return catalog.payload_of(self._summary(self.works.where(F.col("id") == id_)))

    def work_by_record_id(self, record_id: str, source_id: int | None = None) -> DataFrame:
        wanted = self.works.sparkSession.createDataFrame([(record_id,)], "query string")
        found = catalog.by_record_id(self.works, wanted, source_id)
        return catalog.payload_of(self._summary(self.works.join(found.select("id"), "id", "left_semi")))

    def similar(self, id_: int, limit: int = 10, exclude_title_only: bool = False, cross_source: bool = False) -> DataFrame:
        """probe, results (payloads in order), hybrid_count, collaborative_applied."""
        within("limit", limit, 1, 50)
        e, f = self._vectors(self.embeddings), self._vectors(self.factors)
        probe = e.where(F.col("work_id") == id_).select(F.col("work_id").alias("probe"), F.col("vector").alias("probe_vector"), F.col("source_id").alias("probe_source"))
        pool = vectors.similar(probe, e, max(self.weights.pool, limit), cross_source, exclude_title_only)
        candidates = pool.select("probe", "work_id", F.col("score").alias("content_score")).join(f.select("work_id", "factors", "n_patrons"), "work_id", "left")
        own = f.where(F.col("work_id") == id_).select(F.col("work_id").alias("probe"), F.col("factors").alias("probe_vector"), F.col("n_patrons").alias("probe_patrons"))
        return catalog.similar_payload(rank.rerank(candidates, own, self.weights, limit), self._summary(self.works.withColumn("score", F.lit(None).cast("double"))))

    def search_exact(self, query: str, limit: int = 20, source_id: int | None = None) -> DataFrame:
        """id, payload, rank."""
        within("limit", limit, 1, 100)
        within("the length of the query", len(query), 2, 200)
        asked = self.works.sparkSession.createDataFrame([(query,)], "query string")
        self.grams = self.grams or gram_index.build(self.works)
        found = search.search_exact(asked, self.works, limit, source_id, index=self.grams).select("id", "score", "rank")
        return self._answers(found)

    def search_semantic(self, query: str, limit: int = 20, source_id: int | None = None, exclude_title_only: bool = False, min_score: float = 0.0) -> DataFrame:
        """id, payload, rank."""
        within("limit", limit, 1, 100)
        within("the length of the query", len(query), 2, 300)
        within("min_score", min_score, -1.0, 1.0)
        if self.encode is None:
            raise ValueError("no encoder was given")
        vector = [float(x) for x in self.encode(query)]
        # -1 is no work's id
        probe = self.works.sparkSession.createDataFrame([(-1, vector, 0)], "probe long, probe_vector array<double>, probe_source int")
        keys = catalog.live(self.works).select(F.col("id").alias("work_id"), canonical_key(F.col("title"), F.col("authors")).alias("key"))
        rows = catalog.scope(self._vectors(self.embeddings), source_id)
        found = vectors.semantic_search(probe, rows, keys, limit, min_score, cross_source=True, exclude_title_only=exclude_title_only)
        return self._answers(found.select(F.col("work_id").alias("id"), "score", "rank"))

    def _answers(self, found: DataFrame) -> DataFrame:
        summary = self._summary(self.works.join(found.select("id", "score"), "id"))
        return catalog.payload_of(summary).join(found.select("id", "rank"), "id").orderBy("rank")
