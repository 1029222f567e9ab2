"""The engine as one object: overview, search, read, rebuild, sync and evaluation over a project folder."""

from __future__ import annotations

import json
import os
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import reading
from tessera.operators.filters import Filters
from tessera.plans import indexing, search
from tessera.sources import config as settings
from tessera.sources.embeddings import Embed, Remembered, Unavailable
from tessera.sources.files import scan
from tessera.sources.snapshots import SnapshotStore, write_text
from tessera.streaming.sync import Scheduler, SyncReport, sync

MAX_K = 20


class Engine:
    def __init__(self, spark: SparkSession, project: str, embed: Embed | None = None):
        self.spark, self.project = spark, project
        self.config, self.warnings = settings.load(project)
        self.roots = settings.roots(project, self.config.docs_dir)  # before anything is opened
        self.store = SnapshotStore(spark, os.path.join(project, self.config.index))
        self.provider = Remembered(spark, embed, self.store.path) if embed is not None else None
        self.scheduler = Scheduler(self.sync, self.config.throttle_ms / 1000)

    def files(self) -> DataFrame:
        return scan(self.spark, self.roots, self.config.exclude)

    def _aliases(self) -> tuple[str, ...]:
        return tuple(r.alias for r in self.roots if r.alias)

    def index(self) -> indexing.Report:
        return indexing.rebuild(self.files(), self.store, self.config, self.provider, self._aliases())

    def sync(self) -> SyncReport:
        return sync(self.files, self.store, self.config, self.provider, self._aliases())

    def docs_overview(self) -> str:
        report = self.scheduler.report
        store = self.store.pinned()
        return reading.overview(store.read("documents"), report.lines()[1:] if report else [], self.warnings, store.counts())

    def search_docs(self, query: str, type: str | None = None, module: str | None = None, tags=(), k: int | None = None, include_excluded: bool = False, lexical: bool = False) -> str:
        """JSON with mode, results and, for an empty or relaxed search, why."""
        if not query:
            raise ValueError("query must not be empty")
        k = self.config.k if k is None else k
        if not 1 <= k:
            raise ValueError("k must be at least 1")
        vector = self.provider.vector(f"query: {query}") if self.provider is not None and not lexical else None  # without one the search is lexical
        filters = Filters.of(type, module, tags, self.config.convention.excluded_statuses, include_excluded)
        found = search.search_one(search.Index.of(self.store.pinned()), query, vector, filters, k)
        out = {"mode": found.mode, "results": found.results}
        out |= {n: v for n, v in (("noMatchReason", found.no_match_reason), ("filterWarning", found.filter_warning), ("embeddingsWarning", self.provider.told() if self.provider else None)) if v}
        if self.provider is not None:
            self.provider.sweep()
        return json.dumps(out, ensure_ascii=False, indent=2)

    def read_doc(self, path: str, section: str | None = None) -> str:
        store = self.store.pinned()
        return reading.render_read(reading.read(store.read("documents"), store.read("chunks"), path, section))

    def index_md(self) -> tuple[str, list[tuple[str, list[str]]], bool]:
        """The index file of the files as they are now; skipped files; whether it was written anew."""
        t = indexing.transform(self.files(), self.config, self._aliases())
        path = os.path.join(self.roots[0].path, settings.INDEX_FILE)
        text = reading.index_md(t.documents, self.config.convention)
        skipped = [(r["path"], list(r["errors"])) for r in t.skipped.orderBy("path").collect() if r["errors"] != [indexing.NO_CONTENT]]
        t.release()
        return path, skipped, write_text(path, text)

    def evaluate(self, cases: list[dict], k: int | None = None) -> dict[str, dict]:
        """Quality by mode of cases {question, expected}."""
        k = self.config.k if k is None else k
        rows = [(i, c["question"], c["expected"]) for i, c in enumerate(cases)]
        frame = self.spark.createDataFrame(rows, "query_id long, question string, expected string")
        if self.provider is not None and self.store.has_vectors():
            texts = frame.select(F.col("query_id").alias("chunk_id"), F.concat(F.lit("query: "), "question").alias("text"))
            with suppress(Unavailable):  # then it is measured without vectors
                frame = frame.join(self.provider.vectors(texts).select(F.col("chunk_id").alias("query_id"), "embedding"), "query_id")
        return {mode: s.first().asDict() for mode, s in search.quality(search.Index.of(self.store.pinned()), frame, k).items()}


def concept_embeddings(concepts: list[list[str]]) -> Embed:
    """A deterministic provider: counts of each concept's stems in the folded text, a constant, unit length."""
    from tessera.functions.text import folded

    def embed(frame: DataFrame) -> DataFrame:
        text = folded(F.col("text"))
        counts = [sum((F.size(F.split(text, F.lit(stem))) - 1 for stem in stems), F.lit(0)).cast("double") for stems in concepts]
        raw = F.array(*counts, F.lit(0.05))
        norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
        return frame.select("chunk_id", raw.alias("raw")).select("chunk_id", F.transform("raw", lambda x: (x / norm).cast("float")).alias("embedding"))

    return embed
