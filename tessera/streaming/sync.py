"""Incremental passes: the difference of two listings, applied to a snapshot, and a throttled trigger.

A pass is a batch: a file stream reports neither edits nor deletions.  ``stream_sync`` runs passes off a stream of
notices instead, one a micro-batch.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import lexical
from tessera.operators.vector import missing_vectors
from tessera.plans.indexing import embedded, transform
from tessera.sources.config import Config
from tessera.sources.embeddings import Remembered, Unavailable
from tessera.sources.snapshots import MAX_SEGMENTS, Conflict, SnapshotStore, Version, counted, of_generation


def diff(found: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, state): new, changed, same or deleted.  Both sides: path, hash."""
    a, b = found.select("path", F.col("hash").alias("new")), indexed.select("path", F.col("hash").alias("old"))
    state = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("new") == F.col("old"), "same").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def ancestors(path: Column) -> Column:
    """The path and every folder it lies under."""
    names = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))


def deletable(states: DataFrame, unreadable: DataFrame) -> DataFrame:
    """Paths that are gone; what could not be read in this pass (path) protects itself and all that lies under it."""
    gone = states.where(F.col("state") == "deleted").select("path")
    above = gone.select("path", F.explode(ancestors(F.col("path"))).alias("above"))
    safe = above.join(unreadable.select(F.col("path").alias("above")).distinct(), "above", "left_semi").select("path")
    return gone.join(safe, "path", "left_anti")


@dataclass
class SyncReport:
    indexed: list[str] = field(default_factory=list)
    deleted: list[str] = field(default_factory=list)
    unchanged: int = 0
    chunks: int = 0
    embedded: int = 0
    skipped: list[tuple[str, list[str]]] = field(default_factory=list)
    notices: list[tuple[str, str]] = field(default_factory=list)
    warning: str | None = None

    def lines(self) -> list[str]:
        out = [f"Indexed: {len(self.indexed)} ({self.chunks} chunks), deleted: {len(self.deleted)}, unchanged: {self.unchanged}"]
        out += [f"WARNING {p}: {'; '.join(e)}" for p, e in self.skipped]
        out += [f"WARNING {p}: decoded as {e}" for p, e in self.notices]
        return out + ([f"WARNING {self.warning}"] if self.warning else [])


def sync(files: Callable[[], DataFrame], store: SnapshotStore, config: Config, provider: Remembered | None = None, roots: tuple[str, ...] = (), tries: int = 5) -> SyncReport:
    """One pass: changed files are transformed, and a known path that is now rejected goes; missing ones go unless their
    folder could not be read; chunks of unchanged documents without a vector get one.  Only what changed is written; a pass
    that another one has overtaken lists the files anew and starts again from the other's result."""
    for left in range(tries - 1, -1, -1):
        try:
            report = _pass(files(), store, config, provider, roots)
            break
        except Conflict:
            if not left:
                raise
    if len(store.current().segments) > MAX_SEGMENTS:
        with suppress(Conflict):  # the other pass compacts
            store.compact()
    return report


def _pass(files: DataFrame, store: SnapshotStore, config: Config, provider: Remembered | None, roots: tuple[str, ...]) -> SyncReport:
    report, base = SyncReport(), store.current()
    whole = SnapshotStore(store.spark, store.path, base or Version(0, 1, ()))
    gen, parts = (base.number if base else 0) + 1, base.parts if base else 1
    old_documents, old_chunks, old_vectors = (whole.read(n) for n in ("documents", "chunks", "vectors"))
    listing = files.select("path", F.lit(None).cast("string").alias("text"), "encoding", "error", F.sha2(F.col("text").cast("binary"), 256).alias("hash")).persist()  # no texts
    bad, hashed = listing.where(F.col("error").isNotNull()).drop("hash"), listing.where(F.col("error").isNull())
    states = diff(hashed, old_documents).persist()
    changed = states.where(F.col("state").isin("new", "changed"))
    t = transform(files.join(changed.select("path"), "path", "left_semi").unionByName(bad), config, roots)
    new_documents, new_chunks = t.documents.persist(), t.chunks.persist()
    gone = deletable(states, bad).persist()
    replaced = changed.select("path").unionByName(gone)
    stale = old_documents.join(replaced, "path", "left_semi").persist()
    stale_chunks = old_chunks.join(stale.select("doc_id"), "doc_id", "left_semi").persist()
    kept = [listing, states, new_documents, new_chunks, gone, stale, stale_chunks]
    minus, less = lexical.withdrawn(stale_chunks, parts, gen)
    own = {
        "documents": new_documents,
        "chunks": new_chunks,
        "blocks": lexical.blocks(new_chunks, parts, gen).unionByName(minus),
        "totals": lexical.totals(new_chunks, parts, gen).unionByName(less),
        "gone": stale_chunks.select(lexical.part_of(F.col("doc_id"), parts).alias("part"), "doc_id", "chunk_id"),
        "counts": counted(new_documents).unionByName(counted(stale, -1)),
    }
    if provider is not None:
        try:
            same = states.where("state = 'same'").select("path")
            gaps = missing_vectors(old_chunks, old_vectors, old_documents.join(same, "path", "left_semi"))
            ids = gaps.select("chunk_id").persist()
            kept.append(ids)
            own["vectors"] = embedded(new_chunks.select("chunk_id", "heading", "content").unionByName(gaps.select("chunk_id", "heading", "content")), provider)
            report.embedded = ids.count()
        except Unavailable as e:
            report.warning = f"embeddings are unavailable: {e}"
    try:
        if not (changed.isEmpty() and gone.isEmpty() and not report.embedded) or base is None:
            store.append(base, store.segment(**{k: of_generation(v, gen) for k, v in own.items()}))
        paths = lambda df: [r["path"] for r in df.select("path").orderBy("path").collect()]
        report.indexed, report.deleted, report.chunks = paths(new_documents), paths(gone), new_chunks.count()
        report.unchanged = states.where("state = 'same'").count()
        report.skipped = [(r["path"], list(r["errors"])) for r in t.skipped.orderBy("path").collect()]
        report.notices = [(r["path"], r["encoding"]) for r in hashed.where(F.col("encoding") != "utf-8").select("path", "encoding").orderBy("path").collect()]
    finally:
        for df in kept:
            df.unpersist()
        t.release()
        if provider is not None:
            provider.sweep()
    return report


class Scheduler:
    """Runs passes at most once in ``floor`` seconds, a failed one counting too; callers during a pass wait for it."""

    def __init__(self, run: Callable[[], SyncReport], floor: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self._run, self._floor, self._clock = run, floor, clock
        self._state = threading.Condition()
        self._running, self._last = False, None
        self.report: SyncReport | None = None
        self.error: Exception | None = None

    def maybe_sync(self) -> SyncReport | None:
        with self._state:
            if self._running:
                self._state.wait_for(lambda: not self._running)
                return self.report
            if self._last is not None and self._clock() - self._last < self._floor:
                return self.report
            self._running = True
        return self._tracked()

    def startup(self) -> threading.Thread:
        """A first pass that nobody waits for."""
        with self._state:
            self._running = True
        thread = threading.Thread(target=self._tracked, daemon=True)
        thread.start()
        return thread

    def _tracked(self) -> SyncReport | None:
        try:
            self.report, self.error = self._run(), None
        except Exception as e:
            self.error = e
        finally:
            with self._state:
                self._last, self._running = self._clock(), False
                self._state.notify_all()
        return self.report


def stream_sync(notices: DataFrame, run: Callable[[], SyncReport], checkpoint: str):
    """A pass for every micro-batch of a stream of notices (any rows); what is due at the start is worked off, then it ends."""
    return notices.writeStream.foreachBatch(lambda df, _: None if df.isEmpty() else run() and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ThrottledPasses:
    """Passes off a stream of notices (any rows), becoming due at least ``floor`` seconds apart, with the clock in the stream's
    checkpoint; ``last`` is when the last one was due, in milliseconds.

    Notices of one micro-batch are one; what comes within the floor waits for a timer and is worked off by one pass when it
    has gone by.  The time of the last pass is state of the stream, so a restart keeps the floor.  A pass that fails counts:
    its error is kept here and the clock has moved on.  If the driver goes down during a pass, that pass runs again.
    """

    def __init__(self, notices: DataFrame, run: Callable[[], SyncReport], floor: float = 30.0):
        self._notices, self._run, self._floor_ms = notices, run, int(floor * 1000)
        self.last: int | None = None
        self.report: SyncReport | None = None
        self.error: Exception | None = None

    def due(self) -> DataFrame:
        """A stream with a row whenever a pass is due."""
        floor = self._floor_ms

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """At most one notice a task goes on."""
            if any(b.num_rows for b in batches):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())], names=["key"])

        def clock(key: tuple, notices: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            last, waiting = state.get if state.exists else (None, False)
            if state.hasTimedOut:
                state_now = state.getCurrentProcessingTimeMs()
            else:
                waiting = any([len(n) for n in notices]) or waiting
                state_now = state.getCurrentProcessingTimeMs()
            go = waiting and (last is None or state_now - last >= floor)
            if go:
                last, waiting = state_now, False
            state.update((last, waiting))
            if waiting:
                state.setTimeoutDuration(max(1, last + floor - state_now))
            if go:
                yield pd.DataFrame({"at": [state_now]})

        keyed = self._notices.select(F.lit(0).alias("any")).mapInArrow(one, "key int")
        return keyed.groupBy("key").applyInPandasWithState(clock, "at long", "last long, waiting boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)

    def start(self, checkpoint: str, poll: str = "1 second"):
        def passes(batch: DataFrame, _: int) -> None:
            at = batch.agg(F.max("at")).first()[0]  # reads all of the batch, or its state would not be kept
            if at is not None:
                self.last = at
                try:
                    self.report, self.error = self._run(), None
                except Exception as e:
                    self.error = e

        return self.due().writeStream.foreachBatch(passes).option("checkpointLocation", checkpoint).trigger(processingTime=poll).start()
