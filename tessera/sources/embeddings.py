"""Providers of embeddings, and the memory of one that failed.

``Model`` runs a model inside Arrow tasks: each worker process loads it once and keeps it, or keeps why it could not.  A
failure is a row with its reason, not an exception, so no task is tried again because of it.

``Remembered`` stands in front of any provider.  The first failure that its rows (or an exception) tell of opens it: it is
kept in the process and written beside the index for the other processes of the application, and from then on nothing calls
the provider again.  The reason is told once; a new application tries anew.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Embeddings of a frame (chunk_id, text): (chunk_id, embedding), and error (null where there is an embedding) if it tells.
Embed = Callable[[DataFrame], DataFrame]
#: Texts to vectors, one each.
Encode = Callable[[list[str]], Sequence[Sequence[float]]]

BATCH = 16
FOUND = "chunk_id long, embedding array<float>, error string"

#: Of this process: the model, or why there is none, by name.
_MODELS: dict[str, Encode | str] = {}


class Unavailable(RuntimeError):
    """The provider failed, now or before."""


def _first_line(e: object) -> str:
    return (str(e).strip() or type(e).__name__).splitlines()[0]


def _encoded(name: str, load: Callable[[], Encode], texts: list[str]) -> np.ndarray | str:
    """Unit vectors of the texts, or why there are none; after a failure nothing is called again in this process."""
    kept = _MODELS.get(name)
    if isinstance(kept, str):
        return kept
    try:
        if kept is None:
            kept = _MODELS[name] = load()
        rows = np.asarray(kept(texts), np.float32)
        if rows.ndim != 2 or len(rows) != len(texts):
            raise ValueError(f"the model gave {rows.shape} for {len(texts)} texts")
        return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    except Exception as e:
        _MODELS[name] = _first_line(e)
        return _MODELS[name]


@dataclass(frozen=True)
class Model:
    """A provider that loads a model in the workers; name tells models apart within a process."""

    name: str
    load: Callable[[], Encode]
    batch: int = BATCH

    def __call__(self, frame: DataFrame) -> DataFrame:
        name, load, size = self.name, self.load, self.batch

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, size):
                    part = b.slice(lo, size)
                    got = _encoded(name, load, [t or "" for t in part.column(1).to_pylist()])
                    n = part.num_rows
                    vectors = [None] * n if isinstance(got, str) else got.tolist()
                    errors = [got if isinstance(got, str) else None] * n
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=["chunk_id", "embedding", "error"])

        return frame.select(F.col("chunk_id").cast("long").alias("chunk_id"), "text").mapInArrow(run, FOUND)


class Remembered:
    """A provider with the memory of its first failure."""

    def __init__(self, spark: SparkSession, embed: Embed, path: str):
        self.spark, self.embed, self.path = spark, embed, path.rstrip("/")
        self.failure: str | None = None
        self._told = False

    # ------------------------------------------------------------ memory
    def _file(self) -> str:
        return f"{self.path}/provider/{self.spark.sparkContext.applicationId}.json"

    def _fs(self):
        Path = self.spark._jvm.org.apache.hadoop.fs.Path
        return Path(self._file()).getFileSystem(self.spark._jsc.hadoopConfiguration()), Path(self._file())

    def failed(self) -> str | None:
        """Why the provider is not to be called, if so."""
        if self.failure is None:
            fs, file = self._fs()
            if fs.exists(file):
                stream = fs.open(file)
                try:
                    self.failure = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["failure"]
                finally:
                    stream.close()
        return self.failure

    def remember(self, failure: str) -> None:
        if self.failure is None:
            self.failure = failure
            fs, file = self._fs()
            if not fs.exists(file):
                out = fs.create(file, True)
                out.write(bytearray(json.dumps({"failure": failure}).encode()))
                out.close()

    def told(self) -> str | None:
        """The failure, the first time it is asked for."""
        if self.failure is None or self._told:
            return None
        self._told = True
        return self.failure

    def reset(self) -> None:
        """Forgets, so that the provider is tried again; workers keep their own memory of a model."""
        self.failure, self._told = None, False
        fs, file = self._fs()
        fs.delete(file, False)

    # ------------------------------------------------------------ calls
    def vectors(self, frame: DataFrame) -> DataFrame:
        """(chunk_id, embedding) of a frame (chunk_id, text), computed once and written; raises Unavailable."""
        if (known := self.failed()) is not None:
            raise Unavailable(known)
        path = f"{self.path}/provider/embedded-{os.urandom(8).hex()}"
        try:
            found = self.embed(frame)
            if "error" not in found.columns:
                found = found.withColumn("error", F.lit(None).cast("string"))
            found.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"), "error").write.parquet(path)
        except Exception as e:
            self.remember(_first_line(e))
            raise Unavailable(self.failure) from e
        kept = self.spark.read.schema(FOUND).parquet(path)
        wrong = kept.where("error is not null").select("error").first()
        if wrong is not None:
            self.remember(wrong["error"])
            raise Unavailable(self.failure)
        return kept.select("chunk_id", "embedding")

    def vector(self, text: str) -> list[float] | None:
        """The vector of one text; None once the provider has failed."""
        try:
            row = self.vectors(self.spark.createDataFrame([(0, text)], "chunk_id long, text string")).first()
            return list(row["embedding"]) if row is not None and row["embedding"] is not None else None
        except Unavailable:
            return None

    def sweep(self) -> None:
        """Removes the vectors that were written on the way; call it when what was made of them is committed."""
        fs, file = self._fs()
        folder = file.getParent()
        if fs.exists(folder):
            for status in fs.listStatus(folder):
                if status.getPath().getName().startswith("embedded-"):
                    fs.delete(status.getPath(), True)
