"""From files to the index: parse, resolve, chunk, and invert - one job graph, written as one snapshot."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import chunking
from tessera.functions.markdown import outline, scalar, split_frontmatter
from tessera.functions.text import SPACE_CHARS
from tessera.operators import vector
from tessera.operators.convention import resolved
from tessera.sources.config import Config
from tessera.sources.embeddings import Remembered, Unavailable
from tessera.sources.snapshots import SnapshotStore

PARSED = "path string, hash string, title string, summary string, fields map<string,string>, tags array<string>, tags_ok boolean, chunks array<struct<heading:string,content:string>>, parse_error string"
NO_CONTENT = "the document has no indexable content"


def parse_one(path: str, text: str, config: Config) -> dict:
    own = {"path": path, "hash": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), "fields": {}, "tags": None, "tags_ok": True, "chunks": [], "title": "", "summary": "", "parse_error": None}
    try:
        data, body = split_frontmatter(text)
    except Exception as e:  # malformed frontmatter skips the document, with the reason
        return own | {"parse_error": str(e).split("\n")[0]}
    tree = outline(body)
    tags = data.get("tags")
    if tags is not None:
        good = isinstance(tags, list) and all(isinstance(t, str) for t in tags)
        own |= {"tags": tags if good else None, "tags_ok": good}
    own["fields"] = {str(k): v for k, v in ((k, scalar(v) if k == "updated" or isinstance(v, str) else None) for k, v in data.items()) if v is not None}
    by_size = path in config.size_only or path.rsplit("/", 1)[-1] in config.size_only
    chunks = chunking.chunk_whole(body, config.max_tokens) if by_size else chunking.chunk_outline(tree, config.min_tokens, config.max_tokens)
    title = tree.title.strip(SPACE_CHARS)
    own |= {"title": title, "summary": tree.summary, "chunks": [{"heading": h, "content": c} for h, c in chunking.with_headings(chunks, chunking.heading_of(title, path))]}
    return own


def parsed(files: DataFrame, config: Config) -> DataFrame:
    """files (path, text): one Arrow pass for all that needs the document's structure."""
    names = [c.split(" ")[0] for c in PARSED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([parse_one(p, t, config) for p, t in zip(b["path"], b["text"], strict=True)], columns=names)

    return files.select("path", "text").mapInPandas(run, PARSED)


@dataclass
class Transformed:
    documents: DataFrame
    chunks: DataFrame
    skipped: DataFrame  # path, errors
    notices: DataFrame  # path, encoding
    kept: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        """Drops what was kept so that files are read and parsed once; call it when all of it is written."""
        for df in self.kept:
            df.unpersist()


def transform(files: DataFrame, config: Config, roots: tuple[str, ...] = ()) -> Transformed:
    """Accepted documents with their chunks, and for every other file why it was skipped.

    Identifiers are 64-bit hashes of the path, and of path and position, so they stay the same over passes.
    """
    files = files.persist()  # every dataset of an index comes from it
    good = files.where(F.col("error").isNull())
    meta = resolved(parsed(good, config), config.convention, roots)
    errors = F.when(F.col("parse_error").isNotNull(), F.array("parse_error")).when(F.size("errors") > 0, F.col("errors")).when(F.size("chunks") == 0, F.array(F.lit(NO_CONTENT)))
    meta = meta.withColumn("errors", errors).withColumn("doc_id", F.xxhash64("path"))
    meta = meta.persist()
    ok = meta.where(F.col("errors").isNull())
    documents = ok.select("doc_id", "path", "title", "summary", "type", "module", "status", "owner", "tags", "updated", "hash")
    chunks = ok.select("doc_id", "path", F.posexplode("chunks").alias("position", "c")).select(F.xxhash64("path", "position").alias("chunk_id"), "doc_id", "c.heading", "c.content", "position")
    skipped = meta.where(F.col("errors").isNotNull()).select("path", "errors").unionByName(files.where(F.col("error").isNotNull()).select("path", F.array("error").alias("errors")))
    notices = good.where(F.col("encoding") != "utf-8").select("path", "encoding")
    return Transformed(documents, chunks, skipped, notices, (files, meta))


def embedded(chunks: DataFrame, provider: Remembered) -> DataFrame:
    """(chunk_id, embedding) of chunks; raises Unavailable."""
    return provider.vectors(chunks.select("chunk_id", vector.passage().alias("text")))


@dataclass
class Report:
    documents: int
    chunks: int
    skipped: list[tuple[str, list[str]]]
    notices: list[tuple[str, str]]
    mode: str
    warning: str | None = None


def rebuild(files: DataFrame, store: SnapshotStore, config: Config, provider: Remembered | None = None, roots: tuple[str, ...] = ()) -> Report:
    """A whole new index; if embedding fails it is lexical and says why."""
    t = transform(files, config, roots)
    warning, mode, vectors = None, "lexical", None
    if provider is not None:
        try:
            vectors, mode = embedded(t.chunks, provider), "hybrid"
        except Unavailable as e:
            warning = f"embeddings are unavailable, the index is lexical: {e}"
    store.write(documents=t.documents, chunks=t.chunks, **({"vectors": vectors} if vectors is not None else {}))
    if provider is not None:
        provider.sweep()
    rows = lambda df: [tuple(r) for r in df.orderBy("path").collect()]  # a report of what was left out
    report = Report(store.read("documents").count(), store.read("chunks").count(), rows(t.skipped), rows(t.notices), mode, warning)
    t.release()
    return report
