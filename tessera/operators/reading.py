"""Reading documents back, the corpus overview, and the index file."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.functions.markdown import headings_in
from tessera.operators.convention import Convention, index_order

SUGGESTIONS = 3
INDEX_HEADER = '# Documentation index\n\n<!-- Generated by "index-md"; manual edits are overwritten. -->\n'


# ---------------------------------------------------------------- reading
def resolve(documents: DataFrame, path: str) -> Row | None:
    """The document at the path, or at the path without its first folder."""
    other = path.split("/", 1)[1] if "/" in path else path
    return documents.where(F.col("path").isin(path, other)).orderBy(F.col("path") != path).first()


def closest(documents: DataFrame, path: str, n: int = SUGGESTIONS) -> list[str]:
    near = documents.select("path", X.distance(F.lit(path), F.col("path")).alias("d")).orderBy("d", "path").limit(n)
    return [r["path"] for r in near.collect()]


@dataclass(frozen=True)
class Read:
    """kind: document, section, path-not-found, section-not-found or no-sections."""

    kind: str
    meta: Row | None = None
    content: str = ""
    section: str = ""
    listed: tuple[str, ...] = ()


def whole_text(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, content): chunks in order, under the title unless they bring a heading of their own."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", "content"))), lambda s: s["content"])
    body = chunks.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("body"))  # the chunks of one document
    joined = documents.select("doc_id", "title").join(body, "doc_id", "left").withColumn("body", F.coalesce("body", F.lit("")))
    return joined.select("doc_id", F.when(F.col("body").startswith("# "), F.col("body")).otherwise(F.concat(F.lit("# "), "title", F.lit("\n\n"), "body")).alias("content"))


def read(documents: DataFrame, chunks: DataFrame, path: str, section: str | None = None) -> Read:
    doc = resolve(documents, path)
    if doc is None:
        return Read("path-not-found", section=path, listed=tuple(closest(documents, path)))
    own = chunks.where(F.col("doc_id") == doc["doc_id"])
    if not (section or "").strip():
        return Read("document", doc, whole_text(own, documents.where(F.col("doc_id") == doc["doc_id"])).first()["content"])
    wanted = X.fold_similar(section)
    parts = own.orderBy("position").select("heading", "content").collect()  # the chunks of one document
    hits = [p["content"] for p in parts if any(wanted in X.fold_similar(h) for h in (p["heading"], *headings_in(p["content"])))]
    if hits:
        return Read("section", doc, "\n\n".join(hits), section)
    known = tuple(dict.fromkeys(h for p in parts for h in (p["heading"], *headings_in(p["content"])) if h))
    return Read("section-not-found" if known else "no-sections", doc, section=section, listed=known)


def sections(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """(doc_id, section, content) of a batch of requests (doc_id, section): the chunks whose heading, or a heading inside, holds
    the section's folded text, in order; requests that no chunk meets are left out."""
    low = lambda c: X.folded(c, True)
    own = chunks.join(requests, "doc_id")
    titles = F.concat(F.array("heading"), F.when(F.col("content").contains("#"), headings(F.col("content"))).otherwise(F.array().cast("array<string>")))
    hits = own.where(F.exists(titles, lambda h: low(h).contains(low(F.col("section")))))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", "content"))), lambda c: c["content"])
    return hits.groupBy("doc_id", "section").agg(F.array_join(ordered, "\n\n").alias("content"))  # the chunks of one document


@F.arrow_udf(T.ArrayType(T.StringType()))
def _headings(text: pa.Array) -> pa.Array:
    return X.mapped(lambda t: headings_in(t or ""), pa.list_(pa.string()), text)


def headings(text: Column) -> Column:
    return _headings(text)


def frontmatter(type: Column, module: Column, status: Column, owner: Column, tags: Column, updated: Column) -> Column:
    """The metadata block of a document; absent keys are left out."""
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    tag_line = F.when(F.size(tags) > 0, F.concat(F.lit("tags: ["), F.array_join(tags, ", "), F.lit("]")))
    return F.concat_ws("\n", F.lit("---"), line("type", type), line("module", module), line("status", status), line("owner", owner), tag_line, line("updated", updated), F.lit("---"))


def render_read(result: Read) -> str:
    if result.kind == "path-not-found":
        near = "\n".join(f"- {p}" for p in result.listed)
        return f'Document "{result.section}" not found.' + (f" Closest paths:\n{near}" if near else "")
    if result.kind == "no-sections":
        return f'"{result.meta["path"]}" has no sections; read it without "section".'
    if result.kind == "section-not-found":
        known = "\n".join(f"- {s}" for s in result.listed)
        return f'Section "{result.section}" not found in "{result.meta["path"]}". Available sections:\n{known}'
    m = result.meta
    lines = [f"{k}: {m[k]}" for k in ("type", "module", "status", "owner") if m[k] is not None]
    lines += [f"tags: [{', '.join(m['tags'])}]"] * bool(m["tags"]) + ([f"updated: {m['updated']}"] if m["updated"] is not None else [])
    return "\n".join(["---", *lines, "---"]) + f"\n\n{result.content}"


# ---------------------------------------------------------------- overview
def counts(documents: DataFrame) -> DataFrame:
    """(field, value, n): documents by type and by module in one pass; without a value they are not counted."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("type", "module")])).alias("p")
    return documents.select(pairs).select("p.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))


def lines(documents: DataFrame) -> DataFrame:
    """(path, type, line) of every document."""
    line = X.doc_line(F.col("type"), F.col("path"), X.display_summary(F.col("summary"), F.col("title")), F.col("status"))
    return documents.select("path", "type", line.alias("line"))


def overview(documents: DataFrame, sync_warnings: list[str] = (), config_warnings: list[str] = (), kept: DataFrame | None = None) -> str:  # type: ignore[assignment]
    """The text of the overview; the result of a report, so its lines are collected.  Where counts (field, value, n) are
    kept beside the documents, no document is read to count."""
    found = (counts(documents) if kept is None else kept).where(F.col("field").isin("documents", "type", "module")).orderBy("field", "value").collect()
    n = documents.count() if kept is None else sum(r["n"] for r in found if r["field"] == "documents")
    out = [f"Indexed documents: {n}"]
    for f in ("type", "module"):
        if own := [f"{r['value']} ({r['n']})" for r in found if r["field"] == f]:
            out.append(f"By {f}: {', '.join(own)}")
    out += ["", *(r["line"] for r in lines(documents).orderBy("path").toLocalIterator())]
    for title, warnings in (("Sync:", sync_warnings), ("Config:", config_warnings)):
        if warnings:
            out += ["", title, *(f"WARNING {w}" for w in warnings)]
    return "\n".join(out)


def index_md(documents: DataFrame, convention: Convention | None = None) -> str:
    body = [r["line"] for r in lines(documents).orderBy(*index_order(convention or Convention())).toLocalIterator()]
    return INDEX_HEADER + ("\n" + "\n".join(body) + "\n" if body else "")
