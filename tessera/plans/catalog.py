"""Registered queries over whole tables, each with the SQL that answers it wherever SQL can."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as X
from tessera.functions.decode import CP1252_CHARS, decoded
from tessera.functions.excerpt import best_centre, excerpts, flatten, located
from tessera.functions.markdown import outline
from tessera.functions.splitting import split_to_bound
from tessera.functions.text import tokenize_query, units
from tessera.operators import convention, evaluate, filters, fusion, lexical, reading, similar, vector
from tessera.plans import corpus as C
from tessera.plans import search
from tessera.sources import files
from tessera.sources.snapshots import counted, upserted, without
from tessera.streaming import sync

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

K = 5


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


LEXICAL = (C.SQL_CHUNKS, C.SQL_INDEX, C.SQL_WANTED, C.SQL_SCORED)


# ---------------------------------------------------------------- search
@registered(
    with_(C.SQL_CORPUS, *LEXICAL, C.sql_lexical(50), C.sql_vector(50), C.SQL_FUSED)
    + """SELECT f.query_id, f.fused_rank AS rank, c.path, c.title, c.status, round(f.score, 4) AS score
FROM fused f JOIN corpus c ON f.chunk_id = c.doc_id WHERE f.fused_rank <= 5"""
)
def hybrid_search(spark, sf_dir):
    ix = C.index(spark, sf_dir)
    found = search.fused(ix, C.queries(spark, sf_dir), filters.Filters(), K)
    return found.join(ix.documents.select("doc_id", "path", "title", "status"), "doc_id").select("query_id", "rank", "path", "title", "status", F.round("score", 4).alias("score"))


@registered(
    with_(C.SQL_CORPUS, C.SQL_ALLOWED, *LEXICAL, C.sql_lexical(50, "chunk_id IN (SELECT chunk_id FROM allowed)"), C.sql_vector(50, "chunk_id IN (SELECT chunk_id FROM allowed)"), C.SQL_FUSED)
    + """SELECT f.query_id, f.fused_rank AS rank, c.path, c.status, round(f.score, 4) AS score
FROM fused f JOIN corpus c ON f.chunk_id = c.doc_id WHERE f.fused_rank <= 5"""
)
def hybrid_filtered(spark, sf_dir):
    ix = C.index(spark, sf_dir)
    found = search.fused(ix, C.queries(spark, sf_dir), C.SEARCH_FILTERS, K)
    return found.join(ix.documents.select("doc_id", "path", "status"), "doc_id").select("query_id", "rank", "path", "status", F.round("score", 4).alias("score"))


def _lexical(spark, sf_dir, allowed: bool) -> DataFrame:
    ix = C.index(spark, sf_dir, with_vectors=False)
    own = ix.allowed(C.SEARCH_FILTERS) if allowed else None
    found = lexical.search_lexical(C.queries(spark, sf_dir), ix.inverted, fusion.candidates(K), own)
    return found.select("query_id", "chunk_id", "rank", "score")


@registered(with_(*LEXICAL, C.sql_lexical(50)) + "SELECT query_id, chunk_id, rank, score FROM lexical")
def lexical_bm25(spark, sf_dir):
    return _lexical(spark, sf_dir, False)


@registered(with_(C.SQL_CORPUS, C.SQL_ALLOWED, *LEXICAL, C.sql_lexical(50, "chunk_id IN (SELECT chunk_id FROM allowed)")) + "SELECT query_id, chunk_id, rank, score FROM lexical")
def lexical_filtered(spark, sf_dir):
    return _lexical(spark, sf_dir, True)


@registered(with_(C.sql_vector(50, of_documents=False)) + "SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM vector")
def vector_knn(spark, sf_dir):
    found = vector.search_vector(C.vector_queries(spark, sf_dir), C.all_vectors(spark, sf_dir), fusion.candidates(K))
    return found.select("query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


@registered(with_(C.SQL_CORPUS, C.SQL_ALLOWED, C.sql_vector(50, "chunk_id IN (SELECT chunk_id FROM allowed)", of_documents=False)) + "SELECT query_id, chunk_id, rank, round(distance, 6) AS distance FROM vector")
def vector_postfilter(spark, sf_dir):
    allowed = search.allowed(C.chunks(spark, sf_dir), C.documents(spark, sf_dir), C.SEARCH_FILTERS)
    found = vector.search_vector(C.vector_queries(spark, sf_dir), C.all_vectors(spark, sf_dir), fusion.candidates(K), allowed)
    return found.select("query_id", "chunk_id", "rank", F.round("distance", 6).alias("distance"))


@registered(with_(*LEXICAL, C.sql_lexical(50), C.sql_vector(50), C.SQL_FUSED) + "SELECT query_id, chunk_id, fused_rank, best, lexical_rank, vector_rank, round(score, 9) AS score FROM fused")
def rrf_fusion(spark, sf_dir):
    ix, asked = C.index(spark, sf_dir), C.queries(spark, sf_dir)
    n = fusion.candidates(K)
    fused = fusion.fuse([lexical.search_lexical(asked, ix.inverted, n), vector.search_vector(asked, ix.vectors, n)])
    return fused.select("query_id", "chunk_id", "fused_rank", "best", F.col("rank_0").alias("lexical_rank"), F.col("rank_1").alias("vector_rank"), F.round("score", 9).alias("score"))


@registered(
    with_(C.SQL_LINE_CHUNKS, C.SQL_INDEX, C.SQL_WANTED, C.SQL_SCORED, C.sql_lexical(50))
    + """SELECT query_id, chunk_id, doc_id, rank FROM (
  SELECT query_id, chunk_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM (
    SELECT l.query_id, l.chunk_id, c.doc_id, l.rank AS fused_rank, row_number() OVER (PARTITION BY l.query_id, c.doc_id ORDER BY l.rank) AS n
    FROM lexical l JOIN chunks c ON l.chunk_id = c.chunk_id) WHERE n <= 2) WHERE rank <= 5"""
)
def per_document_cap(spark, sf_dir):
    ix = C.index(spark, sf_dir, by_line=True, with_vectors=False)
    found = search.fused(ix, C.queries(spark, sf_dir).drop("embedding"), filters.Filters(), K)
    return found.select("query_id", "chunk_id", "doc_id", "rank")


@registered(
    with_(*LEXICAL, C.sql_lexical(50), C.sql_vector(50), C.SQL_FUSED)
    + """SELECT q.query_id, lexical_rank, vector_rank, fused_rank, CASE WHEN fused_rank <= 5 THEN 'returned' WHEN fused_rank IS NOT NULL THEN 'cut' ELSE 'lost' END AS outcome
FROM (SELECT doc_id AS query_id FROM documents WHERE doc_id % 20 = 0) q LEFT JOIN fused f ON f.query_id = q.query_id AND f.chunk_id = q.query_id"""
)
def rank_probe(spark, sf_dir):
    """At which stage a query's own document is lost: per leg, after fusion, after the limit."""
    asked = C.queries(spark, sf_dir)
    own = rrf_fusion(spark, sf_dir).where("query_id = chunk_id")
    outcome = F.when(F.col("fused_rank") <= K, "returned").when(F.col("fused_rank").isNotNull(), "cut").otherwise("lost")
    return asked.select("query_id").join(own, "query_id", "left").select("query_id", "lexical_rank", "vector_rank", "fused_rank", outcome.alias("outcome"))


@registered(
    with_(C.SQL_CORPUS, C.SQL_CHUNKS) + "SELECT c.chunk_id, d.path, '' AS heading, octet_length(encode(c.content)) AS bytes FROM chunks c JOIN corpus d ON c.doc_id = d.doc_id WHERE c.chunk_id NOT IN (SELECT vec_id FROM embeddings)"
)
def missing_vectors(spark, sf_dir):
    return vector.missing_vectors(C.chunks(spark, sf_dir), C.vectors(spark, sf_dir), C.documents(spark, sf_dir)).select("chunk_id", "path", "heading", F.octet_length("content").alias("bytes"))


@registered(
    with_(C.sql_vector(10_000_000, of_documents=False)) + "SELECT query_id, chunk_id, rank, round(1 - distance * distance / 2, 6) AS cosine FROM vector WHERE rank <= 100"
)
def vector_cosine_ranks(spark, sf_dir):
    """Cosines of the nearest stored vectors by rank: of unit vectors they fall as ranks rise."""
    near = vector.knn(C.vector_queries(spark, sf_dir), C.all_vectors(spark, sf_dir), 100)
    return near.select("query_id", "chunk_id", "rank", F.round(1 - F.col("distance") ** 2 / 2, 6).alias("cosine"))


# ---------------------------------------------------------------- predicates, facets, overview
@registered(with_(C.SQL_CORPUS) + "SELECT doc_id, path FROM corpus WHERE type = 'en' AND module = 'src1'")
def filter_type_module(spark, sf_dir):
    return C.documents(spark, sf_dir).where(filters.Filters.of(" en ", "src1").predicate()).select("doc_id", "path")


@registered(with_(C.SQL_CORPUS) + "SELECT doc_id, status FROM corpus WHERE status IS NULL OR status NOT IN ('draft', 'deprecated')")
def filter_denylist_null_aware(spark, sf_dir):
    return C.documents(spark, sf_dir).where(filters.Filters.of(excluded_statuses=C.EXCLUDED).predicate()).select("doc_id", "status")


@registered(with_(C.SQL_CORPUS) + "SELECT doc_id, type, module FROM corpus WHERE list_has_any(tags, ['fr', 'src3'])")
def filter_tags_any(spark, sf_dir):
    return C.documents(spark, sf_dir).where(filters.Filters.of(tags=("FR", " src3 ", "")).predicate()).select("doc_id", "type", "module")


@registered(with_(C.SQL_CORPUS) + "SELECT type AS value, count(*) AS n FROM corpus WHERE type IS NOT NULL GROUP BY type")
def overview_by_type(spark, sf_dir):
    return reading.counts(C.documents(spark, sf_dir)).where("field = 'type'").select("value", "n")


@registered(with_(C.SQL_CORPUS) + "SELECT module AS value, count(*) AS n FROM corpus WHERE module IS NOT NULL GROUP BY module")
def overview_by_module(spark, sf_dir):
    return reading.counts(C.documents(spark, sf_dir)).where("field = 'module'").select("value", "n")


@registered(
    with_(C.SQL_CORPUS)
    + """SELECT array_to_string((SELECT list(DISTINCT type ORDER BY type) FROM corpus WHERE type IS NOT NULL), ',') AS types,
  array_to_string((SELECT list(DISTINCT module ORDER BY module) FROM corpus WHERE module IS NOT NULL), ',') AS modules,
  array_to_string((SELECT list(DISTINCT t ORDER BY t) FROM (SELECT lower(unnest(tags)) AS t FROM corpus)), ',') AS tags,
  array_to_string((SELECT list(DISTINCT status ORDER BY status) FROM corpus WHERE status IS NOT NULL), ',') AS statuses"""
)
def facets(spark, sf_dir):
    return filters.facets(C.documents(spark, sf_dir)).select(*[F.array_join(c, ",").alias(c) for c in ("types", "modules", "tags", "statuses")])


# ---------------------------------------------------------------- quality
@registered(
    with_(C.SQL_CORPUS, *LEXICAL, C.sql_lexical(150))
    + """SELECT count(*) AS cases, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_k, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr,
  CAST(sum(CASE WHEN rank <= 5 THEN 0 ELSE 1 END) AS BIGINT) AS failures
FROM (SELECT q.doc_id, min(l.rank) AS rank FROM (SELECT doc_id FROM documents WHERE doc_id % 20 = 0) q
      LEFT JOIN lexical l ON l.query_id = q.doc_id AND l.chunk_id = q.doc_id AND l.rank <= 15 GROUP BY q.doc_id)"""
)
def eval_recall_mrr(spark, sf_dir):
    ix = C.index(spark, sf_dir, with_vectors=False)
    asked = C.queries(spark, sf_dir).select("query_id", F.col("text").alias("question"))
    cases = asked.join(ix.documents.select(F.col("doc_id").alias("query_id"), F.col("path").alias("expected")), "query_id")
    s = search.quality(ix, cases, K)["lexical"]
    return s.select("cases", F.round("recall_at_k", 9).alias("recall_at_k"), F.round("mrr", 9).alias("mrr"), "failures")


@registered(
    with_(C.SQL_CORPUS, *LEXICAL, C.sql_lexical(150), C.sql_vector(150), C.SQL_FUSED)
    + """SELECT count(*) AS cases, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 9) AS recall_at_k, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr,
  CAST(sum(CASE WHEN rank <= 5 THEN 0 ELSE 1 END) AS BIGINT) AS failures
FROM (SELECT q.doc_id, min(f.fused_rank) AS rank FROM (SELECT doc_id FROM documents WHERE doc_id % 20 = 0) q
      LEFT JOIN fused f ON f.query_id = q.doc_id AND f.chunk_id = q.doc_id AND f.fused_rank <= 15 GROUP BY q.doc_id)"""
)
def eval_recall_mrr_hybrid(spark, sf_dir):
    ix = C.index(spark, sf_dir)
    asked = C.queries(spark, sf_dir).select("query_id", F.col("text").alias("question"), "embedding")
    cases = asked.join(ix.documents.select(F.col("doc_id").alias("query_id"), F.col("path").alias("expected")), "query_id")
    s = search.quality(ix, cases, K)["hybrid"]
    return s.select("cases", F.round("recall_at_k", 9).alias("recall_at_k"), F.round("mrr", 9).alias("mrr"), "failures")


# ---------------------------------------------------------------- incremental maintenance
def _snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two listings made of the corpus: what is labelled was there before, and what is not toxic is there now; German texts changed."""
    d = C.documents(spark, sf_dir)
    hashed = d.select("doc_id", "path", "type", "status", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    old = hashed.where("status is not null or type <> 'es'")
    new = hashed.where("status is null or status <> 'deprecated'").withColumn("hash", F.when(F.col("type") == "de", F.sha2(F.col("hash").cast("binary"), 256)).otherwise(F.col("hash")))
    return old, new


SQL_SNAPSHOTS = """hashed AS (SELECT doc_id, path, type, status, sha256(text) AS hash FROM corpus),
old AS (SELECT * FROM hashed WHERE status IS NOT NULL OR type <> 'es'),
new AS (SELECT path, CASE WHEN type = 'de' THEN sha256(hash) ELSE hash END AS hash FROM hashed WHERE status IS NULL OR status <> 'deprecated'),
diff AS (
  SELECT coalesce(o.path, n.path) AS path,
         CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'same' ELSE 'changed' END AS state
  FROM old o FULL OUTER JOIN new n ON o.path = n.path)"""


@registered(with_(C.SQL_CORPUS, SQL_SNAPSHOTS) + "SELECT path, state FROM diff")
def sync_diff(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return sync.diff(new, old)


@registered(with_(C.SQL_CORPUS, SQL_SNAPSHOTS) + "SELECT path FROM diff WHERE state = 'deleted' AND NOT (path = 'docs/src2' OR starts_with(path, 'docs/src2/') OR path = 'docs/src3' OR starts_with(path, 'docs/src3/'))")
def sync_delete_protected(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    unreadable = C.documents(spark, sf_dir).where(F.col("module").isin("src2", "src3")).select(F.concat(F.lit("docs/"), "module").alias("path"))
    return sync.deletable(sync.diff(new, old), unreadable)


@registered(with_(C.SQL_CORPUS, SQL_SNAPSHOTS) + "SELECT path, hash FROM old WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT path, hash FROM new")
def snapshot_upsert(spark, sf_dir):
    old, new = _snapshots(spark, sf_dir)
    return upserted(old.select("path", "hash"), new.select("path", "hash"), "path")


@registered(with_(C.SQL_CORPUS, *LEXICAL[:2]) + "SELECT count(*) AS postings, CAST(sum(tf) AS BIGINT) AS tokens FROM postings WHERE chunk_id NOT IN (SELECT doc_id FROM corpus WHERE status = 'deprecated')")
def delete_cascade(spark, sf_dir):
    """Postings that are left when documents go with all that hangs on them."""
    ix = C.index(spark, sf_dir, with_vectors=False)
    gone = ix.documents.where("status = 'deprecated'").select("doc_id")
    stale = ix.chunks.join(gone, "doc_id", "left_semi").select("chunk_id")
    return without(ix.inverted.postings(), stale, "chunk_id").agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))


def _listings(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The listings of `_snapshots` as chunks with metadata: German texts have changed."""
    d = C.documents(spark, sf_dir).select("doc_id", "path", "type", "module", "status", "tags", F.col("doc_id").alias("chunk_id"), F.lit("").alias("heading"), F.col("text").alias("content"))
    old = d.where("status is not null or type <> 'es'")
    new = d.where("status is null or status <> 'deprecated'").withColumn("content", F.when(F.col("type") == "de", F.concat("content", F.lit(" neu gefaßt"))).otherwise(F.col("content")))
    hashed = lambda df: df.withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    return hashed(old), hashed(new)


def _difference(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a pass withdraws, and what it adds."""
    states = sync.diff(new, old)
    of = lambda df, *s: df.join(states.where(F.col("state").isin(*s)).select("path"), "path", "left_semi")
    return of(old, "changed", "deleted"), of(new, "changed", "new")


SQL_LISTED = """listed AS (
  SELECT doc_id, path, type, module, status, tags, CASE WHEN type = 'de' THEN text || ' neu gefaßt' ELSE text END AS content
  FROM corpus WHERE status IS NULL OR status <> 'deprecated')"""


@registered(
    with_(C.SQL_CORPUS, SQL_LISTED, "chunks AS (SELECT doc_id AS chunk_id, doc_id, content FROM listed)", C.SQL_INDEX)
    + "SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tokens FROM postings GROUP BY term"
)
def incremental_postings(spark, sf_dir):
    """Term counts of an index after a pass that withdraws and adds blocks: those of the new listing."""
    old, new = _listings(spark, sf_dir)
    stale, fresh = _difference(old, new)
    parts = max(8, lexical.parts_of(C.table(spark, sf_dir, "documents").count()))
    minus, _ = lexical.withdrawn(stale, parts, 2)
    blocks = lexical.blocks(old, parts, 1).unionByName(lexical.blocks(fresh, parts, 2)).unionByName(minus)
    gone = stale.select(lexical.part_of(F.col("doc_id"), parts).alias("part"), "chunk_id", F.lit(2).cast("long").alias("gen"))
    df = lexical.document_frequency(blocks).where("df > 0")
    tokens = lexical.Inverted(blocks, lexical.totals(new, parts), parts, gone).postings().groupBy("term").agg(F.sum("tf").alias("tokens"))
    return df.join(tokens, "term").select("term", "df", "tokens")


@registered(
    with_(C.SQL_CORPUS, SQL_LISTED)
    + """SELECT 'documents' AS field, '' AS value, count(*) AS n FROM listed HAVING count(*) > 0
UNION ALL SELECT 'type', type, count(*) FROM listed GROUP BY type UNION ALL SELECT 'module', module, count(*) FROM listed GROUP BY module
UNION ALL SELECT 'status', status, count(*) FROM listed WHERE status IS NOT NULL GROUP BY status
UNION ALL SELECT 'tag', t, count(*) FROM (SELECT lower(unnest(tags)) AS t FROM listed) GROUP BY t"""
)
def counts_by_difference(spark, sf_dir):
    """Counts and facets after a pass, from the counts before it and what it withdraws and adds."""
    old, new = _listings(spark, sf_dir)
    stale, fresh = _difference(old, new)
    signed = counted(old).unionByName(counted(fresh)).unionByName(counted(stale, -1))
    return signed.groupBy("field", "value").agg(F.sum("n").alias("n")).where("n <> 0")


@registered(with_(C.SQL_CORPUS, SQL_SNAPSHOTS) + "SELECT o.doc_id AS chunk_id, o.path FROM old o JOIN diff USING (path) WHERE state = 'same' AND o.doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_gaps(spark, sf_dir):
    """Chunks that a pass has to embed besides changed ones: of documents that stay, without a vector."""
    old, new = _snapshots(spark, sf_dir)
    same = sync.diff(new, old).where("state = 'same'").select("path")
    kept = old.select("doc_id", "path").join(same, "path", "left_semi")
    return vector.missing_vectors(C.chunks(spark, sf_dir), C.vectors(spark, sf_dir), kept).select("chunk_id", "path")


@registered(with_(C.SQL_CORPUS) + "SELECT path, starts_with(path, 'docs/src1/') OR starts_with(path, 'docs/src2/') OR doc_id = 20 AS excluded FROM corpus")
def excluded_paths(spark, sf_dir):
    return C.documents(spark, sf_dir).select("path", files.excluded(F.col("path"), ["docs/src1/", "docs/src2", "20.md"]).alias("excluded"))


@registered(with_(C.SQL_CORPUS) + "SELECT doc_id, path FROM corpus")
def normalized_paths(spark, sf_dir):
    """Paths as Windows writes them, brought back."""
    written = F.concat(F.lit(" .\\"), F.translate("path", "/", "\\"), F.lit(" "))
    return C.documents(spark, sf_dir).select("doc_id", evaluate.normalized_path(written).alias("path"))


@registered(with_(C.SQL_CORPUS) + "SELECT path, row_number() OVER (PARTITION BY module ORDER BY coalesce(list_position(['fr', 'de'], type), 0), path) AS rank FROM corpus")
def index_order_ranks(spark, sf_dir):
    """Places in the index file, by module: declared types in their order behind undeclared ones, then paths."""
    order = convention.index_order(convention.Convention("strict", types=("fr", "de")))
    return C.documents(spark, sf_dir).select("path", F.row_number().over(W.partitionBy("module").orderBy(*order)).alias("rank"))


@registered(
    with_(C.SQL_LINE_CHUNKS)
    + """SELECT doc_id, 'LINEA 1' AS section, string_agg(content, chr(10) || chr(10) ORDER BY chunk_id) AS content
FROM chunks WHERE contains('línea ' || (chunk_id % 1000000), 'línea 1') GROUP BY doc_id"""
)
def section_reads(spark, sf_dir):
    """Sections of documents whose lines are headed by their numbers, asked for without case and accent."""
    lines = C.line_chunks(spark, sf_dir).withColumn("heading", F.concat(F.lit("Línea "), F.col("position").cast("string")))
    asked = C.table(spark, sf_dir, "documents").select("doc_id", F.lit("LINEA 1").alias("section"))
    return reading.sections(lines, asked)


@registered(
    with_(C.SQL_CORPUS)
    + """SELECT request_id, n, CASE WHEN n > 0 THEN '' WHEN kt AND km THEN 'combined'
  ELSE 'unknown: ' || array_to_string(list_filter([CASE WHEN NOT kt THEN 'type' END, CASE WHEN NOT km THEN 'module' END], lambda x: x IS NOT NULL), ', ') END AS why
FROM (
  SELECT r.request_id, count(c.doc_id) AS n, r.type IS NULL OR r.type IN (SELECT type FROM corpus) AS kt, r.module IS NULL OR r.module IN (SELECT module FROM corpus) AS km
  FROM (SELECT doc_id AS request_id, CASE doc_id % 3 WHEN 0 THEN upper(type) WHEN 1 THEN type END AS type,
               CASE doc_id % 4 WHEN 0 THEN module || 'x' WHEN 3 THEN NULL ELSE 'src' || (doc_id % 60) END AS module FROM corpus) r
  LEFT JOIN corpus c ON (r.type IS NULL OR c.type = r.type) AND (r.module IS NULL OR c.module = r.module)
  GROUP BY r.request_id, r.type, r.module)"""
)
def empty_result_reasons(spark, sf_dir):
    """Requests of every document's kind, some with values that no document has: what passes, and why nothing does."""
    d, i = C.documents(spark, sf_dir), F.col("doc_id")
    type_ = F.when(i % 3 == 0, F.upper("type")).when(i % 3 == 1, F.col("type"))
    module = F.when(i % 4 == 0, F.concat("module", F.lit("x"))).when(i % 4 != 3, F.concat(F.lit("src"), (i % 60).cast("string")))
    return filters.explained(d.select(i.alias("request_id"), type_.alias("type"), module.alias("module")), d)


@registered("SELECT doc_id, 'passage: ' || source || chr(10) || text AS passage FROM documents")
def embedding_passages(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").select("doc_id", vector.passage("source", "text").alias("passage"))


@registered("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))


# ---------------------------------------------------------------- text
@registered(
    with_(C.SQL_CORPUS)
    + """SELECT target, path, rank FROM (
  SELECT target, path, row_number() OVER (PARTITION BY target ORDER BY levenshtein(target, path) / greatest(length(target), length(path), 1), path) AS rank
  FROM (SELECT 'doc/' || module || '-' || doc_id AS target FROM corpus WHERE doc_id % 20 = 0) CROSS JOIN corpus) WHERE rank <= 3"""
)
def closest_paths(spark, sf_dir):
    d = C.documents(spark, sf_dir)
    wanted = d.where(F.col("doc_id") % C.QUERY_EVERY == 0).select(F.concat(F.lit("doc/"), "module", F.lit("-"), F.col("doc_id").cast("string")).alias("target"))
    return similar.nearest(wanted, d, 3).select("target", "path", "rank")


#: Folded: lower case, no diacritics.  Edits are counted in bytes there, so what is left beyond ASCII becomes one byte.
SQL_OPENINGS = r"""openings AS (SELECT doc_id, substr(text, 1, 40) AS opening FROM documents),
folds AS (SELECT DISTINCT opening, translate(regexp_replace(lower(strip_accents(opening)), '[\^`¨´]', '', 'g'), 'ßøæœđł', chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6)) AS folded FROM openings)"""


@registered(
    with_(SQL_OPENINGS)
    + """SELECT target, opening, rank, distance FROM (
  SELECT t.opening AS target, c.opening, levenshtein(t.folded, c.folded) / greatest(length(t.folded), length(c.opening), 1) AS distance,
         row_number() OVER (PARTITION BY t.opening ORDER BY levenshtein(t.folded, c.folded) / greatest(length(t.folded), length(c.opening), 1), c.opening) AS rank
  FROM (SELECT * FROM folds WHERE opening IN (SELECT opening FROM openings WHERE doc_id % 20 = 0)) t CROSS JOIN folds c) WHERE rank <= 3"""
)
def closest_openings(spark, sf_dir):
    """The documents that begin most like a query's: strings in four languages, compared without case and diacritics."""
    d = C.table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 40).alias("path"))
    found = similar.nearest(d.where(F.col("doc_id") % C.QUERY_EVERY == 0).select(F.col("path").alias("target")), d, 3)
    return found.select("target", F.col("path").alias("opening"), "rank", "distance")


@registered("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@registered(r"SELECT item_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS term FROM benchmark")
def query_terms(spark, sf_dir):
    return C.table(spark, sf_dir, "benchmark").select("item_id", F.explode(X.query_terms(F.col("text"))).alias("term"))


@registered(with_(*LEXICAL[:2]) + "SELECT term, df FROM frequency")
def term_document_frequency(spark, sf_dir):
    return lexical.document_frequency(lexical.postings(C.chunks(spark, sf_dir)))


@registered("SELECT doc_id, upper(source[1]) || source[2:] || ' ' || doc_id || ' notes' AS title FROM documents")
def humanize_title(spark, sf_dir):
    path = F.concat(F.lit("a/b/"), "source", F.lit("_-"), F.col("doc_id").cast("string"), F.lit("--notes.md"))
    return C.table(spark, sf_dir, "documents").select("doc_id", X.humanized(path).alias("title"))


@registered("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS module FROM documents")
def infer_module(spark, sf_dir):
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("docs/"), "source", F.lit(".md"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("docs/"), "source", F.lit("/x.md"))).otherwise(F.concat("source", F.lit("/y/x.md")))
    return C.table(spark, sf_dir, "documents").select("doc_id", X.module_of(path, ("docs",)).alias("module"))


SQL_CONDENSED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@registered(f"SELECT doc_id, CASE WHEN length({SQL_CONDENSED}) <= 140 THEN {SQL_CONDENSED} ELSE substr({SQL_CONDENSED}, 1, 139) || '…' END AS summary FROM documents")
def condense_summary(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").select("doc_id", X.condense(F.col("text")).alias("summary"))


SQL_LINE = f"""'- ' || coalesce('[' || type || '] ', '') || path || ' — ' || CASE WHEN length({SQL_CONDENSED}) <= 140 THEN {SQL_CONDENSED} ELSE substr({SQL_CONDENSED}, 1, 139) || '…' END || coalesce(' (' || status || ')', '')"""


@registered(with_(C.SQL_CORPUS) + f"SELECT path, type, {SQL_LINE} AS line FROM corpus")
def doc_line(spark, sf_dir):
    return reading.lines(C.documents(spark, sf_dir))


@registered(with_(C.SQL_CORPUS) + f"SELECT type, string_agg({SQL_LINE}, chr(10) ORDER BY doc_id) AS body FROM corpus GROUP BY type")
def index_md(spark, sf_dir):
    """Index lines of a type, joined in the order of ids."""
    d = C.documents(spark, sf_dir)
    lines = reading.lines(d).join(d.select("path", "doc_id"), "path")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "line"))), lambda s: s["line"])  # a report: one text a type
    return lines.groupBy("type").agg(F.array_join(ordered, "\n").alias("body"))


STRICT = convention.Convention("strict", types=("en", "fr"), statuses=("current", "draft"))


@registered(
    with_(C.SQL_CORPUS)
    + """SELECT doc_id, array_to_string(list_filter([
  CASE WHEN type NOT IN ('en', 'fr') THEN 'type: ' || type || ' is none of en, fr' END,
  CASE WHEN module = 'src1' THEN 'module: no value' END,
  CASE WHEN status IS NULL THEN 'status: no value' WHEN status NOT IN ('current', 'draft') THEN 'status: ' || status || ' is none of current, draft' END,
  CASE WHEN module = 'src2' THEN 'title: no heading of the first level' END,
  CASE WHEN module = 'src3' THEN 'tags: not a list of texts' END], lambda x: x IS NOT NULL), '; ') AS errors FROM corpus"""
)
def strict_validation_errors(spark, sf_dir):
    d = C.documents(spark, sf_dir)
    fields = F.map_from_arrays(F.array(*map(F.lit, ("type", "module", "status"))), F.array("type", F.when(F.col("module") == "src1", " ").otherwise(F.col("module")), "status"))
    title = F.when(F.col("module") == "src2", "").otherwise(F.col("title"))
    parsed = d.select("doc_id", "path", title.alias("title"), "summary", fields.alias("fields"), "tags", (F.col("module") != "src3").alias("tags_ok"))
    return convention.resolved(parsed, STRICT).select("doc_id", F.array_join("errors", "; ").alias("errors"))


@registered("SELECT doc_id, array_to_string([lower(lang), source], ',') AS tags FROM documents")
def normalize_tags(spark, sf_dir):
    raw = F.array(F.concat(F.lit(" "), F.upper("lang")), F.lit("  "), F.concat("source", F.lit(" ")))
    return C.table(spark, sf_dir, "documents").select("doc_id", F.array_join(convention.normalized_tags(raw), ",").alias("tags"))


@registered(with_(C.SQL_CORPUS) + "SELECT doc_id, '---' || coalesce(chr(10) || 'type: ' || type, '') || coalesce(chr(10) || 'module: ' || module, '') || coalesce(chr(10) || 'status: ' || status, '') || chr(10) || 'tags: [' || type || ', ' || module || ']' || chr(10) || '---' AS block FROM corpus")
def frontmatter_block(spark, sf_dir):
    none = F.lit(None).cast("string")
    return C.documents(spark, sf_dir).select("doc_id", reading.frontmatter(F.col("type"), F.col("module"), F.col("status"), none, F.col("tags"), none).alias("block"))


@registered("SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) AS content FROM documents")
def read_documents(spark, sf_dir):
    """Whole documents put together from their chunks."""
    return reading.whole_text(C.line_chunks(spark, sf_dir), C.documents(spark, sf_dir))


# ---------------------------------------------------------------- splitting and windows
ROOM = 1920  # units that 480 tokens allow


def sql_packed(units: str, glue: str) -> str:
    """A fold over a list of texts: neighbours joined while they fit, too large ones left as they are and marked."""
    flushed = "CASE WHEN acc.size > 0 THEN list_append(acc.done, {'t': acc.held, 'big': false}) ELSE acc.done END"
    wider = f"CASE WHEN acc.size > 0 THEN acc.size + length({glue}) + x.size ELSE x.size END"
    start = "{'done': CAST([] AS STRUCT(t VARCHAR, big BOOLEAN)[]), 'held': '', 'size': 0}"
    unit = "{'done': CAST([] AS STRUCT(t VARCHAR, big BOOLEAN)[]), 'held': u, 'size': CAST(length(u) AS INTEGER)}"
    step = f"""lambda acc, x: CASE
      WHEN {wider} <= {ROOM} THEN {{'done': acc.done, 'held': CASE WHEN acc.size > 0 THEN acc.held || {glue} || x.held ELSE x.held END, 'size': CAST({wider} AS INTEGER)}}
      WHEN x.size <= {ROOM} THEN {{'done': {flushed}, 'held': x.held, 'size': x.size}}
      ELSE {{'done': list_append({flushed}, {{'t': x.held, 'big': true}}), 'held': '', 'size': 0}} END"""
    return f"list_reduce(list_prepend({start}, list_transform({units}, lambda u: {unit})), {step})"


def sql_level(name: str, of: str, units: str, glue: str) -> str:
    """Texts of ``of`` (doc_id, path, t, big) that are too large, cut into units and packed; the others as they are."""
    return f"""{name}_folded AS (SELECT doc_id, path, {sql_packed(units, glue)} AS f FROM {of} WHERE big),
{name}_listed AS (SELECT doc_id, path, CASE WHEN f.size > 0 THEN list_append(f.done, {{'t': f.held, 'big': false}}) ELSE f.done END AS l FROM {name}_folded),
{name} AS (
  SELECT doc_id, path, t, big FROM {of} WHERE NOT big
  UNION ALL SELECT doc_id, list_append(path, i), l[i].t, l[i].big FROM (SELECT doc_id, path, l, unnest(range(1, len(l) + 1)) AS i FROM {name}_listed))"""


#: A word that is no sentence's end (fixed values), or a single letter, before the stop.
SQL_ABBREVIATED = r"""'(?i)(^|[^\p{L}])(\p{L}|sr|sra|srta|dr|dra|ud|uds|art|núm|pág|cap|fig|tab|ej|p|etc|vs)\s*[.!?…]+["''»)]?$'"""
SQL_MARKED = r"""string_split(regexp_replace(t, '([.!?…]+["''»)]?)(\s+)([\p{Lu}¿¡])', '\1' || chr(1) || '\2' || chr(1) || '\3', 'g'), chr(1))"""
SQL_SENTENCES = f"""list_filter(list_transform([list_reduce(
    list_transform(range(0, len({SQL_MARKED}) // 2 + 1), lambda k: {{'done': CAST([] AS VARCHAR[]), 'sep': CASE WHEN k = 0 THEN '' ELSE {SQL_MARKED}[2 * k] END, 'cur': {SQL_MARKED}[2 * k + 1]}}),
    lambda acc, x: CASE WHEN regexp_matches(acc.cur, {SQL_ABBREVIATED}) THEN {{'done': acc.done, 'sep': '', 'cur': acc.cur || x.sep || x.cur}}
                        ELSE {{'done': list_append(acc.done, acc.cur), 'sep': '', 'cur': x.cur}} END)], lambda f: list_append(f.done, f.cur))[1], lambda x: x <> '')"""

SQL_STRETCHES = r"""list_filter(string_split_regex(array_to_string(list_transform(string_split(t, chr(10)),
    lambda l: CASE WHEN regexp_matches(l, '^\s*$') THEN chr(1) ELSE l END), chr(10)), '\n?\x01(\n\x01)*\n?'), lambda b: b <> '')"""

SQL_SPLIT = with_(
    f"whole AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, coalesce(text, '') AS t, length(coalesce(text, '')) > {ROOM} AS big FROM documents)",
    sql_level("by_block", "whole", SQL_STRETCHES, "chr(10) || chr(10)"),
    sql_level("by_line", "by_block", "string_split(t, chr(10))", "chr(10)"),
    sql_level("by_sentence", "by_line", SQL_SENTENCES, "' '"),
    sql_level("by_word", "by_sentence", r"regexp_extract_all(t, '\S+')", "' '"),
    f"""pieces AS (
  SELECT doc_id, path, t FROM by_word WHERE NOT big
  UNION ALL SELECT doc_id, list_append(path, i), substr(t, i * {ROOM} + 1, {ROOM}) FROM (SELECT *, unnest(range(0, CAST(ceil(length(t) / {ROOM}.0) AS BIGINT))) AS i FROM by_word WHERE big))""",
)


@registered(SQL_SPLIT + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS position, t AS content FROM pieces")
def chunk_documents(spark, sf_dir):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parts(text: pd.Series) -> pd.Series:
        return pd.Series([split_to_bound(t or "", 480) for t in text])

    return C.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts("text")).alias("position", "content"))


@registered()
def excerpts_of_results(spark, sf_dir):
    ix = C.index(spark, sf_dir)
    return search.search(ix, C.queries(spark, sf_dir), filters.Filters(), K)


@registered()
def match_centre(spark, sf_dir):
    """Where in a document the window of 120 lies that says most about the document's own terms."""

    def of(text: str | None) -> int | None:
        terms = Counter(units(x) for x in tokenize_query(text or ""))
        return best_centre(located(units(text or ""), list(terms)), 120, terms)

    @F.arrow_udf("int")
    def centre(text: pa.Array) -> pa.Array:
        return X.mapped(of, pa.int32(), text)

    return C.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), centre("text").alias("centre"))


@registered()
def lead_excerpts(spark, sf_dir):
    d = C.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("query_id"), excerpts(F.col("text"), F.col("text"), F.lit(1)).alias("excerpt"))


@registered(
    r"""SELECT doc_id, 'Doc ' || doc_id AS title, words || chr(10) || 'and so on.' AS summary, 'Part ' || lang || '|Deep ' || source AS sections, 'Below ' || doc_id AS below
FROM (SELECT *, array_to_string(regexp_extract_all(text, '\p{L}+')[1:12], ' ') AS words FROM documents)"""
)
def document_outlines(spark, sf_dir):
    """Outlines of documents put into quotes, lists, markup, fences, ATX and setext headings: what of them is title, summary and sections."""

    @F.pandas_udf("title string, summary string, sections string, below string")
    def outlined(body: pd.Series) -> pd.DataFrame:
        trees = [outline(b) for b in body]
        below = ["|".join(c.title for s in t.sections for c in s.children) for t in trees]
        return pd.DataFrame({"title": [t.title for t in trees], "summary": [t.summary for t in trees], "sections": ["|".join(s.title for s in t.sections) for t in trees], "below": below})

    number = F.col("doc_id").cast("string")
    words = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("\\p{L}+"), F.lit(0)), 1, 12), " ")
    body = F.concat(
        F.lit("<!-- # no\n\n## no -->\n# Doc "), number, F.lit("\n\n> ## Quoted\n> "), words, F.lit("\nlazily\n\n<div>\n## Markup\n\n"), words, F.lit("\nand so on.\n\n## Part "), "lang",
        F.lit("\n\n- item\n  ## No\n\n  "), words, F.lit("\n\n### Below "), number, F.lit(" ###\n\n```\n## No\n```\n\nDeep "), "source", F.lit("\n---\n"), words, F.lit("\n"),
    )
    return C.table(spark, sf_dir, "documents").select("doc_id", outlined(body).alias("o")).select("doc_id", "o.*")


#: Markdown flattened; fences aside, which the tables do not hold.
SQL_FLAT = r"""flat AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*#{1,6}\s')), ' '),
  '[`*_>|]', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS flat FROM documents)"""


@registered(with_(SQL_FLAT) + "SELECT doc_id, flat FROM flat")
def flatten_markdown(spark, sf_dir):
    @F.pandas_udf("string")
    def flat(text: pd.Series) -> pd.Series:
        return pd.Series([flatten(t or "", traced=False).text for t in text])

    return C.table(spark, sf_dir, "documents").select("doc_id", flat("text").alias("flat"))


@registered(
    with_(SQL_FLAT, "cut AS (SELECT doc_id, flat, substr(flat, 1, 120) AS head, 121 - instr(reverse(substr(flat, 1, 120)), ' ') AS blank FROM flat)")
    + """SELECT doc_id, CASE WHEN length(flat) <= 120 THEN flat WHEN contains(head, ' ') AND blank - 1 > 60 THEN substr(head, 1, blank - 1) || '…' ELSE head || '…' END AS excerpt FROM cut"""
)
def support_excerpts(spark, sf_dir):
    """How a result that is not the lead one begins, of every document."""
    d = C.table(spark, sf_dir, "documents")
    return d.select("doc_id", excerpts(F.col("text"), F.lit("unused"), F.lit(2)).alias("excerpt"))


SQL_CUT = """cut AS (
  SELECT doc_id, CASE WHEN length(flat) <= 120 THEN flat WHEN contains(head, ' ') AND blank - 1 > 60 THEN substr(head, 1, blank - 1) || '…' ELSE head || '…' END AS excerpt
  FROM (SELECT doc_id, flat, substr(flat, 1, 120) AS head, 121 - instr(reverse(substr(flat, 1, 120)), ' ') AS blank FROM flat))"""


@registered(
    with_(C.SQL_CORPUS, *LEXICAL, C.sql_lexical(50), C.sql_vector(50), C.SQL_FUSED, SQL_FLAT, SQL_CUT)
    + """SELECT f.query_id, f.fused_rank AS rank, c.path, c.title, c.status, excerpt, round(f.score, 4) AS score
FROM fused f JOIN corpus c ON f.chunk_id = c.doc_id JOIN cut ON cut.doc_id = c.doc_id WHERE f.fused_rank BETWEEN 2 AND 5"""
)
def supporting_results(spark, sf_dir):
    """The whole search, excerpts included, of the results behind each query's first one."""
    found = search.search(C.index(spark, sf_dir), C.queries(spark, sf_dir), filters.Filters(), K)
    return found.where("rank > 1").select("query_id", "rank", "path", "title", "status", "excerpt", "score")


@registered(r"SELECT doc_id, array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: length(x) > 0), lambda x: trim(x)), '|') AS headings FROM documents")
def headings(spark, sf_dir):
    """Headings of texts whose every line is made one."""
    marked = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("## "), x)), "\n")
    return C.table(spark, sf_dir, "documents").select("doc_id", F.array_join(reading.headings(marked), "|").alias("headings"))


@registered(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'windows-1252' END AS encoding,
  CASE doc_id % 3 WHEN 0 THEN 'undecodable byte 0x81 at offset ' || (length(text) + 1) WHEN 1 THEN 'undecodable byte 0x07 at offset ' || (length(text) + 1) END AS error FROM documents"""
)
def rejected_bytes(spark, sf_dir):
    """Windows-1252 texts that end in a byte which no such text holds, two in three: which byte, and where."""
    latin = F.encode(F.translate("text", CP1252_CHARS, "?" * len(CP1252_CHARS)), "ISO-8859-1")
    last = F.when(F.col("doc_id") % 3 == 0, F.lit(b"\xe9\x81")).when(F.col("doc_id") % 3 == 1, F.lit(b"\xe9\x07")).otherwise(F.lit(b"\xe9A"))
    return C.table(spark, sf_dir, "documents").select("doc_id", decoded(F.concat(latin, last)).alias("d")).select("doc_id", "d.encoding", "d.error")


@registered("SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'utf-16le' WHEN doc_id % 3 = 1 THEN 'utf-8' WHEN strip_accents(text) = text AND NOT contains(text, 'ß') THEN 'utf-8' ELSE 'windows-1252' END AS encoding FROM documents")
def decode_bytes(spark, sf_dir):
    """Texts written as UTF-16, UTF-8 and Windows-1252 by turns, and decoded."""
    latin = F.encode(F.translate("text", CP1252_CHARS, "?" * len(CP1252_CHARS)), "ISO-8859-1")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"\xff\xfe"), F.encode("text", "UTF-16LE"))).when(F.col("doc_id") % 3 == 1, F.col("text").cast("binary")).otherwise(latin)
    return C.table(spark, sf_dir, "documents").select("doc_id", decoded(raw).alias("d")).select("doc_id", "d.text", "d.encoding")
