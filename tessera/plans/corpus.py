"""The driver's tables seen as a document corpus, in DataFrames and in SQL.

A row of ``documents`` is a document of one chunk; labels give its status, ``embeddings`` its vector.  Searches take as
queries every document whose id is divisible by 20: its whole text, and its vector where it has one.  They run over an
index that is stored once a table and application, under the warehouse.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.operators.filters import Filters
from tessera.plans.search import Index

EXCLUDED = ("draft", "deprecated")
QUERY_EVERY = 20

#: Stored tables of this process: (application, state of the table they are made of, name) -> path.
_STORED: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    status = F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 1, "current").when(F.col("quality") == 0, "draft")
    d = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    return d.select(
        "doc_id",
        F.concat(F.lit("docs/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("summary"),
        F.col("lang").alias("type"),
        F.col("source").alias("module"),
        status.alias("status"),
        F.array("lang", "source").alias("tags"),
        "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.lit("").alias("heading"), F.col("text").alias("content"), F.lit(0).alias("position"))


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk a line, for what concerns several chunks of a document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("position", "content"))
    return lines.select((F.col("doc_id") * 1_000_000 + F.col("position")).alias("chunk_id"), "doc_id", F.lit("").alias("heading"), "content", "position")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return own.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, text, embedding (null where the document has none)."""
    d = table(spark, sf_dir, "documents").where(F.col("doc_id") % QUERY_EVERY == 0)
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return d.select(F.col("doc_id").alias("query_id"), "text").join(v, "query_id", "left")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, embedding: every vector whose id is divisible by 20, with or without a document."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def state(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A table's files with their sizes and times, hashed: what is stored of it holds as long as these do."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    told = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, state(spark, sf_dir, "documents"), name)
    if key not in _STORED:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera-index/{uuid.uuid4().hex}/{name}"
        build().write.parquet(path)
        _STORED[key] = path
        spark._jvm.System.gc()  # shuffles of what is stored now go when the driver's JVM collects garbage
    return spark.read.parquet(_STORED[key])


def index(spark: SparkSession, sf_dir: str, by_line: bool = False, with_vectors: bool = True) -> Index:
    own, kind = (line_chunks(spark, sf_dir), "lines") if by_line else (chunks(spark, sf_dir), "documents")
    n_chunks = own.count()  # no text is taken apart for it but into lines
    parts = lexical.parts_of(n_chunks)
    blocks = stored(spark, sf_dir, f"{kind}-blocks", lambda: lexical.blocks(own, parts).sortWithinPartitions("part", "term"))
    totals = stored(spark, sf_dir, f"{kind}-totals", lambda: lexical.totals_of(blocks, n_chunks))
    return Index(documents(spark, sf_dir), own, lexical.Inverted(blocks, totals, parts), vectors(spark, sf_dir) if with_vectors else None)


#: Of the filtered searches.
SEARCH_FILTERS = Filters(type="en", excluded_statuses=EXCLUDED)

# ---------------------------------------------------------------- the same in SQL
SQL_CORPUS = """corpus AS (
  SELECT d.doc_id, 'docs/' || source || '/' || d.doc_id || '.md' AS path, 'Document ' || d.doc_id AS title, text AS summary,
         lang AS type, source AS module,
         CASE WHEN toxic = 1 THEN 'deprecated' WHEN quality = 1 THEN 'current' WHEN quality = 0 THEN 'draft' END AS status,
         [lang, source] AS tags, text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

SQL_ALLOWED = "allowed AS (SELECT doc_id AS chunk_id FROM corpus WHERE type = 'en' AND (status IS NULL OR status NOT IN ('draft', 'deprecated')))"

SQL_CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, doc_id, text AS content FROM documents)"
SQL_LINE_CHUNKS = """chunks AS (
  SELECT doc_id * 1000000 + pos AS chunk_id, doc_id, content FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents))"""

SQL_INDEX = r"""tokens AS (
  SELECT chunk_id, unnest(regexp_extract_all(lower(strip_accents(content)), '[\p{L}\p{N}]+')) AS term FROM chunks),
postings AS (SELECT term, chunk_id, count(*) AS tf FROM tokens GROUP BY term, chunk_id),
lengths AS (
  SELECT chunk_id, len(regexp_extract_all(lower(strip_accents(content)), '[\p{L}\p{N}]+')) AS n_tokens FROM chunks),
frequency AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
stats AS (SELECT count(*) AS n, avg(n_tokens) AS average FROM lengths)"""

SQL_WANTED = r"""wanted AS (
  SELECT query_id, lower(strip_accents(term)) AS term, count(*) AS times FROM (
    SELECT doc_id AS query_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS term FROM documents WHERE doc_id % 20 = 0)
  GROUP BY query_id, lower(strip_accents(term)))"""

#: A term's contribution is a whole number of units of 1e-8, so that sums do not depend on their order.
SQL_SCORED = """scored AS (
  SELECT query_id, chunk_id, CAST(sum(times * CAST(round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
                                 * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_tokens / average)) * 100000000) AS BIGINT)) AS BIGINT) AS units, units / 1e8 AS score
  FROM wanted JOIN postings USING (term) JOIN frequency USING (term) JOIN lengths USING (chunk_id) CROSS JOIN stats
  GROUP BY query_id, chunk_id)"""


def sql_lexical(limit: int, where: str = "true", name: str = "lexical") -> str:
    return f"""{name} AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY units DESC, chunk_id) AS rank FROM scored WHERE {where})
  WHERE rank <= {limit})"""


def sql_vector(limit: int, where: str = "true", name: str = "vector", of_documents: bool = True) -> str:
    """Four times the limit first, then the filter, then the limit; vectors of documents, or all."""
    own = "vec_id IN (SELECT doc_id FROM documents)" if of_documents else "true"
    return f"""{name}_all AS (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS distance
  FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0 AND {own}) q
  CROSS JOIN (SELECT * FROM embeddings WHERE {own}) v),
{name}_near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 10), chunk_id) AS near FROM {name}_all) WHERE near <= {4 * limit}),
{name} AS (
  SELECT query_id, chunk_id, distance, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 10), chunk_id) AS rank FROM {name}_near WHERE {where})
  WHERE rank <= {limit})"""


SQL_FUSED = """merged AS (
  SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min(rank) AS best,
         min(CASE WHEN leg = 0 THEN rank END) AS lexical_rank, min(CASE WHEN leg = 1 THEN rank END) AS vector_rank
  FROM (SELECT query_id, chunk_id, rank, 0 AS leg FROM lexical UNION ALL SELECT query_id, chunk_id, rank, 1 FROM vector)
  GROUP BY query_id, chunk_id),
fused AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, best, lexical_rank NULLS LAST, vector_rank NULLS LAST, chunk_id) AS fused_rank
  FROM merged)"""
