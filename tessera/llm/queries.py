"""The queries op1 to op13 and pipeline: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm import chat, conversation_repair, decontaminate, filter_audit, line_dedup, lm, near_dedup, packing, pipeline, quality_model, quality_rules, suffix_dedup, toxicity, warc


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(C.read_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "labels"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(C.read_table(spark, sf_dir, "conversations"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(C.read_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(C.read_table(spark, sf_dir, "documents"), ("doc_id",))
    return out.select("row.doc_id", *quality_rules.COUNTS, "base_failed", "kept", "posterior", "votes")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(C.read_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(C.read_table(spark, sf_dir, "documents"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_deleted", "text")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(C.read_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.convert_pages(C.read_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audit(C.read_table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "labels"))


OP9_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
worded AS (
  SELECT doc_id, pos, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seq,
         lead(x) OVER (PARTITION BY doc_id ORDER BY pos) AS nx
  FROM lines WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
ranked AS (
  SELECT doc_id, pos, seq, words, nx,
         row_number() OVER (PARTITION BY x ORDER BY doc_id, seq) AS one,
         row_number() OVER (PARTITION BY x, nx ORDER BY doc_id, seq) AS two
  FROM worded),
cut AS (
  SELECT doc_id, seq FROM ranked WHERE words >= 50 AND one > 1
  UNION SELECT doc_id, seq FROM ranked WHERE nx IS NOT NULL AND two > 1
  UNION SELECT doc_id, seq + 1 FROM ranked WHERE nx IS NOT NULL AND two > 1),
gone AS (SELECT w.doc_id, w.pos FROM worded w JOIN cut c ON w.doc_id = c.doc_id AND w.seq = c.seq),
kept AS (
  SELECT l.doc_id, string_agg(l.x, chr(10) ORDER BY l.pos) AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(w.n, 0) AS n_lines, coalesce(g.n, 0) AS n_deleted, coalesce(k.text, '') AS text
FROM documents d
LEFT JOIN kept k ON d.doc_id = k.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM worded GROUP BY doc_id) w ON d.doc_id = w.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id
"""

#: A vector of four numbers is four texts: nine digits of cost, then the edits; the least text is the least cost, then the least edits.
_MORE = "printf('%09d', CAST(left({0}, 9) AS INTEGER) + {1}) || substr({0}, 10) || '{2}'".format


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


OP11_SQL = rf"""
WITH RECURSIVE bits AS (
  SELECT range AS n, range AS v, 0 AS i FROM range(256)
  UNION ALL SELECT n, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8),
crc_table AS (SELECT list(v ORDER BY n) AS t FROM bits WHERE i = 8),
named AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
dealt AS (
  SELECT n.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS BIGINT))),
                              lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS crc
  FROM named n CROSS JOIN crc_table),
damaged AS (
  SELECT k, turn, CASE WHEN crc = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN crc = 1 THEN '' WHEN crc = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt CROSS JOIN range(2) c(copy) WHERE crc <> 0 AND (copy = 0 OR crc = 3)),
ordered AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
         row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text)) AS pos FROM damaged),
faulty AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY k ORDER BY pos) || initial AS pair FROM ordered),
counts AS (
  SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY k),
ways AS (
  SELECT k, 0 AS done, '000000000' AS q0, CAST(NULL AS VARCHAR) AS q1, CAST(NULL AS VARCHAR) AS q2, CAST(NULL AS VARCHAR) AS q3 FROM counts
  UNION ALL
  SELECT k, done + 1, {_MORE("y0", 2, "D")},
         {_least(_MORE("y1", 2, "D"), f"CASE WHEN stays AND initial = 's' THEN {_MORE('y0', 'late', 'K')} END")},
         {_least(_MORE("y2", 2, "D"), *(f"CASE WHEN stays AND initial = 'u' THEN {_MORE(y, 'late', 'K')} END" for y in ("y0", "y1", "y3")), *(f"CASE WHEN stays THEN {_MORE(y, 'late + 1', 'R')} END" for y in ("y0", "y1", "y3")))},
         {_least(_MORE("y3", 2, "D"), f"CASE WHEN stays AND initial = 'a' THEN {_MORE('y2', 'late', 'K')} END", f"CASE WHEN stays THEN {_MORE('y2', 'late + 1', 'R')} END")}
  FROM (
    SELECT w.k, done, initial, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late, q0 AS y0, q1 AS y1,
           {_least("q2", *(_MORE(q, 5, "I") for q in ("q0", "q1", "q3")))} AS y2, {_least("q3", _MORE("q2", 5, "I"), _MORE("q0", 10, "II"), _MORE("q1", 10, "II"))} AS y3
    FROM ways w JOIN faulty f ON f.k = w.k AND f.pos = w.done + 1)),
best AS (
  SELECT k, {_least("q0", "q3", _MORE("q2", 5, "I"), _MORE("q1", 10, "II"))} AS way FROM ways JOIN counts USING (k) WHERE done = n),
edits AS (
  SELECT k, unnest(string_split(substr(way, 10), '')) AS edit, unnest(range(len(way) - 9)) AS nth FROM best WHERE len(way) > 9),
placed AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER (PARTITION BY k ORDER BY nth) AS pos FROM edits),
kept AS (
  SELECT p.k, p.nth, edit, role, text, count(*) FILTER (WHERE edit <> 'K' OR initial <> 's') OVER (PARTITION BY p.k ORDER BY nth) % 2 AS odd
  FROM placed p LEFT JOIN faulty f ON f.k = p.k AND f.pos = p.pos AND edit <> 'I' WHERE edit <> 'D'),
repaired AS (
  SELECT k, string_agg(CASE WHEN edit = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY nth) AS body
  FROM kept GROUP BY k)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(left(way, 9) AS BIGINT), 0) AS cost, coalesce(substr(way, 10), '') AS audit,
       sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, k FROM named) c LEFT JOIN counts USING (k) LEFT JOIN best USING (k) LEFT JOIN repaired USING (k)
"""

OP12_SQL = r"""
WITH said AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^ 	-
]+') AS w FROM texts),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN words.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM words LEFT JOIN said USING (doc_id)),
sets AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT part, filter_order, step, filter_order[step] AS filter, left(filter_order, step - 1) AS earlier
          FROM (SELECT DISTINCT part FROM sets) CROSS JOIN orders CROSS JOIN range(1, 6) s(step)),
judged AS (
  SELECT s.part, filter_order, step, filter, n, good, toxic, contains(fails, filter) AS own,
         length(translate(fails, earlier, '')) < length(fails) AS gone, fails = filter AS alone
  FROM steps s JOIN sets USING (part)),
told AS (
  SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT own), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND own), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND own), 0) AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND own), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND own), 0) AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM told
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_suffix_array_dedup,
        op2_quality_classifier,
        op3_chat_formatting,
        op4_best_fit_packing,
        op5_quality_rules,
        op6_minhash_near_dedup,
        op7_line_dedup,
        op8_lm_scoring,
        op9_warc,
        op10_benchmark_decontamination,
        op11_conversation_repair,
        op12_filter_audit,
        op13_toxicity,
    )
    return {f.__name__: f for f in own} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": OP7_SQL, "op9_warc": OP9_SQL, "op11_conversation_repair": OP11_SQL, "op12_filter_audit": OP12_SQL}
