"""The best window of a text against SQL that enumerates every place of every term: too slow for whole tables, so over a fixture."""

import random

import duckdb
from tessera.plans.catalog import queries, with_

#: Places of a text's own terms, counted from 0 over folded text, and the windows of 120 that end with each of them.
SQL_CENTRES = with_(
    r"folds AS (SELECT doc_id, lower(strip_accents(text)) AS f, regexp_extract_all(text, '[\p{L}\p{N}]+') AS own FROM documents)",
    "terms AS (SELECT doc_id, term, lower(strip_accents(term)) AS low, count(*) AS times FROM (SELECT doc_id, unnest(own) AS term FROM folds) GROUP BY ALL)",
    "sizes AS (SELECT doc_id, length(low) AS n, max(length(low)) OVER (PARTITION BY doc_id) AS most FROM terms GROUP BY doc_id, length(low))",
    # a stretch of 200 places and what the longest term needs beyond, so that no place is sought from the text's beginning
    "stretches AS (SELECT f.doc_id, b, substr(f, b * 200 + 1, 200 + most) AS s FROM (SELECT *, unnest(range(0, length(f) // 200 + 1)) AS b FROM folds) f JOIN (SELECT DISTINCT doc_id, most FROM sizes) USING (doc_id))",
    "places AS (SELECT doc_id, b * 200 + p - 1 AS a, substr(s, p, most) AS s FROM (SELECT *, unnest(range(1, least(length(s), 200) + 1)) AS p FROM stretches) JOIN (SELECT DISTINCT doc_id, most FROM sizes) USING (doc_id))",
    "parts AS MATERIALIZED (SELECT doc_id, a, n, left(s, n) AS low FROM places JOIN sizes USING (doc_id) WHERE length(s) >= n)",
    "spans AS MATERIALIZED (SELECT p.doc_id, a, a + n AS b, term, times FROM parts p JOIN terms t ON t.doc_id = p.doc_id AND t.low = p.low)",
    """numbered AS (
  SELECT *, row_number() OVER w - 1 AS i, max(b) OVER w - 120 AS least, count(*) OVER (PARTITION BY doc_id, term) * times AS worth FROM spans
  WINDOW w AS (PARTITION BY doc_id ORDER BY a, b, term ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "begins AS (SELECT doc_id, a, max(i) + 1 AS next FROM numbered GROUP BY doc_id, a)",
    "worths AS (SELECT doc_id, sum(worth) AS total FROM (SELECT DISTINCT doc_id, term, worth FROM numbered) GROUP BY doc_id)",
    """windowed AS (
  SELECT n.*, least(coalesce(g.next, 0), n.i) AS first, ln(1 + total / worth) AS weight, lead(n.i) OVER (PARTITION BY n.doc_id, term ORDER BY n.i) AS again
  FROM (SELECT * FROM numbered JOIN worths USING (doc_id)) n ASOF LEFT JOIN begins g ON g.doc_id = n.doc_id AND g.a < n.least)""",
    "falls AS (SELECT doc_id, first - 1 AS last, min(i) AS spot FROM windowed GROUP BY doc_id, first)",
    """held AS (
  SELECT w.doc_id, w.i, least(coalesce(w.again, 9223372036854775807), coalesce(f.spot, 9223372036854775807)) AS until, w.weight, length(term) AS size
  FROM windowed w ASOF LEFT JOIN falls f ON f.doc_id = w.doc_id AND f.last >= w.i)""",
    "changes AS (SELECT doc_id, i AS spot, weight, size FROM held UNION ALL SELECT doc_id, until, -weight, -size FROM held)",
    "sums AS (SELECT doc_id, spot, sum(weight) AS weight, sum(size) AS size FROM changes GROUP BY doc_id, spot)",
    "running AS (SELECT doc_id, spot, round(sum(weight) OVER w, 9) AS weight, sum(size) OVER w AS size FROM sums WINDOW w AS (PARTITION BY doc_id ORDER BY spot))",
    """best AS (
  SELECT w.doc_id, (s.a + w.b) // 2 AS centre, row_number() OVER (PARTITION BY w.doc_id ORDER BY r.weight DESC, r.size DESC, s.a, w.i) AS nth
  FROM windowed w JOIN running r ON r.doc_id = w.doc_id AND r.spot = w.i JOIN numbered s ON s.doc_id = w.doc_id AND s.i = w.first)""",
)


def test_centres_equal_the_sql(spark, tmp_path):
    rng = random.Random(1)
    words = ["a", "of", "The", "the", "lake", "Árbol", "arbol", "ñu", "zebra", "zeb", "stone-age", "x1"]
    texts = ["", "...", "one"] + [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "\n"]) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(SQL_CENTRES + "SELECT d.doc_id AS query_id, CAST(centre AS INTEGER) AS centre FROM documents d LEFT JOIN (SELECT * FROM best WHERE nth = 1) USING (doc_id)").fetchall()
    got = [tuple(r) for r in queries()["match_centre"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and sum(c is None for _, c in got) == 2
