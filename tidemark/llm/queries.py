"""One query per operator over its whole table, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, jaccard, knn, licenses, lines, packing, passages, toxicity, urls
from .frames import load


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(load(spark, sf_dir, "embeddings"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(load(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(load(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(load(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    texts, toxic = toxicity.labelled(docs.where(fold != 0), labels.where(fold != 0))
    scores = toxicity.score(docs, toxicity.fit(texts, toxic))
    return scores.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_packing, op2_decontamination, op3_top_k, op4_main_text, op5_license_scan, op6_repeated_passages, op7_jaccard_join, op8_url_filter, op9_toxicity, op10_line_dedup)}

_WORDS_OF = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS = _WORDS_OF.format("text")

ORACLES: dict[str, str] = {
    "op2_decontamination": rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 8) AS m, array_to_string(w[s : s + least(len(w), 8) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM iw),
dw AS (SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, sizes)),
hit AS (SELECT doc_id, s, dw.m AS m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.g = iw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(items.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op5_license_scan": licenses.oracle(),
    "op3_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op6_repeated_passages": rf"""
WITH RECURSIVE w AS (SELECT doc_id, md5(text) AS t, {_WORDS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT doc_id, t, k, md5(array_to_string(w[k + 1 : k + 50], ' ')) AS h FROM (SELECT *, unnest(range(len(w) - 49)) AS k FROM w WHERE len(w) >= 50)),
g AS (SELECT h, count(*) AS n, min(doc_id) AS lo, max(doc_id) AS hi, min((doc_id, k)) AS lead FROM s GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT s.*, n, lo, hi, lead = (s.doc_id, k) AS leads, k - row_number() OVER (PARTITION BY s.doc_id ORDER BY k) AS run FROM s JOIN g USING (h)),
p AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS b, min(lo) AS lo, max(hi) AS hi, max(n) AS n, arg_min(leads, k) AS leads FROM r GROUP BY doc_id, run),
o AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p),
m AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a) AS part FROM o)
SELECT doc_id, CAST(min(a) AS BIGINT) AS start_word, CAST(max(b) - min(a) AS BIGINT) AS n_words, min(lo) AS first_doc_id, max(hi) AS last_doc_id, CAST(max(n) AS BIGINT) AS n_places, arg_min(leads, a) AS is_first FROM m GROUP BY doc_id, part""",
    "op10_line_dedup": rf"""
WITH l AS (SELECT doc_id, p, x FROM (SELECT doc_id, unnest(x) AS x, unnest(range(len(x))) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))),
b AS (SELECT doc_id, p, t, len({_WORDS_OF.format("t")}) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS k FROM (SELECT *, trim(x, chr(32) || chr(9) || chr(13)) AS t FROM l) WHERE t <> ''),
n AS (SELECT *, lead(t) OVER o AS t2, lead(t, 2) OVER o AS t3, lead(w) OVER o AS w2 FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
r AS (SELECT doc_id, k, CASE WHEN w >= {lines.RUN_WORDS} THEN 1 WHEN w + w2 >= {lines.RUN_WORDS} THEN 2 WHEN t3 IS NOT NULL THEN 3 END AS m, t, t2, t3 FROM n),
late AS (SELECT doc_id, k, m FROM (SELECT doc_id, k, m, row_number() OVER (PARTITION BY CASE m WHEN 1 THEN t WHEN 2 THEN t || chr(10) || t2 ELSE t || chr(10) || t2 || chr(10) || t3 END ORDER BY doc_id, k) AS n FROM r WHERE m IS NOT NULL) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM late, (SELECT unnest(range(3)) AS j) WHERE j < m),
out AS (SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.p) FILTER (gone.k IS NULL) AS text, count(gone.k) AS n
  FROM l LEFT JOIN b USING (doc_id, p) LEFT JOIN gone ON gone.doc_id = b.doc_id AND gone.k = b.k GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(out.text, '') END AS text, CAST(coalesce(out.n, 0) AS BIGINT) AS n_lines_deleted FROM documents d LEFT JOIN out USING (doc_id)""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w WHERE len(w) > 0),
u AS (SELECT list_sort(s) AS s, min(doc_id) AS node, count(*) AS copies, list(doc_id) AS members FROM s GROUP BY 1),
g AS (SELECT node, len(s) AS size, copies, unnest(s) AS g FROM u),
p AS (SELECT a.node AS a, b.node AS b, any_value(b.copies) AS copies FROM g a JOIN g b ON a.g = b.g AND a.node <> b.node AND a.size >= 0.8 * b.size AND b.size >= 0.8 * a.size
  GROUP BY a.node, b.node HAVING 10 * count(*) >= 8 * (any_value(a.size) + any_value(b.size) - count(*))),
reach(node, root) AS (SELECT node, node FROM u UNION SELECT p.b, reach.root FROM reach JOIN p ON p.a = reach.node WHERE reach.root < p.b),
c AS (SELECT node, min(root) AS class_id FROM reach GROUP BY 1),
n AS (SELECT a AS node, sum(copies) AS n FROM p GROUP BY 1),
m AS (SELECT unnest(members) AS doc_id, class_id, coalesce(n.n, 0) + copies - 1 AS n_links FROM u JOIN c USING (node) LEFT JOIN n USING (node))
SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, CAST(coalesce(m.n_links, 0) AS BIGINT) AS n_links FROM documents d LEFT JOIN m USING (doc_id)""",
}
