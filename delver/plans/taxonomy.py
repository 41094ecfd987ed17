"""Concept clustering over the documents of one source, and query correction over part names and user turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from delver.functions.text import tokens, windows
from delver.operators import taxonomy as op

QUERIES, ORACLES = {}, {}


def _rows(s, d):
    t = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", tokens("text").alias("w"))
    return t.select("doc_id", (F.col("source") == "src3").alias("in_result"), F.explode(F.transform(windows(F.col("w"), 2), lambda x: F.array_join(x, " "))).alias("concept"))


R = r"""t AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
r AS (SELECT DISTINCT doc_id, source = 'src3' AS hit, w[i] || ' ' || w[i + 1] AS concept FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t)),
tt AS (SELECT count(*) AS n, count(*) FILTER (WHERE source = 'src3') AS k FROM documents)"""
CA = f"""{R}, c AS (SELECT concept, sum(CAST(hit AS INTEGER)) AS df, count(*) AS gdf FROM r GROUP BY concept HAVING sum(CAST(hit AS INTEGER)) > 0),
ca AS (SELECT concept, df, gdf, round(CASE WHEN k > 10 AND df > k / 3.5 THEN 0 ELSE ln(df + 1) / ln((sqrt(gdf + 1) + 1) / ln(n + 2) + 2) END, 6) AS score,
round(CASE WHEN k > 10 AND df > k / 3.5 THEN 0 ELSE ln(df + 1) / ln((gdf + greatest(2, n // 10000)) / ln(sqrt(n) + 1) + 1) END, 6) AS rank_score FROM c, tt ORDER BY rank_score DESC, concept LIMIT 100)"""


def _cand(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return op.candidates(_rows(s, d), docs.count(), docs.where("source = 'src3'").count(), 100)


QUERIES["cc_candidates"] = _cand
ORACLES["cc_candidates"] = f"WITH {CA} SELECT concept, CAST(df AS BIGINT) AS df, gdf, score, rank_score FROM ca"
QUERIES["cc_containment"] = lambda s, d: op.containment(_rows(s, d).join(F.broadcast(_cand(s, d).select("concept")), "concept"), 0.5, 0.9)
ORACLES["cc_containment"] = f"""WITH {CA}, rr AS (SELECT r.* FROM r SEMI JOIN ca USING (concept)), z AS (SELECT concept, count(*) AS n FROM rr GROUP BY concept), k AS (SELECT a.concept AS i, b.concept AS j, count(*) AS k FROM rr a JOIN rr b USING (doc_id) WHERE a.concept <> b.concept GROUP BY ALL)
SELECT i, j, round(k / zj.n, 6) AS c FROM k JOIN z zi ON zi.concept = i JOIN z zj ON zj.concept = j WHERE k / zj.n >= 0.5 AND k / zi.n <= 0.9"""
QUERIES["cc_siblings"] = lambda s, d: op.siblings(_cand(s, d))
ORACLES["cc_siblings"] = f"""WITH {CA}, x AS (SELECT concept, string_split(concept, ' ') AS w FROM ca)
SELECT a.concept AS i, b.concept AS j, CAST(CAST(a.w[1] = b.w[1] AS INTEGER) + CAST(a.w[2] = b.w[2] AS INTEGER) AS BIGINT) AS same FROM x a JOIN x b ON a.concept < b.concept WHERE a.w[1] = b.w[1] OR a.w[2] = b.w[2]"""
QUERIES["cc_tree"] = lambda s, d: op.tree(_rows(s, d).where("in_result").withColumn("query", F.lit("src3")), _cand(s, d))
LM = r"""c AS (SELECT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '\p{L}+')) AS r FROM part), i AS (SELECT r, unnest(range(1, length(r) + 1)) AS i FROM c),
g AS (SELECT substr(r, i, len) AS gram, len, count(*) AS n FROM i, (VALUES (1), (2), (3)) v(len) WHERE i + len - 1 <= length(r) GROUP BY ALL),
u AS (SELECT gram, len, n / (SELECT sum(n) FROM g WHERE len = 1) AS p FROM g WHERE len = 1),
b AS (SELECT a.gram, a.len, a.n / x.n AS p FROM g a JOIN g x ON a.len = 2 AND x.len = 1 AND x.gram = substr(a.gram, 1, 1) WHERE a.n / x.n >= 0.0015),
t AS (SELECT a.gram, a.len, a.n / x.n AS p FROM g a JOIN g x ON a.len = 3 AND x.len = 2 AND x.gram = substr(a.gram, 1, 2) JOIN b ON b.gram = x.gram WHERE b.p * (a.n / x.n) >= 0.00015)"""


def _chars(s, d):
    return op.char_model(s.read.parquet(f"{d}/part.parquet").select(F.concat_ws(" ", "p_name", "p_type").alias("text")))


QUERIES["qc_lm_train"] = lambda s, d: _chars(s, d).withColumn("p", F.round("p", 6))
ORACLES["qc_lm_train"] = f"WITH {LM} SELECT gram, len, round(p, 6) AS p FROM u UNION ALL SELECT gram, len, round(p, 6) FROM b UNION ALL SELECT gram, len, round(p, 6) FROM t"


def _log(s, d):
    return s.read.parquet(f"{d}/part.parquet").groupBy(F.col("p_type").alias("text")).agg(F.count("*").alias("df"))


QUERIES["qc_lm_log"] = lambda s, d: op.log_model(_log(s, d)).withColumn("w", F.round("w", 6))
ORACLES["qc_lm_log"] = """WITH l AS (SELECT lower(p_type) AS r, count(*) AS df FROM part GROUP BY p_type), i AS (SELECT r, df, unnest(range(1, length(r) + 1)) AS i FROM l)
SELECT substr(r, i, len) AS gram, len, round(sum(df * CASE WHEN len = 1 THEN CAST(0.000001 AS DOUBLE) ELSE CAST(0.004 AS DOUBLE) END), 6) AS w FROM i, (VALUES (1), (2), (3)) v(len) WHERE i + len - 1 <= length(r) GROUP BY substr(r, i, len), len"""


def _scored(s, d):
    p = s.read.parquet(f"{d}/part.parquet")
    return p.groupBy(F.col("p_brand").alias("query"), F.when(F.col("p_size") == 7, F.col("p_brand")).otherwise(F.concat(F.lit("c"), (F.col("p_size") % 9).cast("string"))).alias("candidate")).agg(F.round(F.avg("p_retailprice"), 3).alias("score"))


QUERIES["qc_result_rule"] = lambda s, d: op.keep_ratio(_scored(s, d), 0.97, 0.99)
ORACLES["qc_result_rule"] = """WITH s AS (SELECT p_brand AS query, CASE WHEN p_size = 7 THEN p_brand ELSE 'c' || CAST(p_size % 9 AS VARCHAR) END AS candidate, round(avg(p_retailprice), 3) AS score FROM part GROUP BY ALL),
x AS (SELECT s.* FROM s LEFT JOIN s m ON m.query = s.query AND m.candidate = s.query WHERE m.score IS NULL OR (s.candidate <> s.query AND m.score < s.score * 0.99)),
o AS (SELECT *, CAST(score >= CAST(0.97 AS DOUBLE) * coalesce(lag(score) OVER w, score) AS INTEGER) AS ok FROM x WINDOW w AS (PARTITION BY query ORDER BY score DESC, candidate))
SELECT query, candidate, score FROM (SELECT *, min(ok) OVER (PARTITION BY query ORDER BY score DESC, candidate ROWS UNBOUNDED PRECEDING) AS k FROM o) WHERE k = 1"""
_SYL = ["zhong", "guo", "ren", "min", "zhon", "g", "uo", "xi", "an", "xian", "shang", "hai", "sha", "ng"]
QUERIES["qc_segment"] = lambda s, d: op.segmentations(s.createDataFrame([(1, "zhongguo"), (2, "xian"), (3, "shanghai"), (4, "sanghai")], "id long, text string"), _SYL)


def _beam(s, d):
    model = {r.gram: r.p for r in _chars(s, d).where("len <= 2").collect()}  # letters and their pairs: at most a few thousand
    return op.beam(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.lower(F.substring_index("p_type", " ", 1)).alias("text")), model, {"e": "i", "i": "e", "a": "o", "s": "z"})


QUERIES["qc_beam"] = _beam
