"""Learner queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from delver.functions.text import tokens
from delver.operators import learn as op

QUERIES, ORACLES = {}, {}


def _clicks(s, d):
    return op.clicks(s.read.parquet(f"{d}/events.parquet"), F.col("event_type") == "click")


def _fixed(s, d):
    """A model table with known values, one row a feature."""
    f = _clicks(s, d).select("model", F.explode("feats").alias("feature")).groupBy("model", "feature").agg(F.count("*").alias("n"))
    return f.select("model", "feature", ((F.col("n") % 17) / 4.0 - 2).alias("a"), (1 + F.col("n") % 5 / 2.0).alias("b"))


CL = """c AS (SELECT user_id % 4 AS model, event_id AS id, ['u' || CAST(user_id % 10 AS VARCHAR), 'h' || CAST(hour(ts) AS VARCHAR), 'd' || CAST(dayofweek(ts) + 1 AS VARCHAR)] AS feats FROM events),
x AS (SELECT model, id, unnest(feats) AS feature FROM c), mo AS (SELECT model, feature, (count(*) % 17) / 4.0 - 2 AS a, 1 + (count(*) % 5) / 2.0 AS b FROM x GROUP BY ALL)"""
QUERIES["ctr_probit_train"] = lambda s, d: op.train_online(_clicks(s, d), "probit")
QUERIES["ctr_ftrl_train"] = lambda s, d: op.train_online(_clicks(s, d), "ftrl")
QUERIES["ctr_probit_predict"] = lambda s, d: op.probit_predict(_clicks(s, d), _fixed(s, d)).select("model", "id", F.round("t", 6).alias("t"), F.round("p", 6).alias("p"))
# the normal distribution by its series; beyond 7 it is 0 or 1 to twelve places
_SERIES = "list_sum(list_transform(range(0, 120), lambda k: power(t, 2 * k + 1) / exp(list_sum(list_transform(range(0, k + 1), lambda j: ln(2 * j + 1))))))"
ORACLES["ctr_probit_predict"] = f"""WITH {CL}, y AS (SELECT model, id, CAST(sum(a) / sqrt(1 + sum(b)) AS DOUBLE) AS t FROM x JOIN mo USING (model, feature) GROUP BY ALL)
SELECT model, id, round(t, 6) AS t, round(CASE WHEN t > 7 THEN 1 WHEN t < -7 THEN 0 ELSE CAST(0.5 AS DOUBLE) + exp(-t * t / 2) / sqrt(2 * pi()) * {_SERIES} END, 6) AS p FROM y"""
QUERIES["ctr_forget"] = lambda s, d: op.probit_forget(_fixed(s, d), 0.1).select("model", "feature", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))
ORACLES["ctr_forget"] = f"WITH {CL} SELECT model, feature, round(CAST(0.9 AS DOUBLE) * a / b / (CAST(0.9 AS DOUBLE) / b + CAST(0.1 AS DOUBLE)), 6) AS a, round(1 / (CAST(0.9 AS DOUBLE) / b + CAST(0.1 AS DOUBLE)), 6) AS b FROM mo"
QUERIES["ctr_ftrl_predict"] = lambda s, d: op.ftrl_predict(_clicks(s, d), op.ftrl_weights(_fixed(s, d))).select("model", "id", F.round("p", 6).alias("p"))
ORACLES["ctr_ftrl_predict"] = f"WITH {CL}, w AS (SELECT model, feature, CASE WHEN abs(a) <= 0.1 THEN 0 ELSE -(a - sign(a) * CAST(0.1 AS DOUBLE)) / ((1 + sqrt(b)) / CAST(0.1 AS DOUBLE) + 1) END AS w FROM mo) SELECT model, id, round(1 / (1 + exp(-sum(w))), 6) AS p FROM x JOIN w USING (model, feature) GROUP BY ALL"


def _fm(s, d):
    li = s.read.parquet(f"{d}/lineitem.parquet")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000
    x = li.select(key.alias("row_id"), "l_suppkey", "l_partkey", "l_quantity").distinct().select("row_id", F.explode(F.array((F.col("l_suppkey") % 50), 50 + F.col("l_partkey") % 50)).alias("col"), F.lit(1.0).alias("val"), F.col("l_quantity").alias("y"))
    cols = s.range(100).select(F.col("id").alias("col"))
    w = cols.select("col", ((F.col("col") * 7 % 11) / 10.0 - 0.5).alias("w"))
    v = cols.select("col", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("f")).select("col", "f", ((F.col("col") * 3 + F.col("f") * 5) % 7 / 10.0 - 0.3).alias("v"))
    return x, op.fm_predict(x, 25.0, w, v)


FM = """r AS (SELECT DISTINCT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS row_id, [l_suppkey % 50, 50 + l_partkey % 50] AS cs, l_quantity AS y FROM lineitem), x AS (SELECT row_id, unnest(cs) AS col, y FROM r),
w AS (SELECT range AS col, (range * 7 % 11) / CAST(10 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS w FROM range(100)), v AS (SELECT a.range AS col, b.range AS f, ((a.range * 3 + b.range * 5) % 7) / CAST(10 AS DOUBLE) - CAST(0.3 AS DOUBLE) AS v FROM range(100) a, range(4) b),
l AS (SELECT row_id, sum(w) AS lin FROM x JOIN w USING (col) GROUP BY row_id), q AS (SELECT row_id, sum(s * s - q) AS pair FROM (SELECT row_id, f, sum(v) AS s, sum(v * v) AS q FROM x JOIN v USING (col) GROUP BY ALL) GROUP BY row_id),
p AS (SELECT row_id, 25 + lin + pair / 2 AS p FROM l JOIN q USING (row_id))"""
QUERIES["fm_predict"] = lambda s, d: _fm(s, d)[1].withColumn("p", F.round("p", 6))
ORACLES["fm_predict"] = f"WITH {FM} SELECT row_id, round(p, 6) AS p FROM p"


def _rmse(s, d):
    x, p = _fm(s, d)
    return op.rmse(p.join(x.select("row_id", "y").distinct(), "row_id")).select(F.round("rmse", 6).alias("rmse"))


QUERIES["fm_rmse"] = _rmse
ORACLES["fm_rmse"] = f"WITH {FM}, z AS (SELECT min(y) AS lo, max(y) AS hi FROM r) SELECT round(sqrt(avg(power(greatest(least(p, hi), lo) - y, 2))), 6) AS rmse FROM p JOIN r USING (row_id), z"


def _ratings(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user"))
    li = s.read.parquet(f"{d}/lineitem.parquet").join(o, "l_orderkey")
    return li.select(F.floor(F.col("user") / 50).cast("long").alias("model"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("u"), F.col("user").cast("string")).alias("user"), F.concat(F.lit("i"), F.col("l_suppkey").cast("string")).alias("item"), F.concat(F.lit("c"), F.col("l_returnflag")).alias("ctx"), (F.col("l_quantity") / 10).alias("y"))


def _fit(method, *cols):
    return lambda s, d: op.fm_fit(_ratings(s, d).select("model", "id", F.array(*cols).alias("cols"), "y"), method, rounds=4)


QUERIES |= {"fm_sgd": _fit("sgd", "user", "item"), "fm_als": _fit("als", "user", "item"), "fm_mcmc": _fit("mcmc", "user", "item"), "fm_context": _fit("sgd", "user", "item", "ctx")}
QUERIES["fm_implicit"] = lambda s, d: op.pairwise_ranking(_ratings(s, d).select("model", "user", "item"), rounds=3)


def _docs(s, d):
    lab = s.read.parquet(f"{d}/labels.parquet")
    return s.read.parquet(f"{d}/documents.parquet").join(lab, "doc_id").select(F.col("doc_id").alias("id"), F.array_distinct(tokens("text")).alias("context"), F.col("quality").cast("string").alias("outcome")).where("size(context) > 0")


EV = r"""t AS (SELECT doc_id AS id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS context, CAST(quality AS VARCHAR) AS outcome FROM documents JOIN labels USING (doc_id)), e AS (SELECT * FROM t WHERE len(context) > 0)"""
QUERIES["me_events"] = lambda s, d: op.events(_docs(s, d)).select(F.array_join("context", " ").alias("context"), "outcome", "n")
ORACLES["me_events"] = f"WITH {EV} SELECT array_to_string(context, ' ') AS context, outcome, count(*) AS n FROM e GROUP BY ALL"


def _theta(s, d):
    return _docs(s, d).select("outcome", F.explode("context").alias("pred")).groupBy("pred", "outcome").agg(F.log(F.count("*") + 1.0).alias("theta"))


QUERIES["me_predict"] = lambda s, d: op.maxent_predict(_docs(s, d).select("id", "context"), _theta(s, d)).withColumn("p", F.round("p", 6))
ORACLES["me_predict"] = f"""WITH {EV}, th AS (SELECT pred, outcome, ln(count(*) + 1) AS theta FROM (SELECT outcome, unnest(context) AS pred FROM e) GROUP BY ALL),
x AS (SELECT id, th.outcome, sum(theta) AS s FROM (SELECT id, unnest(context) AS pred FROM e) JOIN th USING (pred) GROUP BY ALL),
s AS (SELECT e.id, o.outcome, coalesce(x.s, 0) AS s FROM e CROSS JOIN (SELECT DISTINCT outcome FROM th) o LEFT JOIN x ON x.id = e.id AND x.outcome = o.outcome)
SELECT id, outcome, round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY id), 6) AS p FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM s)"""
ORACLES["me_best"] = ORACLES["me_predict"].rsplit("SELECT id, outcome, round", 1)[0] + ", q AS (SELECT id, outcome, round(exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY id), 9) AS p FROM (SELECT *, max(s) OVER (PARTITION BY id) AS m FROM s)) SELECT id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p DESC, outcome) AS k FROM q) WHERE k = 1"
QUERIES["me_best"] = lambda s, d: op.best_outcome(op.maxent_predict(_docs(s, d).select("id", "context"), _theta(s, d)))
QUERIES["me_gis"] = lambda s, d: op.gis(op.events(_docs(s, d)), 4)[0]


def _terms(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source", tokens("text").alias("terms"))


# partitioned Gibbs: every block of about 500 documents samples by itself
QUERIES["llda"] = lambda s, d: op.labeled_lda(_terms(s, d).select(F.floor(F.col("doc_id") / 500).alias("model"), "doc_id", F.array("lang", "source").alias("labels"), "terms"), rounds=3)
QUERIES["word2vec"] = lambda s, d: op.word2vec(_terms(s, d)).getVectors().select("word", vector_to_array("vector").alias("vector"))
QUERIES["para2vec"] = lambda s, d: (lambda t: op.word2vec(t).transform(t).select("doc_id", vector_to_array("vector").alias("vector")))(_terms(s, d))
QUERIES["svm_linear"] = lambda s, d: (lambda r: op.linear_svm(r).transform(r).select("doc_id", F.col("prediction")))(_terms(s, d).join(s.read.parquet(f"{d}/labels.parquet"), "doc_id").select("doc_id", "terms", F.col("quality").cast("double").alias("label")))
