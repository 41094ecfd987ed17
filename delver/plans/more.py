"""Queries that combine operators of several modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from delver.functions import text
from delver.operators import dedup, itemset, keyphrase, learn, lsh, simspace
from delver.plans import dedup as dd
from delver.plans import itemset as its
from delver.plans import keyphrase as kp
from delver.plans import learn as le
from delver.plans import lsh as ls
from delver.plans import simspace as sm

QUERIES, ORACLES = {}, {}
QUERIES["an_half_width"] = lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(text.half_width(F.concat(F.lit("ＡＢ９！　"), "text")).cast("binary")).alias("h"))
ORACLES["an_half_width"] = f"""SELECT doc_id, md5(translate('ＡＢ９！　' || text, '{text.FULL.replace("'", "''")}', '{text.HALF.replace("'", "''")}')) AS h FROM documents"""


def _without(s, d):
    return dedup.without_docs(dd._groups(s, d), s.read.parquet(f"{d}/labels.parquet").where("toxic = 1").select("doc_id"))


QUERIES["dd_without"] = _without
ORACLES["dd_without"] = f"""{dd.ALL}, lf AS (SELECT doc_id, group_id FROM gr WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
nw AS (SELECT group_id, min(doc_id) AS low FROM lf GROUP BY group_id HAVING count(*) > 1) SELECT doc_id, low AS group_id FROM lf JOIN nw USING (group_id)"""


def _same(s, d):
    x = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return dedup.same_group(dd._groups(s, d), x)


QUERIES["dd_same_group"] = _same
ORACLES["dd_same_group"] = f"{dd.ALL} SELECT d.doc_id AS a, d.doc_id + 1 AS b, coalesce(x.group_id = y.group_id, false) AS same FROM documents d LEFT JOIN gr x ON x.doc_id = d.doc_id LEFT JOIN gr y ON y.doc_id = d.doc_id + 1"
for _name, _by in (("is_ordered", False), ("is_ordered_by_size", True)):
    QUERIES[_name] = lambda s, d, b=_by: itemset.ordered_sets(its._tx(s, d), b).select("tx_id", F.array_join("items", ",").alias("items"), F.col("rank").cast("long").alias("rank"))
    ORACLES[_name] = f"WITH {its.T}, k AS (SELECT tx_id, list(item ORDER BY item) AS w FROM t GROUP BY tx_id) SELECT tx_id, array_to_string(w, ',') AS items, row_number() OVER (ORDER BY {'len(w), ' if _by else ''}w, tx_id) AS rank FROM k"


def _variants(s, d):
    _, n, f, g = kp._found(s, d)
    return keyphrase.merge_variants(keyphrase.top_phrases(keyphrase.doc_phrases(g, f, n)).select("doc_id", "ngram", "rank"))


QUERIES["kp_post_filter"] = _variants
ORACLES["kp_post_filter"] = f"""WITH {kp.TP}, r AS (SELECT doc_id, ngram, rank FROM tp WHERE rank <= 15),
m AS (SELECT a.doc_id, a.ngram AS short, a.rank AS rs, b.ngram FROM r a JOIN r b USING (doc_id) WHERE len(string_split(b.ngram, ' ')) = len(string_split(a.ngram, ' ')) + 1 AND (starts_with(b.ngram, a.ngram || ' ') OR ends_with(b.ngram, ' ' || a.ngram))),
o AS (SELECT r.doc_id, r.ngram, least(r.rank, coalesce(b.rs, r.rank)) AS k FROM r LEFT JOIN (SELECT doc_id, ngram, min(rs) AS rs FROM m GROUP BY ALL) b ON b.doc_id = r.doc_id AND b.ngram = r.ngram WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = r.doc_id AND m.short = r.ngram))
SELECT doc_id, ngram, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, ngram) AS INTEGER) AS rank FROM o"""


def _translation(s, d):
    """Pages: phrases of the text between tags, terms of the title."""
    p = s.read.parquet(f"{d}/pages.parquet").where("html is not null")
    docs = p.select(F.col("page_id").alias("doc_id"), F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style).*?</\\1>", " "), "<[^>]*>", " . ").alias("text"))
    n = docs.count()
    g = kp.stored(s, keyphrase.counts(keyphrase.ngrams(keyphrase.segments(docs))), "page_ngrams")
    top = keyphrase.top_phrases(keyphrase.doc_phrases(g, keyphrase.collocations(keyphrase.frequencies(g), *keyphrase.gates(n)), n))
    titles = p.select(F.col("page_id").alias("doc_id"), F.explode(text.tokens(F.regexp_extract("html", "<title>([^<]*)", 1))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return keyphrase.translation_rank(top.select("doc_id", "ngram", "rank"), titles, n, rounds=5).withColumn("score", F.round("score", 6))


QUERIES["kp_translation_rank"] = _translation
_planes = [*ls.TABS[0], *ls.TABS[1]]
QUERIES["lsh_tail"] = lambda s, d: ls._v(s, d).select("id", lsh.tail(h := lsh.p_stable(F.col("v"), ls.A[0], 0.3, 0.1)[0], 97).alias("tail"), lsh.lowest_bit(h).alias("bit"))
ORACLES["lsh_tail"] = f"WITH {ls.V}, h AS (SELECT id, CAST(floor(({ls._dot(ls.A[0])} + 0.3) / 0.1) AS BIGINT) AS h FROM v) SELECT id, ((h % 97) + 97) % 97 AS tail, h & 1 AS bit FROM h"
QUERIES["lsh_histogram"] = lambda s, d: lsh.histograms(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("id"), F.col("embedding").alias("v")), _planes, 64)
ORACLES["lsh_histogram"] = f"WITH v AS (SELECT label AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), k AS (SELECT id, CAST({ls._sk(_planes)} AS BIGINT) % 64 AS bin FROM v) SELECT id, bin, count(*) AS n FROM k GROUP BY ALL"


def _asymmetric(s, d):
    """Every query against the vector of the next id: distances count where the signs differ."""
    delta = F.array(*[F.abs(lsh.dot(F.col("v"), a)) for a in _planes])
    v = ls._v(s, d).select("id", lsh.sketch(F.col("v"), _planes).alias("sk"), delta.alias("delta"))
    o = v.select((F.col("id") - 1).alias("id"), F.col("sk").alias("other"))
    return v.join(o, "id").select("id", F.round(lsh.asymmetric_distance(F.col("sk"), F.col("delta"), F.col("other")), 5).alias("dist"))


QUERIES["lsh_asymmetric"] = _asymmetric
_abs = "[" + ", ".join(f"abs({ls._dot(a)})" for a in _planes) + "]"
ORACLES["lsh_asymmetric"] = f"WITH {ls.V}, k AS (SELECT id, CAST({ls._sk(_planes)} AS BIGINT) AS sk, {_abs} AS delta FROM v) SELECT a.id, round(list_sum(list_transform(range(0, {len(_planes)}), lambda i: CASE WHEN (xor(a.sk, b.sk) >> i) & 1 = 1 THEN a.delta[i + 1] ELSE 0 END)), 5) AS dist FROM k a JOIN k b ON b.id = a.id + 1"
QUERIES["lsh_eval"] = lambda s, d: lsh.statistics(lsh.recall(ls._index(s, d), ls._truth(s, d), 10).select(F.col("recall").alias("x"))).select("n", *[F.round(c, 5).alias(c) for c in ("mean", "std", "low", "high")])
ORACLES["lsh_eval"] = f"SELECT count(*) AS n, round(avg(recall), 5) AS mean, round(stddev_pop(recall), 5) AS std, round(min(recall), 5) AS low, round(max(recall), 5) AS high FROM ({ls.ORACLES['lsh_recall']})"
QUERIES["sm_doc_search"] = lambda s, d: simspace.top_per_row(simspace.all_pairs(simspace.normalised(sm.QUERIES["sm_esa"](s, d)), 0.8), 100)
ORACLES["sm_doc_search"] = f"""WITH v AS (SELECT row AS r, col AS c, value AS x FROM ({sm.ORACLES['sm_esa']})), {sm.NORM}, {sm.AP}, y AS (SELECT a AS id, b AS other, round(sim, 6) AS sim FROM ap WHERE sim >= 0.8 UNION ALL SELECT b, a, round(sim, 6) FROM ap WHERE sim >= 0.8)
SELECT id, other, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS rank FROM y) WHERE rank <= 100"""
QUERIES["tm_log_posterior"] = lambda s, d: learn.log_posterior(s.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("topic"), F.explode(text.tokens("text")).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n"))).withColumn("logp", F.round("logp", 6))
ORACLES["tm_log_posterior"] = r"""WITH c AS (SELECT topic, term, count(*) AS n FROM (SELECT lang AS topic, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL)
SELECT topic, term, round(ln((n + CAST(0.1 AS DOUBLE)) / (sum(n) OVER (PARTITION BY topic) + CAST(0.1 AS DOUBLE) * (SELECT count(DISTINCT term) FROM c))), 6) AS logp FROM c"""


def _model(s, d):
    """One machine over all ratings: linear weights and factors of every customer, supplier and return flag."""
    _, w, v = learn.factorize(le._ratings(s, d).select(F.array("user", "item", "ctx").alias("cols"), "y"))
    return w.join(v.groupBy("col").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("own")), "col").select("col", "w", F.transform("own", lambda x: x["v"]).alias("v"))


QUERIES["fm_model"] = _model
QUERIES["me_lbfgs"] = lambda s, d: learn.lbfgs(learn.events(le._docs(s, d)))
