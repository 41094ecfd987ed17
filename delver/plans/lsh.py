"""Locality-sensitive hashing queries over embeddings; queries are the vectors whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import functions as F

from delver.functions.stats import hamming
from delver.operators import blocks
from delver.operators import lsh as op

QUERIES, ORACLES = {}, {}
A = op.matrix(8, 64)
TABS = [op.matrix(5, 64, seed=30 + t) for t in range(32)]
V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_dot = lambda a: f"list_dot_product(e, CAST({a} AS DOUBLE[]))"
_sk = lambda ps: " + ".join(f"CASE WHEN {_dot(p)} > 0 THEN {1 << i} ELSE 0 END" for i, p in enumerate(ps))
TK = "SELECT query_id, id, dist, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM {0}) WHERE rank <= 10"


def _v(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _q(s, d):
    return _v(s, d).where("id % 20 = 0")


QUERIES["lsh_pstable"] = lambda s, d: _v(s, d).select("id", *[f.alias(n) for n, f in (("h0", op.p_stable(F.col("v"), A[0], 0.3, 0.5)[0]), ("h1", op.p_stable(F.col("v"), A[1], 0.1, 0.5)[0]), ("d0", F.round(op.p_stable(F.col("v"), A[0], 0.3, 0.5)[1], 5)))])
ORACLES["lsh_pstable"] = f"WITH {V}, x AS (SELECT id, ({_dot(A[0])} + 0.3) / 0.5 AS a, ({_dot(A[1])} + 0.1) / 0.5 AS b FROM v) SELECT id, CAST(floor(a) AS BIGINT) AS h0, CAST(floor(b) AS BIGINT) AS h1, round(a - floor(a), 5) AS d0 FROM x"
QUERIES["lsh_hyperplane"] = lambda s, d: _v(s, d).select("id", op.hyperplane(F.col("v"), A[0])[0].alias("bit"), F.round(op.hyperplane(F.col("v"), A[0])[1], 5).alias("delta"))
ORACLES["lsh_hyperplane"] = f"WITH {V} SELECT id, CAST({_dot(A[0])} > 0 AS INTEGER) AS bit, round(abs({_dot(A[0])}), 5) AS delta FROM v"
QUERIES["lsh_threshold"] = lambda s, d: _v(s, d).select("id", op.threshold(F.col("v"), 5, 0.05).alias("bit"))
ORACLES["lsh_threshold"] = f"WITH {V} SELECT id, CAST(e[6] >= CAST(0.05 AS DOUBLE) AS INTEGER) AS bit FROM v"
_parts = lambda: [op.p_stable(F.col("v"), A[i], 0.1 * i, 0.5)[0] for i in range(4)]
QUERIES["lsh_composite"] = lambda s, d: _v(s, d).select("id", op.repeat(_parts(), 31, 1009).alias("rep"), op.xor(_parts()).alias("x"))
_h = [f"CAST(floor(({_dot(A[i])} + {0.1 * i}) / 0.5) AS BIGINT)" for i in range(4)]
_mod = "0"
for _x in range(4):
    _mod = f"(((({_mod}) * 31 + h{_x}) % 1009 + 1009) % 1009)"
ORACLES["lsh_composite"] = f"WITH {V}, h AS (SELECT id, {', '.join(f'{x} AS h{i}' for i, x in enumerate(_h))} FROM v) SELECT id, CAST({_mod} AS BIGINT) AS rep, xor(xor(xor(h0, h1), h2), h3) AS x FROM h"


def _sketch_pairs(s, d):
    v = _v(s, d).select("id", op.sketch(F.col("v"), [*TABS[0], *TABS[1], *TABS[2]]).alias("sk"))
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("sk").alias("qs"))
    return v.crossJoin(q).where("id <> query_id").select("query_id", "id", hamming(F.col("sk"), F.col("qs")).alias("distance"))


QUERIES["lsh_sketch_hamming"] = _sketch_pairs
ORACLES["lsh_sketch_hamming"] = f"WITH {V}, k AS (SELECT id, CAST({_sk([*TABS[0], *TABS[1], *TABS[2]])} AS BIGINT) AS sk FROM v) SELECT a.id AS query_id, b.id, CAST(bit_count(xor(a.sk, b.sk)) AS INTEGER) AS distance FROM k a JOIN k b ON a.id % 20 = 0 AND a.id <> b.id"


def _index(s, d):
    return op.top_k(blocks.nearest(_v(s, d), _q(s, d), 10, TABS), 10)


def _truth(s, d):
    return op.top_k(blocks.nearest(_v(s, d), _q(s, d), 10), 10)


IX = f"""{V}, tb AS ({' UNION ALL '.join(f'SELECT id, {i} AS tab, {_sk(p)} AS bucket FROM v' for i, p in enumerate(TABS))}),
cd AS (SELECT DISTINCT a.id AS query_id, b.id FROM tb a JOIN tb b USING (tab, bucket) WHERE a.id % 20 = 0 AND a.id <> b.id),
ds AS (SELECT query_id, cd.id, round(list_distance(a.e, b.e), 5) AS dist FROM cd JOIN v a ON a.id = query_id JOIN v b ON b.id = cd.id)"""
TR = f"{V}, al AS (SELECT a.id AS query_id, b.id, round(list_distance(a.e, b.e), 5) AS dist FROM v a JOIN v b ON a.id % 20 = 0 AND a.id <> b.id)"
QUERIES["lsh_index_query"] = _index
ORACLES["lsh_index_query"] = f"WITH {IX} {TK.format('ds')}"
QUERIES["lsh_topk"] = _truth
ORACLES["lsh_topk"] = f"WITH {TR} {TK.format('al')}"
QUERIES["lsh_recall"] = lambda s, d: op.recall(_index(s, d), _truth(s, d), 10)
ORACLES["lsh_recall"] = f"WITH {IX}, al AS (SELECT a.id AS query_id, b.id, round(list_distance(a.e, b.e), 5) AS dist FROM v a JOIN v b ON a.id % 20 = 0 AND a.id <> b.id), f AS ({TK.format('ds')}), t AS ({TK.format('al')}) SELECT t.query_id, round((count(f.id) + 1) / 11.0, 6) AS recall FROM t LEFT JOIN f ON f.query_id = t.query_id AND f.id = t.id GROUP BY t.query_id"
QUERIES["lsh_forest"] = lambda s, d: op.forest_query(_v(s, d), _q(s, d), [op.matrix(12, 64, seed=50 + t) for t in range(56)], 20, 10)
QUERIES["lsh_multiprobe"] = lambda s, d: op.multi_probe(_v(s, d), _q(s, d), [op.matrix(6, 64, seed=60 + t) for t in range(12)], [0.1 * i for i in range(6)], 2.0, 20, 10)
_PCA = ([0.0] * 64, op.matrix(3, 64, seed=70), [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1.0, 1.0, 0.0], [0.0, 0.0, 2.0]])
QUERIES["lsh_spectral"] = lambda s, d: _v(s, d).select("id", op.spectral(F.col("v"), *_PCA).alias("code"))
_sp = lambda m: " * ".join(f"sin(pi() / 2 + {_dot(a)} * {w})" for a, w in zip(_PCA[1], m, strict=True))
ORACLES["lsh_spectral"] = f"WITH {V} SELECT id, CAST({' + '.join(f'CASE WHEN {_sp(m)} > 0 THEN {1 << i} ELSE 0 END' for i, m in enumerate(_PCA[2]))} AS BIGINT) AS code FROM v"
