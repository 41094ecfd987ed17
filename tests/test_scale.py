"""Steps that once grew faster than their tables: right results, and sizes that the former code couldn't do."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from delver.functions import stats
from delver.operators import blocks, dedup, learn, lsh, recsys


def _slow_sgd(data: list, rounds: int, factors: int = 4, seed: int = 3) -> list[float]:
    """One model's rows (cols, y), a step at a time."""
    rng = np.random.default_rng(seed)
    at = {c: i for i, c in enumerate(sorted({c for cols, _ in data for c in cols}))}
    w0, w, v, y = 0.0, np.zeros(len(at)), rng.normal(0, 0.1, (len(at), factors)), np.array([x for _, x in data])
    own = [np.array(sorted({at[c] for c in cols})) for cols, _ in data]
    score = lambda j: w0 + w[j].sum() + 0.5 * (v[j].sum(0) ** 2 - (v[j] ** 2).sum(0)).sum()
    out = []
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            j, s = own[i], v[own[i]].sum(0)
            g = 0.02 * (min(max(score(j), y.min()), y.max()) - y[i])
            w0 -= g
            w[j] -= g + 2e-4 * w[j]
            v[j] -= g * (s - v[j]) + 2e-4 * v[j]
        out.append(float(np.sqrt(((np.clip([score(j) for j in own], y.min(), y.max()) - y) ** 2).mean())))
    return out


def test_fm_sgd_steps_of_many_models_at_once(spark) -> None:
    rng = np.random.default_rng(1)
    data = {m: [([f"u{rng.integers(4)}", f"i{rng.integers(6)}", *(["c"] if k % 3 else [])], float(rng.integers(1, 6))) for k in range(5 + 7 * m)] for m in range(5)}
    rows = spark.createDataFrame([(m, i, cols, y) for m, own in data.items() for i, (cols, y) in enumerate(own)], "model long, id long, cols array<string>, y double")
    got = {(r.model, r["round"]): r.rmse for r in learn.fm_fit(rows, "sgd", rounds=3).collect()}
    assert got == {(m, k): pytest.approx(x, abs=1e-9) for m, own in data.items() for k, x in enumerate(_slow_sgd(own, 3))}


def test_fm_fit_of_a_wide_model(spark) -> None:
    """60,000 rows of 90,000 columns, which were a dense matrix of 43 GB."""
    rows = spark.range(60_000).select(F.lit(1).cast("long").alias("model"), "id", F.array(F.concat(F.lit("u"), F.col("id") % 30_000), F.concat(F.lit("i"), F.col("id"))).alias("cols"), (F.col("id") % 5).cast("double").alias("y"))
    for method in ("als", "mcmc"):
        got = [r.rmse for r in learn.fm_fit(rows, method, rounds=2).orderBy("round").collect()]
        assert len(got) == 2 and 0 < got[1] < 1.5


def test_pairs_of_blocks_equal_the_expressions(spark) -> None:
    """Vectors of two sizes, missing ones, gaps and zeros; every measure as its column expression gives it."""
    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in np.round(rng.normal(size=5 if i % 7 else 4), 2)]) for i in range(60)] + [(60, None), (61, [1.0, None, 2.0, 0.5, 0.1]), (62, [0.0] * 5), (63, [0.0] * 5), (64, []), (65, [0.5] * 5)]
    v = spark.createDataFrame(data, "id long, v array<float>").repartition(3)
    q = v.where("id % 5 = 0")
    pair = v.select(F.col("id").alias("b"), F.col("v").alias("y")).crossJoin(q.select(F.col("id").alias("a"), F.col("v").alias("x"))).where("a <> b")
    for kind in ("cosine", "l2", "linf", "inverse_l1"):
        f = getattr(stats, kind)
        want = {(r.a, r.b): r.v for r in pair.select("a", "b", F.round(f(F.col("x"), F.col("y")), 5).alias("v")).collect()}
        assert {(r.a, r.b): r.v for r in blocks.measured(v, q, kind, f).collect()} == want
    want = lsh.top_k(pair.select(F.col("a").alias("query_id"), F.col("b").alias("id"), F.round(stats.l2(F.col("x"), F.col("y")), 5).alias("dist")), 4)
    assert {tuple(r) for r in lsh.top_k(blocks.nearest(v, q, 4), 4).collect()} == {tuple(r) for r in want.collect()}


def test_nearest_shuffles_no_pairs(spark) -> None:
    """Tables of a few bits make most vectors candidates, which were shuffled as pairs."""
    planes = [lsh.matrix(2, 8, seed=t) for t in range(3)]
    v = spark.range(3000).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(1000)) / 500.0 - 1).alias("v"))
    q = v.where("id % 20 = 0")
    t = lsh.tables(v, planes)
    found = blocks.nearest(v, q, 5, planes)
    assert found.count() < 150 * 5 * 40
    assert {tuple(r) for r in lsh.top_k(found, 5).collect()} == {tuple(r) for r in lsh.query(t, t.where("id % 20 = 0"), v, 5).collect()}


def test_rounding_is_that_of_columns(spark) -> None:
    x = [0.123455, 0.123445, -0.123455, 1.5e-6, 5e-6, -5e-6, 1e12 + 0.000005, 2.675, 1.005, float("inf"), float("nan"), 0.0, 123456.000005]
    want = [r[0] for r in spark.createDataFrame([(a,) for a in x], "x double").select(F.round("x", 5)).collect()]
    assert [repr(float(a)) for a in blocks.rounded(np.array(x))] == [repr(a) for a in want]


def test_pairs_and_links_of_one_large_bucket(spark) -> None:
    """3,000 fingerprints of one word and its neighbours: pairs are exact, links are few and give the same groups, nothing is joined."""
    fp = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, 5000).otherwise(100).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("hi"), F.when(F.col("id") < 2000, F.col("id")).otherwise(F.col("id") * 1_000_003 % (1 << 31)).alias("lo"))
    got = {tuple(r) for r in dedup.pairs(fp).collect()}
    c = [(r.doc_id, r.lo, 6 if r.n_tokens == 100 else 1) for r in fp.collect()]
    lo, k = np.array([x[1] for x in c]), np.array([x[2] for x in c])
    d = np.bitwise_count(lo[:, None] ^ lo)
    a, b = np.nonzero(np.triu(d <= np.minimum(k[:, None], k), 1))
    assert got == set(zip(a.tolist(), b.tolist(), d[a, b].tolist(), strict=True)) and len(got) > 300_000
    few = dedup.links(fp).collect()
    assert len(few) < 84 * 3000
    name = lambda links: {tuple(r) for r in dedup.groups(fp, links).collect()}
    assert name(spark.createDataFrame(few, "a long, b long")) == name(spark.createDataFrame([(x, y) for x, y, _ in got], "a long, b long"))


def test_probes_of_a_common_prefix(spark) -> None:
    """All of 20,000 documents and 1,000 queries share a prefix, which was a join of 20 million rows a probe."""
    fp = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(7).cast("long").alias("hi"), (F.col("id") * 2).alias("lo"))
    q = fp.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "hi", (F.col("lo") + 1).alias("lo"), F.expr("transform(sequence(1, 16), i -> 1.0D - i / 40.0D)").alias("score"))
    m = dedup.probabilistic_match(fp, q)
    assert {tuple(r) for r in m.collect()} == {(i, i, 1) for i in range(0, 20_000, 20)}
    assert "Join" not in m._jdf.queryExecution().executedPlan().toString()


def test_covisits_are_counted_in_the_task(spark) -> None:
    """A user of 900 items and many users of the same few: exact counts, and no join of visits with themselves."""
    rng = np.random.default_rng(4)
    visits = [(0, i) for i in range(900)] + [(u, int(rng.integers(12))) for u in range(1, 400) for _ in range(6)] + [(5, None), (None, 3)]
    v = spark.createDataFrame(visits, "user long, item int")
    want: dict = {}
    for u in range(400):
        own = {i for x, i in visits if x == u}
        for i in own:
            for j in own:
                want[i, j] = want.get((i, j), 0) + 1
    m = recsys.covisits(v)
    assert {(r.i, r.j): r.n for r in m.collect()} == want and "Join" not in m._jdf.queryExecution().executedPlan().toString()
    old, new = v.where("user % 3 = 0"), v.where("user % 3 <> 0 or user % 2 = 0")
    got = recsys.covisit_update(recsys.covisits(old), old, new)
    text = spark.createDataFrame([(u, None if i is None else str(i)) for u, i in visits], "user long, item string")
    o, n = text.where("user % 3 = 0"), text.where("user % 3 <> 0 or user % 2 = 0")
    assert {(str(r.i), str(r.j), r.n) for r in got.collect()} == {(str(r.i), str(r.j), r.n) for r in recsys.covisit_update(recsys.covisits(o), o, n).where("i is not null and j is not null").collect()} | {(str(r.i), str(r.j), r.n) for r in got.where("i is null or j is null").collect()}


def test_counting_in_small_parts(spark) -> None:
    """The same counts however little a part may hold."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    items = [sorted({int(x) for x in rng.integers(0, 5000, 30)}) for _ in range(40)]
    b = pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.int64())), pa.array([[k % 2 == 0 for k, _ in enumerate(x)] for x in items])], ["items", "fresh"])
    added = []
    for most in (100, 1 << 22):
        n: dict = {}
        for out in recsys._counts([b, b], most):
            for i, j, c in zip(*out.to_pydict().values(), strict=True):
                n[i, j] = n.get((i, j), 0) + c
        added.append(n)
    assert added[0] == added[1] and sum(added[0].values()) == 2 * sum(len(x) ** 2 - (len(x) // 2) ** 2 for x in items)
