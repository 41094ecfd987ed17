"""Learners: click prediction, factorization machines, maximum entropy, topic models, embeddings, classifiers.

Order-dependent learners run one model a group in (ts, id) order; groups are independent models. Iterative ones
work on aggregates and cut their lineage with reliable checkpoints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from delver.operators.graph import cut


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _v(x: float) -> float:
    """Mean shift of a truncated Gaussian."""
    p = _phi(x)
    return math.exp(-x * x / 2) / math.sqrt(2 * math.pi) / p if p > 1e-12 else -x


class Probit:
    """Bayesian probit regression over categorical features; unseen values start at the prior (0, 1)."""

    def __init__(self, beta: float = 1.0) -> None:
        self.beta, self.state = beta, {}

    def update(self, feats: list[str], clicked: bool) -> None:
        s = [self.state.get(f, (0.0, 1.0)) for f in feats]
        y, total = (1 if clicked else -1), self.beta**2 + sum(b for _, b in s)
        root = math.sqrt(total)
        t = y * sum(a for a, _ in s) / root
        v = _v(t)
        w = v * (v + t)
        for f, (a, b) in zip(feats, s, strict=True):
            self.state[f] = (a + y * b / root * v, b * (1 - b / total * w))

    def predict(self, feats: list[str]) -> float:
        s = [self.state[f] for f in feats if f in self.state]
        return _phi(sum(a for a, _ in s) / math.sqrt(self.beta**2 + sum(b for _, b in s)))


class Ftrl:
    """FTRL-proximal logistic regression with g = p - y; weights follow from (z, n)."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.1, l2: float = 1.0) -> None:
        self.a, self.b, self.l1, self.l2, self.state = alpha, beta, l1, l2, {}

    def weight(self, f: str) -> float:
        z, n = self.state.get(f, (0.0, 0.0))
        return 0.0 if abs(z) <= self.l1 else -(z - math.copysign(self.l1, z)) / ((self.b + math.sqrt(n)) / self.a + self.l2)

    def predict(self, feats: list[str]) -> float:
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(map(self.weight, feats))))))

    def update(self, feats: list[str], clicked: bool) -> None:
        g = self.predict(feats) - (1.0 if clicked else 0.0)
        for f, w in [(f, self.weight(f)) for f in feats]:
            z, n = self.state.get(f, (0.0, 0.0))
            self.state[f] = (z + g - (math.sqrt(n + g * g) - math.sqrt(n)) / self.a * w, n + g * g)


def train_online(rows: DataFrame, kind: str) -> DataFrame:
    """(model, feature, a, b) from rows(model, ts, id, feats, y); a, b are (mean, variance) or (z, n)."""

    def out(name: int, m: Probit | Ftrl) -> pd.DataFrame:
        return pd.DataFrame([(name, f, a, b) for f, (a, b) in sorted(m.state.items())], columns=["model", "feature", "a", "b"])

    def run(frames):  # noqa: ANN001, ANN202
        name, m = None, None
        for f in frames:
            for r in f.itertuples():
                if m is None or r.model != name:
                    if m is not None:
                        yield out(name, m)
                    name, m = r.model, Probit() if kind == "probit" else Ftrl()
                m.update(list(r.feats), bool(r.y))
        if m is not None:
            yield out(name, m)

    # rows stream through a task in order; only a model's weights are held
    ordered = rows.repartition("model").sortWithinPartitions("model", "ts", "id")
    return ordered.mapInPandas(run, "model long, feature string, a double, b double")


def probit_forget(model: DataFrame, rate: float, prior: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Pulls (mean, variance) towards the prior in the natural parameters."""
    m0, v0 = prior
    prec = (1 - rate) / F.col("b") + rate / v0
    return model.select("model", "feature", (((1 - rate) * F.col("a") / F.col("b") + rate * m0 / v0) / prec).alias("a"), (1 / prec).alias("b"))


def ftrl_weights(model: DataFrame, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.1, l2: float = 1.0) -> DataFrame:
    w = F.when(F.abs("a") <= l1, 0.0).otherwise(-(F.col("a") - F.signum("a") * l1) / ((beta + F.sqrt("b")) / alpha + l2))
    return model.select("model", "feature", w.alias("w"))


def ftrl_predict(rows: DataFrame, weights: DataFrame) -> DataFrame:
    x = rows.select("model", "id", F.explode("feats").alias("feature")).join(weights, ["model", "feature"], "left")
    return x.groupBy("model", "id").agg((1 / (1 + F.exp(-F.sum(F.coalesce("w", F.lit(0.0)))))).alias("p"))


def probit_predict(rows: DataFrame, model: DataFrame, beta: float = 1.0) -> DataFrame:
    x = rows.select("model", "id", F.explode("feats").alias("feature")).join(model, ["model", "feature"], "left")
    t = x.groupBy("model", "id").agg((F.coalesce(F.sum("a"), F.lit(0.0)) / F.sqrt(F.lit(beta**2) + F.coalesce(F.sum("b"), F.lit(0.0)))).alias("t"))

    def cdf(frames):  # noqa: ANN001, ANN202
        for f in frames:
            yield f.assign(p=[_phi(x) for x in f.t])

    return t.mapInPandas(cdf, "model long, id long, t double, p double")


def fm_predict(x: DataFrame, w0: float, w: DataFrame, v: DataFrame) -> DataFrame:
    """(row_id, p): w0 + sum w x + half of sum over factors of (sum v x)^2 - sum (v x)^2. x(row_id, col, val), w(col, w), v(col, f, v)."""
    lin = x.join(w, "col", "left").groupBy("row_id").agg(F.sum(F.coalesce("w", F.lit(0.0)) * F.col("val")).alias("lin"))
    vx = F.col("v") * F.col("val")
    fac = x.join(v, "col").groupBy("row_id", "f").agg(F.sum(vx).alias("s"), F.sum(vx * vx).alias("q")).groupBy("row_id").agg(F.sum(F.col("s") * F.col("s") - F.col("q")).alias("pair"))
    return lin.join(fac, "row_id", "left").select("row_id", (F.lit(w0) + F.col("lin") + 0.5 * F.coalesce("pair", F.lit(0.0))).alias("p"))


def rmse(pred: DataFrame) -> DataFrame:
    """Root mean squared error of pred(p, y) with p clipped to the range of y."""
    r = pred.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    e = F.greatest(F.least("p", "hi"), "lo") - F.col("y")
    return pred.crossJoin(F.broadcast(r)).agg(F.sqrt(F.avg(e * e)).alias("rmse"))


def _models(batches: Iterator[pa.RecordBatch], most: int = 1 << 19) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, their model counted from 0, row of each model's start) of whole models, about `most` rows at a time, from rows in the order of their models."""

    def cut_up(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        m = pc.fill_null(t["model"], -(1 << 63)).to_numpy()
        new = np.r_[True, m[1:] != m[:-1]]
        return t, np.cumsum(new) - 1, np.flatnonzero(new)

    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= most and held[0].column(0)[0] != b.column(0)[b.num_rows - 1]:
            t, _, starts = cut_up(pa.Table.from_batches(held))
            yield cut_up(t.slice(0, starts[-1]))
            t = t.slice(starts[-1])
            held, n = t.to_batches(), t.num_rows
    if n:
        yield cut_up(pa.Table.from_batches(held))


def _codes(values: pa.Array, of: np.ndarray, models: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, codes of each model): values numbered through, by model and within it in sorted order."""
    coded = values.dictionary_encode(null_encoding="encode")
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    k = max(1, len(order))
    keys, code = np.unique(of * k + rank[coded.indices.to_numpy(zero_copy_only=False)], return_inverse=True)
    return code, np.bincount(keys // k, minlength=models)


def _steps(size: np.ndarray, starts: np.ndarray, orders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, ends): every model's rows in its own order, the first of all models, then the second of all that have one, and so on. Models come by falling size."""
    step = np.concatenate([np.arange(n) for n in size])
    row = np.concatenate([o + a for o, a in zip(orders, starts, strict=True)])
    seq = np.argsort(step, kind="stable")
    return row[seq], np.cumsum(np.bincount(step))


def fm_fit(rows: DataFrame, method: str, factors: int = 4, rounds: int = 10, seed: int = 3) -> DataFrame:
    """(model, round, rmse) of factorization machines fitted per model by SGD, ALS or MCMC over rows(model, id, cols, y), binary features.

    Rows are sparse. SGD takes a step of many models at once, as they share nothing; ALS and MCMC take neighbouring columns at once
    of which no row has two, as they don't change one another's updates.
    """

    def sgd(j, y, of, starts, size, names, lo, hi):  # noqa: ANN001, ANN202
        down = np.argsort(-size, kind="stable")
        rngs = [np.random.default_rng(seed) for _ in size]
        v = np.concatenate([*[r.normal(0, 0.1, (n, factors)) for r, n in zip(rngs, names, strict=True)], np.zeros((1, factors))])
        w0, w = np.zeros(len(size)), np.zeros(len(v))
        low, high = lo[down], hi[down]
        for _ in range(rounds):
            seq, ends = _steps(size[down], starts[down], [rngs[m].permutation(size[m]) for m in down])
            js, ys, base, a = j[seq], y[seq], np.zeros(len(size)), 0
            base[:] = w0[down]
            for e in ends:
                n, at = e - a, js[a:e]
                wj, vj = w[at], v[at]
                s = vj.sum(1)
                p = base[:n] + wj.sum(1) + 0.5 * ((s * s) - (vj * vj).sum(1)).sum(1)
                g = 0.02 * (np.minimum(np.maximum(p, low[:n]), high[:n]) - ys[a:e])
                base[:n] -= g
                w[at] = wj - (g[:, None] + 2e-4 * wj)
                v[at] = vj - (g[:, None, None] * (s[:, None] - vj) + 2e-4 * vj)
                w[-1], v[-1] = 0, 0  # stands for no column
                a = e
            w0[down] = base
            yield w0[of] + w[j].sum(1) + 0.5 * (v[j].sum(1) ** 2 - (v[j] ** 2).sum(1)).sum(1)

    def gibbs(j, y, names):  # noqa: ANN001, ANN202
        """One model; j holds its columns from 0 to names - 1, and names for none."""
        rng, noise = np.random.default_rng(seed), method == "mcmc"
        w0, w, v = 0.0, np.zeros(names + 1), np.concatenate([rng.normal(0, 0.1, (names, factors)), np.zeros((1, factors))])
        predict = lambda: w0 + w[j].sum(1) + 0.5 * (v[j].sum(1) ** 2 - (v[j] ** 2).sum(1)).sum(1)
        at = np.argsort(j, axis=None, kind="stable")[: (j < names).sum()]
        row, col = at // j.shape[1], j.reshape(-1)[at]
        count = np.bincount(col, minlength=names)
        first = np.r_[0, np.cumsum(count)]
        before = np.full(names, -1)
        np.maximum.at(before, col, np.c_[np.full(len(j), -1), j[:, :-1]].reshape(-1)[at])
        cuts = [0]
        for c, b in enumerate(before.tolist()):
            if b >= cuts[-1]:
                cuts.append(c)
        blocks = [(a, b, row[first[a] : first[b]], first[a:b] - first[a], count[a:b]) for a, b in zip(cuts, [*cuts[1:], names], strict=True) if a < b]
        for _ in range(rounds):
            e = y - predict()
            prec = rng.gamma((1 + len(y)) / 2, 2 / (1 + e @ e)) if noise else 1.0
            draw = lambda num, den: num / den + (rng.normal(size=np.shape(den)) / np.sqrt(den) if noise else 0.0)
            new = draw(prec * (e + w0).sum(), prec * len(y) + 1e-6)
            e += w0 - new
            w0 = float(new)
            for a, b, r, start, n in blocks:
                new = draw(prec * (np.add.reduceat(e[r], start) + n * w[a:b]), prec * n + 1.0)
                e[r] += np.repeat(w[a:b] - new, n)
                w[a:b] = new
            q = v[j].sum(1)
            for f in range(factors):
                for a, b, r, start, n in blocks:
                    old, qr = v[a:b, f].copy(), q[r, f]
                    h = qr - np.repeat(old, n)
                    new = draw(prec * np.add.reduceat(h * (e[r] + h * np.repeat(old, n)), start), prec * np.add.reduceat(h * h, start) + 10.0)
                    e[r] += h * np.repeat(old - new, n)
                    q[r, f] = qr + np.repeat(new - old, n)
                    v[a:b, f] = new
            yield predict()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, of, starts in _models(batches):
            lists, y = t["cols"].combine_chunks(), t["y"].to_numpy()
            of_cell = np.repeat(np.arange(len(y)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            code, names = _codes(lists.flatten(), of[of_cell], len(starts))
            total = int(names.sum())
            cell = np.unique(of_cell * max(1, total) + code)
            row, col = cell // max(1, total), cell % max(1, total)
            width = np.bincount(row, minlength=len(y))
            j = np.full((len(y), max(1, int(width.max()))), total)
            j[row, np.arange(len(row)) - (np.cumsum(width) - width)[row]] = col
            size = np.diff(np.r_[starts, len(y)])
            lo, hi = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
            if method == "sgd":
                fits = sgd(j, y, of, starts, size, names, lo, hi)
            else:
                own = [gibbs(np.where(j[a : a + n] < total, j[a : a + n] - c, k), y[a : a + n], int(k)) for a, n, c, k in zip(starts, size, np.cumsum(names) - names, names, strict=True)]
                fits = (np.concatenate(x) for x in zip(*own, strict=True))
            mean, out = np.zeros(len(y)), []
            for r, p in enumerate(fits):
                mean += (p - mean) / (r + 1)
                off = np.clip(mean if method == "mcmc" else p, lo[of], hi[of]) - y
                out.append(np.sqrt(np.add.reduceat(off * off, starts) / size))
            model = t["model"].take(pa.array(np.tile(starts, len(out)))).combine_chunks()
            yield pa.RecordBatch.from_arrays([model, pa.array(np.repeat(np.arange(len(out)), len(starts)), pa.int32()), pa.array(np.concatenate(out))], ["model", "round", "rmse"])

    ordered = rows.select(F.col("model").cast("long").alias("model"), "id", "cols", F.col("y").cast("double").alias("y")).repartition("model").sortWithinPartitions("model", "id", "cols", "y")
    return ordered.mapInArrow(run, "model long, round int, rmse double")


def pairwise_ranking(rows: DataFrame, factors: int = 8, rounds: int = 10, rate: float = 0.05, seed: int = 3) -> DataFrame:
    """(model, round, auc) of implicit factorization: each positive against one seeded random negative. rows(model, user, item).

    A step is one of many models at once, as they share nothing; a model's rows come in the order of users and items, so runs are alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, of, starts in _models(batches):
            u, users = _codes(t["user"].combine_chunks(), of, len(starts))
            i, items = _codes(t["item"].combine_chunks(), of, len(starts))
            size, first = np.diff(np.r_[starts, len(of)]), np.cumsum(items) - items
            down = np.argsort(-size, kind="stable")
            rngs = [np.random.default_rng(seed) for _ in size]
            drawn = [(r.normal(0, 0.1, (a, factors)), r.normal(0, 0.1, (b, factors))) for r, a, b in zip(rngs, users, items, strict=True)]
            p, q, b, out = np.concatenate([x for x, _ in drawn]), np.concatenate([x for _, x in drawn]), np.zeros(int(items.sum())), []
            for _ in range(rounds):
                orders, others = [], np.empty(len(of), np.int64)
                for m in down:
                    orders.append(o := rngs[m].permutation(size[m]))
                    others[o + starts[m]] = first[m] + rngs[m].integers(items[m], size=size[m])
                seq, ends = _steps(size[down], starts[down], orders)
                us, xs, zs, wins, s = u[seq], i[seq], others[seq], np.zeros(len(size), np.int64), 0
                for e in ends:
                    a, x, z = us[s:e], xs[s:e], zs[s:e]
                    pa_, qx, qz = p[a], q[x], q[z]
                    d = (pa_ * (qx - qz)).sum(1) + b[x] - b[z]
                    wins[: e - s] += d > 0
                    g = rate / (1 + np.exp(np.minimum(35.0, d)))
                    p[a] = pa_ + (g[:, None] * (qx - qz) - rate * 0.01 * pa_)
                    move = g[:, None] * pa_
                    q[x] = qx + (move - rate * 0.01 * qx)
                    qz = q[z]
                    q[z] = qz - (move + rate * 0.01 * qz)
                    b[x] += g
                    b[z] -= g
                    s = e
                won = np.empty(len(size))
                won[down] = wins
                out.append(won / size)
            model = t["model"].take(pa.array(np.tile(starts, rounds))).combine_chunks()
            yield pa.RecordBatch.from_arrays([model, pa.array(np.repeat(np.arange(rounds), len(starts)), pa.int32()), pa.array(np.concatenate(out))], ["model", "round", "auc"])

    ordered = rows.select(F.col("model").cast("long").alias("model"), "user", "item").repartition("model").sortWithinPartitions("model", "user", "item")
    return ordered.mapInArrow(run, "model long, round int, auc double")


def events(rows: DataFrame, cutoff: int = 1) -> DataFrame:
    """(context, outcome, n): identical events merged, those below the cutoff dropped. context is an array of predicates."""
    return rows.groupBy(F.array_sort("context").alias("context"), "outcome").agg(F.count("*").alias("n")).where(F.col("n") >= cutoff)


def maxent_predict(rows: DataFrame, theta: DataFrame) -> DataFrame:
    """(id, outcome, p): softmax over summed weights of rows(id, context); unknown predicates count for nothing."""
    outs = theta.select("outcome").distinct()
    x = rows.select("id", F.explode("context").alias("pred")).join(theta, "pred").groupBy("id", "outcome").agg(F.sum("theta").alias("s"))
    s = rows.select("id").distinct().crossJoin(F.broadcast(outs)).join(x, ["id", "outcome"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    top = s.withColumn("e", F.exp(F.col("s") - F.max("s").over(W.partitionBy("id"))))
    return top.select("id", "outcome", (F.col("e") / F.sum("e").over(W.partitionBy("id"))).alias("p"))


def best_outcome(p: DataFrame) -> DataFrame:
    return p.groupBy("id").agg(F.min(F.struct(-F.round("p", 9), "outcome")).alias("m")).select("id", "m.outcome")


def gis(ev: DataFrame, rounds: int = 10) -> tuple[DataFrame, list[float]]:
    """(pred, outcome, theta) by generalised iterative scaling over events(context, outcome, n), and the log-likelihood of each round."""
    ev = ev.withColumn("id", F.xxhash64("context"))
    c = float(ev.agg(F.max(F.size("context"))).first()[0] or 1)
    rows = ev.select("id", "context").distinct()
    weight = ev.groupBy("id").agg(F.sum("n").alias("n"))
    pred = rows.select("id", F.explode("context").alias("pred"))
    seen = ev.select("n", "outcome", F.explode("context").alias("pred")).groupBy("pred", "outcome").agg(F.sum("n").alias("obs"))
    theta = seen.select("pred", "outcome", F.lit(0.0).alias("theta"))
    likelihood = []
    for _ in range(rounds):
        p = maxent_predict(rows, theta)
        likelihood.append(float(ev.join(p, ["id", "outcome"]).agg(F.sum(F.col("n") * F.log("p"))).first()[0]))
        model = pred.join(p, "id").join(weight, "id").groupBy("pred", "outcome").agg(F.sum(F.col("n") * F.col("p")).alias("exp"))
        theta = cut(ev.sparkSession, theta.join(seen, ["pred", "outcome"]).join(model, ["pred", "outcome"]).select("pred", "outcome", (F.col("theta") + F.log(F.col("obs") / F.col("exp")) / c).alias("theta")))
    return theta, likelihood


def labeled_lda(docs: DataFrame, rounds: int = 20, alpha: float = 1.0, eta: float = 0.1, seed: int = 5) -> DataFrame:
    """(model, topic, term, n): collapsed Gibbs where a token's topic is one of its document's labels. docs(model, doc_id, labels, terms)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        pdf = pdf.sort_values("doc_id")
        topics = sorted({x for own in pdf.labels for x in own})
        terms = sorted({x for own in pdf.terms for x in own})
        ti, wi = {x: i for i, x in enumerate(topics)}, {x: i for i, x in enumerate(terms)}
        nt, tw = np.zeros(len(topics)), np.zeros((len(topics), len(terms)))
        state = []
        for labels, words in zip(pdf.labels, pdf.terms, strict=True):
            own, w = np.array([ti[x] for x in labels]), np.array([wi[x] for x in words], int)
            if not len(own):
                continue
            z = own[rng.integers(len(own), size=len(w))]
            np.add.at(tw, (z, w), 1)
            np.add.at(nt, z, 1)
            state.append((own, w, z, np.bincount(z, minlength=len(topics)).astype(float)))
        for _ in range(rounds):
            for own, w, z, dt in state:
                for k in range(len(w)):
                    t = z[k]
                    tw[t, w[k]] -= 1
                    nt[t] -= 1
                    dt[t] -= 1
                    p = (dt[own] + alpha) * (tw[own, w[k]] + eta) / (nt[own] + eta * len(terms))
                    t = own[np.searchsorted(np.cumsum(p), rng.random() * p.sum())]
                    z[k] = t
                    tw[t, w[k]] += 1
                    nt[t] += 1
                    dt[t] += 1
        i, j = np.nonzero(tw)
        return pd.DataFrame({"model": pdf.model.iloc[0], "topic": [topics[x] for x in i], "term": [terms[x] for x in j], "n": tw[i, j].astype(int)})

    return docs.groupBy("model").applyInPandas(run, "model long, topic string, term string, n long")


def word2vec(sentences: DataFrame, size: int = 16, least: int = 5):  # noqa: ANN201
    """Skip-gram vectors of the words of sentences(terms)."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=size, minCount=least, inputCol="terms", outputCol="vector", seed=1, maxIter=1, windowSize=5).fit(sentences)


def linear_svm(rows: DataFrame, features: int = 1 << 12):  # noqa: ANN201
    """A linear support vector classifier over hashed terms of rows(terms, label)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import HashingTF

    return Pipeline(stages=[HashingTF(inputCol="terms", outputCol="features", numFeatures=features), LinearSVC(maxIter=10)]).fit(rows)


def clicks(ev: DataFrame, positive: Column) -> DataFrame:
    """Rows for the online learners from events: one model an hour-of-day quarter, features of user, hour and type of day."""
    hour = F.hour("ts")
    feats = F.array(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")), F.concat(F.lit("h"), hour.cast("string")), F.concat(F.lit("d"), F.dayofweek("ts").cast("string")))
    return ev.select((F.col("user_id") % 4).cast("long").alias("model"), "ts", F.col("event_id").alias("id"), feats.alias("feats"), positive.cast("int").alias("y"))


def lbfgs(ev: DataFrame, rounds: int = 30, prior: float = 1e-4) -> DataFrame:
    """(pred, outcome, theta) of events(context, outcome, n) by L-BFGS on the multinomial likelihood."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer, StringIndexer

    stages = [CountVectorizer(inputCol="context", outputCol="features", binary=True), StringIndexer(inputCol="outcome", outputCol="label"), LogisticRegression(maxIter=rounds, regParam=prior, family="multinomial", weightCol="n", fitIntercept=False, standardization=False)]
    fitted = Pipeline(stages=stages).fit(ev.withColumn("n", F.col("n").cast("double")))
    words, outs, m = fitted.stages[0].vocabulary, fitted.stages[1].labels, fitted.stages[2].coefficientMatrix.toArray()
    return ev.sparkSession.createDataFrame([(w, o, float(m[j, i])) for i, w in enumerate(words) for j, o in enumerate(outs)], "pred string, outcome string, theta double")


def log_posterior(counts: DataFrame, alpha: float = 1.0, eta: float = 0.1) -> DataFrame:
    """(topic, term, logp) = ln (n + eta) / (N + eta V) of labeled_lda() counts(topic, term, n)."""
    c = counts.groupBy("topic", "term").agg(F.sum("n").alias("n"))
    total = c.groupBy("topic").agg(F.sum("n").alias("of"))
    v = c.agg(F.countDistinct("term").alias("v"))
    return c.join(total, "topic").crossJoin(F.broadcast(v)).select("topic", "term", F.log((F.col("n") + eta) / (F.col("of") + eta * F.col("v"))).alias("logp"))


def factorize(rows: DataFrame, factors: int = 4, rounds: int = 20, rate: float = 0.05):  # noqa: ANN201
    """One factorization machine over all rows(cols, y), by distributed gradients; returns (w0, w(col, w), v(col, f, v))."""
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.regression import FMRegressor

    spark = rows.sparkSession
    words = CountVectorizer(inputCol="cols", outputCol="features", binary=True, vocabSize=1 << 24).fit(rows)
    m = FMRegressor(featuresCol="features", labelCol="y", factorSize=factors, maxIter=rounds, stepSize=rate, seed=3).fit(words.transform(rows))
    w = spark.createDataFrame([(c, float(x)) for c, x in zip(words.vocabulary, m.linear.toArray(), strict=True)], "col string, w double")
    v = spark.createDataFrame([(c, f, float(x)) for c, own in zip(words.vocabulary, m.factors.toArray(), strict=True) for f, x in enumerate(own)], "col string, f int, v double")
    return m.intercept, w, v


def categorize(titles: DataFrame, theta: DataFrame, direct: DataFrame, ranges: DataFrame, most: int = 15) -> DataFrame:
    """(id, category) of titles(id, path, title, price).

    direct(path, category) decides where it knows the normalised path; else the best outcome over the first `most` tokens of the path's last level and
    the title, unless the price lies outside ranges(category, low, high).
    """
    from delver.functions.text import tokens

    path = F.lower(F.regexp_replace(F.trim("path"), r"\s*[>/]+\s*", ">"))
    t = titles.select("id", "title", "price", path.alias("path"))
    known = t.join(direct.select(F.lower("path").alias("path"), "category"), "path").select("id", "category")
    rest = t.join(known.select("id"), "id", "left_anti")
    context = F.slice(tokens(F.concat_ws(" ", F.substring_index("path", ">", -1), "title")), 1, most)
    guess = best_outcome(maxent_predict(rest.select("id", context.alias("context")), theta)).join(rest.select("id", "price"), "id").withColumnRenamed("outcome", "category")
    ok = guess.join(ranges, "category", "left").where("low is null or price is null or price between low and high")
    return known.union(ok.select("id", "category"))
