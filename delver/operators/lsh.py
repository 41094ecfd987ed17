"""Locality-sensitive hashing over array columns, with hash-derived matrices so that every run is identical."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from delver.functions.stats import l2


def matrix(rows: int, dim: int, kind: str = "gauss", seed: int = 17) -> list[list[float]]:
    """Fixed projections, rounded to four decimals: Gaussian (L2) or Cauchy (L1)."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, dim)) if kind == "gauss" else rng.standard_cauchy((rows, dim))
    return np.round(x, 4).tolist()


def dot(v: Column, a: list[float]) -> Column:
    return F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in a]), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def p_stable(v: Column, a: list[float], b: float, width: float) -> tuple[Column, Column]:
    """(bucket, fractional remainder) of (a.x + b) / width."""
    x = (dot(v, a) + b) / width
    return F.floor(x), x - F.floor(x)


def hyperplane(v: Column, a: list[float]) -> tuple[Column, Column]:
    """(sign bit, distance from the plane)."""
    x = dot(v, a)
    return (x > 0).cast("int"), F.abs(x)


def threshold(v: Column, dim: int, t: float) -> Column:
    return (F.element_at(v, dim + 1) >= t).cast("int")


def repeat(parts: list[Column], base: int, modulus: int) -> Column:
    """Polynomial composite of several hashes, folded modulo `modulus`."""
    x = F.lit(0).cast("long")
    for p in parts:
        x = F.pmod(x * base + p.cast("long"), F.lit(modulus))
    return x


def xor(parts: list[Column]) -> Column:
    x = parts[0].cast("long")
    for p in parts[1:]:
        x = x.bitwiseXOR(p.cast("long"))
    return x


def sketch(v: Column, planes: list[list[float]]) -> Column:
    """Up to 62 hyperplane signs in a long."""
    return sum((F.when(dot(v, a) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, a in enumerate(planes)), F.lit(0).cast("long"))


def tables(vectors: DataFrame, planes: list[list[list[float]]]) -> DataFrame:
    """(id, tab, bucket): one sign bucket for each table of planes."""
    own = F.array(*[F.struct(F.lit(i).alias("tab"), sketch(F.col("v"), p).alias("bucket")) for i, p in enumerate(planes)])
    return vectors.select("id", F.explode(own).alias("t")).select("id", "t.tab", "t.bucket")


def query(index: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, id, dist, rank): the k nearest by L2 among rows that share a bucket in some table."""
    c = queries.select(F.col("id").alias("query_id"), "tab", "bucket").join(index, ["tab", "bucket"]).where("id <> query_id").select("query_id", "id").distinct()
    q = vectors.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    d = c.join(vectors, "id").join(q, "query_id").withColumn("dist", F.round(l2(F.col("v"), F.col("q")), 5))
    return top_k(d, k)


def top_k(d: DataFrame, k: int) -> DataFrame:
    return d.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.asc_nulls_last("dist"), "id"))).where(F.col("rank") <= k).select("query_id", "id", "dist", "rank")


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall) = (hits + 1) / (k + 1)."""
    hit = truth.join(found.select("query_id", "id", F.lit(1).alias("h")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.round((F.count("h") + 1) / (k + 1.0), 6).alias("recall"))


def nearest(c: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k nearest by L2 among candidates c(query_id, id)."""
    q = vectors.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return top_k(c.join(vectors, "id").join(q, "query_id").withColumn("dist", F.round(l2(F.col("v"), F.col("q")), 5)), k)


def forest_query(vectors: DataFrame, queries: DataFrame, planes: list, least: int, k: int) -> DataFrame:
    """LSH forest: in each tree, candidates share the longest sign prefix under which a query has more than `least` points.

    planes is one tree's planes or a list of trees.
    """
    trees = np.array(planes if isinstance(planes[0][0], list) else [planes], float)
    n = trees.shape[1]

    def labelled(frames):  # noqa: ANN001, ANN202
        for f in frames:
            if len(f):
                up = np.einsum("nd,tpd->ntp", np.array(f.v.tolist(), float), trees) > 0
                label = ["".join("01"[int(x)] for x in row) for row in up.reshape(-1, n)]
                yield pd.DataFrame({"id": np.repeat(f.id.to_numpy(), len(trees)), "tree": np.tile(np.arange(len(trees)), len(f)), "label": label})

    def prefixes(df: DataFrame) -> DataFrame:
        p = df.select("id", "v").mapInPandas(labelled, "id long, tree int, label string")
        return p.select("id", "tree", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("depth"), "label").select("id", "tree", "depth", F.expr("substr(label, 1, depth)").alias("prefix"))

    by = prefixes(vectors)
    counts = by.groupBy("tree", "depth", "prefix").agg(F.count("*").alias("n"))
    q = prefixes(queries).withColumnRenamed("id", "query_id")
    deep = q.join(counts, ["tree", "depth", "prefix"]).where(F.col("n") > least).groupBy("query_id", "tree").agg(F.max(F.struct("depth", "prefix")).alias("m")).select("query_id", "tree", "m.depth", "m.prefix")
    return nearest(deep.join(by, ["tree", "depth", "prefix"]).where("id <> query_id").select("query_id", "id").distinct(), vectors, k)


def multi_probe(vectors: DataFrame, queries: DataFrame, a: list, b: list[float], width: float, probes: int, k: int) -> DataFrame:
    """p-stable buckets; a query also visits the `probes` perturbed buckets of least expected score (squared distance to the border).

    a is one table's projections or a list of tables.
    """
    tables = np.array(a if isinstance(a[0][0], list) else [a], float)
    m = tables.shape[1]

    def slots(f: pd.DataFrame) -> np.ndarray:
        return (np.einsum("nd,tmd->ntm", np.array(f.v.tolist(), float), tables) + np.array(b)) / width

    def coded(frames):  # noqa: ANN001, ANN202
        for f in frames:
            if len(f):
                h = np.floor(slots(f)).astype(int).reshape(-1, m)
                yield pd.DataFrame({"id": np.repeat(f.id.to_numpy(), len(tables)), "tab": np.tile(np.arange(len(tables)), len(f)), "bucket": [",".join(map(str, x)) for x in h]})

    def probe(frames):  # noqa: ANN001, ANN202
        for f in frames:
            out = []
            for i, row in zip(f.id, slots(f) if len(f) else [], strict=True):
                for t, x in enumerate(row):
                    h, d = np.floor(x).astype(int), x - np.floor(x)
                    moves = sorted([(float(y) ** 2, j, -1) for j, y in enumerate(d)] + [((1 - float(y)) ** 2, j, 1) for j, y in enumerate(d)])[: 2 * m]
                    sets = [(sum(s[0] for s in c), c) for r in (1, 2, 3) for c in combinations(moves[:8], r) if len({s[1] for s in c}) == r]
                    for _, c in [(0.0, ())] + sorted(sets, key=lambda x: (x[0], [s[1:] for s in x[1]]))[:probes]:
                        y = h.tolist()
                        for _, j, step in c:
                            y[j] += step
                        out.append((int(i), t, ",".join(map(str, y))))
            yield pd.DataFrame(out, columns=["query_id", "tab", "bucket"])

    index = vectors.select("id", "v").mapInPandas(coded, "id long, tab int, bucket string")
    c = queries.select("id", "v").mapInPandas(probe, "query_id long, tab int, bucket string").join(index, ["tab", "bucket"]).where("id <> query_id").select("query_id", "id").distinct()
    return nearest(c, vectors, k)


def spectral(v: Column, mean: list[float], axes: list[list[float]], modes: list[list[float]]) -> Column:
    """Bits of a spectral hash: signs of products of sin(pi/2 + mode * projection)."""
    centred = F.zip_with(v, F.array(*[F.lit(float(x)) for x in mean]), lambda x, y: x.cast("double") - y)
    proj = [dot(centred, a) for a in axes]
    bit = lambda m: F.lit(1.0) if not m else math.prod([F.sin(F.lit(math.pi / 2) + p * float(w)) for p, w in zip(proj, m, strict=True)], start=F.lit(1.0))
    return sum((F.when(bit(m) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i, m in enumerate(modes)), F.lit(0).cast("long"))


def tail(h: Column, modulus: int) -> Column:
    return F.pmod(h.cast("long"), F.lit(modulus))


def lowest_bit(h: Column) -> Column:
    return h.cast("long").bitwiseAND(F.lit(1).cast("long"))


def delta_lowest_bit(h: Column, remainder: Column) -> tuple[Column, Column]:
    """(lowest bit, distance from where it flips)."""
    return lowest_bit(h), F.least(remainder, 1 - remainder)


def delta_xor(parts: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Xor of several bits, and the least of their distances."""
    return xor([p for p, _ in parts]), F.least(*[d for _, d in parts]) if len(parts) > 1 else parts[0][1]


def asymmetric_distance(bits: Column, deltas: Column, other: Column) -> Column:
    """Sum of the query's distances (array, lowest bit first) over the bits in which the sketches differ."""
    x = bits.bitwiseXOR(other)
    return F.aggregate(F.transform(deltas, lambda d, i: F.when(F.getbit(x, i) == 1, d).otherwise(0.0)), F.lit(0.0), lambda s, v: s + v)


def histograms(sets: DataFrame, planes: list[list[float]], bins: int) -> DataFrame:
    """(id, bin, n): how many vectors of each set(id, v) fall into each of `bins` buckets of their signs."""
    return sets.select("id", tail(sketch(F.col("v"), planes), bins).alias("bin")).groupBy("id", "bin").agg(F.count("*").alias("n"))


def statistics(values: DataFrame) -> DataFrame:
    """One row: n, mean, std, low, high of values(x)."""
    return values.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))


def tune(low: int, high: int, reaches) -> int:  # noqa: ANN001
    """The smallest parameter in [low, high] for which reaches(parameter) holds, which must be monotone; high if none does."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if reaches(mid) else (mid + 1, high)
    return low


def posteriori(train: DataFrame, tables: int) -> DataFrame:
    """(tab, flip, p): how often true neighbours train(tab, flip) stand in the bucket that a flip of bits leads to, out of `tables` rows each; the most likely first."""
    n = train.groupBy("tab").agg(F.count("*").alias("of"))
    c = train.groupBy("tab", "flip").agg(F.count("*").alias("n"))
    return c.join(n, "tab").select("tab", "flip", (F.col("n") / F.col("of")).alias("p")).withColumn("rank", F.row_number().over(W.partitionBy("tab").orderBy(F.desc("p"), "flip"))).where(F.col("rank") <= tables)
