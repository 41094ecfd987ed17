"""All pairs of two sets of vectors, as pairs of blocks: a task holds one block of each side, and nothing but results is shuffled.

Sums run in the order of the column expressions of delver.functions.stats, so values are theirs to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 1024


def whole(v: str) -> Column:
    """Whether a vector is there and has no missing elements; others are left to the column expressions."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull()), F.lit(False))


def rounded(x: np.ndarray, places: int = 5) -> np.ndarray:
    """As round() of a double column: half up in the shortest decimal form."""
    scale = 10.0**places
    with np.errstate(all="ignore"):
        y = x * scale
        out = np.floor(y + 0.5) / scale
        near = np.abs(y - np.floor(y) - 0.5) < 1e-4
    near |= np.abs(y) > 1e9
    for i in np.flatnonzero(near):
        if np.isfinite(x.flat[i]):
            out.flat[i] = float(Decimal(repr(float(x.flat[i]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return np.where(np.isfinite(x), out, x)


def _dots(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Products of all rows, summed from the first element on."""
    s = np.zeros((len(x), len(a)))
    for i in range(min(x.shape[1], a.shape[1])):
        s += x[:, i, None] * a[None, :, i]
    return s


def packed(v: DataFrame, planes: list | None = None, rows: int = ROWS) -> DataFrame:
    """(ids, dim, data, codes) from v(id, v): blocks of equally long vectors; codes are a row's sign bucket in each table of planes."""
    tabs = None if planes is None else np.array(planes, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, flat, ids = pc.list_value_length(b.column(1)).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float), b.column(0).to_numpy()
            first, out = np.cumsum(size) - size, []
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                for k in range(0, len(at), rows):
                    own = at[k : k + rows]
                    x = flat[first[own, None] + np.arange(dim)]
                    code = b"" if tabs is None else ((_dots(x, tabs.reshape(-1, tabs.shape[2])) > 0).reshape(len(x), *tabs.shape[:2]) @ (1 << np.arange(tabs.shape[1]))).astype(np.int64).tobytes()
                    out.append((ids[own].astype(np.int64).tobytes(), dim, x.tobytes(), code))
            for row in out:
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.binary(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["ids", "dim", "data", "codes"])

    return v.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "ids binary, dim int, data binary, codes binary")


def paired(q: DataFrame, v: DataFrame, fn: Callable, schema: str, planes: list | None = None) -> DataFrame:
    """fn over an iterator of (query ids, queries, their codes, ids, vectors, their codes), one pair of blocks each, giving record batches."""
    own = lambda d, s, n: packed(d.repartition(n) if n else d.repartition("id"), planes).select(*[F.col(c).alias(s + c) for c in ("ids", "dim", "data", "codes")])

    def read(x: dict, s: str, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(x[f"{s}ids"][i].as_py(), np.int64)
        return ids, np.frombuffer(x[f"{s}data"][i].as_py()).reshape(len(ids), -1), np.frombuffer(x[f"{s}codes"][i].as_py(), np.int64).reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():  # noqa: ANN202
            for b in batches:
                x = dict(zip(b.schema.names, b.columns, strict=True))
                for i in range(b.num_rows):
                    yield *read(x, "q", i), *read(x, "v", i)

        yield from fn(each())

    return own(v, "v", 0).hint("shuffle_replicate_nl").crossJoin(own(q, "q", 4)).mapInArrow(run, schema)


def _over(x: np.ndarray, y: np.ndarray, step: Callable) -> np.ndarray:
    """step(sum, difference or pair of columns) over the elements of all pairs of rows, a few rows at a time so that sums stay in the cache."""
    out = np.zeros((len(x), len(y)))
    yt = np.ascontiguousarray(y.T)
    for a in range(0, len(x), 32):
        s = out[a : a + 32]
        for i in range(min(x.shape[1], y.shape[1])):
            step(s, x[a : a + 32, i, None], yt[i])
    return out


def _norm(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x))
    for i in range(x.shape[1]):
        s += x[:, i] * x[:, i]
    return np.sqrt(s)


def _add(f: Callable) -> Callable:
    def step(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        s += f(a, b)

    return step


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    d *= d
    return d


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.abs(d, out=d)


def _values(kind: str, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray | bool]:
    """(values, where they are null)."""
    other = x.shape[1] != y.shape[1]
    with np.errstate(all="ignore"):
        if kind == "cosine":
            a, b = _norm(x), _norm(y)
            return _over(x, y, _add(np.multiply)) / a[:, None] / b, ~((a[:, None] > 0) & (b > 0)) | other
        if kind == "l2":
            return np.sqrt(_over(x, y, _add(_square))), other
        if kind == "inverse_l1":
            s = _over(x, y, _add(_gap))
            return np.where(s == 0, 100.0, 1 / s), other
        return _over(x, y, lambda s, a, b: np.maximum(s, _gap(a, b), out=s)), min(x.shape[1], y.shape[1]) == 0


def measured(v: DataFrame, q: DataFrame, kind: str, expression: Callable, places: int = 5) -> DataFrame:
    """(a, b, v): kind of every query q(id, v) against every other vector v(id, v), rounded. expression is the same over columns, for vectors with gaps."""

    def run(pairs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for qi, x, _, vi, y, _ in pairs:
            value, null = _values(kind, x, y)
            keep = (qi[:, None] != vi).reshape(-1)
            gone = np.broadcast_to(null, value.shape).reshape(-1)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, len(vi))[keep]), pa.array(np.tile(vi, len(qi))[keep]), pa.array(rounded(value.reshape(-1)[keep], places), mask=gone)], ["a", "b", "v"])

    every = paired(q.where(whole("v")), v.where(whole("v")), run, "a long, b long, v double")
    return every.union(_gaps(v, q, lambda a, b: expression(a, b), places))


def _gaps(v: DataFrame, q: DataFrame, expression: Callable, places: int) -> DataFrame:
    """The pairs of which a vector is missing or has missing elements."""
    a = q.select(F.col("id").cast("long").alias("a"), F.col("v").alias("x"))
    b = v.select(F.col("id").cast("long").alias("b"), F.col("v").alias("y"))
    some = b.crossJoin(F.broadcast(a.where(~whole("x")))).union(F.broadcast(b.where(~whole("y"))).crossJoin(a.where(whole("x"))).select("b", "y", "a", "x"))
    return some.where("a <> b").select("a", "b", F.round(expression(F.col("x"), F.col("y")), places).alias("v"))


def _least(query: np.ndarray, ids: np.ndarray, dist: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each query, missing distances after all others."""
    order = np.lexsort((ids, dist, null, query))
    q = query[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    return order[np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < k]


def nearest(v: DataFrame, q: DataFrame, k: int, planes: list | None = None, places: int = 5) -> DataFrame:
    """(query_id, id, dist): at least the k nearest others by rounded L2 of each query; with planes, of those that share a bucket of some table with it, for which vectors with gaps have none."""
    from delver.functions.stats import l2

    def run(pairs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2], mask=x[3])], ["query_id", "id", "dist"])
        for qi, x, qc, vi, y, vc in pairs:
            keep = qi[:, None] != vi
            if planes is not None:
                met = np.zeros(keep.shape, bool)
                for t in range(qc.shape[1]):
                    met |= qc[:, t, None] == vc[:, t]
                keep &= met
            other = x.shape[1] != y.shape[1]
            if not other and len(vi) > k:
                qn, vn = (x * x).sum(1), (y * y).sum(1)
                with np.errstate(all="ignore"):  # the distance as a product, close enough to leave out what can't be among the k nearest
                    d = np.sqrt(np.maximum(qn[:, None] + vn - 2 * (x @ y.T), 0))
                if np.isfinite(d).all():
                    d[~keep] = np.inf
                    keep &= d <= np.partition(d, k - 1, axis=1)[:, k - 1, None] + 3 * 10.0**-places + 1e-6 * np.sqrt(qn.max() + vn.max())
            a, b = np.nonzero(keep)
            s = np.zeros(len(a))
            for i in range(0 if other else x.shape[1]):
                e = x[a, i] - y[b, i]
                s += e * e
            held.append((qi[a], vi[b], rounded(np.sqrt(s), places), np.full(len(a), other)))
            n += len(a)
            if n > 1 << 20:
                c = [np.concatenate(z) for z in zip(*held, strict=True)]
                best = _least(*c, k)
                held, n = [tuple(z[best] for z in c)], len(best)
                if n > 1 << 19:
                    yield out(held[0])
                    held, n = [], 0
        if n:
            c = [np.concatenate(z) for z in zip(*held, strict=True)]
            best = _least(*c, k)
            yield out([z[best] for z in c])

    found = paired(q.where(whole("v")), v.where(whole("v")), run, "query_id long, id long, dist double", planes)
    if planes is not None:
        return found
    return found.union(_gaps(v, q, l2, places))
