"""What the operators of this subpackage share: shared-folder tables, word arrays, hashes, components.

Texts are handled as UTF-8 bytes in numpy. A chunk of documents becomes one byte buffer with a
separator after each text, so that one vectorised pass serves many documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delver.operators.graph import cut, shared_dir, stored  # noqa: F401

#: Bytes of text that one vectorised pass takes; a longer text is a chunk of its own.
CHUNK_BYTES = 2_000_000

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW = np.ones(1, U64)
_IPOW = np.ones(1, U64)

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` over lower-cased UTF-8: digits, a-z and every byte of a non-ASCII letter.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fresh(columns: list[str], *names: str) -> list[str]:
    """names, each with underscores put before it until it clashes with no column (nor with another one, whatever the case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def chunks(lengths: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose lengths add up to about `most`."""
    at, ends = 0, np.cumsum(lengths)
    while at < len(lengths):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield at, to
        at = to


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as bytes; null becomes empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse to the powers 0..n-1, modulo 2^64."""
    global _POW, _IPOW
    if len(_POW) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POW, _IPOW = np.full(size, _BASE, U64), np.full(size, _INV, U64)
        _POW[0] = _IPOW[0] = 1
        np.multiply.accumulate(_POW, out=_POW)
        np.multiply.accumulate(_IPOW, out=_IPOW)
    return _POW[:n], _IPOW[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased buffer, word starts, word ends, document of each word, 64-bit hash of each word)."""
    raw = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(raw.translate(LOWER), np.uint8)
    mask = WORD[buf]
    edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    if mask[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[::2], edge[1::2]  # the buffer ends in a separator
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))))
    p, ip = powers(len(buf))
    sums = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * p, out=sums[1:])
    return buf, starts, ends, doc, mix((sums[ends] - sums[starts]) * ip[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words, in order; the caller drops those that cross documents."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out += words[j : j + n] * U64(pow(0xD6E8FEB86659FD93, 2 * j + 1, 1 << 64))
    return mix(out)


class Forest:
    """Union-find over hashable keys; the smallest key of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if a > b:
                a, b = b, a
            self.up[b] = a
            self.up.setdefault(a, a)


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the edges of one partition, in pieces of bounded size."""

    def out(f: Forest) -> pa.RecordBatch:
        pairs = [(x, r) for x in f.up if (r := f.find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    f = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            f.union(a, b)
        if len(f.up) > 2_000_000:
            yield out(f)
            f = Forest()
    yield out(f)


def components(spark: SparkSession, edges: DataFrame, one_task_rows: int = 2_000_000) -> DataFrame:
    """(node, component) of undirected edges (a, b): component is the smallest node reachable.

    Each partition first contracts its edges to a forest. While more than one_task_rows edges are
    left, rounds of hooking every node to its smallest neighbour, pointer jumping and relabelling
    shrink the graph (partial aggregation absorbs hub nodes); the rest, of bounded size, is one
    task. Nodes without an edge are not returned.
    """
    edges = cut(spark, edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInArrow(_contract, "a long, b long"))
    names = None
    while (n := edges.count()) > one_task_rows:
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("b"))
        for _ in range(2):  # pointer jumping
            far = up.select(F.col("a").alias("b"), F.col("b").alias("c"))
            up = cut(spark, up.join(far, "b", "left").select("a", F.coalesce("c", "b").alias("b")))
        names = up.select(F.col("a").alias("node"), F.col("b").alias("at")) if names is None else cut(spark, names.join(up.select(F.col("a").alias("at"), "b"), "at", "left").select("node", F.coalesce("b", "at").alias("at")))
        left = up.select("a", F.col("b").alias("a2"))
        right = up.select(F.col("a").alias("b"), F.col("b").alias("b2"))
        edges = cut(spark, edges.join(left, "a").join(right, "b").where("a2 <> b2").select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct().mapInArrow(_contract, "a long, b long"))
    last = edges.coalesce(1).mapInArrow(_labels, "node long, component long")
    if names is None:
        return last
    return names.join(last.withColumnRenamed("node", "at"), "at", "left").select("node", F.coalesce("component", "at").alias("component"))


def _labels(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            f.union(a, b)
    nodes = list(f.up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([f.find(x) for x in nodes], pa.int64())], ["node", "component"])
