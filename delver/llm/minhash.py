"""Weighted near-duplicate detection with dart-thrown MinHash signatures (after Christiani, DartMinHash, 2020).

A document is a weighted set: its word pairs, weighted by how often they occur (a one-word text: that word).
Element i with weight x_i owns the strip 0 <= w < x_i of the plane (w, rank). Every unit square of a strip
gets a Poisson(1) number of darts, placed by hashes of (element, weight cell, rank cell) alone, so two
documents that share an area share its darts. Darts of rank below theta = t/|x| are looked at, t = k ln k + 4k;
each belongs to one of k coordinates, and a coordinate keeps its earliest. A document that left a coordinate
empty throws again with theta doubled. Two documents agree on a coordinate with the probability of their
weighted Jaccard similarity.

Documents with one signature form a class. Classes meet in banded buckets; buckets with the same members
count once. Inside a bucket all signatures are held against each other, in blocks, and only a spanning forest of
the verified links and a count for each class leave the task, so a hot group never sends all its pairs. A link
is counted in the first band that its classes share. A bucket of more than `block` classes is split into blocks,
and each pair of blocks is a group of its own.

A null, empty or blank text links with nothing; a text without words links with its exact copies only; a
null doc_id is a group of its own. Every row is judged by its own text: rows of one doc_id with different texts are
in the groups of their texts, repeated rows are copies. Of a group the row of the smallest (doc_id, hash of
text) is kept. An empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delver.llm.common import U64, chunks, components, gram_hashes, mix, stored, utf8, word_table

BANDS, ROWS = 64, 3  # of the pairs that just reach SIMILARITY, 3.4e-8 share no band
K = BANDS * ROWS
SIMILARITY = 0.55
BLOCK = 8192
BITMAP = 27
NUMBER_AT = 57  # a bucket's name is its band's number above so many bits of hash
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])
_UNIT = 2.0**-53
_STEP = U64(0x9E3779B97F4A7C15)


def elements(words: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, weight): pairs of neighbouring words with their counts; a lone word stands for itself."""
    n = np.bincount(doc, minlength=n_docs)
    pair = gram_hashes(words, 2)
    inside = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) > 1 else np.zeros(0, np.int64)
    lone = np.flatnonzero(n[doc] == 1) if len(doc) else np.zeros(0, np.int64)
    d = np.concatenate((doc[inside], doc[lone]))
    e = np.concatenate((pair[inside], words[lone]))
    key = mix(e + d.astype(U64) * _STEP)  # a document's own cell; equal keys are equal elements
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(order) else order
    count = np.diff(np.concatenate((first, [len(order)])))
    at = order[first]
    back = np.argsort(d[at], kind="stable")
    return d[at][back], e[at][back], count[back].astype(float)


def _throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, theta: np.ndarray, best: np.ndarray, k: int) -> None:
    """Lowers best[doc * k + coordinate] to the earliest dart: float bits of the rank above 32 bits of its name."""
    cells = np.ceil(weight).astype(np.int64)
    which = np.repeat(np.arange(len(doc)), cells)
    j = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    ranks = np.ceil(theta).astype(np.int64)[doc[which]]
    region = np.repeat(np.arange(len(which)), ranks)
    rho = (np.arange(len(region)) - np.repeat(np.cumsum(ranks) - ranks, ranks)).astype(U64)
    cell = mix(element[which] + (j + 1).astype(U64) * _STEP)
    g = mix(cell[region] ^ ((rho + U64(1)) * U64(0xD6E8FEB86659FD93)))
    n = np.searchsorted(_POISSON, (g >> U64(11)) * _UNIT, "right")
    dart = np.repeat(np.arange(len(region)), n)
    i = (np.arange(len(dart)) - np.repeat(np.cumsum(n) - n, n)).astype(U64)
    h = mix(g[dart] + (i + U64(1)) * _STEP)
    rank = rho[dart] + (h >> U64(11)) * _UNIT
    own = which[region[dart]]
    ok = rank < theta[doc[own]]
    h, rank, own, cell_j = mix(h[ok]), rank[ok], own[ok], j[region[dart[ok]]]
    part = weight[own] - cell_j < 1
    if part.any():  # the last cell of a fractional weight is only partly covered
        ok = ~part | ((mix(h + _STEP) >> U64(11)) * _UNIT < weight[own] - cell_j)
        h, rank, own = h[ok], rank[ok], own[ok]
    key = (rank.astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (h & U64(0xFFFFFFFF))
    np.minimum.at(best, doc[own] * k + ((h >> U64(32)) % U64(k)).astype(np.int64), key)


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int = K) -> np.ndarray:
    """n_docs x k uint16 names of the earliest darts; rows of documents without weight are 0. doc is sorted, element is a mixed hash."""
    total = np.bincount(doc, weight, n_docs)
    t = k * math.log(k) + 4 * k
    none = U64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n_docs * k, none, U64)
    theta = np.zeros(n_docs)
    theta[total > 0] = t / total[total > 0]
    todo = total > 0
    while todo.any():
        some = todo[doc]
        _throw(doc[some], element[some], weight[some], theta, best, k)
        todo &= (best.reshape(n_docs, k) == none).any(1)
        theta[todo] *= 2
    out = (mix(best) >> U64(48)).astype(np.uint16).reshape(n_docs, k)
    out[total <= 0] = 0
    return out


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column(1))
        for a, b in chunks(np.fromiter(map(len, texts), np.int64, len(texts)), 1_000_000):
            _, _, _, doc, words = word_table(texts[a:b])
            d, e, w = elements(words, doc, b - a)
            sig = signatures(d, e, w, b - a)
            n = np.bincount(doc, minlength=b - a).tolist()
            k1, k2, s = [], [], []
            for i, text in enumerate(texts[a:b]):
                raw = sig[i].tobytes() if n[i] else None
                blank = not n[i] and not text.decode().strip()
                x = None if blank else xxhash.xxh3_128_intdigest(raw if n[i] else b"\0" + text)
                k1.append(None if x is None else (x >> 64) - (1 << 63))
                k2.append(None if x is None else (x & ((1 << 64) - 1)) - (1 << 63))
                s.append(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(s, pa.binary())], ["doc_id", "tag", "k1", "k2", "sig"])


def _bands(known=None):  # noqa: ANN001, ANN202
    """(band, class_id); with a bitmap, only bands whose bit is set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(U64)
                h = np.zeros(sig.shape[:2], U64) + np.arange(BANDS, dtype=U64) * _STEP
                for j in range(ROWS):
                    h = mix(h ^ sig[:, :, j]) + _STEP
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
                h = ((np.arange(BANDS, dtype=U64) << U64(NUMBER_AT)) | (h >> U64(64 - NUMBER_AT))).ravel()
                if known is not None:
                    own = h & U64((1 << BITMAP) - 1)
                    some = (known.value[(own >> U64(6)).astype(np.int64)] >> (own & U64(63))) & U64(1) == 1
                    h, ids = h[some], ids[some]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids, pa.int64())], ["band", "class_id"])

    return run


def _bitmap(buckets: DataFrame) -> np.ndarray:
    """2^BITMAP bits, those of the buckets' names set: a filter of fixed size that lets no member go."""
    own = F.col("band").bitwiseAND(F.lit((1 << BITMAP) - 1))
    bit = F.expr("shiftleft(1L, cast(band & 63 as int))")
    words = buckets.select(F.shiftright(own, 6).alias("w"), bit.alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits")).toPandas()  # 2^(BITMAP - 6) rows at most
    out = np.zeros(1 << (BITMAP - 6), U64)
    out[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(U64)
    return out


def links(ids: np.ndarray, sig: np.ndarray, part: np.ndarray, number: int, similarity: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """The links (share of equal coordinates >= similarity) of one pair of blocks: their spanning forest, and how many each row has.

    Where there are two parts, only rows of different parts are held against each other. A pair that agrees
    on a band below `number` was counted there and is passed over, so that every link counts once over all buckets.
    """
    out: list[tuple[int, int]] = []
    degree = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    split = len(ids) > 0 and part.min() != part.max()
    band = sig.reshape(len(ids), BANDS, ROWS)
    for x in range(len(ids) - 1):
        rest = np.arange(x + 1, len(ids))
        if split:
            rest = rest[part[rest] != part[x]]
        for b in range(number):
            if not len(rest):
                break
            rest = rest[(band[rest, b] != band[x, b]).any(1)]
        linked = rest[(sig[rest] == sig[x]).mean(1) >= similarity - 1e-9]
        degree[x] += len(linked)
        degree[linked] += 1
        trees, first = np.unique(root[linked], return_index=True)
        new = trees != root[x]
        if new.any():
            out += [(int(ids[x]), int(ids[y])) for y in linked[first[new]]]
            root[np.isin(root, trees[new])] = root[x]
    return out, degree


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, class_id (smallest doc_id with that signature), n_copies
    (rows of the class), n_links (classes that it is linked to), group_id (smallest doc_id of
    the group), kept (whether the row stands for its group) and tag (hash of the text)."""
    spark = docs.sparkSession
    sk = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tag")).mapInArrow(_sketch, "doc_id long, tag long, k1 long, k2 long, sig binary")
    sk = stored(spark, sk, "signatures")
    named = sk.where("doc_id is not null and k1 is not null")
    classes = named.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "tag")).alias("first"), F.count("*").alias("n_copies"), F.first("sig").alias("sig"))
    classes = stored(spark, classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")  # a number of its own, as doc_ids may repeat
    sigs = classes.where("sig is not null").select("class_id", "sig")
    bands = sigs.mapInArrow(_bands(), "band long, class_id long")
    buckets = bands.groupBy("band").agg(F.count("*").alias("n"), F.min("class_id").alias("m"), F.bit_xor(F.xxhash64("class_id")).alias("s")).where("n > 1")
    buckets = stored(spark, buckets.groupBy("n", "m", "s").agg(F.min("band").alias("band")).select("band", "n"), "buckets")
    known = spark.sparkContext.broadcast(_bitmap(buckets))
    members = sigs.mapInArrow(_bands(known), "band long, class_id long").join(buckets, "band")
    parts = F.ceil(F.col("n") / block).cast("int")
    members = (
        members.withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("class_id", F.lit(7)), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class_id")
        .join(sigs, "class_id")
    )

    def link(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("class_id").to_numpy())
        ids, part = table.column("class_id").to_numpy()[order], table.column("own").to_numpy()[order]
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(ids), K)[order]
        pairs, degree = links(ids, sig, part, table.column("band")[0].as_py() >> NUMBER_AT, similarity)
        own = np.flatnonzero(degree)  # a row without b is a count
        a = np.concatenate((np.array([p[0] for p in pairs], np.int64), ids[own]))
        b = pa.array([p[1] for p in pairs] + [None] * len(own), pa.int64())
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": pa.array(np.concatenate((np.zeros(len(pairs), np.int64), degree[own])))})

    found = stored(spark, members.groupBy("band", "i", "j").applyInArrow(link, "a long, b long, n long"), "links")
    group = components(spark, found.where("b is not null").select("a", "b"))
    degree = found.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("n_links"))
    per_class = classes.drop("sig").join(group.select(F.col("node").alias("class_id"), "component"), "class_id", "left").join(degree, "class_id", "left")
    first = per_class.where("component is not null").groupBy("component").agg(F.min("first").alias("group_first"))
    per_class = per_class.join(first, "component", "left").select("k1", "k2", "n_copies", "n_links", "first", F.coalesce("group_first", "first").alias("group_first"))
    out = sk.select("doc_id", "tag", "k1", "k2").join(per_class, ["k1", "k2"], "left")
    return out.select(
        "doc_id",
        F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("first.doc_id")), "doc_id").alias("class_id"),
        F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("n_copies")), F.lit(1)).cast("long").alias("n_copies"),
        F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("n_links")), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("group_first.doc_id")), "doc_id").alias("group_id"),
        F.coalesce((F.col("doc_id") == F.col("group_first.doc_id")) & (F.col("tag") == F.col("group_first.tag")), F.lit(True)).alias("kept"),
        "tag",
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tag")
