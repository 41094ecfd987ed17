"""Benchmark decontamination by winnowing.

Words are the runs of digits, ASCII letters (lower-cased) and non-ASCII characters. Both sides keep
the minimum 5-gram hash of every six consecutive 5-grams, so any 10 consecutive words that both
share hold a fingerprint that both kept. A fingerprint hit is extended to the six 10-word windows
that contain it; a window whose words equal those of a benchmark window is hit.

Items of fewer than 10 words are one window each and are looked up by their full-length gram.

A benchmark of at most block_bytes of text (its size is counted first) is broadcast as sorted arrays, and nothing
is shuffled. A larger one is joined: winnowed fingerprints of documents meet those of the benchmark, only documents with a
common one give windows around it, and those are joined with the benchmark's windows. Documents are read twice,
whatever the size of the benchmark.

Nulls and empty texts have no words: zero counts, no items, not contaminated. Repeated documents
are judged one by one; repeated items all count. Empty tables give empty results or clean documents. Extra columns
are ignored (mark() passes them through, whatever their names, and replaces n_hit). A null doc_id is kept
as a row of its own; items with a null item_id have no name and are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delver.llm.common import U64, chunks, fresh, gram_hashes, mix, stored, utf8, word_table

WINDOW = 10
GRAM = 5
SPAN = WINDOW - GRAM + 1
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def winnow(grams: np.ndarray, ok: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Sorted positions of the grams that are the (last) minimum of some window of `span` grams, all of them ok."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, span):
        x = grams[j : j + n]
        less = x <= best
        np.copyto(best, x, where=less)
        at[less] = j
    whole = ok[:n].copy()
    for j in range(1, span):
        whole &= ok[j : j + n]
    i = np.flatnonzero(whole)
    at = i + at[i]
    return np.unique(at) if len(at) else at


def _lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index in sorted unique keys of each value, or -1."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


class Index:
    """A block of benchmark items: fingerprints, windows, and the items of every window."""

    def __init__(self, items: list[tuple[str, bytes]]) -> None:
        prints, windows = [], {}
        self.names = [name for name, _ in items]
        _, starts, ends, doc, words = word_table([t for _, t in items] or [b""])
        bounds = np.searchsorted(doc, np.arange(len(items) + 1))
        for i in range(len(items)):
            own = words[bounds[i] : bounds[i + 1]]
            n = min(WINDOW, len(own))
            if not n:
                continue
            for h in gram_hashes(own, n).tolist():
                windows.setdefault(n, {}).setdefault(h, set()).add(i)
            if n == WINDOW:
                g = gram_hashes(own, GRAM)
                prints.append(g[winnow(g, np.ones(len(g), bool))])
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, U64)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.prints >> U64(48)).astype(np.int64)] = True
        self.windows = {}
        for n, table in windows.items():
            keys = np.array(sorted(table), U64)
            self.windows[n] = (keys, [sorted(table[k]) for k in keys.tolist()])

    def hits(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(hit word mask, (document, item) pairs)."""
        mark, found = np.zeros(len(words) + 1, np.int64), []

        def take(at: np.ndarray, which: np.ndarray, n: int) -> None:
            np.add.at(mark, at, 1)
            np.add.at(mark, at + n, -1)
            pair = np.unique(doc[at] * len(self.windows[n][0]) + which)
            for d, w in zip((pair // len(self.windows[n][0])).tolist(), (pair % len(self.windows[n][0])).tolist(), strict=True):
                found.extend((d, i) for i in self.windows[n][1][w])

        for n, (keys, _) in self.windows.items():
            if n > len(words):
                continue
            if n < WINDOW:
                at = np.arange(len(words) - n + 1)
                at = at[doc[at] == doc[at + n - 1]]
                which = _lookup(keys, gram_hashes(words, n)[at])
            else:
                grams = gram_hashes(words, GRAM)
                kept = winnow(grams, doc[: len(grams)] == doc[GRAM - 1 :])
                kept = kept[self.filter[(grams[kept] >> U64(48)).astype(np.int64)]]
                kept = kept[_lookup(self.prints, grams[kept]) >= 0]
                if not len(kept):
                    continue
                at = np.unique((kept[:, None] - np.arange(SPAN)[None, :]).ravel())
                at = at[(at >= 0) & (at <= len(words) - n)]
                at = at[doc[at] == doc[at + n - 1]]
                full = np.zeros(len(at), U64)
                for j in range(n):
                    full += words[at + j] * U64(pow(0xD6E8FEB86659FD93, 2 * j + 1, 1 << 64))
                which = _lookup(keys, mix(full))
            take(at[which >= 0], which[which >= 0], n)
        return np.cumsum(mark[:-1]) > 0, found


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _small(benchmark: DataFrame, block_bytes: int) -> tuple[DataFrame, list[tuple[str, bytes]] | None]:
    """The items with a name and a text; also collected, if their size allows."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item") + 16)).first()[0] or 0
    if size > block_bytes:
        return items, None
    return items, [(r.item, bytes(r.t)) for r in items.select("item", F.col("text").cast("binary").alias("t")).collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 16_000_000) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items, small = _small(benchmark, block_bytes)
    if small is not None:
        return docs.mapInArrow(_scan(spark, small), SCHEMA)
    numbered = stored(spark, docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "decontaminate")
    per = _joined(numbered, items)
    return numbered.select("row", "doc_id").join(per, "row").select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def mark(docs: DataFrame, benchmark: DataFrame, block_bytes: int = 16_000_000) -> DataFrame:
    """docs with n_hit added: how many of the words of text stand in a benchmark window."""
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c.lower() != "n_hit"])
    names = docs.columns
    items, small = _small(benchmark, block_bytes)
    if small is not None:
        scan, at = _scan(spark, small), names.index("text")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], ["doc_id", "text"])
                hits = pa.chunked_array([x.column(2) for x in scan([own])], pa.int64()).combine_chunks()
                yield pa.RecordBatch.from_arrays([*batch.columns, hits], [*names, "n_hit"])

        return docs.mapInArrow(run, T.StructType(list(docs.schema.fields)).add("n_hit", "long"))
    (row,) = fresh(names, "row")
    numbered = stored(spark, docs.select("*", F.monotonically_increasing_id().alias(row)), "decontaminate")
    per = _joined(numbered.select(F.col(row).alias("row"), "text"), items).select(F.col("row").alias(row), "n_hit")
    return numbered.join(per, row).select(*names, "n_hit")


def _joined(numbered: DataFrame, items: DataFrame) -> DataFrame:
    """(row, n_words, n_hit, n_items, items_sha256) of numbered(row, text), by joins."""
    spark = numbered.sparkSession
    items = stored(spark, items, "benchmark")

    def each(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            texts = utf8(batch.column(text))
            for a, b in chunks(np.fromiter(map(len, texts), np.int64, len(texts))):
                _, _, _, doc, words = word_table(texts[a:b])
                yield batch.slice(a, b - a), doc, words

    def prints(doc: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, hash) of the winnowed grams."""
        grams = gram_hashes(words, GRAM)
        at = winnow(grams, doc[: len(grams)] == doc[GRAM - 1 :])
        return at, grams[at]

    def windows(doc: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(max(0, len(words) - n + 1))
        at = at[doc[at] == doc[at + n - 1]]
        return at, gram_hashes(words, n)[at]

    def of_items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n = 0: a fingerprint; else a window of n words and its item."""
        for part, doc, words in each(batches, 1):
            size = np.bincount(doc, minlength=part.num_rows)
            n, h, own = [], [], []
            at, hashes = prints(doc, words)
            n.append(np.zeros(len(at), np.int32))
            h.append(hashes)
            own.append(doc[at])
            for k in range(1, WINDOW + 1):
                at, hashes = windows(doc, words, k)
                ok = size[doc[at]] == k if k < WINDOW else np.ones(len(at), bool)
                n.append(np.full(int(ok.sum()), k, np.int32))
                h.append(hashes[ok])
                own.append(doc[at][ok])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(n)), pa.array(np.concatenate(h).view(np.int64)), part.column(0).take(pa.array(np.concatenate(own)))], ["n", "h", "item"])

    def of_docs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, doc, words in each(batches, 1):
            at, hashes = prints(doc, words)
            bounds = np.searchsorted(doc[at], np.arange(part.num_rows + 1))
            own = [np.unique(hashes[bounds[i] : bounds[i + 1]]).view(np.int64) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.bincount(doc, minlength=part.num_rows), pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["row", "n_words", "prints"])

    def around(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The whole windows that hold a fingerprint which the benchmark has, too."""
        for part, doc, words in each(batches, 1):
            known = part.column(2)
            owner = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(known).to_numpy(zero_copy_only=False))
            key = lambda d, h: mix(h ^ mix(d.astype(U64) + U64(1)))
            good = key(owner, known.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
            at, hashes = prints(doc, words)
            at = at[np.isin(key(doc[at], hashes), good)]
            at = np.unique((at[:, None] - np.arange(SPAN)[None, :]).ravel())
            at = at[(at >= 0) & (at <= len(words) - WINDOW)]
            at = at[doc[at] == doc[at + WINDOW - 1]]
            first = np.searchsorted(doc, np.arange(part.num_rows))
            h = gram_hashes(words, WINDOW)[at].view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[at])), pa.array(at - first[doc[at]], pa.int64()), pa.array(np.full(len(at), WINDOW, np.int32)), pa.array(h)], ["row", "at", "n", "h"])

    def short(sizes: list[int]):  # noqa: ANN202
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, doc, words in each(batches, 1):
                first = np.searchsorted(doc, np.arange(part.num_rows))
                for n in sizes:
                    at, h = windows(doc, words, n)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc[at])), pa.array(at - first[doc[at]], pa.int64()), pa.array(np.full(len(at), n, np.int32)), pa.array(h.view(np.int64))], ["row", "at", "n", "h"])

        return run

    bench = stored(spark, items.select("item", "text").mapInArrow(of_items, "n int, h long, item string").distinct(), "benchmark_windows")
    text = numbered.select("row", "text")
    own = stored(spark, text.mapInArrow(of_docs, "row long, n_words long, prints array<long>"), "prints")
    hits = own.select("row", F.explode("prints").alias("h")).join(bench.where("n = 0").select("h").distinct(), "h", "left_semi").groupBy("row").agg(F.collect_list("h").alias("known"))
    place = "row long, at long, n int, h long"
    seen = text.join(hits, "row").select("row", "text", "known").mapInArrow(around, place)
    sizes = sorted(r.n for r in bench.where((F.col("n") > 0) & (F.col("n") < WINDOW)).select("n").distinct().collect())
    if sizes:
        seen = seen.union(text.mapInArrow(short(sizes), place))
    seen = stored(spark, seen.join(bench.where("n > 0").select("n", "h").distinct(), ["n", "h"], "left_semi"), "hits")
    n_hit = seen.select("row", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("p")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    names = seen.select("row", "n", "h").distinct().join(bench.where("n > 0"), ["n", "h"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<string>")
    return own.select("row", "n_words").join(n_hit, "row", "left").join(names, "row", "left").select(
        "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(F.coalesce("items", none)).cast("long").alias("n_items"), F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256")
    )


def _scan(spark: SparkSession, items: list[tuple[str, bytes]]):  # noqa: ANN202
    index = spark.sparkContext.broadcast(Index(items))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        none = _digest([])
        for batch in batches:
            texts, ids = utf8(batch.column(1)), batch.column(0)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            for a, b in chunks(size):
                _, _, _, doc, words = word_table(texts[a:b])
                n = b - a
                hit, found = ix.hits(words, doc)
                per: dict[int, set[str]] = {}
                for d, i in found:
                    per.setdefault(d, set()).add(ix.names[i])
                n_words = np.bincount(doc, minlength=n)
                n_hit = np.bincount(doc[hit], minlength=n)
                digests = [_digest(sorted(per[d])) if d in per else none for d in range(n)]
                n_items = [len(per.get(d, ())) for d in range(n)]
                cols = [ids.slice(a, n), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests), pa.array(n_hit > 0)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return run


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
