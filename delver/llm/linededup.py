"""Line dedup by distinct-site spread.

A line is what stands between line feeds, without blanks, tabs and carriage returns at its ends; its site
is the document's source. Every task passes on distinct (line hash, site) pairs, HyperLogLog sketches of the
sites merge per line hash, and lines whose estimate lies within three standard errors of min_sites get an
exact distinct count. Lines on at least min_sites sites are boilerplate and leave every document.

The set of boilerplate hashes is broadcast as a sorted array while it is at most broadcast_lines long;
beyond that the same hashes are joined.

A null text stays null and has no lines; empty lines are never removed; a null source is no site; repeated
lines of one document count once; copies of a document are treated alike. An empty table gives an
empty table. Other columns pass through, whatever their names, but for n_lines and n_removed, which are replaced. A tie at the threshold (exactly min_sites sites) is removed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from delver.llm.common import U64, chunks, fresh, mix, stored, utf8

MIN_SITES = 10
LG_K = 10
_BLANK = b" \t\r"
_hash = xxhash.xxh3_64_intdigest


def line_hashes(text: bytes) -> list[int]:
    """0 stands for an empty line."""
    return [_hash(x) or 1 if (x := line.strip(_BLANK)) else 0 for line in text.split(b"\n")]


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines: list[np.ndarray] = []
    sites: list[np.ndarray] = []
    held = 0

    def out() -> pa.RecordBatch:
        line = np.concatenate(lines) if lines else np.zeros(0, U64)
        site = np.concatenate(sites) if sites else np.zeros(0, U64)
        _, at = np.unique(mix(line ^ mix(site)), return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(line[at].view(np.int64)), pa.array(site[at].view(np.int64))], ["line", "site"])

    for batch in batches:
        texts, names = utf8(batch.column(0)), utf8(batch.column(1))
        known = batch.column(1).is_valid().to_pylist()
        for a, b in chunks(np.fromiter(map(len, texts), np.int64, len(texts))):
            rows = [line_hashes(t) if k else [] for t, k in zip(texts[a:b], known[a:b], strict=True)]
            n = np.fromiter(map(len, rows), np.int64, b - a)
            line = np.fromiter((h for r in rows for h in r), U64, int(n.sum()))
            site = np.repeat(np.array([_hash(s) for s in names[a:b]], U64), n)
            some = line != 0
            lines.append(line[some])
            sites.append(site[some])
            held += int(some.sum())
        if held > 1_000_000:
            yield out()
            lines, sites, held = [], [], 0
    yield out()


def spread(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line) hashes of the lines that stand on at least min_sites distinct sources of docs(text, source)."""
    spark = docs.sparkSession
    pairs = stored(spark, docs.where("text is not null and source is not null").select("text", F.col("source").cast("string").alias("source")).mapInArrow(_pairs, "line long, site long"), "lines")
    error = 3 * 1.04 / math.sqrt(1 << LG_K)
    low, high = min_sites * (1 - error) - 0.5, min_sites * (1 + error) + 0.5
    seen = pairs.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("n")).where(F.col("n") >= low)
    seen = stored(spark, seen, "spread")
    near = seen.where(F.col("n") <= high).select("line")
    exact = pairs.join(near, "line", "left_semi").groupBy("line").agg(F.countDistinct("site").alias("n")).where(F.col("n") >= min_sites)
    return stored(spark, seen.where(F.col("n") > high).select("line").union(exact.select("line")), "boilerplate")


def _clean(texts: list[bytes | None], bad_of) -> tuple[list[bytes | None], list[int], list[int]]:  # noqa: ANN001
    """bad_of: flags of the hashes of some lines."""
    out: list[bytes | None] = list(texts)
    n_lines, n_removed = [0] * len(texts), [0] * len(texts)
    hashes = [line_hashes(t) if t is not None else [] for t in texts]
    flat = np.fromiter((h for r in hashes for h in r), U64)
    bad = bad_of(flat)
    at = 0
    for i, r in enumerate(hashes):
        n_lines[i] = len(r)
        own = bad[at : at + len(r)]
        at += len(r)
        if own.any():
            n_removed[i] = int(own.sum())
            out[i] = b"\n".join(line for line, b in zip(texts[i].split(b"\n"), own.tolist(), strict=True) if not b)  # type: ignore[union-attr]
    return out, n_lines, n_removed


def _emit(batch: pa.RecordBatch, names: list[str], at: int, bad_of) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    raw = batch.column(at).cast(pa.binary()).to_pylist()
    for a, b in chunks(np.array([len(t or b"") for t in raw], np.int64)):
        part = batch.slice(a, b - a)
        text, lines, removed = _clean(raw[a:b], bad_of)
        cols = part.columns[: len(names)]
        cols[at] = pa.array(text, pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"])


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, broadcast_lines: int = 4_000_000) -> DataFrame:
    """docs with boilerplate lines taken out of text, and n_lines, n_removed added."""
    spark = docs.sparkSession
    bad = spread(docs, min_sites)
    docs = docs.drop("n_lines", "n_removed")
    names, schema = docs.columns, T.StructType(list(docs.schema.fields)).add("n_lines", "long").add("n_removed", "long")
    at = names.index("text")
    if bad.limit(broadcast_lines + 1).count() <= broadcast_lines:
        keys = np.unique(bad.toPandas()["line"].to_numpy(np.int64).view(U64))
        known = spark.sparkContext.broadcast(keys)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = known.value

            def bad_of(h: np.ndarray) -> np.ndarray:
                return k[np.minimum(np.searchsorted(k, h), len(k) - 1)] == h if len(k) else np.zeros(len(h), bool)

            for batch in batches:
                yield from _emit(batch, names, at, bad_of)

        return docs.mapInArrow(run, schema)

    # one row for each distinct line of each distinct text; copies of a text share their list
    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                h = np.unique(np.array(line_hashes(t), U64))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(h), pa.string()), pa.array(h.view(np.int64))], ["_key", "line"])

    key, found = fresh(names, "_key", "_bad")
    keyed = docs.withColumn(key, F.md5(F.col("text").cast("binary")))
    distinct = keyed.where("text is not null").groupBy(F.col(key).alias("_key")).agg(F.first("text").alias("text"))
    hits = distinct.mapInArrow(explode, "_key string, line long").join(bad, "line").groupBy(F.col("_key").alias(key)).agg(F.collect_set("line").alias(found))
    both = keyed.join(hits, key, "left").select(*names, found)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.array(batch.column(len(names))[i].as_py() or [], np.int64).view(U64)
                yield from _emit(batch.slice(i, 1), names, at, lambda h, own=own: np.isin(h, own))

    return both.mapInArrow(apply, schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).select("doc_id", "text", "n_lines", "n_removed")
