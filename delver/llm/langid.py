"""Language identification by string kernels.

Kernel: the blended spectrum. For each order n = 1..4, K_n(x, y) = |G_n(x) & G_n(y)| / sqrt(|G_n(x)| |G_n(y)|)
over the sets of byte n-grams of the case-folded letters (a presence kernel); K is the mean over n. 4-grams
and 3-grams are hashed to 2^18 and 2^17 cells, 1- and 2-grams are exact.

Fit: at most `per_class` distinct labelled texts of every language, none left out, and fewer of each where all
together would exceed `max_sample` characters (documented bounds of the training sample, drawn by a hash of the text; a text
longer than `max_chars` lends its first `max_chars` characters to the fit). `landmarks` of them, two a language at
least, are Nystroem landmarks; one-versus-rest kernel ridge regression on the Nystroem features. As K is linear in the presence vectors,
landmark expansions fold into one table of weights per order, and a batch of documents is scored by sparse
presence matrices times those tables.

Whole texts are predicted. A text that is null or has no letter gets `und` and score 0. Rows are judged one by
one, so ties and repeats don't matter; equal margins fall to the language that sorts first. With no labelled
row at all every text is `und`. A null doc_id is in the training fold. Other columns pass through, whatever their names,
but for lang_pred and score, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from delver.llm.common import stored

CELLS = (1 << 8, 1 << 16, 1 << 17, 1 << 18)
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}]+")
ASCII_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _folded(text: str) -> np.ndarray:
    """Case-folded bytes; whatever is not a letter is a space."""
    if text.isascii():
        raw = text.encode().translate(ASCII_FOLD)
    else:
        raw = text.lower().encode().translate(ASCII_FOLD)
    return np.frombuffer(b" " + raw + b" ", np.uint8)


def grams(text: str, scratch: list[np.ndarray]) -> list[np.ndarray]:
    """The present cells of each order. scratch: an int32 array a cell, of any content."""
    b = _folded(text).astype(np.uint32)
    out = []
    for n, last in enumerate(scratch, 1):
        if len(b) < n:
            out.append(np.zeros(0, np.int64))
            continue
        if n == 1:
            x = b
        elif n == 2:
            x = (b[:-1] << 8) | b[1:]
        elif n == 3:
            x = (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(15)
        else:
            x = (((b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]) * np.uint32(0x85EBCA6B)) >> np.uint32(14)
        x = x.astype(np.int64)
        place = np.arange(len(x), dtype=np.int32)
        last[x] = place
        out.append(x[last[x] == place])  # each cell once, where it occurs last
    return out


class Model:
    """Per order a table cell -> weight per language, and the calibration of the score."""

    def __init__(self, langs: list[str], tables: list[np.ndarray], slope: float) -> None:
        self.langs, self.tables, self.slope = langs, tables, slope

    def margins(self, texts: list[str]) -> np.ndarray:
        scratch = [np.zeros(c, np.int32) for c in CELLS]
        out = np.zeros((len(texts), len(self.langs)))
        rows: list[list[np.ndarray]] = [grams(t, scratch) for t in texts]
        for n, table in enumerate(self.tables):
            sizes = np.array([len(r[n]) for r in rows])
            if not sizes.sum():
                continue
            weights = table.take(np.concatenate([r[n] for r in rows]), axis=0)
            some = np.flatnonzero(sizes)
            starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            out[some] += np.add.reduceat(weights, starts, axis=0) / np.sqrt(sizes[some])[:, None]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        live = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)] if self.langs else []
        if live:
            m = self.margins([texts[i] for i in live])  # type: ignore[misc]
            best = m.argmax(1)
            z = np.exp(self.slope * (m - m.max(1, keepdims=True)))
            p = z[np.arange(len(live)), best] / z.sum(1)
            for i, k, x in zip(live, best.tolist(), p.tolist(), strict=True):
                pred[i], score[i] = self.langs[k], min(1.0, max(0.0, x))
        return pred, score


def fit(sample: list[tuple[str, str]], landmarks: int = 240, ridge: float = 1e-2) -> Model:
    """sample: (text, lang). One-versus-rest kernel ridge regression on Nystroem features."""
    langs = sorted({lang for _, lang in sample})
    if not sample:
        return Model([], [], 1.0)
    scratch = [np.zeros(c, np.int32) for c in CELLS]
    rows = [grams(t, scratch) for t, _ in sample]
    by: dict[str, list[int]] = {}
    for i, (_, lang) in enumerate(sample):
        by.setdefault(lang, []).append(i)
    marks = sorted(i for own in by.values() for i in own[: max(2, landmarks // len(langs))])
    k = np.zeros((len(sample), len(marks)))
    for n, cells in enumerate(CELLS):
        used = np.unique(np.concatenate([rows[i][n] for i in marks]))  # cells without a landmark add nothing
        place = np.full(cells, len(used))
        place[used] = np.arange(len(used))
        dense = np.zeros((len(used) + 1, len(marks)), np.float32)
        for j, i in enumerate(marks):
            if len(rows[i][n]):
                dense[place[rows[i][n]], j] = 1 / np.sqrt(len(rows[i][n]))
        for i, r in enumerate(rows):
            if len(r[n]):
                k[i] += dense[place[r[n]]].sum(0) / np.sqrt(len(r[n])) / len(CELLS)
    kmm = k[marks]
    values, vectors = np.linalg.eigh((kmm + kmm.T) / 2)
    good = values > 1e-8 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])
    z = k @ half
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for _, lang in sample])
    count = np.array([len(by[lang]) for _, lang in sample])
    w = np.sqrt(len(sample) / len(langs) / count)[:, None]  # balanced classes
    beta = np.linalg.solve((z * w).T @ (z * w) + ridge * np.eye(z.shape[1]), (z * w).T @ (y * w))
    alpha = half @ beta  # landmarks x languages
    tables = []
    for n, cells in enumerate(CELLS):
        t = np.zeros((cells, len(langs)))
        for j, i in enumerate(marks):
            if len(rows[i][n]):
                t[rows[i][n]] += alpha[j] / np.sqrt(len(rows[i][n])) / len(CELLS)
        tables.append(t.astype(np.float32))
    return Model(langs, tables, 4.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, per_class: int = 300, max_chars: int = 20_000, max_sample: int = 100_000_000, landmarks: int = 240) -> Model:
    """Fits on a bounded sample of docs(doc_id, text, lang): see above.

    A row is drawn by a hash of its text against its language's rate (of distinct texts), copies count once, and the
    smallest hashes of each language stay.
    """
    held = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held).select("text", F.col("lang").cast("string").alias("lang")).where(F.col("text").rlike(r"\p{L}"))
    counts = stored(docs.sparkSession, rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")), "languages")
    few = counts.limit(10_001).count() <= 10_000  # so many short rows travel to the texts, more of them are joined
    rates = counts.select(F.col("lang").alias("_lang"), (F.lit(4.0 * per_class) / F.col("n")).alias("rate"))
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumn("h", h).join(F.broadcast(rates) if few else rates, F.col("lang") == F.col("_lang")).where("h < rate").select("lang", "h", F.substring("text", 1, max_chars).alias("text")).distinct()
    drawn = drawn.withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).where(F.col("at") <= per_class)
    sizes = drawn.groupBy("at").agg(F.sum(F.length("text")).alias("n")).orderBy("at").collect()  # at most per_class rows
    most, total = 0, 0
    for r in sizes:
        total += r.n
        if most and total > max_sample:
            break
        most = r["at"]
    sample = sorted((r.lang, r.h, r.text) for r in drawn.where(F.col("at") <= most).select("lang", "h", "text").collect() if LETTER.search(r.text))
    return fit([(text, lang) for lang, _, text in sample], landmarks)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score added; lang, source and doc_id are not read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    docs = docs.select(*names)
    at = names.index("text")
    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                pred, score = shared.value.predict(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
