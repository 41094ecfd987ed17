"""Masked pseudo-likelihood scores from a bidirectional window network trained in numpy, with a memory of the corpus.

Words (as in decontamination) are 32-bit hashes, and the upper 18 bits name a cell. Corpus counts of the cells,
over every text, give a frequency-balanced class to each cell and its probability within the class. The network
predicts the class of every word from the WINDOW words on both sides, the word itself masked: position-scaled
embeddings of the neighbours are summed, tanh, softmax over CLASSES. log P(word | both sides) = log P(class | both
sides) + log P(word | class).

Texts are cut into words once, spread over shards by a hash of the text, ordered by it, and stored; so weights
and scores don't depend on how the table lies in files, but for the rounding of sums. A pass trains on every
position of every document: in each of `rounds` rounds every shard takes the current weights through its
own positions (of a single pass one in `rounds`, another one each round), and token-weighted averages of the shards'
weights, summed in a tree of fan-in FAN, make the next weights. Small corpora get more passes, up to
`passes`, until LEAST_TOKENS positions have been seen. No task or driver holds more than FAN copies of a slice of the weights.

What the network can't hold, single contexts, goes into a memory that grows with the corpus: of every pair of neighbours
(left, right), all words that ever stood between them are counted, over all texts. At every position
P(word) = (1 - a) P_network + a m / d, where m and d are the counts of that word and of all
words in the context without the masked occurrence itself, and a = d / (d + 1). A document's score is
the sum of log P over all of its words.

The counts travel packed. A run of up to RUN words sends its distinct (context, word, n) to the part of the memory that
their context falls to; a part adds up what all runs sent and returns m and d in the order in which they came; runs meet
their words again by chunk. A context with HOT different words in any one run is hot: its words are spread
over the parts, and its total, which every run sends, is broadcast. So no task holds more than a part, a chunk or a text.

Null and empty texts, and texts without words, have n_tokens 0, pll 0 and neither pll_per_token nor recalled. Copies
score alike. Without any words nothing is trained. Repeated rows are rows, a null doc_id is a row. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delver.llm.common import U64, chunks, mix, stored, utf8, word_table

BITS, CLASSES, CONTEXTS, HIDDEN, WINDOW = 18, 64, 8192, 24, 2
FAN, SLICES = 64, 16
BLOCK, CUT = 2048, 120_000  # positions and bytes whose arrays stay in a cache
SHARD_BYTES, LEAST_TOKENS = 4_000_000, 2_000_000
CHUNK, RUN, PART, HOT = 400_000, 1_000_000, 2_000_000, 256
RATE = 0.2
OFFSETS = [*range(-WINDOW, 0), *range(1, WINDOW + 1)]
SHAPES = {"e": (CONTEXTS, HIDDEN), "d": (2 * WINDOW, HIDDEN), "b": (HIDDEN,), "w": (HIDDEN, CLASSES), "c": (CLASSES,)}
SIZE = sum(math.prod(s) for s in SHAPES.values())


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, 32-bit hash) of each word."""
    _, _, _, doc, full = word_table(texts)
    return doc, (full >> U64(32)).astype(np.uint32)


def cells(word: np.ndarray) -> np.ndarray:
    return (word >> np.uint32(32 - BITS)).astype(np.int64)


def contexts(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit name of the two neighbours of every word; 0 stands for the border of a document."""
    left, right = np.zeros(len(word), U64), np.zeros(len(word), U64)
    if len(word) > 1:
        same = doc[1:] == doc[:-1]
        left[1:] = np.where(same, word[:-1].astype(U64) + U64(1), U64(0))
        right[:-1] = np.where(same, word[1:].astype(U64) + U64(1), U64(0))
    return mix(left * U64(0x9E3779B97F4A7C15) + mix(right + U64(0x632BE59BD9B4E019)))


def remembered(context: np.ndarray) -> np.ndarray:
    """The positions whose contexts are counted: all of them."""
    return np.arange(len(context))


class Vocabulary:
    """Class of each cell, log probability within the class, and context number (0 pads, 1 is any rare word)."""

    def __init__(self, counts: np.ndarray) -> None:
        order = np.argsort(-counts, kind="stable")
        n = counts[order] + 1.0
        share = (np.cumsum(n) - n / 2) / n.sum()
        self.of = np.zeros(len(counts), np.int16)
        self.of[order] = np.minimum((share * CLASSES).astype(np.int16), CLASSES - 1)
        total = np.bincount(self.of, counts + 1.0, CLASSES)
        self.log_within = np.log((counts + 1.0) / total[self.of]).astype(np.float32)
        self.context = np.ones(len(counts), np.uint16)
        self.context[order[: CONTEXTS - 2]] = np.arange(2, CONTEXTS)
        self.log_class = np.log(np.maximum(total, 1) / total.sum())


def initial(vocabulary: Vocabulary, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    theta = rng.normal(0, 0.1, SIZE).astype(np.float32)
    p = views(theta)
    p["d"][:] = 1
    p["b"][:] = 0
    p["c"][:] = vocabulary.log_class
    return theta


def views(theta: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = math.prod(shape)
        out[name] = theta[at : at + n].reshape(shape)
        at += n
    return out


def neighbours(doc: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Context numbers at OFFSETS around each position; 0 beyond the document."""
    out = np.zeros((len(OFFSETS), len(doc)), np.uint16)
    for k, o in enumerate(OFFSETS):
        n = len(doc) - abs(o)
        if n > 0:
            to, source = (slice(0, n), slice(o, None)) if o > 0 else (slice(-o, None), slice(0, n))
            out[k, to] = np.where(doc[to] == doc[source], context[source], 0)
    return out


def calm(p: dict[str, np.ndarray]) -> bool:
    """Whether no sum of exponentials can overflow or vanish, so that they need no common factor."""
    return bool((np.abs(p["w"]).sum(0) + np.abs(p["c"])).max() < 80)


def log_probabilities(theta: np.ndarray, v: Vocabulary, doc: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """log P(word | both sides) of every word."""
    p, room = views(theta), Room()
    safe = calm(p)
    tables = [p["e"] * p["d"][k] for k in range(len(OFFSETS))]
    tables[0] += p["b"]
    out = v.log_within[cell].astype(np.float64)
    every, own = neighbours(doc, v.context[cell]), v.of[cell]
    for a in range(0, len(doc), BLOCK):
        near = every[:, a : a + BLOCK]
        n = near.shape[1]
        h = np.take(tables[0], near[0], 0, out=room("h", n, HIDDEN), mode="clip")
        for k in range(1, len(OFFSETS)):
            h += np.take(tables[k], near[k], 0, out=room("t", n, HIDDEN), mode="clip")
        np.tanh(h, out=h)
        z = np.matmul(p["w"].T, h.T, out=room("z", CLASSES, n))  # a row is a class
        z += p["c"][:, None]
        if not safe:
            z -= z.max(0)
        picked = z[own[a : a + BLOCK], np.arange(n)]
        np.exp(z, out=z)
        out[a : a + BLOCK] += picked - np.log(z.sum(0))
    return out


class Room:
    """Memory that is used again: fresh pages for every array of a step cost more than the step."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or len(self.held[name]) < n:
            self.held[name] = np.empty(n, np.float32)
        return self.held[name][:n].reshape(shape)


class Trainer:
    """Adagrad over shuffled batches, starting from the shared weights."""

    def __init__(self, theta: np.ndarray, v: Vocabulary, rate: float = RATE, batch: int = 1024) -> None:
        self.theta, self.v, self.rate, self.batch, self.n = theta.copy(), v, rate, batch, 0
        self.g2 = np.full(SIZE, 1e-3, np.float32)
        self.p, self.e2, self.room = views(self.theta), views(self.g2)["e"], Room()

    def learn(self, doc: np.ndarray, cell: np.ndarray, stride: int, shift: int) -> None:
        at = np.arange(shift % stride, len(doc), stride)
        np.random.default_rng(len(doc)).shuffle(at)
        near, target = neighbours(doc, self.v.context[cell]).take(at, 1), self.v.of[cell[at]].astype(np.int64)
        for a in range(0, len(at), self.batch):
            self.step(near[:, a : a + self.batch], target[a : a + self.batch])
        self.n += len(at)

    def step(self, near: np.ndarray, target: np.ndarray) -> None:
        p, n, room = self.p, near.shape[1], self.room
        one, d = np.ones((1, n), np.float32), p["d"].copy()
        v = np.take(p["e"], near, 0, out=room("v", *near.shape, HIDDEN), mode="clip")
        h = np.einsum("knh,kh->nh", v, p["d"], out=room("h", n, HIDDEN))
        h += p["b"]
        np.tanh(h, out=h)
        z = np.matmul(p["w"].T, h.T, out=room("z", CLASSES, n))  # a row is a class
        z += p["c"][:, None]
        if not calm(p):
            z -= z.max(0)
        np.exp(z, out=z)
        z *= np.float32(1 / n) / z.sum(0)
        z[target, np.arange(n)] -= np.float32(1 / n)
        gh = np.matmul(z.T, p["w"].T, out=room("gh", n, HIDDEN))
        rest = [h.T @ z.T, z @ one[0]]
        h *= h
        gh *= np.subtract(1, h, out=h)
        v *= gh
        self._move(CONTEXTS * HIDDEN, np.concatenate([x.ravel() for x in (one @ v, one @ gh, *rest)]))
        ids = near.ravel()
        order = np.argsort(ids, kind="stable")  # a radix sort
        ids = ids[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        k = order // n
        ge = np.take(gh, order - k * n, 0, out=room("ge", len(ids), HIDDEN), mode="clip")
        ge *= np.take(d, k, 0, out=room("v", len(ids), HIDDEN), mode="clip")
        pairs = np.add.reduceat(ge.view(np.complex64), first, axis=0, out=room("g", len(first), HIDDEN).view(np.complex64))  # two columns are added at once
        self._move_rows(ids[first].astype(np.intp), pairs.view(np.float32))

    def _move(self, begin: int, g: np.ndarray) -> None:
        """All weights but e."""
        self.g2[begin:] += g * g
        self.theta[begin:] -= self.rate * g / np.sqrt(self.g2[begin:])

    def _move_rows(self, rows: np.ndarray, g: np.ndarray) -> None:
        """Some rows of e."""
        s = np.take(self.e2, rows, 0, out=self.room("s", *g.shape), mode="clip")
        s += np.multiply(g, g, out=self.room("v", *g.shape))
        self.e2[rows] = s
        g *= np.float32(self.rate)
        g /= np.sqrt(s, out=s)
        now = np.take(self.p["e"], rows, 0, out=s, mode="clip")
        now -= g
        self.p["e"][rows] = now


def _words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column(1))
        for a, b in chunks(np.fromiter(map(len, texts), np.int64, len(texts)), CUT):
            doc, word = words(texts[a:b])
            at = np.searchsorted(doc, np.arange(b - a + 1))
            own = [word[at[i] : at[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(own, pa.binary())], ["doc_id", "h", "words"])


def _number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows of a shard; a chunk is up to RUN words of consecutive rows, named by its first row."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId()
    row = chunk = shard << 33
    held = 0
    for batch in batches:
        names = []
        for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
            if held and held + n // 4 > RUN:
                chunk, held = row + k, 0
            held += n // 4
            names.append(chunk)
        size = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + size)), batch.column(0), pa.array([shard] * size, pa.int32()), pa.array(names, pa.int64()), batch.column(1)], ["row", "doc_id", "shard", "chunk", "words"])
        row += size


def _released(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """stored(), and its shuffle files go at once: nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return stored(spark, df, name)
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def prepared(docs: DataFrame) -> DataFrame:
    """(row, doc_id, shard, chunk, words): the stored words of docs(doc_id, text), in shards that depend on the texts alone."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    cut = docs.mapInArrow(_words, "doc_id long, h long, words binary").repartition(shards, "h").sortWithinPartitions("h", "words", "doc_id")
    return _released(spark, cut.select("doc_id", "words").mapInArrow(_number, "row long, doc_id long, shard int, chunk long, words binary"), "words")


def _runs(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, document, word) of some rows at a time."""
    for batch in batches:
        raw = batch.column(column).to_pylist()
        for a, b in chunks(np.array([len(r) // 4 for r in raw], np.int64), CHUNK):
            doc = np.repeat(np.arange(b - a), [len(r) // 4 for r in raw[a:b]])
            yield batch.slice(a, b - a), doc, np.frombuffer(b"".join(raw[a:b]), np.uint32)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for _, _, word in _runs(batches, 0):
        total += np.bincount(cells(word), minlength=1 << BITS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["cell", "n"])


def counts(rows: DataFrame) -> np.ndarray:
    """How often each cell occurs in all texts. Its length is fixed, whatever the corpus."""
    found = rows.select("words").mapInArrow(_count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.float64)
    out[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out


def _train(theta, vocabulary, rounds: int, turn: int, rate: float):  # noqa: ANN001, ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, n, t, now = np.zeros(SIZE), 0, None, None
        for part, doc, word in _runs(batches, 1):
            shard = part.column(0).to_numpy()
            for own in np.unique(shard).tolist():  # a shard begins anew, whatever the task
                if own != now:
                    if t is not None:
                        total += t.theta.astype(np.float64) * t.n
                        n += t.n
                    now, t = own, Trainer(theta.value, vocabulary.value, rate)
                mine = shard[doc] == own
                t.learn(doc[mine], cells(word[mine]), rounds, turn)
        if t is not None:
            total += t.theta.astype(np.float64) * t.n
            n += t.n
        if n:
            part = TaskContext.get().partitionId()
            pieces = np.array_split(total, SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([part] * SLICES, pa.int64()), pa.array([float(n)] * SLICES), pa.array([x.tobytes() for x in pieces], pa.binary())], ["slice", "part", "n", "w"]
            )

    return run


def _sum(table: pa.Table) -> pa.Table:
    total = None
    for raw in table.column("w").to_pylist():
        x = np.frombuffer(raw, np.float64)
        total = x.copy() if total is None else total + x
    return pa.table({"slice": table.column("slice").slice(0, 1), "part": table.column("part").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())]), "w": pa.array([total.tobytes()], pa.binary())})


def train(rows: DataFrame, rounds: int = 2, passes: int = 8) -> tuple[Vocabulary, np.ndarray]:
    """Fits on prepared() rows; at least one pass over every position, and more of them where the corpus is small."""
    spark = rows.sparkSession
    n = counts(rows)
    v = Vocabulary(n)
    theta = initial(v)
    shared = spark.sparkContext.broadcast(v)
    times = min(passes, max(1, math.ceil(LEAST_TOKENS / n.sum()))) if n.sum() else 0
    rounds = rounds if times == 1 else 1  # passes are rounds themselves
    for turn in range(times * rounds):
        now = spark.sparkContext.broadcast(theta)
        sums = rows.select("shard", "words").mapInArrow(_train(now, shared, rounds, turn % rounds, RATE / (1 + turn / 8)), "slice int, part long, n double, w binary")
        sums = stored(spark, sums, "weights")
        most = sums.agg(F.max("part")).first()[0]
        while most is not None:
            sums = sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("slice", "part").applyInArrow(_sum, "slice int, part long, n double, w binary")
            most //= FAN
            if not most:
                break
        found = sums.orderBy("slice").collect()
        if not found:
            break
        theta = np.concatenate([np.frombuffer(r.w, np.float64) / r.n for r in found]).astype(np.float32)
    return v, theta


def _spread(x: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; hashes in order have parts in order."""
    return ((x >> U64(32)) * U64(parts)) >> U64(32)


def _sorted(context: np.ndarray) -> np.ndarray:
    """The positions by context. A sort of hashes that carry their positions in the low bits is faster, unless two agree above."""
    low = U64((1 << max(1, (len(context) - 1).bit_length())) - 1)
    key = (context & ~low) | np.arange(len(context), dtype=U64)
    key.sort()
    key &= low
    order = key.view(np.int64)
    c = context[order]
    return order if (c[1:] >= c[:-1]).all() else np.argsort(context)


def _order(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions by context and word, whether each begins a context, whether it begins a word of one)."""
    order = _sorted(context)
    c = context[order]
    same = np.zeros(len(c) + 1, bool)
    np.equal(c[1:], c[:-1], out=same[1:-1])
    new = ~same[:-1]
    tied = np.flatnonzero(same[:-1] | same[1:])
    sub = order[tied]
    order[tied] = sub[np.argsort((np.cumsum(new[tied]).astype(U64) << U64(32)) | word[sub])]
    w = word[order]
    first = new.copy()
    first[1:] |= w[1:] != w[:-1]
    return order, new, first


def _sums(n: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the counts n from each of begin to the next one."""
    total = np.concatenate(([0], np.cumsum(n)))
    return np.diff(total[begin], append=total[-1])


def _among(context: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which contexts are in some, a sorted array."""
    if not len(some):
        return np.zeros(len(context), bool)
    return some[np.minimum(np.searchsorted(some, context), len(some) - 1)] == context


class Entries:
    """The distinct (context, word, n) of a run by part, and the entry of each position."""

    def __init__(self, doc: np.ndarray, word: np.ndarray, hot: np.ndarray, parts: int) -> None:
        context = contexts(doc, word)
        at = remembered(context)
        order, _, first = _order(context[at], word[at])
        begin = np.flatnonzero(first)
        n = np.diff(begin, append=len(order))
        top = order[begin]
        c, w = context[top], word[top]
        part = _spread(c, parts)
        self.hot = _among(c, hot)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(first) - 1
        if self.hot.any():  # else contexts in order have parts in order
            part[self.hot] = _spread(mix(c[self.hot] + w[self.hot]), parts)
            by = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # 16 bits: a radix sort
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            self.of = place[self.of]
            c, w, n, part, self.hot = c[by], w[by], n[by], part[by], self.hot[by]
        self.c, self.w, self.n = c, w, n
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        self.pieces = list(zip(part[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(part)], strict=True))


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length by the bytes of each place, compressed."""
    return pa.compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes() for x in columns), "zstd", asbytes=True)


def _unpack(blob: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(blob, n * sum(sizes), "zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for k, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).reshape(n))
        at += n * size
    return out


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(chunk, first row, rows, document, word) of each run of batches(row, chunk, words): rows of one chunk that stand in a batch."""
    for batch in batches:
        row, chunk, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        ends = np.flatnonzero(np.concatenate(((chunk[1:] != chunk[:-1]) | (row[1:] != row[:-1] + 1), [True]))) + 1 if len(row) else []
        a = 0
        for b in ends:
            word = np.frombuffer(b"".join(raw[a:b]), np.uint32)
            if len(word):
                yield int(chunk[a]), int(row[a]), int(b - a), np.repeat(np.arange(b - a), [len(r) // 4 for r in raw[a:b]]), word
            a = b


def _survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hot contexts, and the number of words in a row without one."""
    for _, _, _, doc, word in _stretches(batches):
        context = contexts(doc, word)
        c = np.sort(context)
        often = c[: len(c) - HOT + 1][c[HOT - 1 :] == c[: len(c) - HOT + 1]] if len(c) >= HOT else c[:0]  # HOT times or more
        at = np.flatnonzero(_among(context, np.unique(often)))
        order, new, first = _order(context[at], word[at])
        begin = np.flatnonzero(new)
        hot = context[at[order[begin[_sums(first, begin) >= HOT]]]].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([None, *hot.tolist()], pa.int64()), pa.array([len(word)] + [0] * len(hot), pa.int64())], ["context", "n"])


_SENT = "part int, chunk long, row long, n_rows int, n int, packed binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 6
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _SENT.split(", ")])


def _send(hot: np.ndarray, parts: int):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, row, n_rows, doc, word in _stretches(batches):
            e = Entries(doc, word, hot, parts)
            out = [(p, chunk, row, n_rows, b - a, _pack(np.diff(e.c[a:b], prepend=U64(0)), e.w[a:b], e.n[a:b].astype(np.uint32))) for p, a, b in e.pieces]
            if e.hot.any():  # their totals go to part -1
                own = np.zeros(len(hot), np.int64)
                np.add.at(own, np.searchsorted(hot, e.c[e.hot]), e.n[e.hot])
                out.append((-1, -1, row, n_rows, len(hot), _pack(own)))
            yield _batch(out)

    return run


def _gather(sent: pa.Table) -> pa.Table:
    """What all runs sent to a part, added up: m and d of each of their entries."""
    rows = sent.to_pylist()
    if rows[0]["part"] < 0:
        total = sum(_unpack(r["packed"], r["n"], np.int64)[0] for r in rows)
        return pa.Table.from_batches([_batch([(-1, -1, 0, 0, len(total), _pack(total))])])
    sizes = [r["n"] for r in rows]
    got = [_unpack(r.pop("packed"), r["n"], U64, np.uint32, np.uint32) for r in rows]
    c = np.concatenate([np.cumsum(x[0]) for x in got])
    w, n = np.concatenate([x[1] for x in got]), np.concatenate([x[2] for x in got]).astype(np.int64)
    del got
    order, new, first = _order(c, w)
    n = n[order]
    m, d = np.empty_like(n), np.empty_like(n)
    for x, begins in ((m, first), (d, new)):
        begin = np.flatnonzero(begins)
        x[order] = np.repeat(_sums(n, begin) - 1, np.diff(begin, append=len(n)))
    ends = np.cumsum(sizes)
    return pa.Table.from_batches([_batch([(r["part"], r["chunk"], r["row"], r["n_rows"], k, _pack(m[b - k : b], d[b - k : b])) for r, k, b in zip(rows, sizes, ends.tolist(), strict=True)])])


class Memory:
    """The returned counts, and the totals of hot contexts."""

    def __init__(self, rows: DataFrame, part: int = PART) -> None:
        spark = rows.sparkSession
        rows = rows.select("row", "chunk", "words")
        found = rows.mapInArrow(_survey, "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).collect()
        self.parts = max(1, math.ceil(sum(r.n for r in found) / part))
        self.hot = np.sort(np.array([r.context for r in found if r.context is not None], np.int64).view(U64))
        self.counts = _released(spark, rows.mapInArrow(_send(self.hot, self.parts), _SENT).groupBy("part").applyInArrow(_gather, _SENT), "memory")
        self.total = np.zeros(len(self.hot), np.int64)
        for r in self.counts.where("part < 0").collect():
            self.total = _unpack(r.packed, r.n, np.int64)[0]


def score(rows: DataFrame, v: Vocabulary, theta: np.ndarray, part: int = PART) -> DataFrame:
    """Per prepared() row: doc_id, n_tokens, pll, pll_per_token, recalled (share of the positions whose word stood in its context before)."""
    memory = Memory(rows, part)
    parts = memory.parts
    model = rows.sparkSession.sparkContext.broadcast((v, theta, memory.hot, memory.total))

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        v, theta, hot, total = model.value
        texts, counts = texts.sort_by("row"), counts.sort_by([("row", "ascending"), ("part", "ascending")]).to_pylist()
        row, raw = texts.column("row").to_numpy(), texts.column("words").to_pylist()
        length = np.array([len(r) // 4 for r in raw], np.int64)
        pll, known = np.zeros(len(raw)), np.zeros(len(raw), np.int64)
        done = 0
        for first, own in itertools.groupby(counts, lambda r: (r["row"], r["n_rows"])):
            own = list(own)
            a = int(np.searchsorted(row, first[0]))
            b = a + first[1]
            word = np.frombuffer(b"".join(raw[a:b]), np.uint32)
            doc = np.repeat(np.arange(b - a), length[a:b])
            e = Entries(doc, word, hot, parts)
            if [(r["part"], r["n"]) for r in own] != [(p, y - x) for p, x, y in e.pieces]:
                raise ValueError(f"a part of the memory is missing for the rows from {first[0]} on")
            m, d = (np.concatenate(x) for x in zip(*(_unpack(r["packed"], r["n"], np.int64, np.int64) for r in own), strict=True))
            if e.hot.any():
                d[e.hot] = total[np.searchsorted(hot, e.c[e.hot])] - 1
            m, d = m[e.of], d[e.of]
            p = log_probabilities(theta, v, doc, cells(word))
            p = np.where(d > 0, np.log((np.exp(p) + m) / (d + 1.0)), p)  # (1 - a) P + a m / d
            pll[a:b] = np.bincount(doc, p, b - a)
            known[a:b] = np.bincount(doc, m > 0, b - a).astype(np.int64)
            done += len(word)
        if done != length.sum():
            raise ValueError("the memory lacks words that were sent")
        nonzero = length > 0
        share = lambda x: pa.array(x / np.maximum(length, 1), mask=~nonzero)
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": pa.array(length), "pll": pa.array(pll), "pll_per_token": share(pll), "recalled": share(known)})

    each = rows.select("row", "doc_id", "chunk", "words").groupBy("chunk")
    return each.cogroup(memory.counts.where("part >= 0").groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, pll double, pll_per_token double, recalled double")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return score(rows, *train(rows))
