"""Near duplicates among embeddings: hierarchical navigable small-world graphs per shard.

Equal vectors are one class (their copies count as links of each other). Classes are spread over shards of at
most `shard_rows`; each shard builds a graph in numpy, in batches: a batch is searched in the graph as it
stands, then its new nodes choose diverse neighbours among what the search and the batch itself offer.
A vector within cosine RADIUS of a node becomes a member of that node instead of a node, so groups of near
copies don't clog the graph. A query beam-searches every shard, keeps expanding all nodes close enough to
have a linked member, and every member found is verified by cosine in double precision.

Before a shard is written its beam is audited: queries are a hashed sample of the whole table and points at
the threshold's angle from the shard's own vectors, truth is brute force over the shard. The beam doubles
until the recall of links reaches `recall`; as wide as the shard it is an exact scan.

A query task writes one row a vector (how many it links to) and a spanning forest of the links, never all
pairs. Exact counts of a group of n different near copies take n^2 verifications, spread over shards.

Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of
different lengths don't link. Every row is judged by its own vector: rows of one vec_id with different vectors are in the
components of their vectors, repeated rows are copies of one another; a null vec_id has a row, without
component. Ties don't occur: a pair is linked at cosine >= threshold. An empty table gives an empty table.
Extra columns are ignored, whatever their names.

Graphs lie in the shared folder under their full address, which tasks open through Arrow. A shard that can't be read, or
whose audit stays below `recall`, is an error: nothing is taken for empty.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delver.llm.common import components, mix, shared_dir, stored

THRESHOLD = 0.95
RADIUS = 0.97
M, M0 = 12, 24
BUILD_BEAM = 32
SHARD_ROWS, SHARD_BYTES = 250_000, 200_000_000
LEAST_SHARDS = 6
QUERY_BYTES = 32_000_000
AUDIT = 128


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", a, b)


class Graph:
    """A small-world graph over the rows of x (unit vectors in double precision)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, weight: np.ndarray) -> None:
        self.ids, self.x, self.weight = ids, x, weight
        self.low = x.astype(np.float32)
        n = len(ids)
        u = (mix(ids.view(np.uint64)) >> np.uint64(11)) * 2.0**-53
        level = np.minimum((-np.log(u + 2.0**-54) / math.log(M)).astype(int), 8)
        self.rep = np.full(n, -1)  # the node of each row; a node is its own
        top = int(level.max()) if n else 0
        self.near = [np.full((n, M0 if k == 0 else M), -1, np.int32) for k in range(top + 1)]
        self.entry = -1
        self.top = -1
        self.beam = 16
        done = 0
        for k in range(top, -1, -1):
            own = np.flatnonzero(level == k)
            at = 0
            while at < len(own):
                size = min(max(64, done), 1024)
                self._insert(own[at : at + size], k)
                done += len(own[at : at + size])
                at += size
        order = np.argsort(self.rep, kind="stable")
        self.member = order
        self.first = np.searchsorted(self.rep[order], np.arange(n + 1))

    def _insert(self, rows: np.ndarray, level: int) -> None:
        q = self.low[rows]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if self.entry >= 0:
            found = self._search(q, BUILD_BEAM, min(level, self.top))
            ids0, sims0 = found[0]
            best = sims0.argmax(1)
            near = sims0[np.arange(len(rows)), best] >= RADIUS
            self.rep[rows[near]] = ids0[np.arange(len(rows)), best][near]
            rows, q = rows[~near], q[~near]
            found = [(i[~near], s[~near]) for i, s in found]
        g = q @ q.T
        lead = np.ones(len(rows), bool)
        for i in np.flatnonzero((np.tril(g, -1) >= RADIUS).any(1)).tolist():
            j = np.flatnonzero(lead[:i] & (g[i, :i] >= RADIUS))
            if len(j):
                lead[i] = False
                self.rep[rows[i]] = rows[j[g[i, j].argmax()]]
        rows, g = rows[lead], g[np.ix_(lead, lead)]
        if not len(rows):
            return
        found = [(i[lead], s[lead]) for i, s in found]
        self.rep[rows] = rows
        np.fill_diagonal(g, -2)
        k = min(16, len(rows) - 1)
        mates = np.argpartition(-g, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(rows), 0), int)
        m_ids, m_sims = rows[mates], np.take_along_axis(g, mates, 1)
        for lv in range(level + 1):
            ids, sims = m_ids, m_sims
            if lv < len(found):
                ids, sims = np.concatenate((found[lv][0], ids), 1), np.concatenate((found[lv][1], sims), 1)
            width = self.near[lv].shape[1]
            chosen, _ = self._choose(ids, sims, M)
            self.near[lv][rows, : chosen.shape[1]] = chosen
            self._back(lv, np.repeat(rows, chosen.shape[1]), chosen.ravel(), width)
        if level > self.top:
            self.top, self.entry = level, int(rows[0])

    def _choose(self, ids: np.ndarray, sims: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """m of the candidates of each row: first those closer to the row than to any chosen one, then the nearest."""
        sims = np.where(ids >= 0, sims, -2).astype(np.float32)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :48]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out_i = np.full((len(ids), min(m, ids.shape[1])), -1, np.int32)
        out_s = np.full(out_i.shape, -2, np.float32)
        for a in range(0, len(ids), 256):
            i, s = ids[a : a + 256], sims[a : a + 256]
            v = self.low[i]
            p = v @ v.transpose(0, 2, 1)
            taken = np.zeros(i.shape, bool)
            for c in range(i.shape[1]):
                clash = (taken[:, :c] & (p[:, c, :c] > s[:, c, None])).any(1)
                taken[:, c] = ~clash & (s[:, c] > -2) & (taken.sum(1) < m)
            rank = np.argsort(np.where(taken, 0, 1) + np.where(s > -2, 0, 2), axis=1, kind="stable")[:, : out_i.shape[1]]
            ci, cs = np.take_along_axis(i, rank, 1), np.take_along_axis(s, rank, 1)
            out_i[a : a + 256], out_s[a : a + 256] = np.where(cs > -2, ci, -1), cs
        return out_i, out_s

    def _back(self, lv: int, src: np.ndarray, dst: np.ndarray, width: int) -> None:
        """Adds edges dst -> src, and prunes lists that overflow."""
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        sim = _dots(self.low[src], self.low[dst])
        order = np.lexsort((-sim, dst))
        src, dst = src[order], dst[order]
        node, start, n = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(start, n)
        most = min(32, int(n.max())) if len(n) else 0
        if not most:
            return
        new = np.full((len(node), most), -1, np.int64)
        keep = place < most
        new[np.repeat(np.arange(len(node)), n)[keep], place[keep]] = src[keep]
        for a in range(0, len(node), 1024):
            own = node[a : a + 1024]
            ids = np.concatenate((self.near[lv][own], new[a : a + 1024]), 1)
            ids = np.sort(ids, axis=1)[:, ::-1]
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("nkd,nd->nk", self.low[np.maximum(ids, 0)], self.low[own])
            sims[ids < 0] = -2
            full = (ids >= 0).sum(1) > width
            order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
            kept = np.take_along_axis(ids, order, 1)
            if full.any():
                chosen, _ = self._choose(ids[full], sims[full], width)
                kept[full] = -1
                kept[full, : chosen.shape[1]] = chosen
            self.near[lv][own] = kept

    def _beam(self, q: np.ndarray, start: np.ndarray, lv: int, beam: int, cutoff: float = 9.0) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """Best-first search of all queries at once. Also all (query, node) found with cosine >= cutoff; those are all expanded."""
        n, width = len(q), self.near[lv].shape[1]
        seen = np.zeros((n, len(self.ids)), bool)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2, np.float32)
        open_ = np.zeros((n, beam), bool)
        k = min(beam, start.shape[1])
        ids[:, :k] = start[:, :k]
        sims[:, :k] = np.einsum("nkd,nd->nk", self.low[np.maximum(start[:, :k], 0)], q)
        sims[ids < 0] = -2
        open_[:] = ids >= 0
        np.put_along_axis(seen, np.maximum(ids, 0), True, 1)
        hit_q, hit_i = [], []

        def note(row: np.ndarray, node: np.ndarray, sim: np.ndarray) -> None:
            ok = sim >= cutoff
            if ok.any():
                hit_q.append(row[ok])
                hit_i.append(node[ok])

        r, c = np.nonzero(open_)
        note(r, ids[r, c], sims[r, c])
        expanded: list[np.ndarray] = []
        live = np.arange(n)
        picks = min(2, beam)
        while len(live):
            s = np.where(open_[live], sims[live], -3)
            top = np.argpartition(-s, picks - 1, axis=1)[:, :picks] if beam > picks else np.tile(np.arange(beam), (len(live), 1))
            good = np.take_along_axis(s, top, 1) > -3
            some = good.any(1)
            live, top, good = live[some], top[some], good[some]
            if not len(live):
                break
            node = np.where(good, ids[live[:, None], top], -1)
            open_[live[:, None], top] = False
            if cutoff < 2:
                r, c = np.nonzero(node >= 0)
                expanded.append(live[r] * len(self.ids) + node[r, c])
            nb = np.where(node[:, :, None] >= 0, self.near[lv][np.maximum(node, 0)], -1).reshape(len(live), -1).astype(np.int64)
            nb = np.sort(nb, axis=1)
            fresh = nb >= 0
            fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
            fresh &= ~seen[live[:, None], np.maximum(nb, 0)]
            r, c = np.nonzero(fresh)
            flat = nb[r, c]
            seen[live[r], flat] = True
            sim = _dots(self.low[flat], q[live[r]])
            note(live[r], flat, sim)
            s = np.full(nb.shape, -2, np.float32)
            s[r, c] = sim
            all_s = np.concatenate((sims[live], s), 1)
            all_i = np.concatenate((ids[live], np.where(fresh, nb, -1)), 1)
            all_o = np.concatenate((open_[live], fresh), 1)
            keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids[live], sims[live], open_[live] = (np.take_along_axis(x, keep, 1) for x in (all_i, all_s, all_o))
        if cutoff < 2 and hit_q:
            size = len(self.ids)
            was = np.concatenate(expanded) if expanded else np.zeros(0, np.int64)
            todo = np.setdiff1d(np.concatenate(hit_q) * size + np.concatenate(hit_i), was)
            while len(todo):
                row, node = todo // size, todo % size
                nb = self.near[lv][node]
                r, c = np.nonzero(nb >= 0)
                key = np.unique(row[r] * size + nb[r, c])
                row, node = key // size, key % size
                ok = ~seen[row, node]
                row, node = row[ok], node[ok]
                seen[row, node] = True
                sim = _dots(self.low[node], q[row])
                note(row, node, sim)
                ok = sim >= cutoff
                todo = row[ok] * size + node[ok]
        none = np.zeros(0, np.int64)
        return ids, sims, (np.concatenate(hit_q) if hit_q else none, np.concatenate(hit_i) if hit_i else none)

    def _search(self, q: np.ndarray, beam: int, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level 0..level what the beam holds in the end."""
        parts: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for a in range(0, len(q), 256):
            own = q[a : a + 256]
            start = np.full((len(own), 1), self.entry)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for lv in range(self.top, -1, -1):
                ids, sims, _ = self._beam(own, start, lv, beam if lv <= level else 4)
                start = ids
                if lv <= level:
                    out.insert(0, (ids, sims))
            parts.append(out)
        return [(np.concatenate([p[i][0] for p in parts]), np.concatenate([p[i][1] for p in parts])) for i in range(level + 1)]

    def links(self, q: np.ndarray, threshold: float = THRESHOLD, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query row, shard row) with cosine >= threshold. q: unit vectors in double precision."""
        if self.entry < 0 or not len(q):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        none = np.zeros(0, np.int64)
        if (beam or self.beam) >= len(self.ids):  # a beam of the whole shard is a scan, whatever the graph reaches
            found = [np.nonzero(q[a : a + 128] @ self.x.T >= threshold) for a in range(0, len(q), 128)]
            return np.concatenate([r + 128 * k for k, (r, _) in enumerate(found)]), np.concatenate([c for _, c in found])
        wide = math.cos(min(math.pi, math.acos(threshold) + math.acos(RADIUS))) - 1e-6
        out_q, out_i = [], []
        block = max(16, min(256, 50_000_000 // len(self.ids)))
        for a in range(0, len(q), block):
            own = q[a : a + block]
            low = own.astype(np.float32)
            start = np.full((len(own), 1), self.entry)
            for lv in range(self.top, 0, -1):
                start, _, _ = self._beam(low, start, lv, 4)
            row, node = self._beam(low, start, 0, beam or self.beam, wide)[2]
            n = self.first[node + 1] - self.first[node]
            ends = np.cumsum(n)
            lo = 0
            while lo < len(node):  # a bounded number of members at a time; one node's are never too many for a pass
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 200_000, "right")))
                m = n[lo:hi]
                at = np.repeat(self.first[node[lo:hi]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                i, r = self.member[at], np.repeat(row[lo:hi], m)
                for b in range(0, len(i), 50_000):
                    ok = _dots(self.x[i[b : b + 50_000]], own[r[b : b + 50_000]]) >= threshold
                    out_q.append(r[b : b + 50_000][ok] + a)
                    out_i.append(i[b : b + 50_000][ok])
                lo = hi
        return (np.concatenate(out_q) if out_q else none), (np.concatenate(out_i) if out_i else none)

    def audit(self, sample: np.ndarray, threshold: float, recall: float) -> float:
        """Widens the beam until the links of the audit queries are found; returns the last recall."""
        rng = np.random.default_rng(11)
        own = self.x[rng.choice(len(self.x), min(AUDIT, len(self.x)), False)]
        noise = rng.normal(size=own.shape)
        noise -= _dots(noise, own)[:, None] * own
        norm = np.linalg.norm(noise, axis=1, keepdims=True)
        noise = np.divide(noise, norm, out=np.zeros_like(noise), where=norm > 1e-12)
        c = min(1.0, threshold + 1e-9)
        q = np.concatenate((sample, c * own + math.sqrt(1 - c * c) * noise))
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        truth = sum(int((self.x[a : a + 20_000] @ q.T >= threshold).sum()) for a in range(0, len(self.x), 20_000))
        while True:
            got = len(self.links(q, threshold)[0]) / truth if truth else 1.0
            if got >= recall or self.beam >= len(self.ids):
                return got
            self.beam = min(self.beam * 2, len(self.ids))

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.savez(f, ids=self.ids, x=self.x, weight=self.weight, rep=self.rep, member=self.member, first=self.first, near=self.near[0], meta=np.array([self.entry, self.top, self.beam]), **{f"up{k}": a[(rows := np.flatnonzero((a >= 0).any(1)))] for k, a in enumerate(self.near) if k}, **{f"at{k}": np.flatnonzero((a >= 0).any(1)) for k, a in enumerate(self.near) if k})
        return f.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        z, g = np.load(io.BytesIO(raw)), cls.__new__(cls)
        g.ids, g.x, g.weight, g.rep, g.member, g.first = (z[k] for k in ("ids", "x", "weight", "rep", "member", "first"))
        g.low = g.x.astype(np.float32)
        g.entry, g.top, g.beam = z["meta"].tolist()
        g.near = [z["near"]]
        k = 1
        while f"up{k}" in z:
            a = np.full((len(g.ids), M), -1, np.int32)
            a[z[f"at{k}"]] = z[f"up{k}"]
            g.near.append(a)
            k += 1
        return g


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content key of each vector; null where it can't link."""
    for batch in batches:
        k1, k2, unit = [], [], []
        for v in batch.column(1).to_pylist():
            x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
            n = float(np.linalg.norm(x / m)) * m if x is not None and len(x) and np.isfinite(x).all() and (m := float(np.abs(x).max())) > 0 else 0.0
            if x is None or not n > 0:
                k1.append(None)
                k2.append(None)
                unit.append(None)
                continue
            h = xxhash.xxh3_128_intdigest((x + 0.0).tobytes())
            k1.append((h >> 64) - (1 << 63))
            k2.append((h & ((1 << 64) - 1)) - (1 << 63))
            x = x / m
            unit.append((x / np.linalg.norm(x)).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(unit, pa.binary())], ["vec_id", "k1", "k2", "unit"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim).copy()


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = 0.98, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per row of vectors(vec_id, embedding): vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    keyed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_keys, "vec_id long, k1 long, k2 long, unit binary")
    keyed = stored(spark, keyed, "vectors")
    live = keyed.where("k1 is not null and vec_id is not null")
    classes = live.groupBy("k1", "k2").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
    classes = classes.withColumn("id", F.monotonically_increasing_id())  # a number of its own, as vec_ids may repeat
    classes = stored(spark, classes.withColumn("dim", F.octet_length("unit") / 8), "vector_classes")
    sizes = {int(r.dim): r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    edges, counts = None, None
    for dim, n in sorted(sizes.items()):  # one length as a rule
        own = classes.where(F.col("dim") == dim)
        shards = max(1, min(LEAST_SHARDS, n), math.ceil(n / min(shard_rows, max(1000, SHARD_BYTES // (12 * dim)))))
        block = max(256, QUERY_BYTES // (8 * dim))
        picked = own.select("unit", F.xxhash64("k1", "k2").alias("h")).orderBy("h").limit(AUDIT).collect()
        sample = np.stack([np.frombuffer(r.unit, np.float64) for r in picked])

        path = f"{shared_dir(spark)}/graphs-{dim}-{np.random.default_rng().integers(1 << 62):x}"
        sharded = own.withColumn("shard", F.pmod(F.xxhash64("k1", "k2", F.lit(1)), F.lit(shards)).cast("int"))
        built = sharded.repartition(shards, "shard").groupBy("shard").applyInArrow(_build(dim, sample, threshold, recall), "shard int, beam int, recall double, nodes long, graph binary")
        built.write.partitionBy("shard").parquet(path)
        there = spark.read.parquet(path).select("shard", "recall").collect()  # one short row a shard
        if missed := [r.shard for r in there if r.recall < recall]:
            raise ValueError(f"shards {missed[:5]} miss a recall of {recall}")
        blocks = max(math.ceil(n / block), min(spark.sparkContext.defaultParallelism * 2, math.ceil(n / 512)))
        found = own.select("id", "unit").repartition(blocks, "id").mapInArrow(_query(path, sorted(r.shard for r in there), dim, threshold, block), "kind int, a long, b long")
        found = stored(spark, found, "vector_links")
        counts_, edges_ = found.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("linked")), found.where("kind = 1").select("a", "b")
        counts = counts_ if counts is None else counts.union(counts_)
        edges = edges_ if edges is None else edges.union(edges_)
    if edges is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    group = components(spark, edges).select(F.col("node").alias("id"), "component")
    per = classes.select("k1", "k2", "id", "low", "weight").join(counts.groupBy("id").agg(F.sum("linked").alias("linked")), "id").join(group, "id", "left")
    least = per.where("component is not null").groupBy("component").agg(F.min("low").alias("least"))
    per = per.join(least, "component", "left")
    component = F.coalesce("least", "low", "vec_id")
    return keyed.select("vec_id", "k1", "k2").join(per, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce(F.when(F.col("vec_id").isNotNull(), F.col("linked") + F.col("weight") - 1), F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _build(dim: int, sample: np.ndarray, threshold: float, recall: float):  # noqa: ANN202
    def build(table: pa.Table) -> pa.Table:
        g = Graph(table.column("id").to_numpy(), _matrix(table.column("unit").combine_chunks(), dim), table.column("weight").to_numpy())
        got = g.audit(sample, threshold, recall)
        nodes = int((g.rep == np.arange(len(g.ids))).sum())
        return pa.table({"shard": table.column("shard").slice(0, 1).cast(pa.int32()), "beam": pa.array([g.beam], pa.int32()), "recall": pa.array([got]), "nodes": pa.array([nodes], pa.int64()), "graph": pa.array([g.dump()], pa.binary())})

    return build


def _query(path: str, shards: list[int], dim: int, threshold: float, rows: int):  # noqa: ANN202
    """Queries every shard with each block of vectors. Kind 0: (id, weight of all other linked classes); kind 1: a link."""

    def graph(shard: int) -> Graph:
        import pyarrow.dataset as ds
        from pyarrow import fs

        address = f"{path}/shard={shard}"
        system, at = fs.FileSystem.from_uri("file://" + address[5:] if address.startswith("file:/") and not address.startswith("file://") else address)
        table = ds.dataset(at, filesystem=system, format="parquet").to_table(columns=["graph"])
        if table.num_rows != 1:
            raise FileNotFoundError(f"{address} holds {table.num_rows} graphs")
        return Graph.load(table.column(0)[0].as_py())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            linked = np.zeros(len(ids), np.int64)
            for shard in shards:
                g = graph(shard)
                row, hit = g.links(q, threshold)
                same = g.ids[hit] == ids[row]
                np.add.at(linked, row, g.weight[hit])
                linked -= np.bincount(row[same], g.weight[hit[same]], len(ids)).astype(np.int64)
                row, hit = row[~same], hit[~same]
                order = np.argsort(row, kind="stable")
                row, hit = row[order], hit[order]
                bounds = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1], [True]))) if len(row) else np.zeros(0, np.int64)
                last = np.full(len(g.ids), -1)
                a, b = [], []
                for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    r, h = int(row[s]), hit[s:e]
                    old = np.unique(last[h])
                    a += [int(ids[r])] * int((old >= 0).sum())
                    b += ids[old[old >= 0]].tolist()
                    new = h[last[h] < 0]
                    a += [int(ids[r])] * len(new)
                    b += g.ids[new].tolist()
                    last[h] = r
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), np.int32)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids), pa.array(linked)], ["kind", "a", "b"])

        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                t = pa.Table.from_batches(held)
                held.clear()
                yield from block(t.column(0).to_numpy(), _matrix(t.column(1).combine_chunks(), dim))

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield from flush()
        yield from flush()

    return run


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
