"""Secret scans: pattern findings, and a character convolutional network over every candidate.

Base findings are three patterns over whole texts (assign, access, hex). Candidates are all maximal runs of 8 or
more token characters but plain words: a run is one if it holds a digit, changes from lower to upper case
twice, has `+`, `/` or `_` between letters, is 20 or longer, or stands where a value is assigned (after a
colon, an equals sign, a quote or `bearer`); and the values of base findings, should they be none of these. A network written in numpy
reads each candidate whole, with its context on both sides: character embeddings and an inside flag, one
convolution, maximum and mean pooling (over pieces that overlap by a filter's width, so length has no bound), one output.
It scores every candidate, those that a pattern knows too.

It is trained on every distinct candidate, those that the patterns label and those that they don't, each of the same
weight whatever its length, and on a fixed set of generated findings in published key formats
and of look-alikes that are none (addresses, numbers, dates, identifiers), so that it is trained on any corpus. All
candidates of a label together weigh no more than BALANCE, so generated findings don't fade as a corpus grows.
The labels are positive and unlabelled: a first fit takes unlabelled candidates for nothing, then those of a sample
that score below all but the lowest of held-out positives (as spies) become negatives, and the others stay out of a second fit. Positives are shown with
and without their context. A stratified fifth of either label is held out; it calibrates the output (Platt)
and sets the threshold: the highest that keeps `recall` of the held-out positives, and never under one half. A
candidate of at least that probability becomes a finding of kind `model`.

Up to `shard` pieces are learnt by the driver. More are spread over shards by their hash: in every epoch each shard takes
the current network through its own candidates and the generated ones, and averages weighted by candidates, summed in a
tree of fan-in FAN, are the next. Held-out logits of all shards are counted in steps of 1 / STEPS, which thresholds are read from.

Null text is empty. Rows are judged one by one; repeated rows are rows, a null doc_id is a row; an empty table
gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from delver.llm.common import stored

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "model")
VALUE = re.compile(r"[A-Za-z0-9+/_.=-]+\Z")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: What tells a run from a plain word: a digit, case that changes back and forth, a symbol between letters.
TELLING = re.compile(r"[0-9]|[a-z][A-Z][A-Za-z]*?[a-z][A-Z]|[A-Za-z][+/_][A-Za-z]")
ALNUM = re.compile(r"[A-Za-z0-9]")
BEFORE = re.compile(r"""(?:[:=]["' ]?|["'])\Z|\bbearer \Z""", re.I)
LONG = 20
#: Unlabelled candidates above this share of the held-out positives are left out of the second fit.
SPIES = 0.1
CONTEXT = 24

WIDTH, EMBED, FILTERS, PIECE = 5, 12, 32, 112
CODES = 100
SHARD, FAN, STEPS, BALANCE = 32_000, 64, 1024, 1000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted: leftmost non-overlapping matches per kind, those that are too short dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of token characters that are no plain words."""
    for m in RUN.finditer(text):
        a, b = m.span()
        run = m[0]
        if TELLING.search(run) or (b - a >= LONG and ALNUM.search(run)) or (a and text[a - 1] in ":=\"' " and BEFORE.search(text, max(0, a - 8), a)):
            yield a, b


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str, int]]]:
    """(base spans, candidates as (start, end, snippet with context, label)): label 1 where a base span meets it."""
    base = base_spans(text)
    found: list[tuple[int, int, int]] = []
    reach = i = 0  # base spans before i end before this run; reach is the furthest end of those
    open_: list[tuple[int, int]] = []
    for a, b in runs(text):
        while i < len(base) and base[i][0] < b:
            open_.append((base[i][0], base[i][2]))
            reach = max(reach, base[i][2])
            i += 1
        hit = reach > a and any(s < b and a < e for s, e in open_)
        if reach <= a:
            open_ = []
        found.append((a, b, int(hit)))
    starts = [f[0] for f in found]
    for s, k, e in base:
        if k == 0:
            s = e - len(VALUE.search(text[s:e])[0])  # type: ignore[index]
        j = bisect.bisect_left(starts, e) - 1
        if j < 0 or found[j][1] <= s:
            found.append((s, e, 1))
    plain = lambda x: x.replace("\0", " ").replace("\n", " ")
    return base, [(s, e, "\0".join(plain(x) for x in (text[max(0, s - CONTEXT) : s], text[s:e], text[e : e + CONTEXT])), y) for s, e, y in sorted(set(found))]


def encode(snippets: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, inside flags, snippet of each piece): pieces of PIECE characters that overlap by WIDTH - 1."""
    codes, inside, owner = [], [], []
    for n, s in enumerate(snippets):
        left, own, right = s.split("\0")
        text = (left + own + right).encode("latin-1", "replace")
        c = np.frombuffer(text, np.uint8).astype(np.int64)
        c = np.where((c >= 32) & (c < 127), c - 30, 1)
        f = np.zeros(len(c), np.float32)
        f[len(left) : len(left) + len(own)] = 1
        for a in range(0, max(1, len(c) - WIDTH + 1), PIECE - WIDTH + 1):
            x, y = np.zeros(PIECE, np.uint8), np.zeros(PIECE, np.float32)
            part = c[a : a + PIECE]
            x[: len(part)], y[: len(part)] = part, f[a : a + PIECE]
            codes.append(x)
            inside.append(y)
            owner.append(n)
    return np.array(codes).reshape(-1, PIECE), np.array(inside).reshape(-1, PIECE), np.array(owner, np.int64)


def _sizes(snippets: list[str]) -> np.ndarray:
    """Log length of each candidate."""
    return np.array([math.log2(s.rindex("\0") - s.index("\0")) / 4 for s in snippets], np.float32)


class Network:
    """Embedding, convolution, maximum and mean over positions, length, logistic output; Platt scaling and a threshold."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.e = rng.normal(0, 0.3, (CODES, EMBED)).astype(np.float32)
        self.w = rng.normal(0, 0.15, (WIDTH * (EMBED + 1), FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.v = rng.normal(0, 0.2, 2 * FILTERS + 1).astype(np.float32)
        self.c = np.zeros(1, np.float32)
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0
        self.rest()

    def params(self) -> list[np.ndarray]:
        return [self.e, self.w, self.b, self.v, self.c]

    def rest(self) -> None:
        """Adam begins anew."""
        self.m1, self.m2, self.step = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()], np.zeros(1)

    def flat(self) -> np.ndarray:
        """Weights and Adam's moments, which shards average alike."""
        return np.concatenate([p.ravel() for p in (*self.params(), *self.m1, *self.m2, self.step)])

    def load(self, theta: np.ndarray) -> Network:
        at = 0
        for p in (*self.params(), *self.m1, *self.m2, self.step):
            p[...] = theta[at : at + p.size].reshape(p.shape)
            at += p.size
        return self

    def _maps(self, codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows, rectified filter outputs, whether a window's middle is inside the candidate)."""
        x = np.concatenate((self.e[codes], inside[:, :, None]), 2)
        win = np.lib.stride_tricks.sliding_window_view(x, WIDTH, 1).transpose(0, 1, 3, 2).reshape(len(x), PIECE - WIDTH + 1, -1)
        return win, np.maximum(win @ self.w + self.b, 0), inside[:, WIDTH // 2 : PIECE - WIDTH // 2]

    def logits(self, snippets: list[str]) -> np.ndarray:
        out = np.zeros(len(snippets))
        for a in range(0, len(snippets), 256):
            part = snippets[a : a + 256]
            codes, inside, owner = encode(part)
            top, total, n = np.zeros((len(part), FILTERS), np.float32), np.zeros((len(part), FILTERS), np.float32), np.zeros(len(part), np.float32)
            for i in range(0, len(codes), 512):
                _, h, own = self._maps(codes[i : i + 512], inside[i : i + 512])
                np.maximum.at(top, owner[i : i + 512], h.max(1))
                np.add.at(total, owner[i : i + 512], np.einsum("npf,np->nf", h, own))
                np.add.at(n, owner[i : i + 512], own.sum(1))
            out[a : a + 256] = np.concatenate((top, total / np.maximum(n, 1)[:, None], _sizes(part)[:, None]), 1) @ self.v + self.c
        return out

    def probability(self, snippets: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(snippets) + self.shift, -60, 60)))

    def fit(self, snippets: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 5) -> None:
        """Adam over shuffled pieces; every piece carries the label of its candidate and an equal share of its weight."""
        rng = np.random.default_rng(seed)
        codes, inside, owner = encode(snippets)
        y, size = labels[owner].astype(np.float32), _sizes(snippets)[owner]
        weight = (weights / np.bincount(owner, minlength=len(snippets)))[owner].astype(np.float32)
        params, step = self.params(), self.step
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for a in range(0, len(order), 64):
                i = order[a : a + 64]
                win, h, own = self._maps(codes[i], inside[i])
                share = own / np.maximum(own.sum(1, keepdims=True), 1)
                at = h.argmax(1)
                top = np.take_along_axis(h, at[:, None, :], 1)[:, 0]
                f = np.concatenate((top, np.einsum("npf,np->nf", h, share), size[i, None]), 1)
                p = 1 / (1 + np.exp(-np.clip(f @ self.v + self.c, -60, 60)))
                g = (p - y[i]) * weight[i] / len(i)
                gf = g[:, None] * self.v
                gh = share[:, :, None] * gf[:, None, FILTERS : 2 * FILTERS]
                np.put_along_axis(gh, at[:, None, :], np.take_along_axis(gh, at[:, None, :], 1) + gf[:, None, :FILTERS], 1)
                gh *= h > 0
                flat = gh.reshape(-1, FILTERS)
                gw = win.reshape(len(flat), -1).T @ flat
                gx = (flat @ self.w.T).reshape(len(i), -1, WIDTH, EMBED + 1)[..., :EMBED]
                per = np.zeros((len(i), PIECE, EMBED), np.float32)
                for k in range(WIDTH):
                    per[:, k : k + gx.shape[1]] += gx[:, :, k]
                ids = codes[i].ravel()
                sort = np.argsort(ids, kind="stable")
                rows, first = np.unique(ids[sort], return_index=True)
                ge = np.zeros_like(self.e)
                ge[rows] = np.add.reduceat(per.reshape(-1, EMBED)[sort], first, axis=0)
                step += 1
                for q, grad, u, s in zip(params, (ge, gw, flat.sum(0), (g[:, None] * f).sum(0), g.sum(keepdims=True)), self.m1, self.m2, strict=True):
                    u += 0.1 * (grad - u)
                    s += 0.001 * (grad * grad - s)
                    q -= rate * (u / (1 - 0.9 ** step[0])) / (np.sqrt(s / (1 - 0.999 ** step[0])) + 1e-8)

    def calibrate(self, z: np.ndarray, labels: np.ndarray, n: np.ndarray, recall: float) -> None:
        """On held-out logits z of weights n."""
        y, n = labels.astype(float), n.astype(float)
        t = np.where(y == 1, ((n * y).sum() + 1) / ((n * y).sum() + 2), 1 / ((n * (1 - y)).sum() + 2))

        def loss(a: float, b: float) -> float:  # the pull towards a = 1 keeps separable data finite
            u = a * z + b
            return float((n * (np.logaddexp(0, u) - t * u)).sum() + (a - 1) ** 2 / 2)

        a, b = 1.0, 0.0
        for _ in range(50):  # Newton steps, halved until they gain
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = n * (p * (1 - p) + 1e-9)
            g = np.array([(n * (p - t) * z).sum() + (a - 1), (n * (p - t)).sum()])
            h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            d = np.linalg.solve(h, g)
            size = 1.0
            while size > 1e-4 and not loss(a - size * d[0], b - size * d[1]) < loss(a, b):
                size /= 2
            if size <= 1e-4:
                break
            a, b = a - size * d[0], b - size * d[1]
        a = max(a, 1e-3)
        self.scale, self.shift = float(a), float(b)
        lowest = _ranked(z[y == 1], n[y == 1], (1 - recall) * n[y == 1].sum())
        self.threshold = max(0.5, float(1 / (1 + np.exp(-np.clip(self.scale * lowest + self.shift, -60, 60)))) - 1e-12)


def _ranked(z: np.ndarray, n: np.ndarray, k: float) -> float:
    """The lowest value such that more than k of the weights n are at or below it."""
    order = np.argsort(z, kind="stable")
    return float(z[order][np.searchsorted(np.cumsum(n[order]), k, "right")])


def generated(n: int = 600, seed: int = 13) -> list[tuple[str, int]]:
    """n labelled findings of either label: random keys in published formats, and look-alikes that are no secret."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, k: "".join(rng.choice(list(chars), int(k)))
    low, up, dig, hexa = string.ascii_lowercase, string.ascii_uppercase, string.digits, "0123456789abcdef"
    alnum, b64 = low + up + dig, low + up + dig + "+/"
    word = lambda: pick(low, rng.integers(2, 10))
    num = lambda a, b: str(int(rng.integers(a, b)))
    secret = [
        lambda: pick(alnum, rng.integers(20, 48)),
        lambda: pick(b64, rng.integers(24, 64)) + "=" * int(rng.integers(0, 3)),
        lambda: pick(hexa, rng.choice([32, 40, 48, 64])),
        lambda: "AKIA" + pick(up + dig, 16),
        lambda: "ghp_" + pick(alnum, 36),
        lambda: "xoxb-" + pick(dig, 12) + "-" + pick(alnum, 24),
        lambda: "sk_live_" + pick(alnum, 24),
        lambda: "AIza" + pick(alnum + "_-", 35),
        lambda: "eyJ" + pick(alnum + "_-", rng.integers(20, 40)) + "." + pick(alnum + "_-", rng.integers(30, 60)) + "." + pick(alnum + "_-", 43),
        lambda: "glpat-" + pick(alnum + "_-", 20),
        lambda: pick(up + dig, rng.integers(20, 40)),
        lambda: pick(low + dig, rng.integers(20, 40)),
        lambda: pick(low + up, rng.integers(24, 44)),
    ]
    harmless = [
        lambda: word() + "." + num(10, 99),
        lambda: f"mail{num(0, 30)}.{word()}.{rng.choice(['com', 'org', 'net'])}",
        lambda: f"{word()}.{word()}{num(0, 30)}",
        lambda: num(10**15, 10**16 - 1),
        lambda: ".".join(num(0, 256) for _ in range(4)),
        lambda: num(10**7, 10**16),
        lambda: num(10**15, 10**16 - 1),
        lambda: f"{num(1990, 2030)}-{int(rng.integers(1, 13)):02d}-{int(rng.integers(1, 29)):02d}",
        lambda: f"{num(200, 999)}-{num(100, 999)}-{num(1000, 9999)}",
        lambda: f"{word()}{num(1, 99)}.example.{rng.choice(['com', 'org', 'net'])}",
        lambda: f"www.{word()}{word()}.com/{word()}/{word()}/{num(1, 9999)}",
        lambda: "_".join(word() for _ in range(int(rng.integers(2, 5)))),
        lambda: "-".join(word() for _ in range(int(rng.integers(3, 7)))),
        lambda: "/".join(["", *(word() for _ in range(int(rng.integers(2, 6))))]),
        lambda: "".join(word().title() for _ in range(int(rng.integers(3, 6)))),
        lambda: word() + "".join(word().title() for _ in range(int(rng.integers(2, 5)))) + num(0, 9),
        lambda: f"{word()}-{num(0, 20)}.{num(0, 20)}.{num(0, 20)}.tar.gz",
        lambda: f"{num(0, 90)}.{num(0, 999999)}e-{num(1, 20)}",
        lambda: "".join(word() for _ in range(int(rng.integers(4, 8)))),
        lambda: pick("-=_.", 1) * int(rng.integers(20, 60)) + word(),
        lambda: word() * 3 + num(0, 9),
        lambda: "".join(word().upper() for _ in range(int(rng.integers(4, 6)))),
        lambda: num(10, 24) + num(10, 60) + num(100000, 999999),
    ]
    around = [lambda: "", lambda: " ".join(word() for _ in range(4)) + " ", lambda: word() + "\"", lambda: word().title() + ": ", lambda: "\n" + word() + " = \"", lambda: word() + " (", lambda: word() + "." + num(0, 99) + "@"]
    told = [lambda: f"{word()} {rng.choice(['token', 'password', 'secret', 'api_key', 'apikey'])} = \"", lambda: "Authorization: Bearer ", lambda: f"{word().upper()}_KEY=", lambda: "key: "]
    after = [lambda: "", lambda: " " + " ".join(word() for _ in range(4)), lambda: "\" ", lambda: ". ", lambda: ")\n"]
    out = []
    for k in range(n):
        left = told if k % 2 else around
        out.append(("\0".join((left[int(rng.integers(len(left)))]()[-CONTEXT:], secret[k % len(secret)](), after[int(rng.integers(len(after)))]()[:CONTEXT])).replace("\n", " "), 1))
        left = told if k % 8 == 0 else around
        out.append(("\0".join((left[int(rng.integers(len(left)))]()[-CONTEXT:], harmless[k % len(harmless)](), after[int(rng.integers(len(after)))]()[:CONTEXT])).replace("\n", " "), 0))
    return out


def _views(part: list[str], contexts: list[str], rng: np.random.Generator) -> list[str]:
    """As they are, without context, and in another candidate's context."""
    values = [s.split("\0") for s in part]
    others = [contexts[i].split("\0") for i in rng.integers(0, len(contexts), len(part))] if contexts else []
    return part + [f"\0{VALUE.search(v[1])[0] if VALUE.search(v[1]) else v[1]}\0" for v in values] + [f"{o[0]}\0{v[1]}\0{o[2]}" for v, o in zip(values, others, strict=bool(others))]


def _fold(part: list[str]) -> tuple[list[str], list[str]]:
    """(train, held out): every fifth in the order of a hash, so that every label has some of either."""
    part = sorted(part, key=lambda s: hashlib.md5(s.encode()).digest())
    return [s for i, s in enumerate(part) if i % 5], part[::5]


def _marks(yes: list[str], no: list[str]) -> np.ndarray:
    return np.array([1] * len(yes) + [0] * len(no))


def _weight(n: int) -> float:
    """Of each of n candidates of one label."""
    return min(1.0, BALANCE / max(n, 1))


def _tiled(part: list[str], views: list[str], made: set[str], weight: float) -> np.ndarray:
    """Of the views of some candidates: 1 for generated ones, weight for the others."""
    return np.tile([1.0 if s in made else weight for s in part], len(views) // max(1, len(part)))


def learn(sample: list[tuple[str, int]], recall: float = 0.98) -> Network:
    """sample: (snippet, 1 if a pattern labels it, else 0 for unlabelled)."""
    net, rng = Network(), np.random.default_rng(9)
    made = generated()
    ours = {s for s, _ in made}
    known = sorted({s for s, y in sample if y})
    unknown = sorted({s for s, y in sample if not y} - set(known))
    per_yes, per_no = _weight(len(known)), _weight(len(unknown))
    yes, yes_held = _fold(known + [s for s, y in made if y])
    no, no_held = _fold([s for s, y in made if not y])
    contexts = unknown or no
    first_yes = _views(yes, contexts, rng)
    net.fit(first_yes + no, _marks(first_yes, no), np.concatenate((_tiled(yes, first_yes, ours, per_yes), np.ones(len(no)))), epochs=5)
    if unknown:  # those that look like held-out positives stay out
        spies = _views(yes_held, [], rng)
        weights = _tiled(yes_held, spies, ours, per_yes)
        least = _ranked(net.logits(spies), weights, SPIES * weights.sum())
        sure = [s for s, z in zip(unknown, net.logits(unknown).tolist(), strict=True) if z < least]
        more, more_held = _fold(sure)
        no, no_held = no + more, no_held + more_held

    def both(yes: list[str], no: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        a, b = _views(yes, contexts, rng), _views(no, [], rng)
        return a + b, _marks(a, b), np.concatenate((_tiled(yes, a, ours, per_yes), _tiled(no, b, ours, per_no)))

    net.rest()
    net.fit(*both(yes, no), epochs=6, rate=0.005)
    held, y, weights = both(yes_held, no_held)
    net.calibrate(net.logits(held), y, weights, recall)
    return net


def _held(snippet: str) -> bool:
    return int.from_bytes(hashlib.md5(snippet.encode()).digest()[:4], "big") % 5 == 0


def _add(sums: pa.Table) -> pa.Table:
    rows = sorted(sums.to_pylist(), key=lambda r: r["shard"])
    total = sum(np.frombuffer(r["w"], np.float64) for r in rows)
    return pa.table({"shard": pa.array([rows[0]["shard"] // FAN], pa.int32()), "n": pa.array([sum(r["n"] for r in rows)], pa.float64()), "w": pa.array([total.tobytes()], pa.binary())})


def _steps(z: np.ndarray, y: int) -> list[tuple[int, int, int]]:
    """(label, step, n) of logits."""
    step, n = np.unique(np.clip(np.floor(z * STEPS), -64 * STEPS, 64 * STEPS).astype(np.int64), return_counts=True)
    return [(y, k, m) for k, m in zip(step.tolist(), n.tolist(), strict=True)]


def learn_spread(found: DataFrame, shards: int, recall: float = 0.98) -> Network:
    """learn() over found(snippet, label), distinct, in shards that depend on the snippets alone."""
    spark = found.sparkSession
    made = generated()
    ours = {s for s, _ in made}
    yes, yes_held = _fold([s for s, y in made if y])
    no, no_held = _fold([s for s, y in made if not y])
    sizes = {r.label: r.n for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    per_yes, per_no = _weight(sizes.get(1, 0)), _weight(sizes.get(0, 0))
    own = found.withColumn("shard", F.pmod(F.xxhash64("snippet"), F.lit(shards)).cast("int"))
    net = Network()

    def by_shard(table: DataFrame) -> GroupedData:
        """As many tasks as shards: they are small, and long to learn."""
        return table.repartition(shards, "shard").groupBy("shard")

    def kinds(t: pa.Table) -> tuple[list[str], list[str], list[str]]:
        """(positives, negatives, all without a label) of a shard; label 2 is left out of the negatives."""
        rows = sorted(zip(t.column("snippet").to_pylist(), t.column("label").to_pylist(), strict=True))
        return tuple([s for s, y in rows if y in want] for want in ((1,), (0,), (0, 2)))  # type: ignore[return-value]

    def epoch(table: DataFrame, turn: int, negatives: bool, rate: float) -> None:
        now = spark.sparkContext.broadcast(net.flat())

        def work(t: pa.Table) -> pa.Table:
            shard = t.column("shard")[0].as_py()
            known, sure, contexts = kinds(t)
            rng = np.random.default_rng((9, shard, turn))
            own_yes = [s for s in known if not _held(s)] + yes
            own_no = no + [s for s in sure if not _held(s)] if negatives else no
            a, b = _views(own_yes, contexts or no, rng), _views(own_no, [], rng) if negatives else no
            weights = np.concatenate((_tiled(own_yes, a, ours, per_yes * shards), _tiled(own_no, b, ours, per_no * shards)))  # each shard has all generated ones
            mine = Network().load(now.value)
            mine.fit(a + b, _marks(a, b), weights, 1, rate, seed=5 + turn)
            size = float(t.num_rows)
            return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([size]), "w": pa.array([(mine.flat().astype(np.float64) * size).tobytes()], pa.binary())})

        sums, left = by_shard(table).applyInArrow(work, "shard int, n double, w binary"), shards
        while left > FAN:
            sums, left = sums.groupBy(F.floor(F.col("shard") / FAN)).applyInArrow(_add, "shard int, n double, w binary"), -(-left // FAN)
        rows = sorted(sums.collect(), key=lambda r: r.shard)
        net.load(sum(np.frombuffer(r.w, np.float64) for r in rows) / sum(r.n for r in rows))

    def logits(table: DataFrame, calibrating: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(z, label, weight) of the held-out views of all shards and of the generated ones; positives alone unless calibrating."""
        now = spark.sparkContext.broadcast(net.flat())

        def held(known: list[str], sure: list[str], contexts: list[str], rng: np.random.Generator) -> list[tuple[int, int, int]]:
            mine = Network().load(now.value)
            out = _steps(mine.logits(_views(known, (contexts or no) if calibrating else [], rng)), 1)
            return out + (_steps(mine.logits(_views(sure, [], rng)), 0) if calibrating else [])

        def work(t: pa.Table) -> pa.Table:
            known, sure, contexts = kinds(t)
            rng = np.random.default_rng((10, t.column("shard")[0].as_py()))
            out = held([s for s in known if _held(s)], [s for s in sure if _held(s)], contexts, rng)
            return pa.table({k: pa.array([x[i] for x in out], pa.int64()) for i, k in enumerate(("y", "step", "n"))})

        counts = {(r.y, r.step): r.n * (per_yes if r.y else per_no) for r in by_shard(table).applyInArrow(work, "y long, step long, n long").groupBy("y", "step").agg(F.sum("n").alias("n")).collect()}
        for y, k, n in held(yes_held, no_held, no, np.random.default_rng(10)):
            counts[y, k] = counts.get((y, k), 0) + n
        keys = np.array(sorted(counts))
        return keys[:, 1] / STEPS, keys[:, 0], np.array([counts[y, k] for y, k in keys.tolist()], float)

    for turn in range(5):
        epoch(own, turn, False, 0.01)
    z, _, n = logits(own, False)
    spies = _ranked(z, n, SPIES * n.sum())
    now = spark.sparkContext.broadcast(net.flat())

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Network().load(now.value)
        for batch in batches:
            y = batch.column(1).to_numpy().copy()
            at = np.flatnonzero(y == 0)
            y[at[mine.logits(batch.column(0).take(pa.array(at)).to_pylist()) >= spies]] = 2
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y, pa.int32()), batch.column(2)], ["snippet", "label", "shard"])

    own = stored(spark, own.select("snippet", "label", "shard").mapInArrow(mark, "snippet string, label int, shard int"), "marked")
    net.rest()
    for turn in range(5, 11):
        epoch(own, turn, True, 0.005)
    net.calibrate(*logits(own, True), recall)
    return net


_FOUND = "doc_id long, base array<struct<start:int,kind:int,end:int>>, cand array<struct<start:int,end:int,snippet:string,label:int>>"
_BASE_T = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_CAND_T = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("snippet", pa.string()), ("label", pa.int32())]))


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, cand = [], []
        for text in batch.column(1).to_pylist():
            b, c = candidates(text or "")
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in b])
            cand.append([{"start": s, "end": e, "snippet": x, "label": y} for s, e, x, y in c])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, _BASE_T), pa.array(cand, _CAND_T)], ["doc_id", "base", "cand"])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, recall: float = 0.98, shard: int = SHARD) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model."""
    spark = docs.sparkSession
    found = stored(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_find, _FOUND), "candidates")
    each = found.select(F.explode("cand").alias("c")).select("c.snippet", "c.label")
    each = stored(spark, each.groupBy("snippet").agg(F.max("label").alias("label")), "distinct")
    shards = math.ceil((each.agg(F.sum(F.ceil(F.length("snippet") / (PIECE - WIDTH + 1)))).first()[0] or 0) / shard)
    net = spark.sparkContext.broadcast(learn_spread(each, shards, recall) if shards > 1 else learn([(r.snippet, r.label) for r in each.collect()], recall))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            base, cand = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            more = [(i, x) for i, own in enumerate(cand) for x in own]
            texts = list(dict.fromkeys(x["snippet"] for _, x in more))  # copies are scored once
            known = dict(zip(texts, net.value.probability(texts).tolist(), strict=True))
            added: dict[int, list[tuple[int, int, int]]] = {}
            for i, x in more:
                if known[x["snippet"]] >= net.value.threshold:
                    added.setdefault(i, []).append((x["start"], 3, x["end"]))
            for i, b in enumerate(base):
                own = [(x["start"], x["kind"], x["end"]) for x in b]
                n = [sum(k == kind for _, k, _ in own) for kind in range(3)]
                rows.append((*n, hashlib.sha256(_joined(own).encode()).hexdigest(), _joined(sorted(own + added.get(i, []))), len(added.get(i, []))))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
