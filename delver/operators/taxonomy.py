"""Concept clustering over a result list, and query correction with a character language model."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates(rows: DataFrame, total: int, result_docs: int, n: int) -> DataFrame:
    """Top n (concept, df, gdf, score, rank_score) from rows(concept, doc_id, in_result)."""
    inc = max(2, total // 10_000)
    c = rows.distinct().groupBy("concept").agg(F.sum(F.col("in_result").cast("int")).alias("df"), F.count("*").alias("gdf")).where("df > 0")
    up = F.log(F.col("df") + 1.0)
    score = up / F.log((F.sqrt(F.col("gdf") + 1.0) + 1) / math.log(total + 2) + 2)
    rank = up / F.log((F.col("gdf") + inc) / F.log(F.sqrt(F.lit(float(total))) + 1) + 1)
    often = F.lit(result_docs > 10) & (F.col("df") > result_docs / 3.5)
    c = c.withColumn("score", F.round(F.when(often, 0.0).otherwise(score), 6)).withColumn("rank_score", F.round(F.when(often, 0.0).otherwise(rank), 6))
    return c.orderBy(F.desc("rank_score"), "concept").limit(n)


def containment(rows: DataFrame, least: float, most: float) -> DataFrame:
    """(i, j, c) with c = |i & j| / |j| >= least and the reverse <= most, over rows(concept, doc_id)."""
    r = rows.select("concept", "doc_id").distinct()
    size = r.groupBy("concept").agg(F.count("*").alias("n"))
    both = r.select("doc_id", F.col("concept").alias("i")).join(r.select("doc_id", F.col("concept").alias("j")), "doc_id").where("i <> j").groupBy("i", "j").agg(F.count("*").alias("k"))
    x = both.join(size.select(F.col("concept").alias("i"), F.col("n").alias("ni")), "i").join(size.select(F.col("concept").alias("j"), F.col("n").alias("nj")), "j")
    return x.where((F.col("k") / F.col("nj") >= least) & (F.col("k") / F.col("ni") <= most)).select("i", "j", F.round(F.col("k") / F.col("nj"), 6).alias("c"))


def siblings(concepts: DataFrame) -> DataFrame:
    """(i, j, same): equally long concepts with equal terms at equal positions."""
    t = concepts.select("concept", F.split("concept", " ").alias("w")).distinct()
    parts = t.select("concept", "w", F.posexplode("w").alias("pos", "t"))
    a, b = parts.select(F.col("concept").alias("i"), F.size("w").alias("n"), "pos", "t"), parts.select(F.col("concept").alias("j"), F.size("w").alias("n"), "pos", "t")
    return a.join(b, ["n", "pos", "t"]).where("i < j").groupBy("i", "j").agg(F.count("*").alias("same"))


def label_conflict(a: str, b: str) -> bool:
    """Near-duplicate labels: equal term count and initials and edit distance below 4; Han labels by distance, containment or same terms."""
    x, y = a.lower(), b.lower()
    d = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        last, d[0] = d[0], i
        for j, q in enumerate(y, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (p != q))
    if any("一" <= ch <= "鿿" for ch in x + y):
        return d[-1] < 2 or x in y or y in x or sorted(x.split()) == sorted(y.split())
    u, v = x.split(), y.split()
    return len(u) == len(v) and [w[0] for w in u] == [w[0] for w in v] and d[-1] < 4


def tree(rows: DataFrame, scores: DataFrame, per_level: int = 6, levels: int = 3, least: float = 0.3) -> DataFrame:
    """(query, node, parent, level, label): greedy taxonomy per query over rows(query, concept, doc_id), a few hundred concepts each."""
    x = rows.join(scores.select("concept", "rank_score"), "concept")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = {c: set(g) for c, g in pdf.groupby("concept").doc_id}
        score = dict(zip(pdf.concept, pdf.rank_score, strict=True))
        nodes = [("", 0, set(pdf.doc_id), set(pdf.doc_id), 0)]
        out, left = [], set(docs)
        while left:
            best = None
            for k, (label, level, own, open_, kids) in enumerate(nodes):
                if level >= levels or kids >= per_level:
                    continue
                for c in sorted(left):
                    share = len(docs[c] & own) / len(docs[c])
                    new = len(docs[c] & open_) / max(len(docs[c]), 1)
                    if share < least or (label and len(docs[c]) >= len(own)):
                        continue
                    boost = 1.5 if set(label.split()) & set(c.split()) else 1.0
                    s = math.sqrt(share * new) * boost * (score[c] + 0.1)
                    if s > 0 and (best is None or (s, c) > best[:2]):
                        best = (s, c, k)
            if best is None:
                break
            _, c, k = best
            left.discard(c)
            if any(label_conflict(c, n[0]) for n in nodes if n[0]):
                continue
            label, level, own, open_, kids = nodes[k]
            nodes[k] = (label, level, own, open_ - set(sorted(docs[c])[::2]), kids + 1)
            nodes.append((c, level + 1, docs[c] & own, docs[c] & own, 0))
            out.append((pdf["query"].iloc[0], len(nodes) - 1, k, level + 1, c))
        return pd.DataFrame(out, columns=["query", "node", "parent", "level", "label"])

    return x.groupBy("query").applyInPandas(run, "query string, node int, parent int, level int, label string")


def char_model(texts: DataFrame, letters: str = r"\p{L}") -> DataFrame:
    """(gram, len, p): unigram shares; bigrams P(b given a) >= 0.0015; trigrams with P(ab) P(c given ab) >= 0.00015; adjacent letters only."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({letters}+)"), F.lit(1))).alias("r"))
    c = runs.select("r", F.explode(F.sequence(F.lit(1), F.length("r"))).alias("i")).select("r", "i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("len"))
    g = c.where("i + len - 1 <= length(r)").select(F.expr("substring(r, i, len)").alias("gram"), "len").groupBy("gram", "len").agg(F.count("*").alias("n"))
    total = g.where("len = 1").agg(F.sum("n").alias("total"))
    uni = g.where("len = 1").crossJoin(F.broadcast(total)).select("gram", "len", (F.col("n") / F.col("total")).alias("p"))
    pre = lambda k: g.where(F.col("len") == k).select(F.col("gram").alias("pre"), F.col("n").alias("m"))
    two = g.where("len = 2").withColumn("pre", F.expr("substring(gram, 1, 1)")).join(pre(1), "pre").select("gram", "len", (F.col("n") / F.col("m")).alias("p")).where("p >= 0.0015")
    three = g.where("len = 3").withColumn("pre", F.expr("substring(gram, 1, 2)")).join(pre(2), "pre").join(two.select(F.col("gram").alias("pre"), F.col("p").alias("q")), "pre")
    three = three.withColumn("p", F.col("n") / F.col("m")).where("q * p >= 0.00015").select("gram", "len", "p")
    return uni.union(two).union(three)


def log_model(log: DataFrame) -> DataFrame:
    """(gram, len, w): df * 1e-6 a unigram, df * 0.004 a bigram or trigram, summed over log(text, df)."""
    c = log.select(F.lower("text").alias("r"), "df").select("r", "df", F.explode(F.sequence(F.lit(1), F.greatest(F.length("r"), F.lit(1)))).alias("i")).select("r", "df", "i", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("len"))
    g = c.where("i + len - 1 <= length(r)").select(F.expr("substring(r, i, len)").alias("gram"), "len", (F.col("df") * F.when(F.col("len") == 1, 1e-6).otherwise(0.004)).alias("w"))
    return g.groupBy("gram", "len").agg(F.sum("w").alias("w"))


def keep_ratio(scored: DataFrame, ratio: float = 0.7, own: float = 0.5) -> DataFrame:
    """Result rule over scored(query, candidate, score): drop everything not far better than the query itself if it is a candidate; stop at the first score under ratio times the one before."""
    from pyspark.sql import Window as W

    mine = scored.where("candidate = query").select("query", F.col("score").alias("mine"))
    x = scored.join(mine, "query", "left").where("mine is null or (candidate <> query and mine < score * " + str(own) + ")").drop("mine")
    w = W.partitionBy("query").orderBy(F.desc("score"), "candidate")
    x = x.withColumn("ok", (F.col("score") >= ratio * F.coalesce(F.lag("score").over(w), F.col("score"))).cast("int"))
    return x.withColumn("ok", F.min("ok").over(w.rowsBetween(W.unboundedPreceding, 0))).where("ok = 1").select("query", "candidate", "score")


def segmentations(texts: DataFrame, syllables: list[str], most: int = 1024) -> DataFrame:
    """(id, parts): every split of texts(id, text) into dictionary syllables, fuzzy initials and finals included, at most `most`."""
    fuzzy = {"zh": "z", "ch": "c", "sh": "s", "ng": "n"}
    known = set(syllables)
    for s in syllables:
        for a, b in fuzzy.items():
            known |= {b + s[2:]} if s.startswith(a) else set()
            known |= {s[:-1]} if a == "ng" and s.endswith(a) else set()

    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            out = []
            for i, t in zip(f.id, f.text, strict=True):
                stack, n = [(0, ())], 0
                while stack and n < most:
                    at, parts = stack.pop()
                    if at == len(t):
                        out.append((i, " ".join(parts)))
                        n += 1
                        continue
                    stack += [(at + k, (*parts, t[at : at + k])) for k in range(1, 7) if t[at : at + k] in known and at + k <= len(t)]
            yield pd.DataFrame(out, columns=["id", "parts"])

    return texts.mapInPandas(run, "id long, parts string")


def beam(queries: DataFrame, model: dict[str, float], alternatives: dict[str, str], width: int = 50) -> DataFrame:
    """(id, candidate, score): characters replaced by their alternatives, scored by the geometric mean of bigram chances, pruned at a fifth of the best."""

    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            out = []
            for i, t in zip(f.id, f.text, strict=True):
                now = [("", 0.0)]
                for ch in t:
                    grown = [(s + c, v + math.log(model.get((s[-1:] + c), model.get(c, 1e-6)))) for s, v in now for c in ch + alternatives.get(ch, "")]
                    grown.sort(key=lambda x: (-x[1], x[0]))
                    best = grown[0][1] / len(grown[0][0])
                    now = [g for g in grown if g[1] / len(g[0]) >= best + math.log(0.2)][:width]
                out += [(i, s, math.exp(v / max(len(s), 1))) for s, v in now[:10]]
            yield pd.DataFrame(out, columns=["id", "candidate", "score"])

    return queries.mapInPandas(run, "id long, candidate string, score double")


#: Suffixes and prefixes that are taken for one another, each way at half weight.
SUFFIXES = [("an", "ang"), ("en", "eng"), ("in", "ing"), ("on", "ong")]
PREFIXES = [("z", "zh"), ("c", "ch"), ("s", "sh"), ("n", "l")]


def fuzzy(syllables: DataFrame, weight: float = 0.5) -> DataFrame:
    """(syllable, variant, weight): the syllable itself, and what one rule makes of it; gn and mg are typing errors for ng."""
    s = F.regexp_replace(F.lower("syllable"), "(gn|mg)$", "ng")
    base = syllables.select("syllable", s.alias("s"))
    out = base.select("syllable", F.col("s").alias("variant"), F.lit(1.0).alias("weight"))
    for a, b in SUFFIXES:
        for x, y in ((a, b), (b, a)):
            out = out.union(base.where(F.col("s").rlike(f"{x}$") & (F.lit(len(x) > len(y)) | ~F.col("s").rlike(f"{y}$"))).select("syllable", F.regexp_replace("s", f"{x}$", y), F.lit(weight)))
    for a, b in PREFIXES:
        for x, y in ((a, b), (b, a)):
            out = out.union(base.where(F.col("s").startswith(x) & (F.lit(not y.startswith(x)) | ~F.col("s").startswith(y))).select("syllable", F.regexp_replace("s", f"^{x}", y), F.lit(weight)))
    return out.groupBy("syllable", "variant").agg(F.max("weight").alias("weight"))


def spellings(words: DataFrame, table: DataFrame) -> DataFrame:
    """(id, full, initials): how words(id, text) are spelt by table(char, spelling), all readings combined in the order of the text."""
    chars = words.select("id", F.posexplode(F.split("text", "")).alias("at", "char")).where("char <> ''").join(table, "char", "left").select("id", "at", F.coalesce("spelling", "char").alias("s"))
    own = chars.groupBy("id", "at").agg(F.array_sort(F.collect_set("s")).alias("s")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("r"))
    grow = F.aggregate(F.col("r"), F.array(F.struct(F.lit("").alias("f"), F.lit("").alias("i"))), lambda acc, x: F.flatten(F.transform(acc, lambda p: F.transform(x["s"], lambda s: F.struct(F.concat(p["f"], s).alias("f"), F.concat(p["i"], F.substring(s, 1, 1)).alias("i"))))))
    return own.select("id", F.explode(grow).alias("p")).select("id", F.col("p.f").alias("full"), F.col("p.i").alias("initials")).distinct()
