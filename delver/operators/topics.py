"""Topic detection and tracking: dense series, smoothing, bursts, series similarity, topic store; query suggestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from delver.operators.graph import cut


def daily_series(rows: DataFrame, start: str, end: str) -> DataFrame:
    """(topic, day, freq) without gaps from rows(topic, day)."""
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day")))
    counts = rows.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).groupBy("topic", "day").agg(F.count("*").alias("freq"))
    return counts.select("topic").distinct().select("topic", days.alias("day")).join(counts, ["topic", "day"], "left").withColumn("freq", F.coalesce("freq", F.lit(0)).cast("long"))


def ema_taps(n: int) -> list[float]:
    a = 2 / (n + 1)
    return [a * (1 - a) ** i for i in range(n)]


def convolve(a: list[float], b: list[float]) -> list[float]:
    out = [0.0] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            out[i + j] += x * y
    return out


def macd_taps(short: int = 4, long: int = 8) -> list[float]:
    s, m = ema_taps(short), ema_taps(long)
    return [(s[i] if i < short else 0.0) - m[i] for i in range(long)]


def histogram_taps(short: int = 4, long: int = 8, mid: int = 5) -> list[float]:
    m = macd_taps(short, long)
    c = convolve(ema_taps(mid), m)
    return [(m[i] if i < len(m) else 0.0) - c[i] for i in range(len(c))]


def filtered(series: DataFrame, taps: list[float], gap: int = 0) -> DataFrame:
    """series with value: a causal filter over the last days, 0 while there are fewer than gap + 1 points."""
    w = W.partitionBy("topic").orderBy("day")
    x = sum((F.coalesce(F.lag("freq", i).over(w), F.lit(0)) * F.lit(t) for i, t in enumerate(taps)), F.lit(0.0))
    return series.withColumn("value", F.when(F.row_number().over(w) > gap, x).otherwise(0.0))


def bursts(series: DataFrame, least: float = 1.0, peak: float = 13.0, gap: int = 3) -> DataFrame:
    """(topic, start, period, weight): maximal runs of two days or more with the histogram at `least`; max/mean of the series >= peak."""
    v = filtered(series, histogram_taps(), gap)
    ok = series.groupBy("topic").agg((F.max("freq") / F.avg("freq")).alias("_p")).where(F.col("_p") >= peak)
    w = W.partitionBy("topic").orderBy("day")
    runs = v.join(ok, "topic").where(F.col("value") >= least).withColumn("_g", F.date_sub("day", F.row_number().over(w)))
    out = runs.groupBy("topic", "_g").agg(F.min("day").alias("start"), F.count("*").cast("int").alias("period"), F.sum("value").alias("weight"))
    return out.where("period > 1").select("topic", "start", "period", "weight")


def series_similarity(series: DataFrame) -> DataFrame:
    """(a, b, sim), a < b: sqrt 2 times sum |psi_ab| over sum sqrt(psi_aa^2 + psi_bb^2) on interior days; 0 where all is zero."""
    w = W.partitionBy("topic").orderBy("day")
    x = series.select("topic", "day", F.col("freq").alias("x"), F.lag("freq").over(w).alias("p"), F.lead("freq").over(w).alias("n")).where("p is not null and n is not null")
    a, b = x.alias("a"), x.alias("b")
    psi = lambda s, t: F.col(f"{s}.x") * F.col(f"{t}.x") - 0.5 * (F.col(f"{s}.p") * F.col(f"{t}.n") + F.col(f"{s}.n") * F.col(f"{t}.p"))
    up, down = F.sum(F.abs(psi("a", "b"))), F.sum(F.sqrt(psi("a", "a") * psi("a", "a") + psi("b", "b") * psi("b", "b")))
    j = a.join(b, (F.col("a.day") == F.col("b.day")) & (F.col("a.topic") < F.col("b.topic"))).groupBy(F.col("a.topic").alias("a"), F.col("b.topic").alias("b"))
    return j.agg(up.alias("u"), down.alias("d")).select("a", "b", F.when(F.col("d") > 0, F.lit(2.0) ** 0.5 * F.col("u") / F.col("d")).otherwise(0.0).alias("sim"))


def in_range(burst: DataFrame, start: str, end: str) -> DataFrame:
    """Topics with a burst day in [start, end)."""
    d = burst.select("topic", F.explode(F.sequence("start", F.expr("date_add(start, period - 1)"))).alias("day"))
    return d.where((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date"))).select("topic").distinct()


def query_terms(log: DataFrame) -> DataFrame:
    """(term, slice, n) over log(query, terms, slice)."""
    return log.select(F.explode("terms").alias("term"), "slice").groupBy("term", "slice").agg(F.count("*").alias("n"))


def entropy(terms: DataFrame) -> DataFrame:
    """(term, entropy) of a term's distribution over slices."""
    p = F.col("n") / F.sum("n").over(W.partitionBy("term"))
    return terms.withColumn("p", p).groupBy("term").agg((-F.sum(F.col("p") * F.log("p"))).alias("entropy"))


def popular(log: DataFrame) -> DataFrame:
    """(query, freq, score): sum over terms of ln((count + 200 H) / (#terms + 200 sum H + 1) + 1), times sqrt(freq + 0.01)."""
    t = query_terms(log)
    period = t.groupBy("term").agg(F.sum("n").alias("c")).join(entropy(t), "term")
    total = period.agg(F.count("*").alias("k"), F.sum("entropy").alias("h"))
    ln = period.crossJoin(F.broadcast(total)).select("term", F.log((F.col("c") + 200 * F.col("entropy")) / (F.col("k") + 200 * F.col("h") + 1) + 1).alias("x"))
    q = log.groupBy("query", "terms").agg(F.count("*").alias("freq"))
    return q.select("query", "freq", F.explode("terms").alias("term")).join(ln, "term").groupBy("query", "freq").agg((F.sum("x") * F.sqrt(F.col("freq") + 0.01)).alias("score"))


def realtime(log: DataFrame, now: int) -> DataFrame:
    """(query, freq, score) of the latest slice: novelty times sqrt(freq * sum ln(slice count / (#terms + 1) + 1) + 0.01)."""
    t = query_terms(log)
    period = t.groupBy("term").agg(F.sum("n").alias("c"))
    late = t.where(F.col("slice") == now).select("term", F.col("n").alias("s"))
    k = late.agg(F.count("*").alias("k"))
    both = late.join(period, "term").crossJoin(F.broadcast(k))
    q = log.where(F.col("slice") == now).groupBy("query", "terms").agg(F.count("*").alias("freq"))
    x = q.select("query", "freq", F.explode("terms").alias("term")).join(both, "term")
    a = x.groupBy("query", "freq").agg(F.avg((F.col("s") + 1) / (F.col("c") + 1)).alias("new"), F.sum(F.log(F.col("s") / (F.col("k") + 1) + 1)).alias("ln"))
    return a.select("query", "freq", (F.col("new") * F.sqrt(F.col("freq") * F.col("ln") + 0.01)).alias("score"))


def greedy_distinct(scored: DataFrame, log: DataFrame, n: int) -> DataFrame:
    """The first n queries by score, each sharing no term with one before it; looks at a ranked list of 5 n."""
    short = scored.orderBy(F.desc(F.round("score", 6)), "query").limit(5 * n).join(log.select("query", "terms").distinct(), "query")

    def pick(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.assign(_s=pdf.score.round(6)).sort_values(["_s", "query"], ascending=[False, True])
        used, keep = set(), []
        for i, terms in zip(pdf.index, pdf.terms, strict=True):
            if used.isdisjoint(terms) and len(keep) < n:
                used |= set(terms)
                keep.append(i)
        return pdf.loc[keep, ["query", "score"]]

    return short.withColumn("_k", F.lit(1)).groupBy("_k").applyInPandas(pick, "query string, score double")


def temporal_phrases(docs: DataFrame, start: str, end: str, gap: int = 3, exceptions: DataFrame | None = None, manual: DataFrame | None = None) -> DataFrame:
    """(topic, day): occurrences of the collocations of docs(doc_id, text, day) in the range, which reaches `gap` days back. exceptions(ngram) are left out, manual(ngram) bypass the tests."""
    from delver.operators import keyphrase

    lo = F.date_sub(F.lit(start).cast("date"), gap)
    docs = docs.where(F.col("day").between(lo, F.lit(end).cast("date")))
    grams = keyphrase.ngrams(keyphrase.segments(docs.select("doc_id", "text")))
    found = keyphrase.collocations(keyphrase.frequencies(grams), *keyphrase.gates(docs.count()), manual=manual).select("ngram")
    if exceptions is not None:
        found = found.join(exceptions.select("ngram"), "ngram", "left_anti")
    return grams.join(found, "ngram").join(docs.select("doc_id", "day"), "doc_id").select(F.col("ngram").alias("topic"), "day")


def merge_topics(series: DataFrame, links: DataFrame) -> DataFrame:
    """(topic, names, day, freq): linked(a, b) topics fuse; a day has the largest count, names are those that no longer name of the topic holds, and the smallest is the topic."""
    ends = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
    names = series.select("topic").distinct()
    root = names.select("topic", F.col("topic").alias("root"))
    while True:  # the smallest name reachable
        near = ends.join(root.select(F.col("topic").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("low"))
        new = cut(series.sparkSession, root.join(near.withColumnRenamed("x", "topic"), "topic", "left").select("topic", F.least("root", "low").alias("root")))
        if new.join(root.withColumnRenamed("root", "old"), "topic").where("root <> old").isEmpty():
            break
        root = new
    group = root.groupBy("root").agg(F.array_sort(F.collect_list("topic")).alias("names"))
    group = group.withColumn("names", F.expr("filter(names, n -> not exists(names, o -> length(o) > length(n) and contains(o, n)))"))
    return series.join(root, "topic").groupBy("root", "day").agg(F.max("freq").alias("freq")).join(group, "root").select(F.col("root").alias("topic"), "names", "day", "freq")


def trailing(docs: DataFrame, end: str, days: int) -> DataFrame:
    """The documents of the last days before `end`, which a later run reads first."""
    return docs.where(F.col("day").between(F.date_sub(F.lit(end).cast("date"), days - 1), F.lit(end).cast("date")))
