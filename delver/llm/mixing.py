"""Mixing sources to target weights by temperature.

Source i holds a share p_i of the corpus's tokens; its weight is p_i^tau / sum p_j^tau. tau is bisected so
that the entropy of the weights reaches `entropy` (a fraction of the largest possible), or so that no source
is repeated more than `max_repeats` times. Both are monotone in tau, and each bisection round is one
aggregate over the source table that looks at 32 exponents at once, so sources are never collected.

The budget (tokens) defaults to the least at which every source is used whole at least once. A source with
target tokens T and total S gets floor(T/S) whole epochs and a partial one: its documents fall into blocks
of about `block_tokens` tokens by a hash of their id, the blocks are permuted by a seeded hash, and the
partial epoch takes whole blocks in that order while they fit, then documents of the next block while they
fit. Every epoch permutes blocks, and documents in them, anew. Only block totals are summed in order, in two levels of
4,096 ranges of the hash, and only documents of one block per source are ranked one by one, so a hot source is
never sorted in one task.

A null source is a source of its own; a null or empty text has no tokens and is used once per whole epoch;
repeated rows are rows of one fate. With no tokens at all every weight is equal. Empty tables give empty results. Other
columns pass through materialise(), whatever their names, but for weight, epoch, block_rank and doc_rank, which are
replaced. Ties of hashes are broken by doc_id and text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from delver.llm.common import fresh, stored

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1_000_000
GRID = 32
ROUNDS = 5


def tokens(text: Column) -> Column:
    """Words: runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def exponent(totals: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None) -> tuple[float, float]:
    """(tau, budget). totals(source, tokens): one row a source.

    With `entropy`, the tau in [0, 1] whose weights have that share of the largest entropy; else the
    smallest tau in [0, 1] with which no source is repeated more than max_repeats times. Where even
    tau = 1 misses the limit, tau = 1 stays.
    """
    some = totals.where("tokens > 0")
    one = some.agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("tokens").alias("most")).first()
    if not one["n"]:
        return 1.0, float(budget or 0)
    total = float(one["t"])
    logs = some.select(F.log(F.col("tokens") / total).alias("l"), (F.col("tokens") / total).alias("p"))

    def look(taus: list[float]) -> list[tuple[float, float]]:
        """(entropy share, largest repeat) of each tau."""
        row = logs.agg(
            *[F.sum(F.exp(F.col("l") * t)).alias(f"z{i}") for i, t in enumerate(taus)],
            *[F.sum(F.exp(F.col("l") * t) * F.col("l") * t).alias(f"e{i}") for i, t in enumerate(taus)],
            *[F.max(F.exp(F.col("l") * (t - 1))).alias(f"r{i}") for i, t in enumerate(taus)],
            *[F.min(F.exp(F.col("l") * (t - 1))).alias(f"s{i}") for i, t in enumerate(taus)],
        ).first()
        out = []
        for i in range(len(taus)):
            z, e, r, s = (float(row[f"{k}{i}"]) for k in "zers")
            share = (math.log(z) - e / z) / math.log(one["n"]) if one["n"] > 1 else 1.0
            out.append((share, r / s if budget is None else budget / total * r / z))
        return out

    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        taus = [low + (high - low) * i / (GRID - 1) for i in range(GRID)]
        found = look(taus)
        if entropy is not None:  # falls with tau
            i = max((i for i, (h, _) in enumerate(found) if h >= entropy - 1e-12), default=0)
            low, high = taus[i], taus[min(i + 1, GRID - 1)]
        else:  # the largest repeat falls with tau, too
            i = min((i for i, (_, r) in enumerate(found) if r <= max_repeats + 1e-9), default=GRID - 1)
            low, high = taus[max(i - 1, 0)], taus[i]
    tau = low if entropy is not None else high
    if budget is None:  # the least budget with every repeat >= 1
        row = logs.agg(F.sum(F.exp(F.col("l") * tau)).alias("z"), F.min(F.exp(F.col("l") * (tau - 1))).alias("s")).first()
        budget = total * float(row["z"]) / float(row["s"])
    return tau, float(budget)


def _rank(seed: int, *by: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(b) if isinstance(b, str) else b for b in by])


def mix(docs: DataFrame, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 7) -> DataFrame:
    """Per row of docs(doc_id, text, source): doc_id, source, _tie (hash of id and text), n_tokens, weight, epochs (whole and started ones), block; a document with no epoch is dropped by materialise()."""
    spark = docs.sparkSession
    small = stored(spark, docs.select("doc_id", "source", tokens(F.col("text")).alias("n_tokens"), F.xxhash64("doc_id", "text").alias("_tie")), "mixing")
    totals = stored(spark, small.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")), "sources")
    tau, spend = exponent(totals, max_repeats, entropy, budget)
    z = totals.where("tokens > 0").agg(F.sum(F.pow(F.col("tokens").cast("double"), F.lit(tau))).alias("z")).first()["z"] or 0.0
    n = totals.count()
    weight = F.when(F.lit(z > 0), F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(tau)) / F.lit(z or 1.0)).otherwise(0.0)).otherwise(1.0 / max(n, 1))
    repeats = F.when(F.col("tokens") > 0, F.lit(spend) * F.col("weight") / F.col("tokens")).otherwise(1.0)
    plan = (
        totals.withColumn("weight", weight)
        .withColumn("repeats", F.floor(repeats * 1e9 + 0.5) / 1e9)
        .withColumn("whole", F.floor("repeats").cast("int"))
        .withColumn("rest", F.floor((F.col("repeats") - F.col("whole")) * F.col("tokens")).cast("long"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long"))
    )
    plan = stored(spark, plan.withColumnRenamed("source", "_source"), "mixing_plan")
    placed = small.join(plan.select("_source", "blocks"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("block", F.pmod(_rank(seed, "doc_id", "_tie"), F.col("blocks"))).drop("blocks", "_source")
    sums = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("size")).withColumn("turn", _rank(seed + 1, F.col("block")))
    sums = stored(spark, sums.withColumn("range", F.shiftright("turn", 52)), "mixing_sums")  # ranges are in the order of the turns
    ranges = sums.groupBy("source", "range").agg(F.sum("size").alias("of"))
    ranges = ranges.select(F.col("source").alias("_source"), F.col("range").alias("_range"), F.coalesce(F.sum("of").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("size").over(W.partitionBy("source", "range").orderBy("turn", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("within", within).join(ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))).drop("_source")
    ranked = sums.withColumn("before", F.col("start") + F.col("within")).join(plan, F.col("source").eqNullSafe(F.col("_source")))
    cutat = stored(
        spark,
        ranked.select("_source", F.col("block").alias("_block"), "weight", "whole", (F.col("rest") - F.col("before")).alias("room"), (F.col("before") + F.col("size") <= F.col("rest")).alias("full")),
        "mixing_blocks",
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    edge = placed.join(cutat.where("not full and room > 0"), same).select("source", "doc_id", "_tie", "n_tokens", "room")
    so_far = F.sum("n_tokens").over(W.partitionBy("source").orderBy(_rank(seed + 2, "doc_id", "_tie"), "doc_id", "_tie").rowsBetween(W.unboundedPreceding, 0))
    extra = edge.withColumn("so_far", so_far).where("so_far <= room").select(F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("_tie").alias("_t")).distinct()
    hit = F.col("source").eqNullSafe(F.col("_s")) & F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_tie") == F.col("_t"))
    marked = placed.join(cutat, same).join(extra, hit, "left")
    epochs = F.col("whole") + (F.col("full") | F.col("_t").isNotNull()).cast("int")
    return marked.select("doc_id", "source", "_tie", "n_tokens", "weight", epochs.cast("long").alias("epochs"), "block")


def materialise(docs: DataFrame, mixed: DataFrame, seed: int = 7) -> DataFrame:
    """docs once for every epoch, with weight, epoch and the keys (epoch, block_rank, doc_rank) that order a pass."""
    own = [c for c in docs.columns if c.lower() not in ("weight", "epoch", "block_rank", "doc_rank")]
    d, src, tie, tag, n, block, weight = fresh(docs.columns, "_d", "_s", "_tie", "_tag", "_n", "_block", "_weight")
    keys = mixed.where("epochs > 0").select(F.col("doc_id").alias(d), F.col("source").alias(src), F.col("_tie").alias(tie), F.col("epochs").alias(n), F.col("block").alias(block), F.col("weight").alias(weight)).distinct()
    tagged = docs.select(*own, F.xxhash64("doc_id", "text").alias(tag))
    out = tagged.join(keys, (F.col(tag) == F.col(tie)) & F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(src)))
    out = out.select(*own, tie, block, F.col(weight).alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias("epoch"))
    return out.select(*own, "weight", "epoch", _rank(seed + 3, "source", block, "epoch").alias("block_rank"), _rank(seed + 4, "doc_id", tie, "epoch").alias("doc_rank"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document and epoch (one without epoch where it has none), with its place in the permutations."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = mix(docs).withColumn("epoch", F.explode_outer(F.when(F.col("epochs") > 0, F.sequence(F.lit(1).cast("long"), F.col("epochs")))))
    ranks = [_rank(10, "source", "block", "epoch").alias("block_rank"), _rank(11, "doc_id", "_tie", "epoch").alias("doc_rank")]
    return rows.select("doc_id", "source", "n_tokens", "weight", "epochs", "block", "epoch", *ranks)
