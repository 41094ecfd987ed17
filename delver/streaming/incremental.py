"""Incremental operators as streams: windowed counts, new pairs of a micro-batch, online learners."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delver.operators import dedup
from delver.operators.learn import Ftrl, Probit


def windowed_counts(events: DataFrame, delay: str = "2 days", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, event_type, n) per event-time window; rows later than the watermark are dropped in append mode."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def distinct_inserts(rows: DataFrame, key: str, time: str = "ts", delay: str = "1 day") -> DataFrame:
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def pair_batches(store: str, pairs: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: fingerprints of the batch meet the stored ones and each other; pairs and fingerprints go to one folder a batch, so a replay overwrites itself."""

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fp = dedup.simhash(batch.select("doc_id", "text")).withColumn("is_new", F.lit(True)).withColumn("epoch", F.lit(epoch))
        fp.drop("is_new").write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
        every = spark.read.parquet(store)
        fresh = every.where(F.col("epoch") == epoch).select("hi", "lo", "n_tokens").distinct().withColumn("_new", F.lit(True))
        flagged = every.join(fresh, ["hi", "lo", "n_tokens"], "left").withColumn("is_new", F.coalesce("_new", F.lit(False)))
        c = flagged.groupBy("hi", "lo", "n_tokens").agg(F.min("doc_id").alias("class_id"), F.max("is_new").alias("is_new"))
        dedup.close(c.select("class_id", "hi", "lo", dedup.allowed(F.col("n_tokens")).alias("k"), "is_new")).select("a", "b").write.mode("overwrite").parquet(f"{pairs}/epoch={epoch}")

    return sink


def online(rows: DataFrame, kind: str) -> DataFrame:
    """(model, n, weights as text) after each micro-batch: one learner a model, its weights in the state."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        m = Probit() if kind == "probit" else Ftrl()
        n, names, a, b = state.get if state.exists else (0, [], [], [])
        m.state = {f: (x, y) for f, x, y in zip(names, a, b, strict=True)}
        rows_ = pd.concat(list(frames)).sort_values(["ts", "id"])
        for r in rows_.itertuples():
            m.update(list(r.feats), bool(r.y))
        items = sorted(m.state.items())
        n += len(rows_)
        state.update((n, [f for f, _ in items], [x for _, (x, _) in items], [y for _, (_, y) in items]))
        yield pd.DataFrame({"model": [key[0]], "n": [n], "weights": [";".join(f"{f}:{x:.6f}:{y:.6f}" for f, (x, y) in items)]})

    return rows.groupBy("model").applyInPandasWithState(update, "model long, n long, weights string", "n long, names array<string>, a array<double>, b array<double>", "update", "NoTimeout")
