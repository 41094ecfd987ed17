"""Streams driven to completion over the test tables; their final state equals the batch answer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from delver.operators import dedup
from delver.operators.graph import cut
from delver.streaming import incremental as op

QUERIES, ORACLES = {}, {}


def _shared(s):
    cut(s, s.range(1))  # makes sure that there is a checkpoint folder
    return f"{s.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def _events(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    return s.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))  # a pattern, so that a single file will do


def _daily(s, d):
    at = _shared(s)
    q = op.windowed_counts(_events(s, d)).writeStream.outputMode("complete").queryName(n := f"t{uuid.uuid4().hex}").format("memory").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.table(n).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES["st_daily_window"] = _daily
ORACLES["st_daily_window"] = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL"


def _pairs(s, d):
    at = _shared(s)
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    sink = op.pair_batches(f"{at}/fp", f"{at}/pairs")
    sink(docs.where(F.xxhash64("doc_id") % 2 == 0), 0)  # as foreachBatch would call it
    sink(docs.where(F.xxhash64("doc_id") % 2 != 0), 1)
    found = s.read.parquet(f"{at}/pairs").select("a", "b")
    # representatives of the first batch may have given way to smaller ids; the final classes name each pair once
    fp = s.read.parquet(f"{at}/fp").select("doc_id", "n_tokens", "hi", "lo")
    name = fp.join(dedup.classes(fp), ["hi", "lo", "n_tokens"]).select("doc_id", "class_id")
    x = found.join(name.select(F.col("doc_id").alias("a"), F.col("class_id").alias("ca")), "a").join(name.select(F.col("doc_id").alias("b"), F.col("class_id").alias("cb")), "b")
    return x.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


QUERIES["st_incremental_pairs"] = _pairs
from delver.plans.dedup import CL, FP, PAIRS  # noqa: E402

ORACLES["st_incremental_pairs"] = f"WITH {FP}, {CL}, {PAIRS} SELECT a, b FROM pr"
