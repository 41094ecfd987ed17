"""Frequent itemsets and maximal sets over transactions (tx_id, item)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequent_items(tx: DataFrame, support: int) -> DataFrame:
    return tx.distinct().groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def frequent_pairs(tx: DataFrame, support: int) -> DataFrame:
    """(a, b, support), a < b; only frequent items are paired."""
    t = tx.distinct().join(frequent_items(tx, support).select("item"), "item")
    a, b = t.select("tx_id", F.col("item").alias("a")), t.select("tx_id", F.col("item").alias("b"))
    return a.join(b, "tx_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def frequent_triples(tx: DataFrame, support: int) -> DataFrame:
    """(a, b, c, support): frequent pairs of a transaction extended by a third item with which both are frequent."""
    p = frequent_pairs(tx, support).select("a", "b")
    t = tx.distinct()
    ab = t.select("tx_id", F.col("item").alias("a")).join(t.select("tx_id", F.col("item").alias("b")), "tx_id").join(p, ["a", "b"])
    bc = p.select(F.col("a").alias("b"), F.col("b").alias("c"))
    ac = p.select("a", F.col("b").alias("c"))
    abc = ab.join(t.select("tx_id", F.col("item").alias("c")), "tx_id").where("b < c").join(bc, ["b", "c"]).join(ac, ["a", "c"])
    return abc.groupBy("a", "b", "c").agg(F.count("*").alias("support")).where(F.col("support") >= support)


def fp_growth(tx: DataFrame, support: int) -> DataFrame:
    """(items, freq): all frequent itemsets, by parallel FP-growth. Half a transaction less, as the library rounds share times rows up."""
    from pyspark.ml.fpm import FPGrowth

    sets = tx.distinct().groupBy("tx_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    n = sets.count()
    return FPGrowth(itemsCol="items", minSupport=min(1.0, max(support - 0.5, 0.0) / max(n, 1))).fit(sets).freqItemsets


def maximal_sets(tx: DataFrame) -> DataFrame:
    """(tx_id, size) of the sets without a strict superset; equal sets all stay. Candidates share a set's rarest item."""
    t = tx.distinct()
    n = t.groupBy("item").agg(F.count("*").alias("n"))
    sets = t.join(n, "item").groupBy("tx_id").agg(F.array_sort(F.collect_list("item")).alias("items"), F.min(F.struct("n", "item")).alias("m"))
    small = sets.select("tx_id", "items", F.col("m.item").alias("item"))
    big = sets.select(F.col("tx_id").alias("other"), F.col("items").alias("more")).join(t.select(F.col("tx_id").alias("other"), "item"), "other")
    covered = small.join(big, "item").where((F.size("items") < F.size("more")) & (F.size(F.array_except("items", "more")) == 0)).select("tx_id").distinct()
    return sets.join(covered, "tx_id", "left_anti").select("tx_id", F.size("items").alias("size"))


def ordered_sets(tx: DataFrame, by_size: bool = False) -> DataFrame:
    """(tx_id, items, rank): sets in lexicographic order of their sorted items, or by size first; ties by tx_id. Ranks are global, so this is for results."""
    from pyspark.sql import Window as W

    sets = tx.distinct().groupBy("tx_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return sets.withColumn("rank", F.row_number().over(W.orderBy(*([F.size("items")] if by_size else []), "items", "tx_id")))
