"""Itemset queries: an order's items are part families (l_partkey % 50)."""

from __future__ import annotations

from pyspark.sql import functions as F

from delver.operators import itemset as op

QUERIES, ORACLES = {}, {}
T = "t AS (SELECT DISTINCT l_orderkey AS tx_id, l_partkey % 50 AS item FROM lineitem)"
I = f"{T}, f AS (SELECT item, count(*) AS support FROM t GROUP BY item HAVING count(*) >= 5)"  # noqa: E741
P = "p AS (SELECT a.item AS a, b.item AS b, count(*) AS support FROM t a JOIN t b ON a.tx_id = b.tx_id AND a.item < b.item GROUP BY ALL HAVING count(*) >= 25)"


def _tx(s, d):
    return s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("tx_id"), (F.col("l_partkey") % 50).alias("item"))


QUERIES["is_items"] = lambda s, d: op.frequent_items(_tx(s, d), 5)
ORACLES["is_items"] = f"WITH {I} SELECT * FROM f"
QUERIES["is_pairs"] = lambda s, d: op.frequent_pairs(_tx(s, d), 25)
ORACLES["is_pairs"] = f"WITH {T}, {P} SELECT * FROM p"
QUERIES["is_triples"] = lambda s, d: op.frequent_triples(_tx(s, d), 5)
ORACLES["is_triples"] = f"WITH {T} SELECT a.item AS a, b.item AS b, c.item AS c, count(*) AS support FROM t a JOIN t b ON a.tx_id = b.tx_id AND a.item < b.item JOIN t c ON a.tx_id = c.tx_id AND b.item < c.item GROUP BY ALL HAVING count(*) >= 5"
QUERIES["is_fpgrowth"] = lambda s, d: op.fp_growth(_tx(s, d), 25).select(F.array_join(F.array_sort("items"), ",").alias("items"), F.col("freq").alias("support"))
ORACLES["is_fpgrowth"] = f"""WITH RECURSIVE {T}, r(tx_id, items, last) AS (SELECT tx_id, [item], item FROM t UNION ALL SELECT r.tx_id, list_append(r.items, t.item), t.item FROM r JOIN t ON r.tx_id = t.tx_id AND t.item > r.last)
SELECT array_to_string(items, ',') AS items, count(*) AS support FROM r GROUP BY items HAVING count(*) >= 25"""
QUERIES["is_maximal"] = lambda s, d: op.maximal_sets(_tx(s, d))
ORACLES["is_maximal"] = f"WITH {T}, k AS (SELECT tx_id, list(item ORDER BY item) AS w FROM t GROUP BY tx_id) SELECT tx_id, CAST(len(w) AS INTEGER) AS size FROM k WHERE NOT EXISTS (SELECT 1 FROM k b, t c WHERE c.item = k.w[1] AND c.tx_id = b.tx_id AND len(b.w) > len(k.w) AND list_has_all(b.w, k.w))"
