"""The registered queries over the test tables, and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in ("dedup", "recsys", "simspace", "keyphrase", "topics", "itemset", "lsh", "wiki", "learn", "taxonomy", "streaming", "more"):
    _m = import_module(f"delver.plans.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
