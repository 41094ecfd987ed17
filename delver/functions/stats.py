"""Statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ll(k: Column, n: Column, p: Column) -> Column:
    """k ln p + (n - k) ln(1 - p), with 0 ln 0 = 0."""
    a = F.when(k > 0, k * F.log(p)).otherwise(F.lit(0.0))
    b = F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(F.lit(0.0))
    return a + b


def log_likelihood(f: Column, f1: Column, f2: Column, n: Column) -> Column:
    """2 ln of the likelihood ratio of k1/n1 against k2/n2, where k1 = f, n1 = f1, k2 = max(f2 - f, 0), n2 = n - f1."""
    k1, n1, k2, n2 = f.cast("double"), f1.cast("double"), F.greatest(f2 - f, F.lit(0)).cast("double"), (n - f1).cast("double")
    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, F.when(n2 > 0, k2 / n2).otherwise(0.0)
    return 2 * (_ll(k1, n1, p1) + _ll(k2, n2, p2) - _ll(k1, n1, p) - _ll(k2, n2, p))


def mutual_information(f: Column, f1: Column, f2: Column, n: Column) -> Column:
    return f * n / f1 / f2


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero or sizes differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0), dot / norm(a) / norm(b))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def inverse_l1(a: Column, b: Column) -> Column:
    """1 / distance, 100 for equal vectors."""
    return F.when(l1(a, b) == 0, F.lit(100.0)).otherwise(1 / l1(a, b))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
