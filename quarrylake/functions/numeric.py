"""Vector and probability expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ln_factorial(n: Column) -> Column:
    """ln(n!): exact below 16, by Stirling's series (error under 1e-12) from there on."""
    small = F.element_at(F.array(*(F.lit(math.lgamma(k + 1)) for k in range(16))), F.least(n, F.lit(15)).cast("int") + 1)
    x = n.cast("double") + 1
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return F.when(n < 16, small).otherwise(series)


def ln_choose(n: Column, k: Column) -> Column:
    return ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k)


def same_domain_probability(jaccard: Column, n_a: Column, n_b: Column) -> Column:
    """Hypergeometric probability that two samples of one domain share no more values than these do."""
    total = n_a + n_b
    k = F.least(F.floor(jaccard * total / (1 + jaccard)), n_a, n_b).cast("bigint")
    every = ln_choose(total, n_b)
    return F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), F.lit(0.0), lambda s, i: s + F.exp(ln_choose(n_a, i) + ln_choose(n_b, n_b - i) - every))


def finite(v: Column) -> Column:
    """Whether a vector has neither NaN nor infinities nor nulls."""
    return ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def strict_domain_probability(jaccard: Column, n_a: Column, n_b: Column) -> Column:
    """As same_domain_probability, of fewer shared values; 0 if the smaller is contained whole and sizes differ."""
    total = n_a + n_b
    k = F.least(F.floor(jaccard * total / (1 + jaccard)), n_a, n_b).cast("bigint")
    every = ln_choose(total, n_b)
    terms = F.when(k > 0, F.sequence(F.lit(0).cast("bigint"), k - 1)).otherwise(F.array().cast("array<bigint>"))
    below = F.aggregate(terms, F.lit(0.0), lambda s, i: s + F.exp(ln_choose(n_a, i) + ln_choose(n_b, n_b - i) - every))
    return F.when((k == F.least(n_a, n_b)) & (n_a != n_b), 0.0).otherwise(below)


def entropy(p: Column) -> Column:
    """A term of the entropy, to be summed."""
    return F.when(p > 0, -p * F.ln(p)).otherwise(0.0)
