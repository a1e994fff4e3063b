"""Numeric functions over arrays of doubles and over bags (maps from terms to weights)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(xs: Column, p: int = 2) -> Column:
    """The 1- or 2-norm; p = 0 is the largest magnitude."""
    if p == 0:
        return F.array_max(F.transform(xs, lambda x: F.abs(x.cast("double"))))
    size = total(F.transform(xs, lambda x: F.abs(x.cast("double")) if p == 1 else x.cast("double") * x.cast("double")))
    return size if p == 1 else F.sqrt(size)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is all zeros."""
    sizes = norm(a) * norm(b)
    return F.when(sizes > 0, dot(a, b) / sizes).otherwise(F.lit(0.0))


def scaled(xs: Column, by: Column) -> Column:
    return F.transform(xs, lambda x: x * by)


def normalised(xs: Column, p: int = 2) -> Column:
    size = norm(xs, p)
    return F.when(size > 0, F.transform(xs, lambda x: x / size)).otherwise(xs)


def index_of_max(xs: Column) -> Column:
    """0-based; the first of several."""
    return F.array_position(xs, F.array_max(xs)) - 1


def log_sum_exp(xs: Column) -> Column:
    top = F.array_max(xs)
    return top + F.log(total(F.transform(xs, lambda x: F.exp(x - top))))


def softmax(xs: Column) -> Column:
    whole = log_sum_exp(xs)
    return F.transform(xs, lambda x: F.exp(x - whole))


def entropy(ps: Column) -> Column:
    """In bits; the weights need not sum to one."""
    whole = total(ps)
    return -total(F.transform(ps, lambda p: F.when(p > 0, p / whole * F.log2(p / whole)).otherwise(F.lit(0.0))))


def kl_divergence(p: Column, q: Column) -> Column:
    """In bits; null where q lacks what p has."""
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log2(x / y)).otherwise(F.lit(0.0))))


def js_divergence(p: Column, q: Column) -> Column:
    half = F.zip_with(p, q, lambda x, y: (x + y) / 2)
    return (kl_divergence(p, half) + kl_divergence(q, half)) / 2


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(float(c))
    return out


def almost_equal(a: Column, b: Column, epsilon: float = 1e-6) -> Column:
    return F.abs(a - b) < epsilon


@F.pandas_udf(DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma)


def digamma_of(x: float) -> float:
    """By recurrence up to 6, then the asymptotic series."""
    out = 0.0
    while x < 6:
        out -= 1 / x
        x += 1
    f = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


@F.pandas_udf(DoubleType())
def digamma(x: pd.Series) -> pd.Series:
    return x.map(digamma_of)


def log_beta(a: Column, b: Column) -> Column:
    return log_gamma(a) + log_gamma(b) - log_gamma(a + b)


def log_factorial(n: Column) -> Column:
    return log_gamma(n.cast("double") + 1)


def combinations(n: Column, k: Column) -> Column:
    return F.round(F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k))).cast("long")


def permutations(n: Column, k: Column) -> Column:
    return F.round(F.exp(log_factorial(n) - log_factorial(n - k))).cast("long")


def log_binomial(n: Column, k: Column, p: Column) -> Column:
    """The log of the chance of k in n."""
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(p) + (n - k) * F.log(1 - p)


def binomial_cdf(n: Column, k: Column, p: Column) -> Column:
    """The chance of at most k in n, from the ratios of neighbouring terms."""
    zero = F.struct(F.pow(1 - p, n).alias("term"), F.pow(1 - p, n).alias("sum"))

    def more(a, i):
        term = a["term"] * (n - i + 1) / i * p / (1 - p)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), zero, more)["sum"]


def normal_cdf(x: Column) -> Column:
    """By the error function's rational approximation, to 1.5e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    tail = poly(t, [0.0, 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429]) * F.exp(-z * z) / 2
    return F.when(x < 0, tail).otherwise(1 - tail)


# bags


def bag_sum(a: Column, b: Column, sign: int = 1) -> Column:
    """Keys of both; differences that come to nothing go."""
    both = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) + sign * F.coalesce(y, F.lit(0.0)))
    return F.map_filter(both, lambda k, v: F.abs(v) > 1e-6) if sign < 0 else both


def bag_dot(a: Column, b: Column) -> Column:
    return total(F.map_values(F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0)))))


def bag_norm(a: Column, p: int = 2) -> Column:
    return norm(F.map_values(a), p)


def bag_cosine(a: Column, b: Column) -> Column:
    sizes = bag_norm(a) * bag_norm(b)
    return F.when(sizes > 0, bag_dot(a, b) / sizes).otherwise(F.lit(0.0))


def deducted_cosine(child: Column, parent: Column) -> Column:
    """The cosine of a child and its parent without the child."""
    return bag_cosine(child, bag_sum(parent, child, -1))


def hashed_feature(name: Column, size: int) -> Column:
    """(slot, sign) of a feature in a space of fixed size, from the first digits of its MD5."""
    digits = F.md5(name.cast("binary"))
    slot = F.conv(F.substring(digits, 1, 8), 16, 10).cast("long") % size
    return F.struct(slot.alias("slot"), F.when(F.conv(F.substring(digits, 9, 1), 16, 10).cast("int") < 8, 1).otherwise(-1).alias("sign"))
