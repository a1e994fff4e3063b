"""Densities of the usual distributions as columns, mixtures, and fits from moments."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.maths import log_gamma, total


def log_gaussian(x: Column, mean, variance) -> Column:
    mean, variance = F.lit(mean), F.lit(variance)
    return -0.5 * F.log(2 * math.pi * variance) - (x - mean) * (x - mean) / (2 * variance)


def log_beta_density(x: Column, a: float, b: float) -> Column:
    return (a - 1) * F.log(x) + (b - 1) * F.log(1 - x) - (math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))


def log_gamma_density(x: Column, shape: float, rate: float) -> Column:
    return shape * math.log(rate) - math.lgamma(shape) + (shape - 1) * F.log(x) - rate * x


def log_poisson(k: Column, mean: float) -> Column:
    return k * math.log(mean) - mean - log_gamma(k.cast("double") + 1)


def log_dirichlet(p: Column, alpha: list[float]) -> Column:
    """Of an array of shares."""
    const = math.lgamma(sum(alpha)) - sum(map(math.lgamma, alpha))
    return const + total(F.transform(p, lambda x, i: (F.get(F.array(*map(F.lit, alpha)), i) - 1) * F.log(x)))


def log_multinomial(counts: Column, p: list[float]) -> Column:
    return total(F.transform(counts, lambda n, i: n * F.log(F.get(F.array(*map(F.lit, p)), i))))


def log_plated(values: Column, p: list[float]) -> Column:
    """Of a sequence of discrete values, each drawn from p."""
    return total(F.transform(values, lambda v: F.log(F.get(F.array(*map(F.lit, p)), v))))


def log_mixture(parts: list[tuple[float, Column]]) -> Column:
    """Of (weight, log density) parts."""
    from textloom.functions.maths import log_sum_exp

    return log_sum_exp(F.array(*(math.log(w) + e for w, e in parts)))


def responsibilities(parts: list[tuple[float, Column]]) -> Column:
    """The share of each part in a row, as an array; its index of maximum is the best gate."""
    whole = log_mixture(parts)
    return F.array(*(F.exp(math.log(w) + e - whole) for w, e in parts))


def beta_summary(a: float, b: float) -> dict[str, float]:
    n = a + b
    return {"mean": a / n, "variance": a * b / (n * n * (n + 1)), "mode": (a - 1) / (n - 2) if a > 1 and b > 1 else float("nan")}


def fit_beta(rows: DataFrame, value: str) -> tuple[float, float]:
    r = rows.agg(F.avg(value).alias("m"), F.var_pop(value).alias("v")).first()
    s = r["m"] * (1 - r["m"]) / r["v"] - 1
    return r["m"] * s, (1 - r["m"]) * s


def fit_weighted_gaussian(rows: DataFrame, value: str, weight: str, least: int = 5) -> tuple[float, float]:
    """Mean and variance with weights; a variance of one for fewer than `least` rows."""
    x, w = F.col(value), F.col(weight)
    r = rows.agg(F.sum(w).alias("n"), F.sum(w * x).alias("s"), F.sum(w * x * x).alias("q"), F.count(value).alias("k")).first()
    mean = r["s"] / r["n"]
    return mean, (max(r["q"] / r["n"] - mean * mean, 1e-12) if r["k"] >= least else 1.0)


def log_multivariate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return -0.5 * (len(mean) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + np.einsum("ij,ij->i", d @ np.linalg.inv(cov), d))


def chinese_restaurant(n: int, concentration: float, seed: int = 1) -> np.ndarray:
    """Tables of n customers of an infinite mixture."""
    rng, sizes, out = np.random.default_rng(seed), [], np.zeros(n, int)
    for i in range(n):
        p = np.array([*sizes, concentration]) / (i + concentration)
        t = int(rng.choice(len(p), p=p))
        if t == len(sizes):
            sizes.append(0)
        sizes[t] += 1
        out[i] = t
    return out


def collapsed_variational(docs: list[np.ndarray], k: int, vocabulary: int, sweeps: int = 30, alpha: float = 0.1, beta: float = 0.01, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Topic shares of documents and words by the zero-order collapsed variational update, for the documents of one task."""
    rng = np.random.default_rng(seed)
    q = [rng.dirichlet(np.ones(k), len(d)) for d in docs]
    nw, nd = np.zeros((vocabulary, k)), np.array([x.sum(0) for x in q])
    for d, x in zip(docs, q, strict=True):
        np.add.at(nw, d, x)
    nk = nw.sum(0)
    for _ in range(sweeps):
        for i, d in enumerate(docs):
            for j, w in enumerate(d):
                old = q[i][j]
                p = (nd[i] - old + alpha) * (nw[w] - old + beta) / (nk - old + vocabulary * beta)
                p = np.maximum(p, 1e-12)
                p /= p.sum()
                nd[i] += p - old
                nw[w] += p - old
                nk += p - old
                q[i][j] = p
    return nd / nd.sum(1, keepdims=True), nw / nw.sum(0)


def online_topics(batches, k: int, vocabulary: int, total_docs: int, alpha: float = 0.1, beta: float = 0.01, delay: float = 1.0, power: float = 0.7, inner: int = 20, seed: int = 1) -> np.ndarray:
    """Topics by stochastic variational steps over batches (lists of word-index arrays), as foreachBatch gives them: (words, topics)."""
    from textloom.functions.maths import digamma_of

    dig = np.vectorize(digamma_of)
    lam = np.random.default_rng(seed).gamma(100, 0.01, (vocabulary, k))
    for t, batch in enumerate(batches):
        e = np.exp(dig(lam) - dig(lam.sum(0)))
        stats = np.zeros_like(lam)
        for d in batch:
            if not len(d):
                continue
            g = np.full(k, alpha + len(d) / k)
            for _ in range(inner):
                p = e[d] * np.exp(dig(g))
                p /= p.sum(1, keepdims=True) + 1e-100
                g = alpha + p.sum(0)
            np.add.at(stats, d, p)
        step = (t + 1 + delay) ** -power
        lam = (1 - step) * lam + step * (beta + total_docs / max(1, len(batch)) * stats)
    return lam / lam.sum(0)
