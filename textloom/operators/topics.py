"""Topic models by collapsed Gibbs sampling, held-out evaluation, and fits of the distributions they use.

Documents stay where they are; in each sweep a task samples the topics of its tokens from last sweep's word counts, and the
changes are summed in Spark. Word counts have a row per word and topic of a vocabulary cut to a stated size."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from textloom.functions.maths import digamma_of


def sample_document(words: np.ndarray, z: np.ndarray, counts: np.ndarray, totals: np.ndarray, alpha: np.ndarray, beta: float, rng) -> np.ndarray:
    """One sweep over a document's tokens; counts (words, topics) and totals change in place."""
    k, v = len(alpha), len(counts)
    mine = np.bincount(z, minlength=k).astype(float)
    u = rng.random(len(words))
    for i, w in enumerate(words):
        t = z[i]
        mine[t] -= 1
        counts[w, t] -= 1
        totals[t] -= 1
        p = np.cumsum((mine + alpha) * (counts[w] + beta) / (totals + v * beta))
        t = int(np.searchsorted(p, u[i] * p[-1], side="right"))
        t = min(t, k - 1)
        z[i] = t
        mine[t] += 1
        counts[w, t] += 1
        totals[t] += 1
    return z


def sample_documents(words: list[np.ndarray], zs: list[np.ndarray], counts: np.ndarray, totals: np.ndarray, alpha: np.ndarray, beta: float, rngs) -> list[np.ndarray]:
    """What sample_document() gives for each of several documents when each is drawn against the same counts, which don't change: all
    documents take a token at a time."""
    k, v, n = len(alpha), len(counts), np.array([len(w) for w in words], int)
    order = np.argsort(-n, kind="stable")
    n, flat, z = n[order], np.concatenate([words[i] for i in order]), np.concatenate([zs[i] for i in order])
    u = np.concatenate([rngs[i].random(len(words[i])) for i in order])
    at, doc = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    used, own = np.unique(doc.astype(np.int64) * v + flat, return_inverse=True)
    held = counts[used % v]  # a row for each word of each document
    mine = np.bincount(doc * k + z, minlength=len(n) * k).reshape(-1, k).astype(float)
    whole = np.repeat(totals[None, :], len(n), axis=0)
    live = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")  # documents of more than i words
    for i, m in enumerate(live):
        d, x = np.arange(m), at[:m] + i
        t, w = z[x], own[x]
        mine[d, t] -= 1
        held[w, t] -= 1
        whole[d, t] -= 1
        p = np.cumsum((mine[:m] + alpha) * (held[w] + beta) / (whole[:m] + v * beta), axis=1)
        t = np.minimum((p <= (u[x] * p[:, -1])[:, None]).sum(1), k - 1)
        z[x] = t
        mine[d, t] += 1
        held[w, t] += 1
        whole[d, t] += 1
    out: list = [None] * len(n)
    for i, a, m in zip(order, at, n, strict=True):
        out[i] = z[a : a + m]
    return out


def lda(docs: DataFrame, k: int, vocabulary: int, sweeps: int = 10, alpha: float = 0.1, beta: float = 0.01, seed: int = 1, cut=None) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, words, z) with the sampled topics, and the word-topic counts, from rows (doc_id, words array<int>).

    cut writes a step's table so that plans stay short (checkpoint by default)."""
    from textloom.operators.relations import cut as _cut

    cut = cut or _cut
    rows = docs.select("doc_id", "words", F.transform("words", lambda w, i: F.pmod(F.xxhash64(F.col("doc_id"), i, F.lit(seed)), F.lit(k)).cast("int")).alias("z"))
    rows = cut(rows)
    counts = _counts(rows, k, vocabulary)
    for s in range(sweeps):
        shared = docs.sparkSession.sparkContext.broadcast(counts)

        def run(batches, s=s, shared=shared):
            c = shared.value
            totals = c.sum(0)
            a = np.full(k, alpha)
            for pdf in batches:
                zs = []
                for at in range(0, len(pdf), 2_000):
                    part = pdf.iloc[at : at + 2_000]
                    rngs = [np.random.default_rng([seed, s, int(d) & 0xFFFFFFFF]) for d in part["doc_id"]]
                    # each document is drawn against the sweep's counts, however rows are dealt out
                    zs += sample_documents([np.array(w, int) for w in part["words"]], [np.array(z, int) for z in part["z"]], c, totals, a, beta, rngs)
                yield pdf.assign(z=zs)

        rows = cut(rows.mapInPandas(run, rows.schema))
        counts = _counts(rows, k, vocabulary)
    return rows, counts


def _counts(rows: DataFrame, k: int, vocabulary: int) -> np.ndarray:
    long = rows.select(F.explode(F.arrays_zip("words", "z")).alias("x")).groupBy("x.words", "x.z").agg(F.count("*").alias("n")).toArrow().to_pandas()
    out = np.zeros((vocabulary, k))
    out[long["words"].to_numpy(int), long["z"].to_numpy(int)] = long["n"]
    return out


def top_words(counts: np.ndarray, words: list[str], n: int = 10) -> list[list[str]]:
    return [[words[i] for i in np.lexsort((np.arange(len(words)), -counts[:, t]))[:n]] for t in range(counts.shape[1])]


def topic_phrases(rows: DataFrame) -> DataFrame:
    """(topic, phrase, n): runs of neighbouring words with one topic, from rows (doc_id, pos, term, topic)."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("pos")
    new = F.coalesce((F.lag("topic").over(w) != F.col("topic")).cast("int"), F.lit(1))
    marked = rows.withColumn("_n", new).withColumn("_run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = marked.groupBy("doc_id", "_run", "topic").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("t"))
    return runs.where(F.size("t") > 1).select("topic", F.array_join(F.transform("t", lambda x: x["term"]), " ").alias("phrase")).groupBy("topic", "phrase").agg(F.count("*").alias("n"))


def left_to_right(words: np.ndarray, phi: np.ndarray, alpha: np.ndarray, particles: int = 10, seed: int = 1) -> float:
    """An estimate of a held-out document's log-likelihood, position by position; phi is (words, topics), columns sum to one."""
    rng = np.random.default_rng(seed)
    total, k = 0.0, len(alpha)
    z = np.zeros((particles, len(words)), int)
    mine = np.zeros((particles, k))
    for i, w in enumerate(words):
        p_all = 0.0
        for r in range(particles):
            for j in range(i):
                mine[r, z[r, j]] -= 1
                p = np.cumsum((mine[r] + alpha) * phi[words[j]])
                z[r, j] = min(int(np.searchsorted(p, rng.random() * p[-1])), k - 1)
                mine[r, z[r, j]] += 1
            theta = (mine[r] + alpha) / (i + alpha.sum())
            p = theta * phi[w]
            p_all += p.sum()
            c = np.cumsum(p)
            z[r, i] = min(int(np.searchsorted(c, rng.random() * c[-1])), k - 1)
            mine[r, z[r, i]] += 1
        total += math.log(max(p_all / particles, 1e-300))
    return total


def infer_theta(words: np.ndarray, phi: np.ndarray, alpha: np.ndarray, sweeps: int = 20) -> np.ndarray:
    """A document's topic shares under fixed topics, by fixed-point steps."""
    theta = np.full(len(alpha), 1 / len(alpha))
    for _ in range(sweeps):
        p = phi[words] * theta
        theta = alpha + (p / np.maximum(p.sum(1, keepdims=True), 1e-300)).sum(0)
        theta /= theta.sum()
    return theta


def fit_dirichlet(counts: np.ndarray, steps: int = 100) -> np.ndarray:
    """Maximum likelihood of a Dirichlet behind rows of counts, by Minka's fixed point."""
    a = np.full(counts.shape[1], 0.5)
    n = counts.sum(1)
    for _ in range(steps):
        below = sum(digamma_of(x + a.sum()) for x in n) - len(n) * digamma_of(a.sum())
        new = np.array([a[k] * (sum(digamma_of(c + a[k]) for c in counts[:, k]) - len(n) * digamma_of(a[k])) / below for k in range(len(a))])
        new = np.maximum(new, 1e-6)
        if np.abs(new - a).max() < 1e-7:
            return new
        a = new
    return a


def fit_dirichlet_moments(shares: np.ndarray) -> np.ndarray:
    """By matching means and the variance of each share."""
    m, v = shares.mean(0), shares.var(0)
    ok = (v > 0) & (m > 0) & (m < 1)
    s = np.exp(np.mean(np.log(np.maximum(m[ok] * (1 - m[ok]) / v[ok] - 1, 1e-6)))) if ok.any() else 1.0
    return m * s


def fit_beta_moments(x: np.ndarray) -> tuple[float, float]:
    m, v = float(x.mean()), float(x.var())
    s = m * (1 - m) / v - 1
    return m * s, (1 - m) * s


def gaussian_fits(rows: DataFrame, by: str, value: str) -> DataFrame:
    return rows.groupBy(by).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.count(value).alias("n"))


def covariance(rows: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances in one job of sums."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    r = rows.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs)).first()
    out = np.zeros((len(columns), len(columns)))
    for a, b in pairs:
        i, j = columns.index(a), columns.index(b)
        out[i, j] = out[j, i] = r[f"c_{a}_{b}"]
    return np.array([r[f"m_{c}"] for c in columns]), out


def mixture_em(rows: DataFrame, value: str, k: int, steps: int = 20) -> list[tuple[float, float, float]]:
    """A mixture of k Gaussians over one column as (weight, mean, variance): each step is one job of weighted sums."""
    qs = rows.approxQuantile(value, [(i + 0.5) / k for i in range(k)], 0.001)
    v0 = rows.agg(F.var_pop(value)).first()[0] or 1.0
    parts = [(1 / k, q, v0) for q in qs]
    x = F.col(value)
    for _ in range(steps):
        like = [F.lit(p) * F.exp(-((x - m) * (x - m)) / (2 * v)) / math.sqrt(2 * math.pi * v) for p, m, v in parts]
        whole = like[0]
        for e in like[1:]:
            whole = whole + e
        r = rows.agg(*(e for i, p in enumerate(like) for e in (F.sum(p / whole).alias(f"n{i}"), F.sum(p / whole * x).alias(f"s{i}"), F.sum(p / whole * x * x).alias(f"q{i}"))), F.count(value).alias("n")).first()
        parts = [(r[f"n{i}"] / r["n"], r[f"s{i}"] / r[f"n{i}"], max(r[f"q{i}"] / r[f"n{i}"] - (r[f"s{i}"] / r[f"n{i}"]) ** 2, 1e-9)) for i in range(k)]
    return sorted(parts, key=lambda p: p[1])


def draw(kind: str, size: int, seed: int = 1, **p) -> np.ndarray:
    """Samples of the usual distributions."""
    rng = np.random.default_rng(seed)
    return {
        "poisson": lambda: rng.poisson(p["mean"], size),
        "bernoulli": lambda: (rng.random(size) < p["p"]).astype(int),
        "discrete": lambda: rng.choice(len(p["p"]), size, p=np.array(p["p"]) / np.sum(p["p"])),
        "gaussian": lambda: rng.normal(p["mean"], math.sqrt(p["variance"]), size),
        "gamma": lambda: rng.gamma(p["shape"], 1 / p["rate"], size),
        "exponential": lambda: rng.exponential(1 / p["rate"], size),
        "chi_square": lambda: rng.chisquare(p["k"], size),
        "beta": lambda: rng.beta(p["a"], p["b"], size),
        "dirichlet": lambda: rng.dirichlet(p["alpha"], size),
    }[kind]()


class AliasTable:
    """Draws from fixed weights in constant time."""

    def __init__(self, weights):
        p = np.asarray(weights, float) * len(weights) / np.sum(weights)
        self.keep, self.other = np.ones(len(p)), np.arange(len(p))
        low, high = [i for i, x in enumerate(p) if x < 1], [i for i, x in enumerate(p) if x >= 1]
        while low and high:
            i, j = low.pop(), high.pop()
            self.keep[i], self.other[i] = p[i], j
            p[j] -= 1 - p[i]
            (low if p[j] < 1 else high).append(j)

    def draw(self, n: int | tuple[int, ...], rng) -> np.ndarray:
        i = rng.integers(len(self.keep), size=n)
        return np.where(rng.random(n) < self.keep[i], i, self.other[i])


def weighted_sample(rows: DataFrame, weight: str, n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement, in proportion to weights: the n smallest of exponential races, a sort that stops at n."""
    u = (F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return rows.where(F.col(weight) > 0).withColumn("_k", -F.log(u) / F.col(weight)).orderBy("_k").limit(n).drop("_k")


def best_gates(rows: DataFrame, value: str, weights: list[float], shares: DataFrame) -> DataFrame:
    """Adds gate: of a categorical mixture the part that most likely gave the value; shares is (part, value, p), a value without a
    share in a part can't come from it. Ties go to the smaller part, values in no part have none."""
    w = F.array(*map(F.lit, weights))
    scored = shares.select(F.col("value").alias(value), F.struct((-F.get(w, F.col("part")) * F.col("p")).alias("_s"), F.col("part").alias("_g")).alias("_x")).where(F.col("_x._s") < 0)
    return rows.join(scored.groupBy(value).agg(F.min("_x")["_g"].alias("gate")), value, "left")


def most_likely(counts: DataFrame, by: list[str], item: str) -> DataFrame:
    """(by, item): the value of a discrete variable with the largest count (by, item, n), ties to the smaller."""
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(item).alias("v")))["v"].alias(item))
