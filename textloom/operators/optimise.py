"""Objectives, update rules and trainers of linear models.

A pass over the data is one job: each task turns its rows into a partial gradient, a dense vector of the model's size, and the
partial vectors are added up in Spark. The model is an array of fixed size, that of the hashed feature space."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# objectives: (value, derivative) of a loss in the score; y is 1 or -1, or a number for regression


def log_loss(s, y):
    m = y * s
    return np.logaddexp(0, -m), -y / (1 + np.exp(np.clip(m, -500, 500)))


def hinge(s, y):
    return np.maximum(0, 1 - y * s), np.where(y * s < 1, -y, 0.0)


def hinge_squared(s, y):
    v = np.maximum(0, 1 - y * s)
    return v * v, -2 * v * y


def smooth_hinge(s, y):
    m = y * s
    return np.where(m >= 1, 0, np.where(m <= 0, 0.5 - m, 0.5 * (1 - m) ** 2)), np.where(m >= 1, 0, np.where(m <= 0, -y, -y * (1 - m)))


def perceptron_loss(s, y):
    return np.maximum(0, -y * s), np.where(y * s <= 0, -y, 0.0)


def squared(s, y):
    return 0.5 * (s - y) ** 2, s - y


def absolute(s, y):
    return np.abs(s - y), np.sign(s - y)


def insensitive(epsilon: float = 0.1):
    def loss(s, y):
        d = s - y
        return np.maximum(0, np.abs(d) - epsilon), np.where(np.abs(d) > epsilon, np.sign(d), 0.0)

    return loss


def multiclass_log(scores: np.ndarray, y: int) -> tuple[float, np.ndarray]:
    p = np.exp(scores - scores.max())
    p /= p.sum()
    value = -math.log(max(p[y], 1e-300))
    p[y] -= 1
    return value, p


def multiclass_hinge(scores: np.ndarray, y: int) -> tuple[float, np.ndarray]:
    m = scores + 1.0
    m[y] -= 1.0
    k = int(m.argmax())
    g = np.zeros_like(scores)
    if k != y:
        g[k], g[y] = 1, -1
    return float(m[k] - scores[y]), g


OBJECTIVES = {"log": log_loss, "hinge": hinge, "hinge_squared": hinge_squared, "smooth_hinge": smooth_hinge, "perceptron": perceptron_loss, "squared": squared, "absolute": absolute, "insensitive": insensitive()}

# update rules: step(weights, gradient) -> weights; gradients are of what is minimised


@dataclass
class Constant:
    rate: float = 0.1
    decay: str = ""  # "", "sqrt" or "linear"
    t: int = 0

    def step(self, w, g):
        self.t += 1
        return w - self.rate / {"": 1.0, "sqrt": math.sqrt(self.t), "linear": self.t}[self.decay] * g


@dataclass
class AdaGrad:
    rate: float = 1.0
    delta: float = 0.1
    seen: np.ndarray | None = None

    def step(self, w, g):
        self.seen = g * g if self.seen is None else self.seen + g * g
        return w - self.rate / (self.delta + np.sqrt(self.seen)) * g


@dataclass
class AdaGradRDA:
    """Dual averaging with an l1 and l2 penalty and per-weight rates: exact zeros."""

    rate: float = 1.0
    delta: float = 0.1
    l1: float = 0.0
    l2: float = 0.0
    t: int = 0
    sums: np.ndarray | None = None
    seen: np.ndarray | None = None

    def step(self, w, g):
        self.t += 1
        self.sums = g.copy() if self.sums is None else self.sums + g
        self.seen = g * g if self.seen is None else self.seen + g * g
        h = (self.delta + np.sqrt(self.seen)) / self.rate + self.t * self.l2
        return -np.sign(self.sums) * np.maximum(0, np.abs(self.sums) - self.t * self.l1) / h


@dataclass
class FTRL:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    z: np.ndarray | None = None
    n: np.ndarray | None = None

    def step(self, w, g):
        if self.z is None:
            self.z, self.n = np.zeros_like(w), np.zeros_like(w)
        sigma = (np.sqrt(self.n + g * g) - np.sqrt(self.n)) / self.alpha
        self.z += g - sigma * w
        self.n += g * g
        return np.where(np.abs(self.z) <= self.l1, 0.0, -(self.z - np.sign(self.z) * self.l1) / ((self.beta + np.sqrt(self.n)) / self.alpha + self.l2))


@dataclass
class Pegasos:
    penalty: float = 0.1
    t: int = 0

    def step(self, w, g):
        self.t += 1
        w = w - (g + self.penalty * w) / (self.penalty * self.t)
        size = np.linalg.norm(w)
        return w * min(1.0, 1 / (math.sqrt(self.penalty) * size)) if size else w


@dataclass
class ExponentiatedGradient:
    """Weights stay positive and sum to one."""

    rate: float = 0.1

    def step(self, w, g):
        w = np.where(w > 0, w, 1.0 / len(w)) * np.exp(-self.rate * (g - g.min()))
        return w / w.sum()


@dataclass
class Averaged:
    """The mean of another rule's weights over its steps, in .mean."""

    rule: object
    t: int = 0
    mean: np.ndarray | None = None

    def step(self, w, g):
        w = self.rule.step(w, g)
        self.t += 1
        self.mean = w.copy() if self.mean is None else self.mean + (w - self.mean) / self.t
        return w


def mira_step(w, features, margin_violation: float, most: float = 1.0):
    """The least change that mends a violated margin, at most so large."""
    size = float(features @ features)
    return w + min(most, margin_violation / size) * features if size and margin_violation > 0 else w


def project_ball(w, radius: float = 1.0):
    size = np.linalg.norm(w)
    return w * (radius / size) if size > radius else w


def project_cube(w, low: float = -1.0, high: float = 1.0):
    return np.clip(w, low, high)


def line_search(f, w, direction, value, gradient, step: float = 1.0, shrink: float = 0.5, share: float = 1e-4):
    slope = float(gradient @ direction)
    while step > 1e-12:
        new = w + step * direction
        v, g = f(new)
        if v <= value + share * step * slope:
            return new, v, g
        step *= shrink
    return w, value, gradient


def lbfgs(f, w, steps: int = 100, memory: int = 10, tolerance: float = 1e-8):
    """Minimises f(w) -> (value, gradient)."""
    value, g = f(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.linalg.norm(g) < tolerance:
            break
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        new, v, ng = line_search(f, w, -q, value, g)
        if np.array_equal(new, w):
            break
        if (new - w) @ (ng - g) > 1e-14:
            past = [*past, (new - w, ng - g)][-memory:]
        done = abs(value - v) < tolerance * max(1.0, abs(value))
        w, value, g = new, v, ng
        if done:
            break
    return w


def conjugate_gradient(f, w, steps: int = 200, tolerance: float = 1e-8):
    value, g = f(w)
    d = -g
    for _ in range(steps):
        if np.linalg.norm(g) < tolerance:
            break
        if g @ d >= 0:
            d = -g
        new, v, ng = line_search(f, w, d, value, g)
        if np.array_equal(new, w):
            break
        beta = max(0.0, float(ng @ (ng - g)) / float(g @ g))
        d, w, value, g = -ng + beta * d, new, v, ng
    return w


def svm_dual(x: np.ndarray, y: np.ndarray, c: float = 1.0, sweeps: int = 50) -> np.ndarray:
    """An l2-regularised linear SVM by dual coordinate steps, for data of one task."""
    w, a, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    for _ in range(sweeps):
        for i in range(len(x)):
            if q[i]:
                new = min(max(a[i] - (y[i] * (w @ x[i]) - 1) / q[i], 0), c)
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w


def check_gradient(f, w, epsilon: float = 1e-5, share: float = 1e-3) -> bool:
    _, g = f(w)
    for i in range(len(w)):
        e = np.zeros_like(w)
        e[i] = epsilon
        if abs((f(w + e)[0] - f(w - e)[0]) / (2 * epsilon) - g[i]) > share * max(1.0, abs(g[i])):
            return False
    return True


# distributed passes


def loss_and_gradient(rows: DataFrame, w: np.ndarray, objective: str) -> tuple[float, np.ndarray, int]:
    """Over rows (y, index array<int>, value array<double>): sums of the loss and its gradient in weights of fixed size.

    Tasks send vectors of the model's size, which are added up per coordinate block before the driver gets one row per block."""
    shared = rows.sparkSession.sparkContext.broadcast(w)
    loss = OBJECTIVES[objective]
    width = 4096

    def run(batches):
        weights = shared.value
        g, total, n = np.zeros(len(weights) + 1), 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
            index, value = b.column("index"), b.column("value")
            size = np.diff(index.offsets.to_numpy())
            i, v = index.flatten().to_numpy(), value.flatten().to_numpy()
            row = np.repeat(np.arange(len(y)), size)
            s = np.bincount(row, weights[i] * v, len(y))
            each, slope = loss(s, y)
            g[:-1] += np.bincount(i, slope[row] * v, len(weights))
            total += float(each.sum())
            n += len(y)
        g[-1] = total
        for k in range(0, len(g), width):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([g[k : k + width]], pa.list_(pa.float64()))], names=["block", "n", "g"])

    parts = rows.select("y", "index", "value").mapInArrow(run, "block int, n long, g array<double>")
    flat = parts.select("block", "n", F.posexplode("g").alias("k", "x")).groupBy((F.col("block") + F.col("k")).alias("i")).agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    got = flat.toArrow().to_pandas()
    out = np.zeros(len(w) + 1)
    out[got["i"].to_numpy()] = got["x"].to_numpy()
    return float(out[-1]), out[:-1], int(got["n"].max()) if len(got) else 0


@dataclass
class LinearModel:
    weights: np.ndarray
    history: list[float] = field(default_factory=list)

    def score(self, rows: DataFrame, into: str = "score") -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(self.weights)

        def run(batches):
            w = shared.value
            for b in batches:
                i, v = b.column("index"), b.column("value")
                row = np.repeat(np.arange(b.num_rows), np.diff(i.offsets.to_numpy())) if b.num_rows else np.empty(0, int)
                s = np.bincount(row, w[i.flatten().to_numpy()] * v.flatten().to_numpy(), b.num_rows) if b.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, into])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {into} double"
        return rows.mapInArrow(run, schema)


def train(rows: DataFrame, size: int, objective: str = "log", rule=None, passes: int = 10, l2: float = 0.0) -> LinearModel:
    """Synchronous training: each pass is a full gradient, averaged over rows, and one step of the rule."""
    rule = rule or AdaGrad()
    model = LinearModel(np.zeros(size))
    for _ in range(passes):
        value, g, n = loss_and_gradient(rows, model.weights, objective)
        model.history.append(value / max(n, 1))
        model.weights = rule.step(model.weights, g / max(n, 1) + l2 * model.weights)
    if isinstance(rule, Averaged) and rule.mean is not None:
        model.weights = rule.mean
    return model


def train_batch(rows: DataFrame, size: int, objective: str = "log", steps: int = 20, l2: float = 1e-3) -> LinearModel:
    """L-BFGS, each evaluation one job."""
    history: list[float] = []

    def f(w):
        value, g, n = loss_and_gradient(rows, w, objective)
        n = max(n, 1)
        history.append(value / n)
        return value / n + l2 / 2 * float(w @ w), g / n + l2 * w

    return LinearModel(lbfgs(f, np.zeros(size), steps), history)


def search(space: dict, trial, n: int = 10, seed: int = 1) -> tuple[dict, float]:
    """Random search: space maps names to lists or (low, high) ranges, log-uniform above zero; trial(**settings) is maximised."""
    rng = np.random.default_rng(seed)
    best: tuple[dict, float] = ({}, -math.inf)
    for _ in range(n):
        s = {k: v[int(rng.integers(len(v)))] if isinstance(v, list) else float(np.exp(rng.uniform(np.log(v[0]), np.log(v[1])))) if v[0] > 0 else float(rng.uniform(*v)) for k, v in space.items()}
        got = trial(**s)
        if got > best[1]:
            best = (s, got)
    return best


# further rules


@dataclass
class ConstantLength:
    """Steps of one length, whatever the gradient's."""

    rate: float = 0.1
    decay: str = ""
    t: int = 0

    def step(self, w, g):
        self.t += 1
        size = np.linalg.norm(g)
        return w - self.rate / {"": 1.0, "sqrt": math.sqrt(self.t), "linear": self.t}[self.decay] * g / size if size else w


@dataclass
class RDA:
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 0.0
    t: int = 0
    sums: np.ndarray | None = None

    def step(self, w, g):
        self.t += 1
        self.sums = g.copy() if self.sums is None else self.sums + g
        return -np.sign(self.sums) * np.maximum(0, np.abs(self.sums) - self.t * self.l1) / (1 / self.rate + self.t * self.l2)


@dataclass
class GroupLassoRDA:
    """Whole groups of weights go to zero together; groups maps each weight to its group."""

    groups: np.ndarray
    rate: float = 0.1
    l1: float = 0.01
    t: int = 0
    sums: np.ndarray | None = None

    def step(self, w, g):
        self.t += 1
        self.sums = g.copy() if self.sums is None else self.sums + g
        size = np.sqrt(np.bincount(self.groups, self.sums**2))
        keep = np.maximum(0, 1 - self.t * self.l1 / np.maximum(size, 1e-300))
        return -self.rate * keep[self.groups] * self.sums


@dataclass
class AdaMira:
    """AdaGrad's direction, and a step no longer than mends the loss."""

    most: float = 1.0
    delta: float = 0.1
    seen: np.ndarray | None = None

    def step(self, w, g, value: float = 1.0):
        self.seen = g * g if self.seen is None else self.seen + g * g
        d = g / (self.delta + np.sqrt(self.seen))
        size = float(g @ d)
        return w - min(self.most, value / size) * d if size > 0 else w


@dataclass
class WeightDecay:
    rule: object
    rate: float = 0.01

    def step(self, w, g):
        return self.rule.step(w * (1 - self.rate), g)


@dataclass
class Multiplex:
    """Another rule for each block (start, stop) of the weights."""

    rules: list[tuple[int, int, object]]

    def step(self, w, g):
        w = w.copy()
        for a, b, rule in self.rules:
            w[a:b] = rule.step(w[a:b], g[a:b])
        return w


@dataclass
class Projected:
    rule: object
    project: object = project_ball

    def step(self, w, g):
        return self.project(self.rule.step(w, g))


def sdca(x: np.ndarray, y: np.ndarray, l2: float = 0.1, sweeps: int = 50, seed: int = 1) -> np.ndarray:
    """Stochastic dual coordinate ascent for the smoothed hinge, for data of one task."""
    rng, n = np.random.default_rng(seed), len(x)
    a, w = np.zeros(n), np.zeros(x.shape[1])
    q = (x * x).sum(1) / (l2 * n)
    for _ in range(sweeps):
        for i in rng.permutation(n):
            step = np.clip((1 - y[i] * (w @ x[i]) - a[i]) / (q[i] + 1) + a[i], 0, 1) - a[i]
            a[i] += step
            w += step * y[i] * x[i] / (l2 * n)
    return w


def train_online(rows: DataFrame, size: int, objective: str = "log", passes: int = 3, rate: float = 0.1, shards: int = 4) -> LinearModel:
    """A step per row inside each shard, and the mean of the shards' models after each pass: parameter mixing."""
    model, loss, width = LinearModel(np.zeros(size)), OBJECTIVES[objective], 4096
    held = rows.select("y", "index", "value").repartition(shards)
    for _ in range(passes):
        shared = rows.sparkSession.sparkContext.broadcast(model.weights)

        def run(batches, shared=shared):
            w, seen = shared.value.copy(), np.zeros(size)
            for b in batches:
                for y, i, v in zip(b.column("y").to_pylist(), b.column("index").to_pylist(), b.column("value").to_pylist(), strict=True):
                    i, v = np.array(i, int), np.array(v)
                    g = loss(w[i] @ v, y)[1] * v
                    seen[i] += g * g
                    w[i] -= rate / (0.1 + np.sqrt(seen[i])) * g
            for k in range(0, size, width):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([w[k : k + width]], pa.list_(pa.float64()))], names=["block", "w"])

        parts = held.mapInArrow(run, "block int, w array<double>").select("block", F.posexplode("w").alias("k", "x"))
        got = parts.groupBy((F.col("block") + F.col("k")).alias("i")).agg(F.avg("x").alias("x")).toArrow().to_pandas()
        model.weights = np.zeros(size)
        model.weights[got["i"].to_numpy()] = got["x"].to_numpy()
    return model


def steepest(f, w, steps: int = 100, tolerance: float = 1e-8):
    """Gradient steps of the length that a line search finds."""
    value, g = f(w)
    for _ in range(steps):
        if np.linalg.norm(g) < tolerance:
            break
        new, v, h = line_search(f, w, -g, value, g)
        if value - v < tolerance:
            return new
        w, value, g = new, v, h
    return w


def mini_batch(examples):
    """Several examples, each a function of weights that gives (value, gradient), as one: their values and gradients added up."""

    def f(w):
        parts = [e(w) for e in examples]
        return sum(v for v, _ in parts), np.sum([g for _, g in parts], axis=0)

    return f


def predictor(x: np.ndarray, y: float, objective: str = "log"):
    """An example of a linear predictor."""
    loss = OBJECTIVES[objective]

    def f(w):
        value, slope = loss(float(w @ x), y)
        return float(value), float(slope) * x

    return f


def train_two_stage(rows: DataFrame, size: int, objective: str = "log", passes: int = 2, steps: int = 10, l2: float = 1e-3, **online) -> LinearModel:
    """Online steps first, then L-BFGS from where they came to."""
    start, history = train_online(rows, size, objective, passes, **online).weights, []

    def f(w):
        value, g, n = loss_and_gradient(rows, w, objective)
        n = max(n, 1)
        history.append(value / n)
        return value / n + l2 / 2 * float(w @ w), g / n + l2 * w

    return LinearModel(lbfgs(f, start, steps), history)
