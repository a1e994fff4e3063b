"""Training of models over factor graphs from examples, and ranking embeddings."""

from __future__ import annotations

import numpy as np

from textloom.operators.graphs import Graph, _local, climb, enumerate_all, propagate


class Templates:
    """A log-linear model: build(example, weights) makes a Graph, stats(example, setting) the feature counts of a setting."""

    def __init__(self, build, stats, size: int):
        self.build, self.stats, self.w = build, stats, np.zeros(size)

    def expected(self, example, exact: bool = True) -> np.ndarray:
        g = self.build(example, self.w)
        settings = list(g.settings())
        p = np.exp(np.array([g.score(s) for s in settings]) - enumerate_all(g)[1])
        return sum(q * self.stats(example, s) for q, s in zip(p, settings, strict=True))

    # gradients of what is maximised

    def likelihood(self, example, gold) -> np.ndarray:
        return self.stats(example, gold) - self.expected(example)

    def perceptron(self, example, gold) -> np.ndarray:
        best = propagate(self.build(example, self.w), 50, best=True)[1]
        return self.stats(example, gold) - self.stats(example, tuple(best))

    def margin(self, example, gold, cost: float = 1.0) -> np.ndarray:
        """Structured SVM: the best setting of scores plus the number of wrong values."""
        g = self.build(example, self.w)
        for v, n in enumerate(g.sizes):
            wrong = np.full(n, cost)
            wrong[gold[v]] = 0
            g.factors.append(((v,), wrong))
        best = tuple(propagate(g, 50, best=True)[1])
        return self.stats(example, gold) - self.stats(example, best)

    def pseudo_likelihood(self, example, gold) -> np.ndarray:
        g, out = self.build(example, self.w), np.zeros_like(self.w)
        for v, n in enumerate(g.sizes):
            e = _local(g, list(gold), v)
            p = np.exp(e - e.max())
            p /= p.sum()
            out += self.stats(example, gold)
            for k in range(n):
                out -= p[k] * self.stats(example, tuple(k if u == v else x for u, x in enumerate(gold)))
        return out

    def pseudomax(self, example, gold, cost: float = 0.0) -> np.ndarray:
        """Each variable alone, the others gold: where another value scores as high as gold (with a cost, within that margin), the best
        such value's features go down and gold's go up."""
        g, out = self.build(example, self.w), np.zeros_like(self.w)
        for v, _ in enumerate(g.sizes):
            e = _local(g, list(gold), v) + cost
            e[gold[v]] -= cost
            k = int(e.argmax())
            if k == gold[v]:
                e[k] = -np.inf
                k = int(e.argmax()) if cost == 0 and len(e) > 1 and e.max() >= _local(g, list(gold), v)[gold[v]] else gold[v]
            if k != gold[v]:
                out += self.stats(example, gold) - self.stats(example, tuple(k if u == v else x for u, x in enumerate(gold)))
        return out

    def case_likelihood(self, example, gold, cases: list[tuple[int, ...]]) -> np.ndarray:
        """The likelihood of gold among some settings only."""
        g = self.build(example, self.w)
        scores = np.array([g.score(c) for c in cases])
        p = np.exp(scores - scores.max())
        p /= p.sum()
        return self.stats(example, gold) - sum(q * self.stats(example, c) for q, c in zip(p, cases, strict=True))

    def contrastive_divergence(self, example, gold, steps: int = 1, rng=None, start=None) -> tuple[np.ndarray, tuple]:
        """The gold setting against one that a few Gibbs steps reach from it, or from `start` (persistent chains)."""
        rng = rng or np.random.default_rng(0)
        g, x = self.build(example, self.w), list(start or gold)
        for _ in range(steps):
            for v, n in enumerate(g.sizes):
                e = _local(g, x, v)
                p = np.exp(e - e.max())
                x[v] = int(rng.choice(n, p=p / p.sum()))
        return self.stats(example, gold) - self.stats(example, tuple(x)), tuple(x)

    def sample_rank(self, example, objective, start, steps: int = 20, rate: float = 1.0, rng=None) -> tuple:
        """Walks by single changes; where model and objective disagree on a change, the weights move towards the better setting."""
        rng = rng or np.random.default_rng(0)
        x = tuple(start)
        for _ in range(steps):
            g = self.build(example, self.w)
            v = int(rng.integers(len(x)))
            y = tuple(int(rng.integers(g.sizes[v])) if u == v else k for u, k in enumerate(x))
            gain, model = objective(y) - objective(x), g.score(y) - g.score(x)
            d = self.stats(example, y) - self.stats(example, x)
            if gain > 0 and model <= 0:
                self.w += rate * d
            elif gain < 0 and model >= 0:
                self.w -= rate * d
            if self.build(example, self.w).score(y) > self.build(example, self.w).score(x):
                x = y
        return x

    def fit(self, examples, kind: str = "likelihood", passes: int = 20, rate: float = 0.5):
        for _ in range(passes):
            for x, gold in examples:
                g = getattr(self, kind)(x, gold)
                self.w += rate * (g[0] if isinstance(g, tuple) else g)
        return self

    def best(self, example) -> list[int]:
        g = self.build(example, self.w)
        return climb(g, propagate(g, 50, best=True)[1])


def chain_templates(tags: int, words: int) -> Templates:
    """Observation and transition weights of a chain over word indexes."""
    def build(x, w):
        emit, move = w[: words * tags].reshape(words, tags), w[words * tags :].reshape(tags, tags)
        return Graph([tags] * len(x), [((i,), emit[k].copy()) for i, k in enumerate(x)] + [((i, i + 1), move.copy()) for i in range(len(x) - 1)])

    def stats(x, y):
        out = np.zeros(words * tags + tags * tags)
        for k, t in zip(x, y, strict=True):
            out[k * tags + t] += 1
        for a, b in zip(y, y[1:]):
            out[words * tags + a * tags + b] += 1
        return out

    return Templates(build, stats, words * tags + tags * tags)


def rank_labels(pairs: list[tuple[int, int]], items: int, labels: int, size: int = 8, passes: int = 20, rate: float = 0.05, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of items and labels so that an item's label ranks first: labels are drawn until one violates the margin, and the step
    grows with the rank that the number of draws suggests."""
    rng = np.random.default_rng(seed)
    u, v = rng.normal(0, 0.1, (items, size)), rng.normal(0, 0.1, (labels, size))
    for _ in range(passes):
        for i, y in pairs:
            for draws in range(1, labels):
                k = int(rng.integers(labels))
                if k != y and u[i] @ v[k] > u[i] @ v[y] - 1:
                    step = rate * np.log1p((labels - 1) // draws)
                    du = v[y] - v[k]
                    v[y] += step * u[i]
                    v[k] -= step * u[i]
                    u[i] += step * du
                    break
    return u, v


def composite_likelihood(model: Templates, example, gold, groups: list[tuple[int, ...]]) -> np.ndarray:
    """Each group of variables given all others; groups are small, since their settings are listed."""
    g, out = model.build(example, model.w), np.zeros_like(model.w)
    import itertools

    for group in groups:
        options = []
        for values in itertools.product(*(range(g.sizes[v]) for v in group)):
            x = list(gold)
            for v, k in zip(group, values, strict=True):
                x[v] = k
            options.append(tuple(x))
        s = np.array([g.score(x) for x in options])
        p = np.exp(s - s.max())
        p /= p.sum()
        out += model.stats(example, gold) - sum(q * model.stats(example, x) for q, x in zip(p, options, strict=True))
    return out


def domination(scores: np.ndarray, good: np.ndarray, margin: float = 1.0) -> tuple[float, np.ndarray]:
    """(loss, gradient in the scores): the best of the bad should be a margin below the best of the good."""
    g = np.zeros_like(scores, dtype=float)
    if good.all() or not good.any():
        return 0.0, g
    i, j = int(np.where(good, scores, -np.inf).argmax()), int(np.where(good, -np.inf, scores).argmax())
    loss = float(max(0.0, scores[j] + margin - scores[i]))
    if loss:
        g[i], g[j] = -1, 1
    return loss, g


def semi_supervised(model: Templates, example, allowed) -> np.ndarray:
    """Expected counts under the settings that allowed(setting) accepts, less those under all."""
    g = model.build(example, model.w)
    settings = list(g.settings())
    s = np.array([g.score(x) for x in settings])
    ok = np.array([bool(allowed(x)) for x in settings])

    def expect(mask):
        p = np.where(mask, np.exp(s - s.max()), 0)
        p /= p.sum()
        return sum(q * model.stats(example, x) for q, x in zip(p, settings, strict=True) if q)

    return expect(ok) - expect(np.ones(len(s), bool))
