"""Chain models over tagged sequences: features as columns or arrays, decoding per sentence in Arrow batches."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def viterbi(emit: np.ndarray, move: np.ndarray, first: np.ndarray | None = None) -> list[int]:
    """The best tags of scores (positions, tags) and transitions (from, to); -inf forbids."""
    n, k = emit.shape
    score = emit[0] + (first if first is not None else 0)
    if k == 2:  # plain numbers are faster than calls on such small arrays; the same sums
        return _viterbi_of_two(score.tolist(), emit.tolist(), move.tolist())
    back = np.zeros((n, k), int)
    for i in range(1, n):
        step = score[:, None] + move
        back[i] = step.argmax(0)
        score = step.max(0) + emit[i]
    out = [int(score.argmax())]
    for i in range(n - 1, 0, -1):
        out.append(int(back[i, out[-1]]))
    return out[::-1]


def _viterbi_of_two(score: list[float], emit: list[list[float]], move: list[list[float]]) -> list[int]:
    """viterbi() of two tags from the scores at the first place."""
    (m00, m01), (m10, m11) = move
    a, b = score
    back = []
    for x, y in emit[1:]:
        stay, come, leave, keep = a + m00, b + m10, a + m01, b + m11
        back.append((come > stay, keep > leave))
        a, b = (come if come > stay else stay) + x, (keep if keep > leave else leave) + y
    out = [int(b > a)]
    for came in reversed(back):
        out.append(int(came[out[-1]]))
    return out[::-1]


def forward_backward(emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of tags and of neighbouring pairs, and the log partition function."""
    n, k = emit.shape
    ls = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    a, b = np.zeros((n, k)), np.zeros((n, k))
    a[0] = emit[0]
    for i in range(1, n):
        a[i] = ls(a[i - 1][:, None] + move, 0) + emit[i]
    for i in range(n - 2, -1, -1):
        b[i] = ls(move + (emit[i + 1] + b[i + 1])[None, :], 1)
    z = float(ls(a[-1], 0))
    pairs = np.array([np.exp(a[i][:, None] + move + (emit[i + 1] + b[i + 1])[None, :] - z) for i in range(n - 1)]).reshape(-1, k, k)
    return np.exp(a + b - z), pairs, z


def licit(tags: list[str], scheme: str = "BIO") -> np.ndarray:
    """0 where a tag may follow another, -inf where it may not."""
    out = np.zeros((len(tags), len(tags)))
    for i, p in enumerate(tags):
        for j, t in enumerate(tags):
            pk, pl, tk, tl = p[0], p[2:], t[0], t[2:]
            if scheme == "BIO":
                ok = tk != "I" or pk in "BI" and pl == tl
            else:
                inside = pk in "BI"
                ok = (tk in "IL") == inside and (not inside or pl == tl)
            out[i, j] = 0.0 if ok else -np.inf
    return out


def token_features(words: list[str]) -> list[list[str]]:
    """Word, shape, affixes and digits, with those of the neighbours at one and two places. A word may carry a tag behind a unit
    separator, which is a feature of its own and of its neighbours."""
    said = [f"t={w.partition(chr(31))[2]}" if chr(31) in w else "" for w in words]
    words = [w.partition(chr(31))[0] for w in words]
    shape = lambda w: "".join("A" if c.isupper() else "a" if c.islower() else "1" if c.isdigit() else c for c in w[:8])
    own = [[f"w={w.lower()}", f"s={shape(w)}", f"p={w[:3].lower()}", f"x={w[-3:].lower()}"] for w in words]
    out = []
    for i in range(len(words)):
        feats = ["bias", *own[i]]
        if said[i]:
            feats += [said[i], *(f"{said[i + k]}@{k}" for k in (-1, 1) if 0 <= i + k < len(words))]
        for k in OFFSETS:
            feats += [f"{f}@{k}" for f in own[i + k][:2]] if 0 <= i + k < len(words) else ["<START>" if k < 0 else "<END>"]
        out.append(feats)
    return out


OFFSETS = (-2, -1, 1, 2)
#: words whose slots a model keeps
MOST_KNOWN = 1 << 18


@dataclass
class ChainModel:
    tags: list[str]
    size: int = 1 << 18
    weights: np.ndarray | None = None  # (slots, tags)
    move: np.ndarray | None = None
    mask: np.ndarray | None = None
    loss: list[float] = field(default_factory=list)
    _known: dict[str, int] = field(default_factory=dict, repr=False, compare=False)  # rows of the table: slots that come from a word alone
    _table: np.ndarray = field(default_factory=lambda: np.zeros((0, 12), np.int64), repr=False, compare=False)

    def __post_init__(self):
        k = len(self.tags)
        self.weights = np.zeros((self.size, k)) if self.weights is None else self.weights
        self.move = np.zeros((k, k)) if self.move is None else self.move

    def slots(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slots of the features of token_features(), a row a word in their order, and which of the cells hold one."""
        crc = lambda f: zlib.crc32(f.encode()) % self.size
        if any(chr(31) in w for w in words):
            rows = [[crc(f) for f in fs] for fs in token_features(words)]
            held = np.arange(max(map(len, rows))) < np.array([len(r) for r in rows])[:, None]
            out = np.zeros(held.shape, np.int64)
            out[held] = np.concatenate(rows)
            return out, held
        if len(self._known) > MOST_KNOWN:
            self._known.clear()
        known, at = self._known, []
        for w in words:
            if (i := known.get(w)) is None:
                i = known[w] = len(known)
                if i >= len(self._table):
                    self._table = np.concatenate([self._table, np.zeros((max(1024, len(self._table)), 12), np.int64)])
                own = token_features([w])[0][1:5]
                self._table[i] = [crc(f) for f in own] + [crc(f"{f}@{k}") for k in OFFSETS for f in own[:2]]
            at.append(i)
        t = self._table[at]
        out, held = np.zeros((len(words), 13), np.int64), np.ones((len(words), 13), bool)
        out[:, 0], out[:, 1:5] = crc("bias"), t[:, :4]
        for j, k in enumerate(OFFSETS):
            here = slice(5 + 2 * j, 7 + 2 * j)
            inside, beyond = (slice(-k, None), slice(0, -k)) if k < 0 else (slice(0, max(len(words) - k, 0)), slice(max(len(words) - k, 0), None))
            there = slice(0, max(len(words) + k, 0)) if k < 0 else slice(k, None)
            out[inside, here] = t[there, 4 + 2 * j : 6 + 2 * j]
            out[beyond, 5 + 2 * j], held[beyond, 6 + 2 * j] = crc("<START>" if k < 0 else "<END>"), False
        return out, held

    def scores(self, slots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Sums of weights, feature after feature, whatever the number of words."""
        w = self.weights[slots[0].T]
        w[~slots[1].T] = 0
        return w.sum(0)

    def decode(self, words: list[str]) -> list[str]:
        if not len(words):
            return []
        move = self.move if self.mask is None else self.move + self.mask
        return [self.tags[t] for t in viterbi(self.scores(self.slots(words)), move)]

    def step(self, words: list[str], gold: list[str], rate: float = 0.1, likelihood: bool = True) -> None:
        """One example's update: of the likelihood, or of the structured perceptron."""
        slots, held = self.slots(words)
        y = [self.tags.index(t) for t in gold]
        emit = self.scores((slots, held))
        if likelihood:
            p, pairs, z = forward_backward(emit, self.move)
            self.loss.append(z - sum(emit[i, t] for i, t in enumerate(y)) - sum(self.move[a, b] for a, b in zip(y, y[1:])))
            g = -p
            g[np.arange(len(y)), y] += 1
            np.add.at(self.weights, slots[held], np.repeat(rate * g, held.sum(1), 0))
            if len(y) > 1:
                self.move -= rate * pairs.sum(0)
        else:
            guess = viterbi(emit, self.move)
            self.loss.append(float(guess != y))
            got, want = np.array(guess), np.array(y)
            wrong = np.flatnonzero(got != want)
            # word after word, first to the right tag, then from the guessed one
            cells = slots[wrong, None, :] * len(self.tags) + np.stack([want[wrong], got[wrong]], 1)[:, :, None]
            by = np.broadcast_to(np.array([rate, -rate])[:, None], cells.shape)
            used = np.broadcast_to(held[wrong, None, :], cells.shape)
            np.add.at(self.weights.reshape(-1), cells[used], by[used])
            for a, b in zip(guess, guess[1:]):
                self.move[a, b] -= rate
        for a, b in zip(y, y[1:]):
            self.move[a, b] += rate


def train_chain(sentences: DataFrame, tags: list[str], passes: int = 5, rate: float = 0.1, shards: int = 4, likelihood: bool = True, size: int = 1 << 16) -> ChainModel:
    """Parameter mixing over rows (words array<string>, tags array<string>): in each pass every shard trains from the shared model
    on its own sentences, and the models, tables of fixed size, are averaged by slot in Spark."""
    model = ChainModel(tags, size)
    k = len(tags)
    sharded = sentences.select("words", "tags").repartition(shards)
    for _ in range(passes):
        shared = sentences.sparkSession.sparkContext.broadcast((model.weights, model.move))

        def run(batches, shared=shared):
            w, m = shared.value
            own = ChainModel(tags, size, w.copy(), m.copy())
            for pdf in batches:
                for words, gold in zip(pdf["words"], pdf["tags"], strict=True):
                    if len(words):
                        own.step(list(words), list(gold), rate, likelihood)
            changed = np.flatnonzero((own.weights != w).any(1))
            yield pd.DataFrame({"slot": [*changed, *range(-1, -k - 1, -1)], "w": [*(own.weights - w)[changed], *(own.move - m)]})

        parts = sharded.mapInPandas(run, "slot int, w array<double>")
        sums = parts.groupBy("slot").agg(*(F.sum(F.get("w", F.lit(j))).alias(f"w{j}") for j in range(k))).toArrow().to_pandas()
        step = sums[[f"w{j}" for j in range(k)]].to_numpy() / shards
        at = sums["slot"].to_numpy()
        model.weights[at[at >= 0]] += step[at >= 0]
        model.move[-at[at < 0] - 1] += step[at < 0]
    return model


def tag(sentences: DataFrame, model: ChainModel, into: str = "predicted") -> DataFrame:
    """Adds the decoded tags of an array of words."""
    shared = sentences.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for pdf in batches:
            yield pdf.assign(**{into: [m.decode(list(w)) for w in pdf["words"]]})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema) + f", {into} array<string>"
    return sentences.mapInPandas(run, schema)


def ambiguity_classes(tagged: DataFrame, share: float = 0.4, sure_count: int = 1000, sure_share: float = 0.999) -> DataFrame:
    """(word, tags, sure): tags above a share of the word's uses; sure where one tag has nearly all of many uses."""
    c = tagged.groupBy(F.lower("word").alias("word"), "tag").agg(F.count("*").alias("n"))
    t = c.groupBy("word").agg(F.sum("n").alias("all"))
    x = c.join(t, "word").withColumn("share", F.col("n") / F.col("all"))
    return x.groupBy("word").agg(F.array_sort(F.collect_list(F.when(F.col("share") > share, F.col("tag")))).alias("tags"), F.max((F.col("all") >= sure_count) & (F.col("share") >= sure_share)).alias("sure"))
