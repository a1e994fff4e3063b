"""Dependency trees: the projective parser, a transition parser, and queries over rows (sent_id, pos, head, label)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def eisner(scores: np.ndarray) -> list[int]:
    """Heads of the best projective tree; scores[head, dependent] with 0 as root; heads of words 1 .. n are returned."""
    n = len(scores)
    full = np.zeros((n, n, 2))
    part = np.full((n, n, 2), -np.inf)
    fb, pb = np.zeros((n, n, 2), int), np.zeros((n, n), int)
    full += -np.inf
    for i in range(n):
        full[i, i] = 0
    for width in range(1, n):
        for i in range(n - width):
            j = i + width
            inner = [full[i, k, 1] + full[k + 1, j, 0] for k in range(i, j)]
            k = int(np.argmax(inner))
            pb[i, j] = i + k
            part[i, j, 0] = inner[k] + scores[j, i]
            part[i, j, 1] = inner[k] + scores[i, j]
            left = [full[i, k, 0] + part[k, j, 0] for k in range(i, j)]
            k = int(np.argmax(left))
            full[i, j, 0], fb[i, j, 0] = left[k], i + k
            right = [part[i, k, 1] + full[k, j, 1] for k in range(i + 1, j + 1)]
            k = int(np.argmax(right))
            full[i, j, 1], fb[i, j, 1] = right[k], i + 1 + k
    heads = [-1] * n
    stack = [(0, n - 1, 1, True)]
    while stack:
        i, j, d, whole = stack.pop()
        if i == j:
            continue
        if whole:
            k = fb[i, j, d]
            stack += [(i, k, 0, True), (k, j, 0, False)] if d == 0 else [(i, k, 1, False), (k, j, 1, True)]
        else:
            heads[i if d == 0 else j] = j if d == 0 else i
            k = pb[i, j]
            stack += [(i, k, 1, True), (k + 1, j, 0, True)]
    return heads[1:]


ACTIONS = ("shift", "left", "right")


class TransitionParser:
    """Arc-standard parsing by a linear classifier over hashed features, trained as a perceptron by following gold trees.

    Actions are shift, and left and right arcs with a label."""

    def __init__(self, labels: list[str], size: int = 1 << 16):
        self.actions = [("shift", "")] + [(a, x) for a in ACTIONS[1:] for x in labels]
        self.size = size
        self.weights = np.zeros((size, len(self.actions)))

    def features(self, words, tags, stack, at, heads) -> np.ndarray:
        get = lambda xs, i: xs[i] if 0 <= i < len(xs) else "<none>"
        s0, s1 = (stack[-1] if stack else -1), (stack[-2] if len(stack) > 1 else -1)
        w = lambda i: "<root>" if i == 0 else get(words, i - 1)
        t = lambda i: "<root>" if i == 0 else get(tags, i - 1)
        f = [f"s0w={w(s0)}", f"s0t={t(s0)}", f"s1w={w(s1)}", f"s1t={t(s1)}", f"b0w={w(at)}", f"b0t={t(at)}", f"b1t={t(at + 1)}", f"s1s0={t(s1)},{t(s0)}", f"s0b0={t(s0)},{t(at)}", f"s1s0b0={t(s1)},{t(s0)},{t(at)}", f"ww={w(s1)},{w(s0)}", f"n={len(stack) > 2}", f"d={min(5, s0 - s1)}"]
        f += [f"k0={sum(h == s0 for h in heads.values())}", f"k1={sum(h == s1 for h in heads.values())}"]
        return np.array([zlib.crc32(x.encode()) % self.size for x in f])

    def legal(self, stack, at, n):
        return [a == "shift" and at <= n or a == "left" and len(stack) > 2 or a == "right" and (len(stack) > 2 or len(stack) == 2 and at > n) for a, _ in self.actions]

    def run(self, words, tags, gold=None, rate: float = 1.0):
        """(heads, labels); with gold (heads, labels) it follows the gold tree and learns."""
        n, stack, at, heads, labels = len(words), [0], 1, {}, {}
        left_to_do = {h: sum(x == h for x in gold[0]) for h in range(n + 1)} if gold else {}
        while at <= n or len(stack) > 1:
            x = self.features(words, tags, stack, at, heads)
            scores = np.where(self.legal(stack, at, n), self.weights[x].sum(0), -np.inf)
            pick = int(scores.argmax())
            if gold:
                want = self._oracle(stack, at, n, gold, left_to_do)
                if want is None:
                    break
                if pick != want:
                    np.add.at(self.weights[:, want], x, rate)
                    np.add.at(self.weights[:, pick], x, -rate)
                pick = want
            action, label = self.actions[pick]
            if action == "shift":
                stack.append(at)
                at += 1
            else:
                child = stack.pop(-2 if action == "left" else -1)
                heads[child], labels[child] = stack[-1], label
                if gold:
                    left_to_do[stack[-1]] -= 1
        return [heads.get(i, 0) for i in range(1, n + 1)], [labels.get(i, "") for i in range(1, n + 1)]

    def _oracle(self, stack, at, n, gold, to_do):
        heads, labels = gold
        if len(stack) > 1:
            s0, s1 = stack[-1], stack[-2]
            if s1 and heads[s1 - 1] == s0 and not to_do[s1]:
                return self.actions.index(("left", labels[s1 - 1]))
            if heads[s0 - 1] == s1 and not to_do[s0]:
                return self.actions.index(("right", labels[s0 - 1]))
        return 0 if at <= n else None  # a tree with crossing arcs can't be followed further

    def fit(self, sentences, passes: int = 5):
        for _ in range(passes):
            for words, tags, heads, labels in sentences:
                self.run(words, tags, (heads, labels))
        return self


def parse(sentences: DataFrame, parser: TransitionParser) -> DataFrame:
    """Adds head and label arrays to rows with words and tags."""
    shared = sentences.sparkSession.sparkContext.broadcast(parser)

    def run(batches):
        p = shared.value
        for pdf in batches:
            got = [p.run(list(w), list(t)) for w, t in zip(pdf["words"], pdf["tags"], strict=True)]
            yield pdf.assign(head=[h for h, _ in got], label=[x for _, x in got])

    return sentences.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sentences.schema) + ", head array<int>, label array<string>")


def children(rows: DataFrame, by: str = "sent_id") -> DataFrame:
    """(sent_id, pos, children) of every node with dependents, and of the root as 0."""
    return rows.groupBy(by, F.col("head").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("children"))


def subtrees(rows: DataFrame, by: str = "sent_id", deepest: int = 100) -> DataFrame:
    """(sent_id, pos, member): every node with all that hang from it, itself included; one task holds a sentence."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        head = dict(zip(pdf["pos"], pdf["head"], strict=True))
        out = []
        for p in head:
            at, steps = p, 0
            while at in head and steps <= deepest:
                out.append((key[0], at, p))
                at, steps = head[at], steps + 1
        return pd.DataFrame(out, columns=[by, "pos", "member"])

    return rows.groupBy(by).applyInPandas(run, f"{by} {rows.schema[by].dataType.simpleString()}, pos long, member long")


def collapse_phrases(rows: DataFrame, spans: DataFrame, by: str = "sent_id") -> DataFrame:
    """The tree over phrases (sent_id, first, last): tokens inside one become its first token; arcs inside go."""
    inside = rows.join(spans, by, "left").where("first is null or (pos >= first and pos <= last)")
    vertex = rows.join(inside.select(by, "pos", F.col("first").alias("_v")).dropDuplicates([by, "pos"]), [by, "pos"], "left").select(by, "pos", F.coalesce("_v", "pos").alias("v"), "head", "label")
    up = vertex.select(by, F.col("pos").alias("head"), F.col("v").alias("hv"))
    return vertex.join(up, [by, "head"], "left").select(by, F.col("v").alias("pos"), F.coalesce("hv", F.lit(0)).alias("head"), "label").where("pos <> head").distinct()
