"""Classifiers from rows (id, feature) and labels (id, y). Counting is Spark's; only tables of fixed size reach the driver."""

from __future__ import annotations

import math
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


# naive Bayes: no class prior unless asked for

#: naive_bayes() gives a weight for every feature in every class; that is refused beyond so many classes
MOST_CLASSES = 10_000


def naive_bayes(features: DataFrame, labels: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """(y, feature, w): ln of each feature's smoothed share of its class, for every class and every feature seen at all."""
    seen = features.join(labels, "id").groupBy("y", "feature").agg(F.count("*").alias("n"))
    every = seen.select("feature").distinct()
    size = every.agg(F.count("*").alias("v"))
    totals = seen.groupBy("y").agg(F.sum("n").alias("t"))
    totals = totals.join(F.broadcast(size))  # one row
    # every feature in every class: classes as an array in each row, of a bounded number of classes
    if (n := totals.count()) > MOST_CLASSES:
        raise ValueError(f"{n} classes, more than {MOST_CLASSES}")
    grid = every.join(F.broadcast(totals))
    full = grid.join(seen, ["y", "feature"], "left")
    return full.select("y", "feature", F.log((F.coalesce("n", F.lit(0)) + smoothing) / (F.col("t") + smoothing * F.col("v"))).alias("w"))


def predict_naive_bayes(features: DataFrame, weights: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(id, predicted, score): the class with the largest sum; ties go to the smaller label. Unknown features count for nothing."""
    counts = features.groupBy("id", "feature").agg(F.count("*").alias("n"))
    scores = counts.join(weights, "feature").groupBy("id", "y").agg(F.sum(F.col("n") * F.col("w")).alias("score"))
    if prior is not None:  # (y, p)
        scores = scores.join(prior, "y").withColumn("score", F.col("score") + F.log("p")).drop("p")
    best = Window.partitionBy("id").orderBy(F.desc(F.round("score", 6)), "y")
    return scores.withColumn("r", F.row_number().over(best)).where("r = 1").select("id", F.col("y").alias("predicted"), F.round("score", 6).alias("score"))


# trees: rows (id, y, w) with columns of numbers; thresholds come from a fixed number of bins per column


def _impurity(kind: str, counts: list[float]) -> float:
    n = sum(counts)
    if not n:
        return 0.0
    ps = [c / n for c in counts if c]
    return 1 - sum(p * p for p in ps) if kind == "gini" else -sum(p * math.log2(p) for p in ps)


def grow_tree(rows: DataFrame, columns: list[str], kind: str = "gini", depth: int = 3, least: int = 1, bins: int = 32) -> list[dict]:
    """Nodes {id, column, at, left, right} or {id, value}. kind: gini (CART), info (ID3), ratio (C4.5), variance (regression).

    A level is one job: per node, column and bin a few sums, so what reaches the driver depends on the tree and the bins alone."""
    regression = kind == "variance"
    cuts = {c: sorted({float(q) for q in qs}) for c, qs in zip(columns, rows.approxQuantile(columns, [i / bins for i in range(1, bins)] + [1.0], 1e-3), strict=True)}
    rows = rows.select(*columns, "y", (F.col("w") if "w" in rows.columns else F.lit(1.0)).alias("w"))
    binned = rows
    for c in columns:
        e = F.lit(len(cuts[c]))
        for i in range(len(cuts[c]) - 1, -1, -1):
            e = F.when(F.col(c) <= cuts[c][i], i).otherwise(e)
        binned = binned.withColumn(f"_b_{c}", e)
    nodes: list[dict] = [{"id": 0}]
    level = [0]
    for d in range(depth + 1):
        where = _node_of(nodes, columns)
        at = binned.withColumn("_node", where).where(F.col("_node").isin(level)).select("_node", "y", "w", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"_b_{c}").alias("b")) for i, c in enumerate(columns)))).alias("x"))
        if regression:
            cells = at.groupBy("_node", "x.c", "x.b").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("q")).toPandas()
        else:
            cells = at.groupBy("_node", "x.c", "x.b", "y").agg(F.sum("w").alias("n")).toPandas()
        level = []
        for node, part in cells.groupby("_node"):
            level += _split(nodes, int(node), part, columns, cuts, kind, last=d == depth, least=least)
        if not level:
            break
    return nodes


def _stats(part: pd.DataFrame, regression: bool):
    if regression:
        n, s, q = part["n"].sum(), part["s"].sum(), part["q"].sum()
        return n, (q / n - (s / n) ** 2 if n else 0.0), (s / n if n else 0.0)
    per = part.groupby("y")["n"].sum()
    return per.sum(), per, per.sort_index().idxmax() if len(per) else None


def _split(nodes, node, part, columns, cuts, kind, last, least):
    regression = kind == "variance"
    one = part[part["c"] == 0]
    n, spread, value = _stats(one, regression)
    here = nodes[node]
    here["value"] = value
    measure = lambda p: _stats(p, True)[1] if regression else _impurity("gini" if kind == "gini" else "info", list(p.groupby("y")["n"].sum()))
    base = measure(one)
    if last or base <= 1e-12 or n <= least:
        return []
    best = (1e-12, None)
    for c, cells in part.groupby("c"):
        for b in sorted(cells["b"].unique())[:-1]:
            low, high = cells[cells["b"] <= b], cells[cells["b"] > b]
            nl, nh = low["n"].sum(), high["n"].sum()
            gain = base - nl / n * measure(low) - nh / n * measure(high)
            if kind == "ratio":
                gain /= max(_impurity("info", [nl, nh]), 1e-9)
            if min(nl, nh) >= least and gain > best[0] + 1e-12:
                best = (gain, (int(c), int(b)))
    if best[1] is None:
        return []
    c, b = best[1]
    left, right = len(nodes), len(nodes) + 1
    here |= {"column": columns[c], "at": cuts[columns[c]][b], "left": left, "right": right, "gain": best[0]}
    nodes += [{"id": left}, {"id": right}]
    return [left, right]


def _node_of(nodes: list[dict], columns: list[str]):
    def at(i: int):
        n = nodes[i]
        return F.when(F.col(n["column"]) <= n["at"], at(n["left"])).otherwise(at(n["right"])) if "column" in n else F.lit(i)

    return at(0)


def predict_tree(rows: DataFrame, nodes: list[dict], into: str = "predicted") -> DataFrame:
    def at(i: int):
        n = nodes[i]
        return F.when(F.col(n["column"]) <= n["at"], at(n["left"])).otherwise(at(n["right"])) if "column" in n else F.lit(n.get("value"))

    return rows.withColumn(into, at(0))


def prune_tree(nodes: list[dict], rows: DataFrame) -> list[dict]:
    """Reduced-error pruning: a split goes where its majority does at least as well on these rows as what is below it."""
    paths = rows.withColumn("_leaf", _node_of(nodes, [])).groupBy("_leaf", "y").agg(F.count("*").alias("n")).toPandas()
    nodes = [dict(n) for n in nodes]

    def visit(i: int) -> tuple[dict, float]:
        n = nodes[i]
        if "column" not in n:
            part = paths[paths["_leaf"] == i]
            per = dict(zip(part["y"], part["n"], strict=True))
            return per, float(per.get(n.get("value"), 0))
        (a, x), (b, y) = visit(n["left"]), visit(n["right"])
        per = {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}
        if per.get(n["value"], 0) >= x + y:
            for k in ("column", "at", "left", "right"):
                n.pop(k)
            return per, float(per.get(n["value"], 0))
        return per, x + y

    visit(0)
    return nodes


def ada_boost(rows: DataFrame, columns: list[str], rounds: int = 10, depth: int = 1) -> list[tuple[float, list[dict]]]:
    """SAMME: (weight, tree) pairs. Weights of rows are an expression over the trees so far, so nothing is stored per row."""
    k = rows.select("y").distinct().count()
    out: list[tuple[float, list[dict]]] = []
    weight = F.lit(1.0)
    for _ in range(rounds):
        tree = grow_tree(rows.withColumn("w", weight), columns, depth=depth)
        miss = (_value_of(tree) != F.col("y")).cast("double")
        r = rows.agg((F.sum(weight * miss) / F.sum(weight)).alias("e")).first()["e"]
        if r >= 1 - 1 / k:
            break
        a = math.log((1 - r) / max(r, 1e-10)) + math.log(k - 1) if k > 1 else 1.0
        out.append((a, tree))
        if r <= 1e-10:
            break
        weight = weight * F.exp(F.lit(a) * miss)
    return out


def _value_of(nodes):
    def at(i: int):
        n = nodes[i]
        return F.when(F.col(n["column"]) <= n["at"], at(n["left"])).otherwise(at(n["right"])) if "column" in n else F.lit(n.get("value"))

    return at(0)


def vote(rows: DataFrame, trees: list[tuple[float, list[dict]]], classes: list, into: str = "predicted") -> DataFrame:
    """The class with the most weight; ties go to the first of `classes`."""
    scores = [F.lit(0.0) for _ in classes]
    for a, t in trees:
        v = _value_of(t)
        scores = [s + F.when(v == c, a).otherwise(0.0) for s, c in zip(scores, classes, strict=True)]
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = F.lit(None)
    for s, c in list(zip(scores, classes, strict=True))[::-1]:
        out = F.when(s == top, F.lit(c)).otherwise(out)
    return rows.withColumn(into, out)


def random_forest(rows: DataFrame, columns: list[str], trees: int = 10, depth: int = 4, features: int | None = None, seed: int = 1) -> list[tuple[float, list[dict]]]:
    """Trees over Poisson-weighted rows, each with its own columns; the weights come from hashes, so they can be made again."""
    features = features or max(1, round(math.sqrt(len(columns))))
    out = []
    for t in range(trees):
        own = sorted(columns, key=lambda c, t=t: zlib.crc32(f"{seed}/{t}/{c}".encode()))[:features]
        u = (F.pmod(F.xxhash64("id", F.lit(seed * 1000 + t)), F.lit(1 << 30)) / (1 << 30)).cast("double")
        w, term, below = F.lit(0.0), math.exp(-1), 0.0
        for k in range(1, 8):  # inverse of the Poisson distribution with mean one
            below += term
            w = F.when(u >= below, float(k)).otherwise(w)
            term /= k
        out.append((1.0, grow_tree(rows.withColumn("w", w).where("w > 0"), own, depth=depth)))
    return out
