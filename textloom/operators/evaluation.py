"""Evaluation of labels, spans, clusterings and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def confusion(rows: DataFrame, gold: str = "gold", predicted: str = "predicted") -> DataFrame:
    return rows.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def per_label(rows: DataFrame, gold: str = "gold", predicted: str = "predicted", undefined: float = 0.0) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1), from one pass over the confusion counts."""
    cells = confusion(rows, gold, predicted)
    hit = (F.col(gold) == F.col(predicted)).cast("long") * F.col("n")
    miss = (F.col(gold) != F.col(predicted)).cast("long") * F.col("n")
    none = F.lit(0).cast("long")
    long = cells.select(F.col(gold).alias("label"), hit.alias("tp"), none.alias("fp"), miss.alias("fn")).union(cells.select(F.col(predicted), none, miss, none))
    out = long.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp"), undefined), ratio(F.col("tp"), F.col("tp") + F.col("fn"), undefined)
    return out.select("label", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def macro(scores: DataFrame) -> DataFrame:
    return scores.agg(*(F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")))


def micro(scores: DataFrame) -> DataFrame:
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    p, r = ratio(tp, tp + fp, 1.0), ratio(tp, tp + fn, 1.0)
    return scores.agg(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def span_scores(gold: DataFrame, predicted: DataFrame, on: list[str]) -> DataFrame:
    """Exact span matches: one row (tp, n_predicted, n_gold, precision, recall, f1)."""
    both = gold.select(*on, F.lit(1).alias("g")).join(predicted.select(*on, F.lit(1).alias("p")), on, "full_outer")
    tp, n_p, n_g = F.count(F.when(F.col("g").isNotNull() & F.col("p").isNotNull(), 1)), F.count("p"), F.count("g")
    p, r = ratio(tp, n_p, 1.0), ratio(tp, n_g, 1.0)
    return both.agg(tp.alias("tp"), n_p.alias("n_predicted"), n_g.alias("n_gold"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def overlaps(rows: DataFrame) -> DataFrame:
    """(gold, predicted, n, ng, np) of clusterings (point, gold, predicted): sizes of meets, never pairs of points."""
    cells = rows.groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    return cells.join(cells.groupBy("gold").agg(F.sum("n").alias("ng")), "gold").join(cells.groupBy("predicted").agg(F.sum("n").alias("np")), "predicted")


def pairwise(rows: DataFrame) -> DataFrame:
    cells = overlaps(rows)
    tp = F.sum(F.col("n") * (F.col("n") - 1))
    p, r = ratio(tp, F.sum(F.col("n") * (F.col("np") - 1)), 1.0), ratio(tp, F.sum(F.col("n") * (F.col("ng") - 1)), 1.0)
    return cells.agg(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def b_cubed(rows: DataFrame) -> DataFrame:
    cells = overlaps(rows)
    n = F.sum("n")
    p, r = F.sum(F.col("n") * F.col("n") / F.col("np")) / n, F.sum(F.col("n") * F.col("n") / F.col("ng")) / n
    return cells.agg(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"))


def muc(rows: DataFrame) -> DataFrame:
    """Links kept: a cluster of n points in k parts of the other clustering keeps n - k of n - 1."""
    def side(a: str, b: str) -> DataFrame:
        return rows.groupBy(a).agg(F.count("*").alias("n"), F.count_distinct(b).alias("k")).agg(F.sum(F.col("n") - F.col("k")).alias("kept"), F.sum(F.col("n") - 1).alias("all"))

    p, r = side("predicted", "gold").select(ratio(F.col("kept"), F.col("all"), 1.0).alias("p")), side("gold", "predicted").select(ratio(F.col("kept"), F.col("all"), 1.0).alias("r"))
    return p.join(F.broadcast(r)).select(F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1(F.col("p"), F.col("r")), 6).alias("f1"))


def best_assignment(weights) -> list[tuple[int, int]]:
    """Pairs (row, column) of a matrix with the largest total weight, by shortest augmenting paths with potentials."""
    import numpy as np

    w = np.asarray(weights, float)
    flip = w.shape[0] > w.shape[1]
    cost = -(w.T if flip else w)
    n, m = cost.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    found = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((c, r) for r, c in found) if flip else sorted(found)


def ceaf(rows: DataFrame, by_entity: bool, by: str = "doc_id") -> DataFrame:
    """(by, score, n_gold, n_predicted) of clusterings (by, point, gold, predicted): the best matching of entities in each document,
    by shared points (CEAF-M) or by their share of both sizes (CEAF-E). Points are counted by Spark; what a task matches is the meets of
    entities of one document after another."""
    import numpy as np
    import pandas as pd

    cells = rows.groupBy(by, "gold", "predicted").agg(F.count("*").alias("n"))
    docs = cells.groupBy(by).agg(F.collect_list("gold").alias("g"), F.collect_list("predicted").alias("p"), F.collect_list("n").alias("n"))

    def match(g, p, n):
        golds, gi = np.unique(g, return_inverse=True)
        said, pi = np.unique(p, return_inverse=True)
        meet = np.zeros((len(golds), len(said)))
        meet[gi, pi] = n
        w = 2 * meet / (meet.sum(1)[:, None] + meet.sum(0)[None, :]) if by_entity else meet
        score = float(w.max()) if 1 in w.shape else float(sum(w[i, j] for i, j in best_assignment(w)))
        points = int(np.sum(n))
        return score, len(golds) if by_entity else points, len(said) if by_entity else points

    def run(batches):
        known: dict[tuple, tuple] = {}  # small documents repeat each other's cells; each kind is matched once in a task
        for pdf in batches:
            out = []
            for cells in zip(pdf["g"], pdf["p"], pdf["n"], strict=True):
                if len(cells[0]) > 16:
                    out.append(match(*cells))
                    continue
                key = tuple(x for c in cells for x in c.tolist())
                if key not in known:
                    if len(known) >= 100_000:
                        known.clear()
                    known[key] = match(*cells)
                out.append(known[key])
            yield pd.DataFrame({by: pdf[by], "score": [x[0] for x in out], "n_gold": [x[1] for x in out], "n_predicted": [x[2] for x in out]})

    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    return docs.mapInPandas(run, StructType([rows.schema[by], StructField("score", DoubleType()), StructField("n_gold", LongType()), StructField("n_predicted", LongType())]))


def average_precision(rows: DataFrame, by: str, score: str, hit: str, tie: str) -> DataFrame:
    """(by, ap): the mean over hits of the share of hits down to each, by falling score."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    ranked = rows.withColumn("_r", F.row_number().over(w)).withColumn("_h", F.sum(hit).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.groupBy(by).agg(F.round(ratio(F.sum(F.when(F.col(hit) == 1, F.col("_h") / F.col("_r"))), F.sum(hit)), 6).alias("ap"))


def attachment(rows: DataFrame) -> DataFrame:
    """UAS and LAS of rows (gold_head, gold_label, head, label)."""
    right = F.col("gold_head") == F.col("head")
    return rows.agg(F.round(F.avg(right.cast("double")), 6).alias("uas"), F.round(F.avg((right & (F.col("gold_label") == F.col("label"))).cast("double")), 6).alias("las"))


def without_singletons(rows: DataFrame, side: str = "gold") -> DataFrame:
    """Leaves out points that are alone in their cluster of one side."""
    w = Window.partitionBy(side)
    return rows.withColumn("_n", F.count("*").over(w)).where("_n > 1").drop("_n")


def blanc(rows: DataFrame) -> DataFrame:
    """The mean of the F1 of coreferent and of other pairs, from sizes of meets."""
    cells = overlaps(rows)
    s = cells.agg(F.sum(F.expr("n * (n - 1)")).alias("rc"), F.sum(F.expr("n * (np - 1)")).alias("pc"), F.sum(F.expr("n * (ng - 1)")).alias("gc"), F.sum("n").alias("n"))
    rc, pc, gc, every = F.col("rc"), F.col("pc"), F.col("gc"), F.expr("n * (n - 1)")
    rn = every - pc - gc + rc
    pn, gn = every - pc, every - gc
    p, r = (ratio(rc, pc) + ratio(rn, pn)) / 2, (ratio(rc, gc) + ratio(rn, gn)) / 2
    f = (f1(ratio(rc, pc), ratio(rc, gc)) + f1(ratio(rn, pn), ratio(rn, gn))) / 2
    return s.select(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def linking_accuracy(rows: DataFrame, by: str = "doc_id") -> DataFrame:
    """(micro, macro): the share of right links over all rows, and the mean of the shares by document."""
    right = (F.col("gold") == F.col("predicted")).cast("double")
    per = rows.groupBy(by).agg(F.sum(right).alias("s"), F.count("*").alias("n"))
    return per.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("micro"), F.round(F.avg(F.col("s") / F.col("n")), 6).alias("macro"))


def mean_average_precision(per: DataFrame) -> DataFrame:
    return per.agg(F.round(F.avg("ap"), 6).alias("map"))


def same_partition(rows: DataFrame) -> bool:
    """Whether both clusterings part the points alike: every meet is a whole cluster of both."""
    return not overlaps(rows).where("n <> ng or n <> np").limit(1).count()
