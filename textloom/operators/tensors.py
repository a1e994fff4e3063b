"""Tensors of any order as rows (indexes..., v): sparse, each cell once, absent cells zero. All operations are joins and sums by index,
so a tensor is dealt out over tasks and never held by one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from textloom.functions.maths import hashed_feature


def tensor(rows: DataFrame, indexes: dict[str, Column], value: Column) -> DataFrame:
    """Sums values by their indexes; cells that come to zero are absent."""
    return rows.groupBy(*(c.alias(k) for k, c in indexes.items())).agg(F.sum(value.cast("double")).alias("v")).where("v <> 0")


def _indexes(a: DataFrame) -> list[str]:
    return [c for c in a.columns if c != "v"]


def add(a: DataFrame, b: DataFrame, times: float = 1.0) -> DataFrame:
    """a + times * b."""
    return tensor(a.unionByName(b.withColumn("v", F.col("v") * times)), {c: F.col(c) for c in _indexes(a)}, F.col("v"))


def scale(a: DataFrame, by: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * by)


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell by cell; indexes that only one of them has are kept, so that a vector scales a matrix's rows or columns."""
    on = [c for c in _indexes(a) if c in _indexes(b)]
    both = a.join(b.withColumnRenamed("v", "w"), on)
    return both.select(*dict.fromkeys([*_indexes(a), *_indexes(b)]), (F.col("v") * F.col("w")).alias("v"))


def contract(a: DataFrame, b: DataFrame, over: list[str]) -> DataFrame:
    """Sums products over shared indexes: matrix times vector, matrix times matrix, a tensor of order three times a vector."""
    left = [c for c in [*_indexes(a), *_indexes(b)] if c not in over]
    both = a.join(b.withColumnRenamed("v", "w"), over)
    total = F.sum(F.col("v") * F.col("w")).alias("v")
    return (both.groupBy(*left).agg(total) if left else both.agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("v"))).where("v <> 0")


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (v)."""
    return a.join(b.withColumnRenamed("v", "w"), _indexes(a)).agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("v"))


def outer(a: DataFrame, b: DataFrame, most: int = 1_000_000) -> DataFrame:
    """All products of cells of two tensors with different indexes. b must have at most `most` cells, which is counted."""
    if (n := b.count()) > most:
        raise ValueError(f"the second factor of an outer product has {n} cells, more than {most}")
    return a.join(F.broadcast(b.withColumnRenamed("v", "w"))).select(*_indexes(a), *_indexes(b), (F.col("v") * F.col("w")).alias("v"))


def renamed(a: DataFrame, **names: str) -> DataFrame:
    """Indexes by other names: a transposition is renamed(a, r="c", c="r")."""
    return a.select(*(F.col(c).alias(names.get(c, c)) for c in a.columns))


def diagonal(a: DataFrame, first: str, second: str) -> DataFrame:
    return a.where(F.col(first) == F.col(second)).drop(second)


def trace(a: DataFrame, first: str, second: str) -> DataFrame:
    return diagonal(a, first, second).agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))


def sums(a: DataFrame, by: str) -> DataFrame:
    """(by, v): sums over all other indexes: row sums, column sums."""
    return a.groupBy(by).agg(F.sum("v").alias("v"))


def part(a: DataFrame, index: str, at) -> DataFrame:
    """The slice at one value of an index."""
    return a.where(F.col(index) == F.lit(at)).drop(index)


def active(a: DataFrame, index: str) -> DataFrame:
    """(index): the values of it at which some cell is not zero."""
    return a.where("v <> 0").select(index).distinct()


def norm(a: DataFrame, p: int = 2) -> DataFrame:
    """One row (v): the 1- or 2-norm; p = 0 is the largest magnitude."""
    v = F.abs("v")
    return a.agg(F.coalesce(F.max(v) if p == 0 else F.sum(v) if p == 1 else F.sqrt(F.sum(v * v)), F.lit(0.0)).alias("v"))


def hashed(a: DataFrame, size: int) -> DataFrame:
    """(slot, v): cells in a space of fixed size, with signs so that collisions cancel out on average."""
    h = hashed_feature(F.concat_ws("|", *(F.col(c).cast("string") for c in _indexes(a))), size)
    return a.select(h.alias("h"), "v").groupBy(F.col("h.slot").alias("slot")).agg(F.sum(F.col("h.sign") * F.col("v")).alias("v"))


def concatenated(parts: list[DataFrame], index: str = "block") -> DataFrame:
    """The tensors side by side, told apart by a further index."""
    return reduce(DataFrame.unionByName, [p.withColumn(index, F.lit(i)) for i, p in enumerate(parts)])


def same(a: DataFrame, b: DataFrame, epsilon: float = 0.0) -> bool:
    """Whether all cells agree."""
    w = b.withColumnRenamed("v", "w")
    differ = a.join(w, _indexes(a), "full_outer").where(F.abs(F.coalesce("v", F.lit(0.0)) - F.coalesce("w", F.lit(0.0))) > epsilon)
    return not differ.limit(1).count()


def proportions(counts: DataFrame, by: list[str], prior: float = 0.0) -> DataFrame:
    """(by, value index, v, p, log_p): masses normalised within `by`, `prior` added to each that is there: counts to shares."""
    total = counts.groupBy(*by).agg(F.sum(F.col("v") + prior).alias("total")) if by else counts.agg(F.sum(F.col("v") + prior).alias("total"))
    both = counts.join(total, by) if by else counts.join(F.broadcast(total))  # one row
    p = (F.col("v") + prior) / F.col("total")
    return both.select(*_indexes(counts), "v", p.alias("p"), F.log(p).alias("log_p"))
