"""Vocabularies and corpus statistics from token rows (doc_id, term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def counts(toks: DataFrame) -> DataFrame:
    return toks.groupBy("term").agg(F.count("*").alias("n"))


def trim_below(vocabulary: DataFrame, least: int) -> DataFrame:
    return vocabulary.where(F.col("n") >= least)


def trim_above(vocabulary: DataFrame, most: int) -> DataFrame:
    return vocabulary.where(F.col("n") <= most)


def count_of_counts(vocabulary: DataFrame) -> DataFrame:
    """(n, terms, at_or_above): how many terms occur n times, and n times or more. A row per distinct count, so the window is small."""
    per = vocabulary.groupBy("n").agg(F.count("*").alias("terms"))
    return per.withColumn("at_or_above", F.sum("terms").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)))


def trim_to_size(vocabulary: DataFrame, size: int) -> DataFrame:
    """Terms that occur at least so often, 2 times or more, that fewer than `size` are left."""
    per = count_of_counts(vocabulary)
    bound = per.where((F.col("at_or_above") < size) & (F.col("n") >= 2)).agg(F.min("n").alias("bound"))
    return vocabulary.join(F.broadcast(bound), F.col("n") >= F.col("bound")).drop("bound")  # one row


def encode(vocabulary: DataFrame) -> DataFrame:
    """(term, n, index): 0-based by falling count, then term.

    The rank is a count of the more frequent (from the table of counts) plus a rank among those of equal count, so no window runs
    over all terms."""
    above = count_of_counts(vocabulary).select("n", (F.col("at_or_above") - F.col("terms")).alias("before"))
    same = Window.partitionBy("n").orderBy("term")
    return vocabulary.join(above, "n").select("term", "n", (F.col("before") + F.row_number().over(same) - 1).alias("index"))


def term_frequencies(toks: DataFrame) -> DataFrame:
    return toks.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def tf_weight(tf: Column, kind: str, highest: Column | None = None, distinct: Column | None = None, k: float = 0.5) -> Column:
    """raw, binary, scaled (by the number of distinct terms), log_norm, or k_norm (k plus the rest by the highest count)."""
    return {
        "raw": lambda: tf.cast("double"),
        "binary": lambda: (tf > 0).cast("double"),
        "scaled": lambda: tf / distinct,
        "log_norm": lambda: 1 + F.log(tf.cast("double")),
        "k_norm": lambda: k + (1 - k) * tf / highest,
    }[kind]()


def document_frequencies(toks: DataFrame) -> DataFrame:
    return toks.select("doc_id", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n_docs, smooth: float = 0.0) -> Column:
    return F.log(smooth + n_docs / (1 + df))


def tfidf_top(toks: DataFrame, n_docs: int, k: int) -> DataFrame:
    """(doc_id, term, score, rank): each document's k terms of highest tf times ln(1 + N / (1 + df))."""
    tf = term_frequencies(toks)
    # every row has a count above zero; asking for it makes both sides of the join read one shuffle, so that texts are cut once
    df = tf.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("df"))
    weighted = tf.join(df, "term").select("doc_id", "term", F.round(F.col("tf") * idf(F.col("df"), F.lit(n_docs), 1.0), 6).alias("score"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    return weighted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def pmi(bigrams: DataFrame, unigrams: DataFrame, total: int, least_pair: int, least_word: int) -> DataFrame:
    """(a, b, n, pmi): N c(ab) / (c(a) c(b)) of pairs over both thresholds."""
    often = unigrams.where(F.col("n") > least_word)
    left, right = often.select(F.col("term").alias("a"), F.col("n").alias("na")), often.select(F.col("term").alias("b"), F.col("n").alias("nb"))
    return bigrams.where(F.col("n") > least_pair).join(left, "a").join(right, "b").select("a", "b", "n", F.round(F.lit(total) * F.col("n") / (F.col("na") * F.col("nb")), 6).alias("pmi"))


def _bits(*parts: Column) -> Column:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole + p
    out = F.lit(0.0)
    for p in parts:
        out = out + F.when(p > 0, -(p / whole) * F.log2(p / whole)).otherwise(0.0)
    return out


def information_gain(toks: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, gain) in bits, of a term's presence for a 0/1 label; labels is (doc_id, y)."""
    totals = labels.agg(F.sum("y").alias("t1"), (F.count("*") - F.sum("y")).alias("t0"))
    having = toks.select("doc_id", "term").distinct().join(labels, "doc_id").groupBy("term").agg(F.sum("y").alias("a1"), (F.count("*") - F.sum("y")).alias("a0"))
    x = having.join(F.broadcast(totals))  # one row
    a1, a0, b1, b0 = F.col("a1"), F.col("a0"), F.col("t1") - F.col("a1"), F.col("t0") - F.col("a0")
    n, na = F.col("t1") + F.col("t0"), a1 + a0
    without = F.when(n > na, (n - na) / n * _bits(b1, b0)).otherwise(0.0)
    return x.select("term", F.round(_bits(F.col("t1"), F.col("t0")) - na / n * _bits(a1, a0) - without, 6).alias("gain"))


def log_odds(toks: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, score): p ln(p / q) of a term's smoothed rates under label 1 and 0; terms unseen under 1 score 0."""
    x = toks.join(labels, "doc_id").groupBy("term").agg(F.sum("y").alias("a"), (F.count("*") - F.sum("y")).alias("b"))
    size = x.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count("*").alias("v"))
    x = x.join(F.broadcast(size))  # one row
    p, q = (F.col("a") + 1) / (F.col("ta") + F.col("v")), (F.col("b") + 1) / (F.col("tb") + F.col("v"))
    return x.select("term", F.round(F.when(F.col("a") > 0, p * F.log(p / q)).otherwise(0.0), 9).alias("score"))
