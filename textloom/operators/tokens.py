"""Tokens as rows (doc_id, pos, term), and what windows over them give."""

from __future__ import annotations

import re
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from textloom.functions.strings import segment


def tokens(docs: DataFrame, kind: str = "ascii_alpha", lower: bool = True, key: str = "doc_id") -> DataFrame:
    text = F.lower("text") if lower else F.col("text")
    # the outer form keeps the optimiser from inferring a filter on the array, which would cut each text twice
    return docs.select(key, F.posexplode_outer(segment(text, kind)).alias("pos", "term")).where("term is not null")


def ngrams(docs: DataFrame, n: int, joint: str = " ") -> DataFrame:
    """(doc_id, gram) rows of sliding windows, from arrays: no shuffle."""
    parts = word_windows(docs, n)
    return parts.select("doc_id", F.concat_ws(joint, *(F.col(f"w{i}") for i in range(n))).alias("gram"))


def word_windows(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, w0 .. w(n-1)): the words of each window of n, by shifted arrays side by side."""
    words = docs.select("doc_id", segment(F.lower("text")).alias("w"))
    shifted = F.arrays_zip(*(F.slice("w", i + 1, F.greatest(F.size("w") - (n - 1), F.lit(0))).alias(f"w{i}") for i in range(n)))
    return words.select("doc_id", F.explode_outer(shifted).alias("g")).where("g is not null").select("doc_id", "g.*")


def _per_word(docs: DataFrame, each) -> DataFrame:
    """(doc_id, *fields) of the struct that each(words, word, place) gives for every word of a document: within one array, so that no
    token is shuffled."""
    words = docs.select("doc_id", segment(F.lower("text")).alias("w"))
    return words.select("doc_id", F.explode_outer(F.transform("w", lambda t, i: each(F.col("w"), t, i))).alias("x")).where("x is not null").select("doc_id", "x.*")


def neighbours_in(docs: DataFrame, offsets: tuple[int, ...]) -> DataFrame:
    """As neighbours() for the words of documents (doc_id, text)."""

    def each(w, t, i):
        at = [F.coalesce(F.concat(F.get(w, i + k), F.lit(f"@{k}")), F.lit("<START>" if k < 0 else "<END>")).alias(f"at_{'m' if k < 0 else 'p'}{abs(k)}") for k in offsets]
        return F.struct(i.alias("pos"), t.alias("term"), *at)

    return _per_word(docs, each)


def conjunctions_in(docs: DataFrame, left: int, right: int) -> DataFrame:
    """As conjunctions() for the words of documents (doc_id, text)."""

    def each(w, t, i):
        a, b = F.get(w, i + left), F.get(w, i + right)
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(i.alias("pos"), F.concat(a, F.lit(f"@{left}_&_"), b, F.lit(f"@{right}")).alias("feature")))

    return _per_word(docs, each)


def conjunction_counts(docs: DataFrame, left: int, right: int) -> DataFrame:
    """(feature, n): how often each feature of conjunctions_in() occurs. Each task sums its counts in bounded tables, and their rows are
    dealt out as they are, so no task holds all the features of its texts."""
    words = re.compile("[A-Za-z]+").findall
    before, ahead = max(-left, -right, 0), max(left, right, 0)

    def pairs(t):
        w = words(t)
        stop = max(len(w) - ahead, before)
        return zip(w[before + left : stop + left], w[before + right : stop + right])

    rows = counted(docs.select(F.lower("text").alias("text")), pairs, "feature", lambda p: f"{p[0]}@{left}_&_{p[1]}@{right}")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "feature").groupBy("feature").agg(F.sum("uses").alias("n"))


def bags_in(docs: DataFrame, before: int, after: int) -> DataFrame:
    """As window_bag() for the words of documents (doc_id, text)."""

    def each(w, t, i):
        first = F.greatest(i - before, F.lit(0))
        return F.struct(i.alias("pos"), t.alias("term"), F.slice(w, first + 1, i - first).alias("prev_bag"), F.slice(w, i + 2, F.lit(after)).alias("next_bag"))

    return _per_word(docs, each)


def phrases_in(docs: DataFrame, phrases: DataFrame, longest: int, broadcast_rows: int = 100_000) -> DataFrame:
    """(doc_id, pos, length, phrase): occurrences in the words of documents of phrases, their words separated by one space."""

    phrases = phrases.select("phrase").distinct()
    of = F.least(F.size(F.split("phrase", " ", -1)), F.lit(longest))
    lengths = sorted(r.n for r in phrases.select(of.alias("n")).distinct().where("n is not null").collect())  # at most `longest` rows

    def each(w, t, i):
        return F.filter(F.array(*(F.when(i + n <= F.size(w), F.struct(i.alias("pos"), F.lit(n).alias("length"), F.array_join(F.slice(w, i + 1, n), " ").alias("phrase"))) for n in lengths or [1])), lambda x: x.isNotNull())

    words = docs.select("doc_id", segment(F.lower("text")).alias("w"))
    found = words.select("doc_id", F.explode_outer(F.flatten(F.transform("w", lambda t, i: each(F.col("w"), t, i)))).alias("x")).where("x is not null").select("doc_id", "x.*")
    return found.join(F.broadcast(phrases) if phrases.count() <= broadcast_rows else phrases, "phrase", "left_semi").select("doc_id", "pos", "length", "phrase")


#: different items that a task counts before it passes the counts on
MOST_COUNTED = 300_000


def counted(docs: DataFrame, items, name: str, form=str, text: str = "text") -> DataFrame:
    """(name, uses): counts of what items(text) gives for each text, shown by form(item). A task counts up to MOST_COUNTED different items
    at once, so an item comes in several rows."""
    most = MOST_COUNTED

    def run(batches):
        def out():
            for at in range(0, len(n), 50_000):
                part = list(islice(n.items(), at, at + 50_000))
                yield pa.RecordBatch.from_arrays([pa.array([form(k) for k, _ in part], pa.string()), pa.array([c for _, c in part], pa.int64())], names=[name, "uses"])

        n: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                n.update(items(t.as_py() or ""))
                if len(n) > most:
                    yield from out()
                    n.clear()
        yield from out()

    return docs.select(text).mapInArrow(run, f"{name} string, uses long")


def neighbours(toks: DataFrame, offsets: tuple[int, ...], by: str = "doc_id", order: str = "pos", value: str = "term") -> DataFrame:
    """Adds a column per offset: the value there with `@offset`, or a mark beyond either end."""
    w = Window.partitionBy(by).orderBy(order)
    for k in offsets:
        there = F.lag(value, abs(k)).over(w) if k < 0 else F.lead(value, k).over(w)
        toks = toks.withColumn(f"at_{'m' if k < 0 else 'p'}{abs(k)}", F.coalesce(F.concat(there, F.lit(f"@{k}")), F.lit("<START>" if k < 0 else "<END>")))
    return toks


def conjunctions(toks: DataFrame, left: int, right: int, by: str = "doc_id") -> DataFrame:
    """(doc_id, pos, feature): products of the values at two offsets."""
    w = Window.partitionBy(by).orderBy("pos")
    at = lambda k: F.lag("term", -k).over(w) if k < 0 else F.lead("term", k).over(w) if k else F.col("term")
    return toks.select(by, "pos", F.concat_ws("_&_", F.concat(at(left), F.lit(f"@{left}")), F.concat(at(right), F.lit(f"@{right}"))).alias("feature"), at(left).alias("l"), at(right).alias("r")).where("l is not null and r is not null").drop("l", "r")


def window_bag(toks: DataFrame, before: int, after: int, by: str = "doc_id") -> DataFrame:
    """Adds prev_bag and next_bag: the values up to so far before and after, in order."""
    w = Window.partitionBy(by).orderBy("pos")
    toks = toks.withColumn("prev_bag", F.collect_list("term").over(w.rowsBetween(-before, -1)))
    return toks.withColumn("next_bag", F.collect_list("term").over(w.rowsBetween(1, after)))


def runs(rows: DataFrame, by: str, order: str, label: str) -> DataFrame:
    """(by, label, first, last, length): maximal runs of equal labels."""
    w = Window.partitionBy(by).orderBy(order)
    new = F.coalesce((~F.lag(label).over(w).eqNullSafe(F.col(label))).cast("int"), F.lit(1))
    marked = rows.withColumn("_n", F.when(F.row_number().over(w) == 1, 1).otherwise(new))
    marked = marked.withColumn("_run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "_run", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_run")


def sessions(rows: DataFrame, by: str, at: str, gap_seconds: int, tie: str) -> DataFrame:
    """(by, session, start, stop, n): rows in order, split where the time since the last is over the gap."""
    w = Window.partitionBy(by).orderBy(at, tie)
    new = F.coalesce((F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) > gap_seconds * 1_000_000).cast("int"), F.lit(0))
    marked = rows.withColumn("_new", new)
    marked = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "session").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count("*").alias("n"))


def decode_bio(rows: DataFrame, by: str = "sent_id", order: str = "pos", tag: str = "tag") -> DataFrame:
    """(by, label, first, last): spans of BIO tags; an I- that continues nothing begins a span."""
    w = Window.partitionBy(by).orderBy(order)
    kind, label = F.substring(tag, 1, 1), F.expr(f"substring({tag}, 3)")
    rows = rows.withColumn("_k", kind).withColumn("_l", label)
    before_k, before_l = F.lag("_k").over(w), F.lag("_l").over(w)
    begins = (F.col("_k") == "B") | ((F.col("_k") == "I") & (before_k.isNull() | (before_k == "O") | (before_l != F.col("_l"))))
    rows = rows.withColumn("_b", begins.cast("int")).withColumn("_s", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_k <> 'O'").groupBy(by, "_s").agg(F.first("_l").alias("label"), F.min(order).alias("first"), F.max(order).alias("last")).drop("_s")


def decode_bilou(rows: DataFrame, by: str = "sent_id", order: str = "pos", tag: str = "tag") -> DataFrame:
    """As decode_bio() for BILOU tags: U and B begin, a change of label begins too."""
    plain = rows.withColumn(tag, F.when(F.col(tag).rlike("^[UB]-"), F.concat(F.lit("B"), F.expr(f"substring({tag}, 2)"))).when(F.col(tag).rlike("^[IL]-"), F.concat(F.lit("I"), F.expr(f"substring({tag}, 2)"))).otherwise("O"))
    return decode_bio(plain, by, order, tag)


def iob_to_bilou(rows: DataFrame, by: str = "sent_id", order: str = "pos", tag: str = "tag") -> DataFrame:
    """Replaces IOB tags, which write B only where a span touches another of its label, by BILOU."""
    w = Window.partitionBy(by).orderBy(order)
    label = lambda c: F.expr(f"substring({c}, 3)")
    rows = rows.withColumn("_p", F.lag(tag).over(w)).withColumn("_x", F.lead(tag).over(w))
    inside = lambda c: F.coalesce(F.col(c) != "O", F.lit(False))
    begins = ~inside("_p") | (label("_p") != label(tag)) | F.col(tag).startswith("B")
    ends = ~inside("_x") | (label("_x") != label(tag)) | F.col("_x").startswith("B")
    kind = F.when(begins & ends, "U").when(begins, "B").when(ends, "L").otherwise("I")
    return rows.withColumn(tag, F.when(F.col(tag) == "O", "O").otherwise(F.concat(kind, F.lit("-"), label(tag)))).drop("_p", "_x")


def at_span(start: Column, end: Column, other_start: Column, other_end: Column) -> dict[str, Column]:
    """Predicates on two half-open spans."""
    return {
        "overlaps": (start < other_end) & (other_start < end),
        "contains": (start <= other_start) & (other_end <= end),
        "starts_at": start == other_start,
        "ends_at": end == other_end,
        "follows": start >= other_end,
    }


def _flat(x: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, values, known) of arrays of integers: known is false for null arrays, which have no values."""
    known = x.is_valid().to_numpy(zero_copy_only=False)
    return np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64), x.flatten().to_numpy(zero_copy_only=False).astype(np.int64), known


def _lists(values: pa.Array, sizes: np.ndarray, known: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, mask=pa.array(~known))


@F.arrow_udf(ArrayType(LongType()))
def packed_offsets(starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Token offsets in one integer each: the distance from the token before in the upper 16 bits, the length in the lower. A distance
    or length of 65,536 or more can't be packed; the whole array is null then."""
    (n, s, known), (m, e, also) = _flat(starts), _flat(ends)
    if (n[known & also] != m[known & also]).any():
        raise ValueError("starts and ends of different lengths")
    known = known & also
    if (n != m).any():  # one of the two arrays is null
        s, e = s[np.repeat(known, n)], e[np.repeat(known, m)]
        n = np.where(known, n, 0)
    first = (np.cumsum(n) - n)[n > 0]
    before = np.concatenate([[0], e[:-1]])[: len(e)]
    before[first] = 0
    gaps, sizes = s - before, e - s
    fits = (gaps >= 0) & (gaps < 1 << 16) & (sizes >= 0) & (sizes < 1 << 16)
    whole = np.bincount(np.repeat(np.arange(len(n)), n)[~fits], minlength=len(n)) == 0
    held = np.repeat(whole, n)
    return _lists(pa.array(((gaps << 16) + sizes)[held]), np.where(whole, n, 0), known & whole)


@F.arrow_udf(ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))
def unpacked_offsets(packed: pa.Array) -> pa.Array:
    """An array of (start, end) from packed_offsets(): running sums over whole Arrow batches."""
    n, p, known = _flat(packed)
    sizes = p & 65535
    ends = np.cumsum((p >> 16) + sizes)
    first = np.cumsum(n) - n
    ends = ends - np.repeat(np.concatenate([[0], ends])[first], n)
    return _lists(pa.StructArray.from_arrays([pa.array(ends - sizes), pa.array(ends)], ["start", "end"]), n, known)
