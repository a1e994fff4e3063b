"""Benchmark decontamination by winnowing (operator 4), in DataFrame functions only.

Words are hashed, and of each window of `window` words the k-gram of least hash (k = window // 2) is a fingerprint, kept once with
its place however many windows it stands for: about 2 of 7 places. Texts that share `window` words share a fingerprint inside
them, so joining the fingerprints of documents with those of the benchmark finds every such span. Each hit is extended word by
word, to the left and to the right, as far as document and item agree as text; extended hits of at least `window` words
are spans, and every word in one is hit. So the result is exact, and hashes only find places.

An item of fewer words is one window; its longest word is its key, joined with all words of the documents, and the whole item must
agree there. Items of equal words are compared once and share their hits.

Benchmark tables are broadcast only after they were counted, in rows and in bytes, and found small; otherwise the joins shuffle by hash.

Null or empty texts, and texts without words, are never hit. Null item ids count for hits but aren't listed. Every row gives one row,
judged by its own text: rows of equal doc_id, or without one, are not mixed up. Texts are taken whole, however long. Further columns
are ignored, except those named in `keep`. An empty benchmark hits nothing; no documents give no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.llm.common import broadcast_if_small, materialise, table

WINDOW = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: what separates the words of a text that isn't lower-cased yet
RAW_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def words_of(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.array_remove(F.split(lowered, SEPARATORS), ""), F.array().cast("array<string>"))


def count_words(text: Column) -> Column:
    """size(words_of(text)), without making the words: separators are fewer to find."""
    at = lambda i: F.substring(text, i, 1).rlike(RAW_SEPARATOR).cast("int")
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(RAW_SEPARATOR + "+")) + 1 - at(1) - at(-1)).otherwise(0)


def _sliding(values: str, width: int, best) -> Column:
    """best() of each `width` consecutive values."""
    whole = F.slice(values, 1, F.greatest(F.size(values) - (width - 1), F.lit(0)))
    return F.transform(whole, lambda x, i: best(x, *(F.get(values, i + j) for j in range(1, width))))


def _sliding_least(df: DataFrame, values: str, width: int, into: str) -> DataFrame:
    """Adds the least of each `width` consecutive values: arrays are zipped with themselves, shifted by 1, 2, 4, ..., which is cheaper than
    to look up each value `width` times. Every step is a column, so that none is computed twice."""
    now, reach, names = values, 1, []
    while reach < width:
        step = min(reach, width - reach)
        name, n = f"_least{reach}", F.greatest(F.size(now) - step, F.lit(0))
        df = df.withColumn(name, F.zip_with(F.slice(now, 1, n), F.slice(now, step + 1, n), lambda x, y: F.least(x, y)))
        names.append(name)
        now, reach = name, reach + step
    return df.withColumn(into, F.col(now)).drop(*names)


def fingerprinted(df: DataFrame, window: int) -> DataFrame:
    """Adds words, hashes, and prints: (p, key) of the k-grams that are the least of some window."""
    k = window // 2
    grams = window - k + 1
    df = df.withColumn("words", words_of(F.col("text"))).drop("text")
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("grams", _sliding("hashes", k, lambda *x: F.xxhash64(*x)))
    df = _sliding_least(df, "grams", grams, "least")

    def print_at(x, i):  # a k-gram is kept if it is the least of one of the windows it is in
        is_least = x == F.get("least", i)
        for j in range(1, grams):
            is_least = is_least | (x == F.get("least", i - j))
        return F.when(is_least, F.struct(i.alias("p"), x.alias("key")))

    kept = F.filter(F.transform("grams", print_at), lambda x: x.isNotNull())
    return df.withColumn("prints", F.when(F.size("least") > 0, kept).otherwise(F.array().cast("array<struct<p:int,key:bigint>>"))).drop("grams", "least")


def benchmark_items(items: DataFrame) -> DataFrame:
    """(item, text, items): each distinct sequence of words once, joined by spaces, with the sorted item ids that have it."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    return items.groupBy(F.array_join("w", " ").alias("text")).agg(F.array_sort(F.collect_set("item_id")).alias("items")).select(F.sha2("text", 256).alias("item"), "text", "items")


def benchmark_prints(items: DataFrame, window: int) -> DataFrame:
    """(kind, key, item, at): kind 0 a fingerprint at word `at` of the item, kind 1 the hash of a short item's longest word."""
    items = fingerprinted(items.select("item", "text"), window)
    # the outer form of explode keeps the optimiser from inferring a filter on the array, which would be computed many times
    long = items.select(F.lit(0).alias("kind"), "item", F.explode_outer("prints").alias("x")).where("x is not null").select("kind", "x.key", "item", F.col("x.p").alias("at"))
    longest = F.array_max(F.transform("words", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), F.xxhash64(w).alias("h"))))
    short = items.where(F.size("words") < window).select(F.lit(1).alias("kind"), longest["h"].alias("key"), "item", (-longest["i"]).alias("at"))
    return long.union(short)


def _agreeing(mine: Column, theirs: Column) -> Column:
    """How many of the first elements of two arrays of equal size are equal."""
    differs = F.array_position(F.zip_with(mine, theirs, lambda a, b: a == b), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(mine)).cast("int")


def extended(hits: DataFrame, window: int) -> DataFrame:
    """Adds start and length: the words around (p, at) in which words and item_words agree; those too short for a window go."""
    short = F.col("kind") == 1
    back = F.least("p", "at")
    ahead = F.least(F.size("words") - F.col("p"), F.size("item_words") - F.col("at"))
    before = lambda a, at: F.reverse(F.slice(a, F.col(at) - back + 1, back))
    left = _agreeing(before("words", "p"), before("item_words", "at"))
    right = _agreeing(F.slice("words", F.col("p") + 1, ahead), F.slice("item_words", F.col("at") + 1, ahead))
    hits = hits.withColumn("left", left).withColumn("length", F.col("left") + right).withColumn("start", F.col("p") - F.col("left"))
    return hits.where(F.when(short, F.col("length") == F.size("item_words")).otherwise(F.col("length") >= window)).drop("left")


KEY = ("doc_id", "mark", "n")


def _marked(docs: DataFrame) -> DataFrame:
    """Adds what tells rows apart: rows of the same id and text have the same hits."""
    return docs.withColumn("mark", F.xxhash64("text")).withColumn("n", F.octet_length("text"))


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, n, start, length, item, items): the longest spans of documents that are in an item, each once per item."""
    items = materialise(benchmark_items(items), "items")
    prints = materialise(benchmark_prints(items, window), "prints")
    n_prints, n_short = prints.count(), prints.where("kind = 1").limit(1).count()
    n_items, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text") + F.size("items") * 16), F.lit(0))).first()
    small = n_prints <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES

    docs = fingerprinted(_marked(docs.select("doc_id", "text")), window)
    all_ = F.transform("prints", lambda x: F.struct(F.lit(0).alias("kind"), x["p"].alias("p"), x["key"].alias("key")))
    if n_short:
        all_ = F.concat(all_, F.transform("hashes", lambda h, i: F.struct(F.lit(1).alias("kind"), i.alias("p"), h.alias("key"))))
    texts = items.select("item", F.split("text", " ").alias("item_words"), "items")
    if small:
        # one stage of generated code: words are carried by reference and compared at hits only
        found = docs.select(*KEY, "words", F.explode_outer(all_).alias("x")).select(*KEY, "words", "x.kind", "x.p", "x.key")
        found = found.join(F.broadcast(prints), ["kind", "key"]).join(broadcast_if_small(texts, n_items, BROADCAST_ROWS), "item")
    else:
        found = docs.select("doc_id", "mark", F.explode_outer(all_).alias("x")).select("doc_id", "mark", "x.kind", "x.p", "x.key")
        found = found.join(prints, ["kind", "key"]).join(texts, "item").withColumnsRenamed({"doc_id": "d", "mark": "m"})
        found = docs.select(*KEY, "words").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("mark").eqNullSafe(F.col("m")))
    return extended(found, window).select(*KEY, "start", "length", "item", "items").distinct()


def covered(spans: Column) -> Column:
    """How many integers the half-open ranges of an array of (start, stop) cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["to"]))).alias("n"), F.greatest(a["to"], s["stop"]).alias("to"))
    return F.aggregate(F.array_sort(spans), zero, step)["n"]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, then n_words, n_hit, n_items, items_sha256, contaminated and longest_hit, per row of docs; longest_hit
    is the words of the longest span found."""
    hits = find_hits(docs, items, window)
    spans = F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop")))
    hit = hits.groupBy(*KEY).agg(covered(spans).cast("long").alias("n_hit"), F.max("length").alias("longest_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hit = materialise(hit.withColumnRenamed("doc_id", "d").select("*", F.col("d").isNull().alias("no_id")), "hit")
    size = hit.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    few = broadcast_if_small(hit, sum(size), BROADCAST_ROWS)
    kept = [F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)]
    out = _marked(docs.select(*kept, "doc_id", "text")).select(*(f"keep_{i}" for i in range(len(keep))), F.coalesce(count_words(F.col("text")), F.lit(0)).cast("long").alias("n_words"), F.coalesce("doc_id", F.lit(0)).alias("key"), F.col("doc_id").isNull().alias("none"), F.col("mark").alias("key_mark"), F.col("n").alias("key_n"))
    same = (F.col("key") == F.coalesce("d", F.lit(0))) & (F.col("none") == F.col("no_id")) & (F.col("key_mark") == F.col("mark")) & (F.col("key_n") == F.col("n"))
    out = out.join(few, same, "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("longest_hit", F.lit(0)).alias("longest_hit"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_hit")


OP4_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
bw as (
  select distinct item_id, 10 as n, list_aggregate(w[i : i + 9], 'string_agg', ' ') as t from (select item_id, w, unnest(range(1, len(w) - 8)) as i from b where len(w) >= 10)
  union select item_id, len(w) as n, list_aggregate(w, 'string_agg', ' ') as t from b where len(w) between 1 and 9),
ns as (select distinct n from bw),
dw as (select doc_id, i, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as t from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, ns where len(w) >= n)),
hit as (select distinct doc_id, i, n, t from dw where t in (select t from bw)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, n, unnest(range(i, i + n)) as p from hit) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct doc_id, cast(item_id as varchar) as item_id from hit join bw using (t)) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join named using (doc_id)
"""
