"""Joins that follow references, spans, lexicons and blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def by_example(df: DataFrame, example: dict, select: list[str] | None = None) -> DataFrame:
    """Rows that have the example's values; a list means any of its values, a tuple (low, high) a closed range, None null."""
    for name, value in example.items():
        c = F.col(name)
        df = df.where(c.isNull() if value is None else c.isin(value) if isinstance(value, list) else c.between(*value) if isinstance(value, tuple) else c == value)
    return df.select(*select) if select else df


def traverse(roots: DataFrame, steps: list[tuple[DataFrame, str, str]], depth: int) -> DataFrame:
    """Follows references: each step (table, its key, the key's name in the last) joins the next table, up to a depth."""
    for table, key, ref in steps[:depth]:
        roots = roots.join(table, F.col(ref) == F.col(key))
    return roots


def inverse(parents: DataFrame, key: str, children: DataFrame, ref: str, collect: str, name: str) -> DataFrame:
    """Each parent with the sorted values of the children that point to it; parents without any get an empty array."""
    held = children.groupBy(F.col(ref).alias("_k")).agg(F.array_sort(F.collect_list(collect)).alias(name))
    return parents.join(held, F.col(key) == F.col("_k"), "left").drop("_k").withColumn(name, F.coalesce(F.col(name), F.array().cast(held.schema[name].dataType)))


def apply_delta(table: DataFrame, delta: DataFrame, key: str, columns: list[str], deleted: str) -> DataFrame:
    """Upserts: delta's non-null fields win, new keys are added, keys with a true `deleted` go."""
    new = delta.select(F.col(key), F.col(deleted), *(F.col(c).alias(f"_{c}") for c in columns))
    both = table.join(new, key, "full_outer").where(~F.coalesce(F.col(deleted), F.lit(False)))
    return both.select(key, *(F.coalesce(f"_{c}", c).alias(c) for c in columns))


def pairs_within(rows: DataFrame, by: str, item: str) -> DataFrame:
    """(by, a, b): unordered pairs of distinct items that share a block."""
    some = rows.select(by, item).distinct()
    return some.select(by, F.col(item).alias("a")).join(some.select(by, F.col(item).alias("b")), by).where("a < b")


def canopy_pairs(rows: DataFrame, item: str, keys: Column) -> DataFrame:
    """(a, b) with a < b of items that share any canopy key, each pair once: in the block of the least key that both have, so that no
    pairs are shuffled."""
    held = rows.select(F.col(item), F.explode(keys).alias("key")).where("key is not null").groupBy(item).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    blocks = held.select(F.col(item).alias("a"), F.col("keys").alias("ka"), F.explode("keys").alias("key"))
    pairs = blocks.join(blocks.toDF("b", "kb", "key"), "key").where("a < b")
    only = (F.size("ka") == 1) | (F.size("kb") == 1)
    return pairs.where(only | (F.array_min(F.array_intersect("ka", "kb")) == F.col("key"))).select("a", "b")


def match_phrases(toks: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """(doc_id, pos, length, phrase): occurrences in token rows of phrases (phrase, words separated by one space)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    grams = F.array(*(F.struct(F.lit(n).alias("length"), F.concat_ws(" ", "term", *(F.lead("term", k).over(w) for k in range(1, n))).alias("phrase"), (F.lead("term", n - 1).over(w).isNotNull() if n > 1 else F.lit(True)).alias("whole")) for n in range(1, longest + 1)))
    rows = toks.select("doc_id", "pos", grams.alias("grams")).select("doc_id", "pos", F.explode("grams").alias("g")).where("g.whole").select("doc_id", "pos", "g.length", "g.phrase")
    return rows.join(phrases.select("phrase").distinct(), "phrase").select("doc_id", "pos", "length", "phrase")


def spans_at(spans: DataFrame, others: DataFrame, by: str, how: str) -> DataFrame:
    """Pairs of spans (id, start, end) of a document: containing, overlapping, starting_at, ending_at or following the other."""
    a = spans.select(by, *(F.col(c).alias(f"a_{c}") for c in ("id", "start", "end")))
    b = others.select(by, *(F.col(c).alias(f"b_{c}") for c in ("id", "start", "end")))
    test = {"containing": "a_start <= b_start and b_end <= a_end", "overlapping": "a_start < b_end and b_start < a_end", "starting_at": "a_start = b_start", "ending_at": "a_end = b_end", "following": "a_start >= b_end"}[how]
    return a.join(b, by).where(test)


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Adds to each left row the right value of the same key last before or at its time: one union and one window, no range join."""
    both = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_l", F.lit(1)).unionByName(right.select(by, at, F.col(value).alias("_v")).withColumn("_l", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_l").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_l = 1").drop("_v", "_l")


def any_of(*lexicons: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [x.select("phrase") for x in lexicons]).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest reachable node of undirected edges (a, b).

    Alternating large and small stars until no edge moves; each step is checkpointed so that plans stay short."""
    edges = cut(edges.select("a", "b").where("a is not null and b is not null").distinct())
    falling = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars, moved = cut(falling(edges)), True
    while moved:
        both = stars.union(stars.select("b", "a"))
        near = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = cut(falling(both.join(near, "a").where("b > a").select("b", "m").toDF("a", "b")))
        down = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        new = cut(falling(down.select("b", "m").union(down.select("a", "m")).toDF("a", "b")))
        moved = new.exceptAll(stars).limit(1).count() or stars.exceptAll(new).limit(1).count()
        stars = new
    nodes = edges.select("a").union(edges.select("b")).distinct().toDF("node")
    return cut(nodes.join(stars, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component")))


def shared_components(rows: DataFrame) -> DataFrame:
    """(node, component): smallest reachable id of ids linked by two or more shared items, from rows (id, item); ids without links have none.

    Ids that have two items are linked to the least that has both, so no ids are paired. Neighbouring items of each id give parts first;
    of all its pairs of items, a part then has each once."""
    rows = rows.where("id is not null and item is not null")
    sets = cut(rows.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items")).where("size(items) > 1"))

    def stars(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("x", "y").agg(F.min("c").alias("m"), F.max("c").alias("o")).where("m < o")
        return pairs.join(least, ["x", "y"]).where("c > m").select(F.col("c").alias("a"), F.col("m").alias("b")).distinct()

    each = lambda df: df.select("c", "items", F.posexplode("items").alias("i", "x")).where("i + 1 < size(items)")
    first = components(stars(each(sets.withColumnRenamed("id", "c")).select("c", "x", F.get("items", F.col("i") + 1).alias("y"))))
    named = sets.join(first, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("c"), F.col("node").isNotNull().alias("linked"), "items")
    every = each(named.select("c", "items")).select("c", "x", F.explode(F.slice("items", F.col("i") + 2, F.size("items") - F.col("i") - 1)).alias("y"))
    joined = components(stars(cut(every.distinct())))
    out = named.select("id", "c", "linked").join(joined, F.col("c") == F.col("node"), "left").where("linked or component is not null")
    return out.select(F.col("id").alias("node"), F.coalesce("component", "c").alias("component"))


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in spark.checkpoint.dir; where that is unset, in a folder of its own for a master on one machine, else an error."""
    sc = df.sparkSession.sparkContext
    if not sc.getConf().get("spark.checkpoint.dir") and not sc._jsc.sc().getCheckpointDir().isDefined():
        import tempfile

        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="textloom-"))
    return df.checkpoint()


def pairs_by_key(left: DataFrame, right: DataFrame, on: str, l: str, r: str, block: int = 2048, task_rows: int = 4_000_000) -> DataFrame:
    """The inner join on a key whose groups may be large on both sides: rows of a key are dealt by columns l and r into blocks of about
    `block` rows a side, and pairs of blocks to tasks that make about `task_rows` rows each. A row is sent once for each block of the other
    side, so what is shuffled is the pairs divided by half of `block`, or less."""
    n = lambda df, c: df.groupBy(on).agg(F.count("*").alias(c))
    sizes = cut(n(left, "_l").join(n(right, "_r"), on))
    pairs = sizes.agg(F.sum(F.col("_l") * F.col("_r"))).first()[0] or 0
    tasks = min(max(-(-pairs // task_rows), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 50_000)
    blocks = sizes.select(on, F.ceil(F.col("_l") / block).alias("_nl"), F.ceil(F.col("_r") / block).alias("_nr"))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    x = left.join(blocks, on).select(*left.columns, F.pmod(F.xxhash64(l), "_nl").alias("_bl"), each("_nr").alias("_br"))
    y = right.join(blocks, on).select(*right.columns, F.pmod(F.xxhash64(r), "_nr").alias("_br"), each("_nl").alias("_bl"))
    by = [on, "_bl", "_br"]
    return x.repartition(tasks, *by).join(y.repartition(tasks, *by), by).drop("_bl", "_br")


def prune(cells: DataFrame, least_row: int, least_col: int) -> DataFrame:
    """Cells (r, c, v) in rows and columns of more than so many cells, in the largest connected part of those; of equals the one
    with the smallest row."""
    rows, cols = cells.groupBy("r").agg(F.count("*").alias("nr")), cells.groupBy("c").agg(F.count("*").alias("nc"))
    kept = cells.join(rows.where(F.col("nr") > least_row), "r").join(cols.where(F.col("nc") > least_col), "c").select("r", "c", "v")
    kept = cut(kept)
    part = components(kept.select((F.col("r") * 2).alias("a"), (F.col("c") * 2 + 1).alias("b")))
    sized = kept.join(part, F.col("r") * 2 == F.col("node")).select("r", "c", "v", "component")
    best = sized.groupBy("component").agg(F.count_distinct("r").alias("n"), F.min("r").alias("least")).orderBy(F.desc("n"), "least").limit(1)
    return sized.join(F.broadcast(best), "component").select("r", "c", "v")


def sections_at(sections: DataFrame, spans: DataFrame, by: str = "doc_id") -> DataFrame:
    """Spans (by, start, end) with the section (by, section, first, last) that holds them whole; those that cross a border have none."""
    held = spans.join(sections.select(by, "section", "first", "last"), by).where("first <= start and end <= last")
    return held.drop("first", "last")


def split_by(rows: DataFrame, test: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass a test, and the others; a test that is null doesn't pass."""
    ok = F.coalesce(test, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def of_kind(rows: DataFrame, kinds: list[str], column: str = "factor") -> DataFrame:
    """Rows of some classes or families, as factors of several templates in one table."""
    return rows.where(F.col(column).isin(*kinds))


def subsequence(rows: DataFrame, test: Column, by: str, order: str, value: str) -> DataFrame:
    """(by, values): the values of rows that pass a test, in their order."""
    return rows.where(test).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def combined(parts: list[DataFrame], key: str) -> DataFrame:
    """(key, score): the sum of the scores that several models (key, score) give; a model that says nothing of a key gives it zero."""
    return reduce(DataFrame.unionByName, [p.select(key, F.col("score").cast("double").alias("score")) for p in parts]).groupBy(key).agg(F.sum("score").alias("score"))


def top_counts(rows: DataFrame, by: str, item: str, n: int) -> DataFrame:
    """(by, counts): the n most frequent items, as an array of (item, n) by falling count, ties by item."""
    c = rows.groupBy(by, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), item)
    c = c.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return c.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(item).alias("item"), "n"))), lambda x: F.struct(x["item"].alias("item"), x["n"].alias("n"))).alias("counts"))
