"""Near-duplicates by b-bit MinHash signatures and a multi-index Hamming join (operator 5).

Each distinct shingle set gets a signature of 40 minima, 16 bits kept of each. The signature is split into 8 chunks of 5
symbols. By pigeonhole, two signatures that differ in at most 15 symbols have a chunk with at most one error; enumerating that
error (each symbol of a chunk left out in turn) gives 40 keys, and all pairs within that distance share one of them. A pair of
similarity 0.85 misses all eight chunks with probability 5e-7, one of 0.80 with 2.3e-5. Every pair that shares a key is either
connected already, or confirmed on whole sets, of which each shingle has 128 bits from two hashes of its words.

No pairs are written out. The sets that share keys form groups, through the smallest id of each key's bucket:
* a group of at most UNIT sets is resolved at once, in one place;
* in a larger one the set nearest to the group's most common symbols is compared with all others, a part of UNIT of them at a
  time. Most of a large group of copies hangs together by that. The sets left over are compared with those that share a key with
  them, bucket by bucket (a pair in the first bucket it shares only) or throughout the group, whichever takes fewer rows, and block by
  block.
So neither a task's memory nor its time depends on the size of a group. Links are joined by connected components.

Rows: null and empty texts, and texts without words, have 0 shingles and link with nothing. Rows without doc_id link with nothing,
have no component and are kept. Rows with equal doc_id are one document with all their texts; each row gives one row. Texts of any
length are taken whole. Further columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm.common import broadcast_if_small, hash_spans, joined, materialise, mix, slices, table
from textloom.llm.graph import components

CHUNKS, WIDTH, BITS = 8, 5, 16
SYMBOLS = CHUNKS * WIDTH
WORDS = 5
PERCENT = 85
#: So many sets, and about so many shingles, are compared with each other in one place.
UNIT, UNIT_SHINGLES = 64, 400_000
#: What is left of a large group is compared in blocks of so many sets.
BLOCK = 256
PER_SET = SYMBOLS
BROADCAST_ROWS = 1_000_000

_rng = np.random.default_rng(20240229)
_FACTORS = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_KEYS = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
#: odd factors of a shingle's words, for each of the two hashes
_PLACES = _rng.integers(1, 1 << 63, (2, WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = (0x2545F4914F6CDD1D, 0x71D67FFFEDA60001)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(col: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Two hashes of each word of all texts, A-Z lower-cased, and where each text's words begin (one more at the end)."""
    data, ends = joined(col)
    if not len(data):
        return [np.empty(0, np.uint64)] * 2, np.zeros(len(col) + 1, np.int64)
    data = _LOWER[data]
    first = ~_SPACE[data]
    inner = first[1:] & first[:-1]
    starts_at_text = np.zeros(len(data) + 1, bool)
    starts_at_text[ends] = True
    begin = first.copy()
    begin[1:] &= ~inner | starts_at_text[1:-1]
    last = first.copy()
    last[:-1] &= ~inner | starts_at_text[1:-1]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(last) + 1
    return hash_spans(data, starts, stops, _SEEDS), np.searchsorted(starts, ends)


def shingle_sets(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each distinct shingle of each text, sorted, one text after another, and where each text's begin. A shingle's hash is
    a sum of its words' hashes, which are not sums of anything, times a factor for each place, mixed."""
    words = WORDS
    hashes, at = word_hashes(col)
    n = len(col)
    counts = np.diff(at)
    doc = np.repeat(np.arange(n), counts)
    many = len(doc) - words + 1
    whole = doc[:many] == doc[words - 1 :] if many > 0 else np.empty(0, bool)
    short = np.flatnonzero((counts > 0) & (counts < words))
    owner = np.concatenate([doc[: max(many, 0)][whole], short])
    values = []
    for h, places in zip(hashes, _PLACES, strict=True):
        value = np.zeros(max(many, 0), np.uint64)
        for k in range(words if many > 0 else 0):
            value += h[k : k + many] * places[k]
        less = counts[short].astype(np.uint64)
        for k in range(words - 1):
            has = counts[short] > k
            less[has] += h[at[short[has]] + k] * places[k]
        values.append(mix(np.concatenate([value[whole], less])))
    order = np.lexsort((values[0], owner))
    a, b = values[0][order], values[1][order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # hardly ever
        order = np.lexsort((values[1], values[0], owner))
        a, b = values[0][order], values[1][order]
    owner = owner[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (owner[1:] != owner[:-1])
    a, b, owner = a[keep], b[keep], owner[keep]
    return a, b, np.searchsorted(owner, np.arange(n + 1))


def signatures(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, 40) symbols; a text without shingles has zeros."""
    n = len(at) - 1
    out = np.zeros((n, SYMBOLS), np.uint16)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        starts = at[:-1][full]
        for k in range(SYMBOLS):
            least = np.minimum.reduceat((sets ^ _FLIPS[k]) * _FACTORS[k], starts)
            out[full, k] = mix(least) >> np.uint64(64 - BITS)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, 40) keys: each chunk with each of its symbols left out."""
    wide = sig.astype(np.uint64)
    keys = np.empty((len(sig), SYMBOLS), np.uint64)
    for c in range(CHUNKS):
        for p in range(WIDTH):
            key = np.zeros(len(sig), np.uint64)
            for k in range(WIDTH):
                if k != p:
                    key = key << np.uint64(BITS) | wide[:, c * WIDTH + k]
            keys[:, c * WIDTH + p] = mix(key ^ _KEYS[c * WIDTH + p])
    return keys


def set_hashes(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(2, texts): a 128-bit hash of each whole set."""
    out = np.zeros((2, len(at) - 1), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[0, full] = mix(np.add.reduceat(mix(a + np.uint64(1)), at[:-1][full]))
        out[1, full] = mix(np.add.reduceat(mix(b + np.uint64(2)), at[:-1][full]))
    return out.view(np.int64)


def profiles(df: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig): the set's size, a 128-bit hash of the whole set, and its signature."""

    def run(batches):
        for b in slices(batches):
            one, two, at = shingle_sets(b.column("text"))
            h, sig = set_hashes(one, two, at), signatures(one, at)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(h[0]), pa.array(h[1]), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "n_shingles", "h1", "h2", "sig"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sig binary")


def bucket_keys(reps: DataFrame) -> DataFrame:
    """(key, rep): the 40 keys of each signature."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, SYMBOLS)
                keys = chunk_keys(sig)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(b.column("rep").to_numpy(), SYMBOLS))], names=["key", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, rep long")


#: What is compared in a unit: all sets; those that share a key; those whose first shared key is the unit's.
ALL, GROUP, BUCKET = 0, 1, 2


class Unit:
    """What is compared in one place: the sets of side 0 with each other in mode ALL, and with those of side 1."""

    def __init__(self, mode: int, percent: int):
        self.mode, self.percent = mode, percent
        self.held: list[tuple] = []
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def similar(self, mine, theirs: list) -> np.ndarray:
        """Which of their sets are as similar to mine as the threshold asks."""
        a, b = mine
        size = np.array([len(x) for x, _ in theirs], np.int64)
        out = np.zeros(len(theirs), bool)
        for part in np.array_split(np.arange(len(theirs)), max(1, int(size.sum()) // 1_000_000)):
            x, y = (np.concatenate([theirs[i][k] for i in part]) for k in (0, 1))
            # shingles equal in the first hash stand together, nearly always one by one
            low, high = np.searchsorted(a, x, side="left"), np.searchsorted(a, x, side="right")
            there = np.minimum(low, len(a) - 1)
            same = (low < high) & (b[there] == y)
            for i in np.flatnonzero((high - low > 1) & ~same):
                same[i] = y[i] in b[low[i] : high[i]]
            both = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(size[part])[:-1]]))
            out[part] = 100 * both >= self.percent * (size[part] + len(a) - both)
        return out

    def compare(self, x: tuple, others: list[tuple]):
        """(a, b) for each of the others that is linked with x and was not connected with it before."""
        doc, label, _, sets, _ = x
        n = len(sets[0])
        ask = [o for o in others if 100 * min(n, len(o[3][0])) >= self.percent * max(n, len(o[3][0])) and self.root(o[1]) != self.root(label)]
        if ask:
            for o, yes in zip(ask, self.similar(sets, [o[3] for o in ask]), strict=True):
                if yes and self.root(o[1]) != self.root(label):
                    self.up[self.root(o[1])] = self.root(label)
                    yield doc, o[0]

    def meet(self, others: list[tuple], key: np.uint64):
        """Links of what is held with the others; of two sets left over one way round only."""
        if self.mode != ALL:
            docs, rest, keys = np.array([o[0] for o in others]), np.array([o[2] for o in others]), np.array([o[4] for o in others])
        for x in self.held:
            ask = others
            if self.mode != ALL:
                same = keys == x[4]
                ok = same.any(axis=1) if self.mode == GROUP else keys[np.arange(len(others)), same.argmax(axis=1)] == key
                ask = [others[i] for i in np.flatnonzero(ok & ~(rest & (docs < x[0])))]
            yield from self.compare(x, ask)


def linked(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): links from rows (unit, i, j, side, mode, doc_id, label, rest, h1, h2, text) that connect what no equal labels connect."""

    def run(batches):
        now, unit = None, Unit(ALL, percent)
        for batch in slices(batches):
            one, two, at = shingle_sets(batch.column("text"))
            h = set_hashes(one, two, at)
            cols = [batch.column(c).to_pylist() for c in ("unit", "i", "j", "side", "mode", "doc_id", "label", "rest", "h1", "h2")]
            keys = chunk_keys(signatures(one, at)) if any(cols[4]) else None
            found, waiting = [], []
            for k, (u, i, j, side, mode, doc, label, rest, h1, h2) in enumerate(zip(*cols, strict=True)):
                if h[0, k] != h1 or h[1, k] != h2:
                    continue  # another text of the same id, with a place of its own
                if now != (u, i, j):
                    if waiting:
                        found += unit.meet(waiting, np.int64(now[0]).view(np.uint64))
                    now, unit, waiting = (u, i, j), Unit(mode, percent), []
                me = (doc, label, rest, (one[at[k] : at[k + 1]].copy(), two[at[k] : at[k + 1]].copy()), keys[k] if mode else None)
                if side:
                    waiting.append(me)
                else:
                    if not mode:
                        found += unit.compare(me, unit.held)
                    unit.held.append(me)
            if waiting:
                found += unit.meet(waiting, np.int64(now[0]).view(np.uint64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return rows.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "side").mapInArrow(run, "a long, b long")


def _parts(rows, n, most):
    return F.greatest(F.ceil(rows / most), F.ceil(n / UNIT_SHINGLES), F.lit(1)).cast("int")


def _part(of: str):
    return F.pmod(F.xxhash64("doc_id"), F.col(of)).cast("int")


def centres(members: DataFrame, n_groups: int) -> DataFrame:
    """(component, centre): of each group the set whose signature is nearest to the group's most common symbols."""
    symbols = members.select("component", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(SYMBOLS - 1)), lambda k: F.substring("sig", 2 * k + 1, F.lit(2)))).alias("k", "s"))
    common = symbols.groupBy("component", "k", "s").agg(F.count("*").alias("n")).groupBy("component", "k").agg(F.max(F.struct("n", "s"))["s"].alias("s"))
    common = common.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]).alias("common"))
    equal = lambda k, s: (F.substring("sig", 2 * k + 1, F.lit(2)) == s).cast("int")
    common = broadcast_if_small(materialise(common, "common"), n_groups, BROADCAST_ROWS // 10)
    near = members.join(common, "component").select("component", "doc_id", F.aggregate(F.transform("common", lambda s, k: equal(k, s)), F.lit(0), lambda a, x: a - x).alias("d"))
    return near.groupBy("component").agg(F.min(F.struct("d", "doc_id"))["doc_id"].alias("centre"))


def near_duplicates(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of (doc_id, text): the smallest id reachable by links of similarity
    percent / 100 or more, found from signatures and confirmed on whole sets. percent must be 80 or more."""
    df = df.select("doc_id", "text")
    profile = materialise(profiles(df), "profiles")
    classes = profile.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    classes = materialise(classes.withColumnRenamed("n_shingles", "n"), "classes")
    # ids that have several texts hold their classes together
    several = profile.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k"), F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("k > 1 and x <> y").select("doc_id")
    several = materialise(profile.join(several, "doc_id").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "several")
    n_several = several.count()

    keys = materialise(bucket_keys(classes), "keys")
    buckets = keys.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("tail")).where("head <> tail").select("key", "head")
    stars = keys.join(buckets, "key").where("head <> rep").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    groups = components(stars)

    members = materialise(classes.select(F.col("rep").alias("node"), "n", "h1", "h2", "sig").join(groups, "node").withColumnRenamed("node", "doc_id"), "members")
    sizes = members.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
    large = materialise(sizes.where((F.col("sets") > 2) & ((F.col("sets") > UNIT) | (F.col("shingles") > UNIT_SHINGLES))), "large")
    n_large = large.count()  # at most one for each UNIT sets or UNIT_SHINGLES shingles
    few = broadcast_if_small(members.select("doc_id").distinct(), members.count(), BROADCAST_ROWS)
    texts = materialise(df.join(few, "doc_id"), "texts")

    def with_texts(rows: DataFrame, count: int | None) -> DataFrame:
        return texts.join(rows if count is None else broadcast_if_small(rows, count, BROADCAST_ROWS), "doc_id")

    own = (F.col("doc_id").alias("label"), F.lit(False).alias("rest"), "h1", "h2")
    large_ids = broadcast_if_small(large, n_large, BROADCAST_ROWS)
    small = members.join(large_ids, "component", "left_anti").select(F.col("component").alias("unit"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), F.lit(ALL).alias("mode"), "doc_id", *own)
    first = small
    if n_large:
        big = materialise(members.join(large_ids, "component").withColumn("parts", _parts(F.col("sets"), F.col("shingles"), UNIT)), "big")
        centre = materialise(centres(big, n_large), "centres")
        big = big.join(broadcast_if_small(centre, n_large, BROADCAST_ROWS), "component")
        spread = big.where("doc_id = centre").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        others = big.where("doc_id <> centre").withColumn("i", _part("parts"))
        for side, rows in ((0, spread), (1, others)):
            first = first.union(rows.select(F.col("component").alias("unit"), F.col("i").cast("int"), F.lit(1).alias("j"), F.lit(side).alias("side"), F.lit(ALL).alias("mode"), "doc_id", *own))
    first = materialise(first, "first")
    links = materialise(linked(with_texts(first, first.count()), percent), "links")
    if n_large:
        # who is not connected with the centre is compared with those that share a key: bucket by bucket, or, where the same sets
        # meet in very many buckets, throughout the group; of the two what takes fewer rows
        at_centre = links.join(broadcast_if_small(centre, n_large, BROADCAST_ROWS), F.col("a") == F.col("centre"), "left_semi").select(F.col("b").alias("doc_id"), F.col("a").alias("to"))
        state = big.join(at_centre, "doc_id", "left").select("doc_id", "component", "n", "h1", "h2", F.coalesce("to", "doc_id").alias("label"), (F.col("to").isNull() & (F.col("doc_id") != F.col("centre"))).alias("rest"))
        state = materialise(state, "state")
        def crowded(rows: DataFrame, by: str) -> DataFrame:
            met = rows.groupBy(F.col(by).alias("unit")).agg(F.first("component").alias("of"), F.count_if("rest").alias("r"), F.sum(F.when(F.col("rest"), F.col("n")).otherwise(0)).alias("rn"), F.count("*").alias("m"), F.sum("n").alias("mn"), F.min("label").alias("x"), F.max("label").alias("y")).where("r > 0 and x <> y")
            met = met.withColumn("ri", _parts(F.col("r"), F.col("rn"), BLOCK)).withColumn("mj", _parts(F.col("m"), F.col("mn"), BLOCK))
            return materialise(met.withColumn("cost", F.col("r") * F.col("mj") + F.col("m") * F.col("ri")).select("unit", "of", "m", "ri", "mj", "cost"), "crowds")

        whole = crowded(state, "component")
        # a group that takes no more rows for each set than the set has keys needs no look at its buckets
        costly = whole.where(F.col("cost") > PER_SET * F.col("m")).select(F.col("of").alias("component"))
        costly = broadcast_if_small(materialise(costly, "costly"), n_large, BROADCAST_ROWS)
        where = materialise(keys.withColumnRenamed("rep", "doc_id").join(state.join(costly, "component", "left_semi"), "doc_id"), "where")
        buckets = crowded(where, "key")
        by_bucket = buckets.groupBy("of").agg(F.sum("cost").alias("all")).join(whole.select("of", "cost"), "of").where("all < cost").select("of")
        by_bucket = broadcast_if_small(materialise(by_bucket, "by_bucket"), n_large, BROADCAST_ROWS)
        crowds = [buckets, whole]
        rows = None
        for mode, by, source, crowd, how in ((BUCKET, "key", where, crowds[0], "left_semi"), (GROUP, "component", state, crowds[1], "left_anti")):
            met = source.withColumn("unit", F.col(by)).join(crowd.join(by_bucket, "of", how).select("unit", "ri", "mj"), "unit")
            rest = met.where("rest").withColumn("i", _part("ri")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("mj") - 1)))
            every = met.withColumn("j", _part("mj")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ri") - 1)))
            for side, part in ((0, rest), (1, every)):
                part = part.select("unit", "i", "j", F.lit(side).alias("side"), F.lit(mode).alias("mode"), "doc_id", "label", "rest", "h1", "h2")
                rows = part if rows is None else rows.union(part)
        rows = materialise(rows, "rest")
        if n_rows := rows.count():
            links = links.union(materialise(linked(with_texts(rows, n_rows), percent), "more"))
    together = materialise(components(links.union(several) if n_several else links), "together")

    ids = together.withColumnRenamed("node", "rep")
    classes = classes.join(ids, "rep", "left").where("copies > 1 or component is not null")
    classes = classes.select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = profile.select("doc_id", "n_shingles", "h1", "h2").join(classes, ["h1", "h2"], "left")
    own_id = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own_id.alias("component_id"), own_id.eqNullSafe(F.col("doc_id")).alias("kept"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
