"""Language identification with a bit-sliced Bloom filter of n-grams (operator 3).

Training counts byte n-grams of lower-cased texts per language. A language contains an n-gram if it occurs there twice or more and
at no less than RATIO of the rate of the language where it is most frequent. One filter serves all languages: each of its slots
has one bit per language, in as many words of bits as the languages need, so that and-ing an n-gram's slots gives the set of all
languages that contain it.

A text's languages are scored by popcounts over its n-grams, corrected for the rate at which a language's bits are set by chance:
c' = (c - n * p) / (1 - p), where p is the language's fill of the slots to the power of the number of slots of an n-gram. The largest
wins (of equals the first by name); score is its share c' / n.

A tenth of the training texts, chosen by their hash, is left out of the filter and calibrates what is accepted: a text of at least
SURE n-grams whose score is under SLACK times that of nearly all calibration texts' scores is in none of the languages. Shorter texts
are accepted if they have a letter.

The model is of fixed size (2 ** SLOT_BITS slots), fitted on distinct labelled texts, at most about FIT_TEXTS of them, a documented bound:
above it, texts are drawn by the hash of the text, at a rate for each language that leaves the rare ones whole. Everything else
covers all rows and whole texts, however long.

A text that is null or has no letter is `und` with score 0. A text with letters but too short for any n-gram of the model gets the
language most frequent in training with score 0; so does every text if nothing is labelled, then as `und`, and all texts with a
letter are accepted. Repeated rows give repeated results. Further columns are ignored, except those named in `keep`. An empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from textloom.llm.common import joined, materialise, mix, slices, table

GRAM = 5
SLOT_BITS, PROBES = 22, 3
RATIO = 0.25
FIT_TEXTS = 40_000
UNKNOWN = "und"
FOLDS = 5
#: bits of one mask word in Spark, which has signed words only
WORD = 63
#: accepted: texts of fewer n-grams, or with at least SLACK of the score that all but UNSURE of the calibration texts reach
SURE, SLACK, UNSURE = 40, 0.4, 0.01

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)
_SEEDS = mix(np.arange(11, 11 + PROBES, dtype=np.uint64))


def gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, letters only with single spaces between words, and where each text's begin."""
    data, ends = joined(pa.array([t if t.isascii() else t.lower() for t in texts], pa.large_string()))
    data = _CLEAN[data]
    # runs of spaces become one; a space is put before and after each text
    size = np.diff(ends)
    wide = np.full(len(data) + 2 * len(texts), 32, np.uint8)
    shift = np.repeat(np.arange(len(texts)) * 2 + 1, size)
    wide[np.arange(len(data)) + shift] = data
    owner = np.repeat(np.arange(len(texts)), size + 2)
    keep = np.ones(len(wide), bool)
    keep[1:] = (wide[1:] != 32) | (wide[:-1] != 32) | (owner[1:] != owner[:-1])
    wide, owner = wide[keep], owner[keep]
    n = len(wide) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h << np.uint64(8) | wide[k : k + n]
    whole = owner[:n] == owner[GRAM - 1 :]
    return mix(h[whole]), np.searchsorted(owner[:n][whole], np.arange(len(texts) + 1))


def slots_of(grams: np.ndarray, k: int) -> np.ndarray:
    return (((grams ^ _SEEDS[k]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (words, slots): one bit per language in each slot
    chance: np.ndarray
    prior: str
    floor: float = 0.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Per text its language, its score, and whether it is accepted as a text of that language."""
        said = [t or "" for t in texts]
        grams, at = gram_hashes(said)
        n = np.diff(at)
        counts = np.zeros((len(said), max(1, len(self.languages))))
        if len(grams) and self.languages:
            full = np.flatnonzero(n)
            probes = [slots_of(grams, k) for k in range(PROBES)]
            kind, bits = self.table.dtype.type, self.table.dtype.itemsize * 8
            bits = min(bits, WORD)
            for w, word in enumerate(self.table):
                mask = word[probes[0]]
                for slots in probes[1:]:
                    mask &= word[slots]
                for j in range(min(bits, len(self.languages) - w * bits)):
                    counts[full, w * bits + j] = np.add.reduceat((mask >> kind(j) & kind(1)).astype(np.int64), at[:-1][full])
        fixed = np.clip((counts - n[:, None] * self.chance) / (1 - self.chance), 0, None)
        best = fixed.argmax(axis=1)
        top = fixed[np.arange(len(said)), best]
        score = np.where(n > 0, np.minimum(1.0, top / np.maximum(n, 1)), 0.0)
        langs, accepted = [], []
        for i, t in enumerate(said):
            if not any(map(str.isalpha, t)):
                langs.append(UNKNOWN)
                score[i] = 0.0
                accepted.append(False)
            else:
                langs.append(self.languages[best[i]] if top[i] > 0 else self.prior)
                accepted.append(bool(n[i] < SURE or score[i] >= self.floor))
        return langs, [round(float(s), 6) for s in score], accepted


def rates(sizes: dict[str, int], most: int) -> dict[str, float]:
    """The share of each language's texts to draw, so that about `most` are drawn and none of a rarer language is left out first."""
    left, out = most, {}
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left // (len(sizes) - k))
        out[lang] = take / n
        left -= take
    return out


def fit(labelled: DataFrame, fit_texts: int = FIT_TEXTS) -> Model:
    """From rows of (text, lang), both not null. What reaches the driver is a count for each language and the filter."""
    spark = labelled.sparkSession
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    dtype = np.uint8 if len(languages) <= 8 else np.uint64
    bits = 8 if dtype == np.uint8 else WORD
    words = max(1, -(-len(languages) // bits))
    prior = max(languages, key=lambda x: sizes[x]) if languages else UNKNOWN
    model = Model(languages, np.zeros((words, 1 << SLOT_BITS), dtype), np.zeros(max(1, len(languages))), prior)
    if not languages:
        return model
    hashed = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    share = rates(sizes, fit_texts)
    if min(share.values()) < 1:
        drawn = spark.createDataFrame(list(share.items()), "lang string, share double")  # a row per language
        labelled = labelled.join(F.broadcast(drawn), "lang").where(hashed < F.col("share") * (1 << 30))
    labelled = materialise(labelled.select("text", "lang").distinct(), "labelled")
    calibrates = F.pmod(F.xxhash64("text", F.lit("calibration")), F.lit(10)) == 0
    index = {lang: j for j, lang in enumerate(languages)}

    def count(batches):
        held: dict[str, list[np.ndarray]] = {}
        n = 0

        def out():
            for lang, parts in held.items():
                grams, times = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([index[lang]] * len(grams), pa.int32()), pa.array(grams.view(np.int64)), pa.array(times.astype(np.int64))], names=["j", "gram", "n"])

        for b in slices(batches, "text", 256 << 10):
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            grams, at = gram_hashes(texts)
            for i, lang in enumerate(langs):
                held.setdefault(lang, []).append(grams[at[i] : at[i + 1]])
            n += len(grams)
            if n > 2_000_000:
                yield from out()
                held, n = {}, 0
        yield from out()

    counts = materialise(labelled.where(~calibrates).mapInArrow(count, "j int, gram long, n long").groupBy("j", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("j").agg(F.sum("n").cast("double").alias("total"))
    # of an n-gram there are at most as many rows as languages
    rated = counts.join(F.broadcast(totals), "j").select("gram", F.struct("j", "n", (F.col("n") / F.col("total")).alias("rate")).alias("x"))
    per = rated.groupBy("gram").agg(F.collect_list("x").alias("xs"), F.max("x.rate").alias("most"))
    having = F.filter("xs", lambda x: (x["n"] >= 2) & (x["rate"] >= RATIO * F.col("most")))
    one = F.lit(1).cast("long")

    def word_of(w: int):
        mine = F.filter(having, lambda x: F.floor(x["j"] / bits) == w)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", one, x["j"] % bits)))

    mask = [word_of(w) for w in range(words)]
    chosen = per.select("gram", *(m.alias(f"m{w}") for w, m in enumerate(mask))).where(" or ".join(f"m{w} <> 0" for w in range(words)))
    names = [f"m{w}" for w in range(words)]

    def probe(batches):
        for b in batches:
            g = b.column("gram").to_numpy().view(np.uint64)
            for k in range(PROBES):
                yield pa.RecordBatch.from_arrays([pa.array(slots_of(g, k)), *(b.column(m) for m in names)], names=["slot", *names])

    # at most as many rows as the filter has slots
    bit_rows = chosen.mapInArrow(probe, ", ".join(["slot long", *(f"{m} long" for m in names)])).groupBy("slot").agg(*(F.bit_or(m).alias(m) for m in names)).toArrow()
    for w, m in enumerate(names):
        model.table[w, bit_rows.column("slot").to_numpy()] = bit_rows.column(m).to_numpy().astype(dtype)
    fill = np.array([((model.table[j // bits] >> dtype(j % bits)) & dtype(1)).mean() for j in range(len(languages))])
    model.chance = np.minimum(fill**PROBES, 0.99)
    # the filter's calibration: scores of texts it has not seen, at most a tenth of the bounded sample
    seen = identify(labelled.where(calibrates), model, ("text", "lang")).where(F.col("lang_pred") == F.col("lang"))
    long_enough = seen.where(F.length(F.regexp_replace("text", r"[^\p{L}]+", "")) >= SURE)
    low = long_enough.agg(F.percentile("score", F.lit(UNSURE))).first()[0]
    model.floor = SLACK * low if low is not None else 0.0
    return model


def identify(df: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, then lang_pred, score and accepted, from the text alone."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = df.select(*keep).schema

    def run(batches):
        known = shared.value
        for b in slices(batches, "text", 256 << 10):
            langs, scores, accepted = known.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=[*keep, "lang_pred", "score", "accepted"])

    out = StructType([*schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())])
    return df.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, out)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    """The model of the labelled documents that are not held out."""
    return fit(docs.where(~held_out()).where("text is not null and lang is not null").select("text", "lang"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.withColumn("held_out", held_out()), fit_documents(docs), ("doc_id", "held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")
