"""Taggers: tag sets, the greedy forward tagger, stacked chains, repair of tag sequences, words from characters, unsupervised sentence
bounds, number of nouns."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from textloom.functions.segmentation import abbreviation_scores
from textloom.operators.chains import ChainModel, licit, tag, train_chain
from textloom.operators.tokens import counted

#: coarse tags of the treebank tags
UNIVERSAL = {
    **dict.fromkeys(("JJ", "JJR", "JJS"), "ADJ"), **dict.fromkeys(("RB", "RBR", "RBS", "WRB"), "ADV"), **dict.fromkeys(("NN", "NNS", "NNP", "NNPS"), "NOUN"),
    **dict.fromkeys(("VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "MD"), "VERB"), **dict.fromkeys(("PRP", "PRP$", "WP", "WP$", "EX"), "PRON"), **dict.fromkeys(("DT", "PDT", "WDT"), "DET"),
    "IN": "ADP", "CC": "CONJ", "CD": "NUM", **dict.fromkeys(("POS", "RP", "TO"), "PRT"), **dict.fromkeys((".", ",", ":", "``", "''", "-LRB-", "-RRB-", "$", "#"), "."),
}


def universal_tag(tag_: Column) -> Column:
    """The coarse tag of a treebank tag; X for any other."""
    known = F.create_map(*(F.lit(x) for pair in UNIVERSAL.items() for x in pair))
    return F.coalesce(known[tag_], F.lit("X"))


# the forward tagger


@dataclass
class ForwardTagger:
    """Left to right, each word gets the best tag of a linear model that sees the two tags before it. Words that nearly always have
    one tag get it from a table."""

    tags: list[str]
    size: int = 1 << 16
    weights: np.ndarray | None = None
    sure: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.weights = np.zeros((self.size, len(self.tags))) if self.weights is None else self.weights

    def slots(self, words: list[str], i: int, before: int, before2: int) -> np.ndarray:
        w = words[i]
        low, n = w.lower(), len(words)
        shape = "".join("A" if c.isupper() else "a" if c.islower() else "1" if c.isdigit() else "-" for c in w[:4])
        feats = ["bias", "w=" + low, "x=" + low[-3:], "y=" + low[-2:], "p=" + low[:2], "s=" + shape, f"t={before}", f"tt={before},{before2}", f"tw={before},{low}", "l=" + (words[i - 1].lower() if i else "<"), "r=" + (words[i + 1].lower() if i + 1 < n else ">")]
        return np.array([zlib.crc32(f.encode()) % self.size for f in feats])

    def run(self, words: list[str], gold: list[int] | None = None, rate: float = 1.0, sums: np.ndarray | None = None, t: int = 1) -> list[int]:
        """The tags; with gold tags, a perceptron step where one is wrong, added times t to `sums` for averaging."""
        out: list[int] = []
        for i, w in enumerate(words):
            k = self.sure.get(w.lower())
            if k is None:
                s = self.slots(words, i, out[-1] if out else -1, out[-2] if len(out) > 1 else -1)
                k = int(self.weights[s].sum(0).argmax())
                if gold is not None and k != gold[i]:
                    for j, d in ((gold[i], rate), (k, -rate)):
                        np.add.at(self.weights[:, j], s, d)
                        if sums is not None:
                            np.add.at(sums[:, j], s, d * t)
            out.append(k)
        return out


def train_forward(sentences: DataFrame, tags: list[str], passes: int = 3, shards: int = 4, size: int = 1 << 16, sure_count: int = 1000, sure_share: float = 0.999) -> ForwardTagger:
    """Averaged perceptrons on shards of rows (words, tags), mixed after each pass. The model is of fixed size; the table of sure
    words has at most one for each sure_count tokens."""
    pairs = sentences.select(F.explode(F.arrays_zip("words", "tags")).alias("x")).groupBy(F.lower("x.words").alias("w"), F.col("x.tags").alias("t")).agg(F.count("*").alias("n"))
    per = pairs.groupBy("w").agg(F.sum("n").alias("n"), F.max(F.struct("n", "t")).alias("best")).where((F.col("n") >= sure_count) & (F.col("best.n") >= sure_share * F.col("n")))
    index = {t: j for j, t in enumerate(tags)}
    model = ForwardTagger(tags, size, sure={r.w: index[r.best.t] for r in per.collect() if r.best.t in index})
    k, sharded = len(tags), sentences.select("words", "tags").repartition(shards)
    for _ in range(passes):
        shared = sentences.sparkSession.sparkContext.broadcast(model)

        def run(batches, shared=shared):
            own = ForwardTagger(tags, size, shared.value.weights.copy(), shared.value.sure)
            sums, n = np.zeros_like(own.weights), 1
            for pdf in batches:
                for words, gold in zip(pdf["words"], pdf["tags"], strict=True):
                    own.run(list(words), [index.get(t, 0) for t in gold], 1.0, sums, n)
                    n += 1
            mean = own.weights - sums / n - shared.value.weights
            changed = np.flatnonzero(mean.any(1))
            yield pd.DataFrame({"slot": changed.astype(np.int32), "w": pd.Series(list(mean[changed]), dtype=object)})

        total = sharded.mapInPandas(run, "slot int, w array<double>").groupBy("slot").agg(*(F.sum(F.get("w", F.lit(j))).alias(f"w{j}") for j in range(k))).toArrow().to_pandas()
        model.weights[total["slot"].to_numpy()] += total[[f"w{j}" for j in range(k)]].to_numpy() / shards
    return model


def tag_forward(sentences: DataFrame, model: ForwardTagger, into: str = "predicted") -> DataFrame:
    """Adds the tags of an array of words."""
    shared = sentences.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            tags = [[m.tags[k] for k in m.run(w or [])] for w in b.column("words").to_pylist()]
            yield b.append_column(into, pa.array(tags, pa.list_(pa.string())))

    return sentences.mapInArrow(run, StructType([*sentences.schema.fields, StructField(into, ArrayType(StringType()))]))


# stacked chains and well-formed tags


def with_tags(sentences: DataFrame, tags_: str) -> DataFrame:
    """Words that carry a tag as a further feature of a chain model."""
    return sentences.withColumn("words", F.zip_with("words", tags_, lambda w, t: F.concat(w, F.lit("\x1f"), t)))


def train_stacked(sentences: DataFrame, tags: list[str], **options) -> tuple[ChainModel, ChainModel]:
    """Two chain models; the second sees what the first says of each word and its neighbours."""
    first = train_chain(sentences, tags, **options)
    said = with_tags(tag(sentences, first, "_said"), "_said").select("words", "tags")
    second = train_chain(said, tags, **options)
    first.mask = second.mask = licit(tags, "BILOU" if any(t[0] in "LU" for t in tags) else "BIO") if any("-" in t for t in tags) else None
    return first, second


def tag_stacked(sentences: DataFrame, models: tuple[ChainModel, ChainModel], into: str = "predicted") -> DataFrame:
    words = sentences.withColumn("_words", F.col("words"))
    out = tag(with_tags(tag(words, models[0], "_said"), "_said"), models[1], into)
    return out.withColumn("words", F.col("_words")).drop("_words", "_said")


def well_formed(tags_: Column) -> Column:
    """BIO tags in which an I- that continues no span of its label becomes a B-."""
    kind, label = (lambda t: F.substring(t, 1, 2)), (lambda t: F.substring(t, F.lit(3), F.length(t)))
    before = lambda i: F.coalesce(F.get(tags_, i - 1), F.lit("O"))
    return F.transform(tags_, lambda t, i: F.when((kind(t) == "I-") & ((before(i) == "O") | (label(before(i)) != label(t))), F.concat(F.lit("B-"), label(t))).otherwise(t))


# words from characters


def boundary_tags(words: Column) -> Column:
    """For each character of an array of words whether it begins, is inside of, ends, or is a word: B, M, E, S."""
    one = lambda w: F.when(F.length(w) == 1, F.array(F.lit("S"))).otherwise(F.concat(F.array(F.lit("B")), F.array_repeat(F.lit("M"), F.length(w) - 2), F.array(F.lit("E"))))
    return F.flatten(F.transform(F.filter(words, lambda w: w != ""), one))


@F.arrow_udf(ArrayType(StringType()))
def words_of_tags(chars: pa.Array, tags_: pa.Array) -> pa.Array:
    """Words from characters and their boundary tags: a word ends at E and S, and before B and S. Words are cut from the joined characters
    of a whole Arrow batch by their places, in one step for each character."""
    known = pc.and_(chars.is_valid(), tags_.is_valid())
    n, m = (np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64) for x in (chars, tags_))
    letters, marks = chars.flatten(), tags_.flatten()
    if (n != m).any():  # characters without a tag are in no word; tags without a character add none
        row, at = np.repeat(np.arange(len(m)), m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        place = np.where(at < n[row], (np.cumsum(n) - n)[row] + at, -1)
        letters = letters.take(pa.array(place, mask=place < 0))
    letters = pc.fill_null(letters.cast(pa.string()), "")
    marks = marks.cast(pa.string())
    closes = pc.is_in(marks, pa.array(["E", "S"])).to_numpy(zero_copy_only=False)
    opens = pc.is_in(pc.fill_null(marks, "S"), pa.array(["B", "S"])).to_numpy(zero_copy_only=False)
    last = np.cumsum(m)[m > 0] - 1
    after = np.concatenate([opens[1:], [True]])[: len(opens)]
    ends = closes | after
    ends[last] = True
    stops = np.flatnonzero(ends) + 1
    if not len(stops):
        return pa.array([[] if k else None for k in known.to_pylist()], pa.list_(pa.string()))
    places = np.frombuffer(letters.buffers()[1], np.int32)[letters.offset : letters.offset + len(letters) + 1]
    words = pa.StringArray.from_buffers(len(stops), pa.py_buffer(places[np.concatenate([[0], stops])].copy()), letters.buffers()[2])
    per = np.bincount(np.repeat(np.arange(len(m)), m)[stops - 1], minlength=len(m))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), words, mask=pc.invert(known))


def train_segmenter(sentences: DataFrame, **options) -> ChainModel:
    """A chain model that cuts text without spaces, from rows of words."""
    rows = sentences.select(F.split(F.array_join("words", ""), "").alias("words"), boundary_tags(F.col("words")).alias("tags"))
    return train_chain(rows, ["B", "M", "E", "S"], **options)


def cut_words(rows: DataFrame, model: ChainModel, text: str = "text") -> DataFrame:
    chars = rows.withColumn("words", F.split(text, ""))
    return tag(chars, model, "_tags").withColumn("words", words_of_tags(F.col("words"), F.col("_tags"))).drop("_tags")


# unsupervised sentence bounds

SPANS = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
_CLOSES = re.compile(r"[.!?…][\"'”’)\]]*$")


def cut_sentences(text: str | None, abbreviations: set[str]) -> list[tuple[int, int]]:
    """(start, end) of sentences: after a token that ends in closing punctuation, if the next begins with no lower-case letter and the
    token, without its stop, is no abbreviation or initial."""
    out, first, last = [], None, None
    tokens = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", text or "")]
    for k, (start, end, t) in enumerate(tokens):
        first = start if first is None else first
        last = end
        if _CLOSES.search(t) and k + 1 < len(tokens):
            bare = t.rstrip("\"'”’)]")
            word = bare[:-1].lower()
            stop = bare.endswith(".") and (word in abbreviations or len(word) == 1 and word.isalpha())
            if not stop and not tokens[k + 1][2].lstrip("\"'“‘([")[:1].islower():
                out.append((first, last))
                first = None
    if first is not None:
        out.append((first, last))
    return out


def own_abbreviations(text: str | None, least: int = 2) -> set[str]:
    """Of one text: short words of two or more uses that always have a stop, and are followed by a small letter at least once."""
    tokens = re.findall(r"\S+", text or "")
    dotted, plain, inner = Counter(), Counter(), set()
    for k, t in enumerate(tokens):
        if t.endswith(".") and len(t) <= 8:
            dotted[t[:-1].lower()] += 1
            if k + 1 < len(tokens) and tokens[k + 1][:1].islower():
                inner.add(t[:-1].lower())
        else:
            plain[t.lower()] += 1
    return {w for w, n in dotted.items() if n >= least and not plain[w] and w in inner}


def unsupervised_sentences(docs: DataFrame, mode: str = "joint", threshold: float = 0.3, most: int = 1_000_000) -> DataFrame:
    """(doc_id, sent, start, end) of documents (doc_id, text). Abbreviations come from all texts together (joint), from each text alone
    (document), or there are none (none). Over `most` abbreviations is an error."""
    known: set[str] = set()
    if mode == "joint":
        words = counted(docs, re.compile(r"[^ \t\n\x0b\f\r]+").findall, "string")
        found = abbreviation_scores(words).where(F.col("score") >= threshold).select("word")
        if (n := found.count()) > most:
            raise ValueError(f"{n} abbreviations")
        known = {r.word for r in found.collect()}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for b in batches:
            ids, row, sent, start, end = b.column("doc_id"), [], [], [], []
            for r, t in enumerate(b.column("text").to_pylist()):
                spans = cut_sentences(t, own_abbreviations(t) if mode == "document" else shared.value)
                row += [r] * len(spans)
                sent += range(len(spans))
                start += [s for s, _ in spans]
                end += [e for _, e in spans]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int32())), *(pa.array(x, pa.int32()) for x in (sent, start, end))], names=["doc_id", "sent", "start", "end"])

    return docs.select("doc_id", "text").mapInArrow(run, StructType([docs.schema["doc_id"], StructField("sent", IntegerType()), *SPANS.fields]))


# number of nouns

_PLURAL = ((r"(?i)(s|x|z|ch|sh)$", "$1es"), (r"(?i)([^aeiou])y$", "$1ies"), (r"(?i)(?:fe|([lr])f)$", "$1ves"))
IRREGULAR = {"man": "men", "woman": "women", "child": "children", "person": "people", "foot": "feet", "tooth": "teeth", "mouse": "mice", "goose": "geese"}


def plural(word: Column) -> Column:
    out = F.concat(word, F.lit("s"))
    for pattern, into in reversed(_PLURAL):
        out = F.when(word.rlike(pattern), F.regexp_replace(word, pattern, into)).otherwise(out)
    for one, many in IRREGULAR.items():
        out = F.when(F.lower(word) == one, many).otherwise(out)
    return out


def singular(word: Column) -> Column:
    out = F.when(word.rlike(r"(?i)[^s]s$"), F.regexp_replace(word, r"(?i)s$", "")).otherwise(word)
    out = F.when(word.rlike(r"(?i)(s|x|z|ch|sh)es$"), F.regexp_replace(word, r"(?i)es$", "")).otherwise(out)
    out = F.when(word.rlike(r"(?i)[^aeiou]ies$"), F.regexp_replace(word, r"(?i)ies$", "y")).otherwise(out)
    out = F.when(word.rlike(r"(?i)[lr]ves$"), F.regexp_replace(word, r"(?i)ves$", "f")).otherwise(out)
    for one, many in IRREGULAR.items():
        out = F.when(F.lower(word) == many, one).otherwise(out)
    return out
