"""Token counts by distinct pre-token (operator 6).

The pre-tokens of all texts are counted; each distinct pre-token is split into pieces once, in one table; a document's count
is the sum over its own pre-token frequencies of that table's piece counts. Ids are never materialised.

Frequent pre-tokens, at most `most_frequent` of them, are joined in the worker that cuts the text (a table of fixed size is
broadcast); the frequencies of all others are joined to the table by a shuffle, so nothing is lost at any vocabulary size.
A pre-token outside the frequent ones can't be hot.

Null text is empty: 0 bytes, 0 tokens. Special strings (as in the library's default) split the text and count as one token.
Repeated rows of the same id, and rows without one, are counted as separate rows through their own row key. Texts are taken whole,
however long; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm.common import materialise, slices, table
from textloom.llm.piece_encoding import model_file

MODEL = "byte_bpe_50k.json"
MOST_FREQUENT = 300_000
FLUSH = 400_000
#: Where the regex library's and the tokenizer's character classes agree (the tests compare every code point of it).
SAFE = ((0, 0x557), (0x900, 0x97F), (0x1E00, 0x1FFF), (0x2000, 0x2064), (0x20A0, 0x20BF), (0x2100, 0x2B73), (0x3000, 0x3003), (0x3041, 0x3096), (0x30A1, 0x30FF), (0x4E00, 0x9FEF), (0xAC00, 0xD7A3), (0xFF01, 0xFFBE), (0x1F300, 0x1F64F))
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Cutter:
    """Cuts texts into the pre-tokens of a byte-level tokenizer, and counts the pieces of one."""

    def __init__(self, model: str):
        import re

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model_file(model))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        # \s of the tokenizer is Unicode's White_Space, which has not the separators 1C to 1F
        self.cut = regex.compile(PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        self.unsafe = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SAFE) + "]").search

    def __call__(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and the number of special tokens."""
        if self.special and (parts := self.special.split(text))[1:]:
            return [t for p in parts for t in self.plain(p)], len(parts) - 1
        return self.plain(text), 0

    def plain(self, text: str) -> list[str]:
        if text.isascii() or not self.unsafe(text):
            return self.cut(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, tokens: list[str]) -> list[int]:
        """Pieces of each pre-token; a pre-token's encoding alone is its encoding inside a text."""
        t = self.tokenizer
        t.encode_special_tokens = True
        try:
            return [len(e.ids) for e in t.encode_batch_fast(tokens, add_special_tokens=False)]
        finally:
            t.encode_special_tokens = False


@lru_cache(maxsize=2)
def cutter(model: str) -> Cutter:
    return Cutter(model)


def pre_token_counts(df: DataFrame, model: str = MODEL) -> DataFrame:
    """(piece, n): every distinct pre-token of the text column with its total count; summed in the workers first."""

    def run(batches):
        cut, counts = cutter(model), Counter()

        def out():
            return pa.RecordBatch.from_pydict({"piece": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

        for b in slices(batches):
            for text in b.column("text").to_pylist():
                if text:
                    counts.update(cut(text)[0])
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return df.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_counts(vocabulary: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds k, the number of pieces, once per distinct pre-token."""

    def run(batches):
        cut = cutter(model)
        for b in batches:
            tokens = b.column("piece").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("piece"), b.column("n"), pa.array(cut.pieces(tokens) if tokens else [], pa.int32())], names=["piece", "n", "k"])

    return vocabulary.mapInArrow(run, "piece string, n long, k int")


def frequent_pieces(vocabulary: DataFrame, most: int) -> tuple[dict[str, int], int]:
    """{pre-token: pieces} of those that occur at least so often that at most `most` do, and that number of times."""
    step = F.floor(F.log2("n") * 4).cast("int")
    total, least = 0, None
    for r in sorted(vocabulary.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return {}, 1 << 62
    bound = next(n for n in range(max(1, int(2 ** (least / 4)) - 2), int(2 ** (least / 4)) + 3) if int(math.floor(math.log2(n) * 4)) >= least)
    return {r.piece: r.k for r in vocabulary.where(F.col("n") >= bound).select("piece", "k").collect()}, bound


def count_tokens(df: DataFrame, model: str = MODEL, most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) per row of df."""
    spark = df.sparkSession
    vocabulary = materialise(piece_counts(pre_token_counts(df, model), model), "pieces")
    known, bound = frequent_pieces(vocabulary, most_frequent)
    shared = spark.sparkContext.broadcast(known)

    def run(batches):
        cut, known = cutter(model), shared.value
        for b in slices(batches):
            row, doc, size, total, piece, times = [], [], [], [], [], []
            for r, d, text in zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                pre, n = cut(text) if text else ((), 0)
                at = len(row)
                row.append(r)
                doc.append(d)
                size.append(len(text.encode()) if text else 0)
                total.append(n)
                piece.append(f"\0{r}")  # no pre-token begins so and goes on with digits: the row joins with nothing, spread evenly
                times.append(0)
                for t, c in Counter(pre).items():
                    k = known.get(t)
                    if k is not None:
                        n += k * c
                    else:
                        row.append(r)
                        doc.append(None)
                        size.append(0)
                        total.append(0)
                        piece.append(t)
                        times.append(c)
                total[at] = n
            yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(doc, pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(piece, pa.string()), pa.array(times, pa.int32())], names=["row", "doc_id", "n_bytes", "total", "piece", "times"])

    parts = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, "row long, doc_id long, n_bytes long, total long, piece string, times int")
    rare = vocabulary.where(F.col("n") < bound).select("piece", "k")
    return (
        parts.join(rare, "piece", "left")
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("total") + F.col("times") * F.coalesce("k", F.lit(0))).alias("n_tokens"))
        .drop("row")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)
