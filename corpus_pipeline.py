"""Cleaning a corpus end to end: each stage reads what its predecessor kept.

Stages: documents in none of the learned languages go; of near-duplicates, five words a shingle and a similarity of 0.8 or more, the
one with the smallest id stays; bytes of strings of 100 or more that also occur earlier go from the texts; documents with a passage
of the benchmark go; what is left is encoded.

Null and empty texts, and texts without a letter, are in no language and go first. Rows with equal doc_id are one document: what a
stage decides of it holds for all its rows, but language and benchmark passages are judged row by row. Rows without doc_id are
not compared with others. Where lang is null it becomes
the language found. Further columns, of any name, are carried through all stages but the last. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textloom.llm.common import broadcast_if_small, materialise, table
from textloom.llm.decontamination import decontaminate
from textloom.llm.language_id import UNKNOWN, fit_documents, identify
from textloom.llm.near_duplicates import near_duplicates
from textloom.llm.piece_encoding import encode_digests
from textloom.llm.suffix_repeats import without_repeats

#: Of near-duplicates' shingle sets.
PERCENT = 80
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    ids = materialise(ids, "gone")
    return docs.join(broadcast_if_small(ids, ids.count(), BROADCAST_ROWS), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are accepted as texts of a learned language; the model is fitted on this stage's own documents."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "text")
    kept = identify(whole, fit_documents(docs), ("doc",)).where("accepted")
    cols = [F.coalesce("doc.lang", F.when(F.col("lang_pred") != UNKNOWN, F.col("lang_pred"))).alias(c) if c == "lang" else F.col(f"doc.`{c}`") for c in docs.columns]
    return kept.select(*cols)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, near_duplicates(docs, PERCENT).where("not kept").select("doc_id"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated bytes out of the texts. Bytes of characters that were cut in two go as well."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    out = without_repeats(docs.select(F.struct(*others).alias("doc"), "doc_id", "text"), keep=("doc",))
    text = F.when(F.col("n_removed") > 0, F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", "")).otherwise(F.col("kept").cast("string"))
    return out.select("doc.*", text.alias("text")).withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", "text")
    clean = decontaminate(whole, table(spark, sf_dir, "benchmark"), keep=("doc",)).where("not contaminated")
    return clean.select(*(F.col(f"doc.`{c}`") for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_digests(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("repeats", repeats), ("decontamination", decontamination), ("encoding", encoding)]
#: SQL can't express the language model or the encoder; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
