"""Annotation as a chain of transformations, each with what it needs and what it gives; the chain is resolved before it runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from textloom.functions import segmentation as sg, strings as S


@dataclass(frozen=True)
class Annotator:
    name: str
    requires: frozenset[str]
    provides: frozenset[str]
    transform: Callable[[DataFrame], DataFrame]


def annotator(name: str, requires: str, provides: str, transform: Callable[[DataFrame], DataFrame]) -> Annotator:
    return Annotator(name, frozenset(requires.split()), frozenset(provides.split()), transform)


def compound(name: str, parts: list[Annotator]) -> Annotator:
    needs, gives = set(), set()
    for p in parts:
        needs |= p.requires - gives
        gives |= p.provides

    def run(df: DataFrame) -> DataFrame:
        for p in parts:
            df = p.transform(df)
        return df

    return Annotator(name, frozenset(needs), frozenset(gives), run)


def resolve(wanted: list[str], known: list[Annotator], given: set[str]) -> list[Annotator]:
    """The annotators that give what is wanted, each after what it needs, none twice. Attributes at hand are not made again.

    Raises ValueError for what nobody provides, for cycles, and where two chosen annotators would give the same attribute."""
    makers: dict[str, list[Annotator]] = {}
    for a in known:
        for p in a.provides:
            makers.setdefault(p, []).append(a)
    chain: list[Annotator] = []
    have, open_ = set(given), []

    def need(attribute: str) -> None:
        if attribute in have:
            return
        if attribute not in makers:
            raise ValueError(f"nothing provides {attribute}")
        # of several the first that makes nothing again
        a = next((m for m in makers[attribute] if not m.provides & have), makers[attribute][0])
        if a in open_:
            raise ValueError(f"a cycle through {a.name}")
        open_.append(a)
        for r in sorted(a.requires):
            need(r)
        open_.pop()
        if a not in chain:
            if twice := a.provides & have:
                raise ValueError(f"{a.name} would provide {sorted(twice)} again")
            chain.append(a)
            have.update(a.provides)

    for w in wanted:
        need(w)
    return chain


def run(df: DataFrame, wanted: list[str], known: list[Annotator] | None = None) -> DataFrame:
    for a in resolve(wanted, known or DEFAULT, set(df.columns)):
        df = a.transform(df)
    return df


DEFAULT = [
    annotator("tokenizer", "doc_id text", "pos start end string sent", lambda df: sg.tokens_of(df, sentences=True)),
    annotator("sentences", "doc_id pos start end string", "sent", sg.sentences_of),
    annotator("normaliser", "string", "norm", lambda df: df.withColumn("norm", sg.normal_form(F.col("string")))),
    annotator("lower lemmatiser", "norm", "lemma", lambda df: df.withColumn("lemma", F.lower("norm"))),
    annotator("stemmer", "norm", "stem", lambda df: df.withColumn("stem", S.porter_stem(F.lower("norm")))),
    annotator("shapes", "string", "shape", lambda df: df.withColumn("shape", S.shape(F.col("string"), 2))),
    annotator("digits", "string", "digits", lambda df: df.withColumn("digits", S.simplify_digits(F.col("string")))),
    annotator("number words", "string", "is_number", lambda df: df.withColumn("is_number", S.is_number(F.col("string")))),
]


def registered(spark) -> None:
    """Makes the functions of this library callable from SQL."""
    spark.udf.register("porter_stem", S.porter_stem)
    spark.udf.register("token_spans", sg.token_spans)
