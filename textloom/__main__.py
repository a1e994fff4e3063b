"""python -m textloom COMMAND ...: annotate, classify, topics, vectors or query over text on any path that Spark reads."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("annotate", help="documents to tokens with attributes")
    a.add_argument("--attributes", default="sent,lemma,shape")
    c = sub.add_parser("classify", help="naive Bayes over directories of documents")
    c.add_argument("--test", required=True)
    t = sub.add_parser("topics")
    t.add_argument("--topics", type=int, default=10)
    t.add_argument("--sweeps", type=int, default=10)
    t.add_argument("--vocabulary", type=int, default=20_000)
    q = sub.add_parser("query", help="a registered query over a folder of tables")
    q.add_argument("name")
    for s in (a, c, t, q):
        s.add_argument("--input", required=True)
        s.add_argument("--output", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("textloom").getOrCreate()
    from textloom.operators.tokens import tokens
    from textloom.sources import text as src

    if o.command == "annotate":
        from textloom.plans.annotators import run

        run(src.read_documents(spark, o.input).withColumnRenamed("name", "doc_id"), o.attributes.split(",")).write.parquet(o.output)
    elif o.command == "classify":
        from textloom.operators.classify import naive_bayes, predict_naive_bayes

        read = lambda p: src.read_directories(spark, p).withColumnRenamed("name", "doc_id")
        feats = lambda d: tokens(d).select(F.col("doc_id").alias("id"), F.col("term").alias("feature"))
        train = read(o.input)
        w = naive_bayes(feats(train), train.select(F.col("doc_id").alias("id"), F.col("label").alias("y")))
        predict_naive_bayes(feats(read(o.test)), w).write.parquet(o.output)
    elif o.command == "topics":
        from textloom.operators.embeddings import vocabulary
        from textloom.operators.topics import lda

        docs = src.read_documents(spark, o.input).select(F.xxhash64("name").alias("doc_id"), "text")
        toks = tokens(docs)
        v = vocabulary(toks, 2, o.vocabulary)
        rows = toks.join(v.select("term", "index"), "term").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "index"))), lambda x: x["index"].cast("int")).alias("words"))
        lda(rows, o.topics, o.vocabulary, o.sweeps)[0].write.parquet(o.output)
    else:
        from textloom.plans.catalog import QUERIES

        QUERIES[o.name](spark, o.input).write.parquet(o.output)


if __name__ == "__main__":
    main()
