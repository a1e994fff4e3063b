"""Readers of annotated corpora whose lines or documents have inner structure."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textloom.sources.text import lines_and_names, marked_lines, read_columns

_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def bracket_spans(cells: list[str]) -> list[tuple[str, int, int]]:
    """(label, first, last) of a column of bracket marks such as `(3`, `(1)`, `3)` or `(3|(4`, crossing spans included."""
    open_: dict[str, list[int]] = {}
    out = []
    for i, cell in enumerate(cells):
        for mark in cell.split("|"):
            if m := re.fullmatch(r"(\()?([^()\s]+?)(\))?", mark.strip()):
                if m[2] in ("-", "_", "*"):
                    continue
                if m[1]:
                    open_.setdefault(m[2], []).append(i)
                if m[3] and open_.get(m[2]):
                    out.append((m[2], open_[m[2]].pop(), i))
    return sorted(out, key=lambda s: (s[1], -s[2], s[0]))


def constituents(cells: list[str]) -> list[tuple[str, int, int]]:
    """(label, first, last) of a column of tree pieces such as `(S(NP*`, `*)`: each `*` is a token."""
    stack, out = [], []
    for i, cell in enumerate(cells):
        for m in re.finditer(r"\(([^\s()*]+)|\)", cell):
            if m[1]:
                stack.append((m[1], i))
            elif stack:
                label, first = stack.pop()
                out.append((label, first, i))
    return sorted(out, key=lambda s: (s[1], -s[2]))


SPANS = "array<struct<label:string,first:int,last:int>>"


def read_conll2011(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc, part, sent, words, tags, ner, constituents, coref): a sentence per row; `#begin document` starts documents."""
    lines, name = lines_and_names(spark, path, F.trim("line") == "", F.col("line").startswith("#begin document"))
    rows = lines.where(~F.col("line").startswith("#") & (F.trim("line") != "")).select("file_id", F.col("doc").alias("number"), "gap", "n", "line")
    key = ["file_id", "number", "gap"]

    def gather(batches):
        """Neighbouring lines of a sentence in one row, so that what is dealt out are sentences, not tokens; a batch may cut one."""
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in key], 1)
            at = np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), (keys[1:] != keys[:-1]).any(1)])).tolist()
            text = b.column("line").to_pylist()
            first = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(first) for c in (*key, "n")), pa.array(["\n".join(text[i:j]) for i, j in zip(at, [*at[1:], len(text)], strict=True)], pa.string())], names=[*key, "n", "lines"])

    parts = rows.mapInArrow(gather, "file_id long, number long, gap long, n long, lines string")
    sents = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("n", "lines"))).alias("t")).select(*key, F.array_join("t.lines", "\n").alias("lines"))

    def run(batches):
        for pdf in batches:
            rows = []
            for file, d, gap, lines in pdf[[*key, "lines"]].itertuples(index=False):
                t = [f for x in lines.split("\n") if len(f := _SPACE.split(x.strip(" "))) > 11]
                if not t:
                    continue
                col = lambda i, t=t: [f[i] for f in t]
                as_rows = lambda spans: [{"label": a, "first": b, "last": c} for a, b, c in spans]
                rows.append((int(file), t[0][0], t[0][1], int(d), int(gap), col(3), col(4), as_rows(constituents([x.replace("*", "") for x in col(10)])), as_rows(constituents(col(5))), as_rows(bracket_spans(col(-1)))))
            yield pd.DataFrame(rows, columns=[*key[:1], "doc", "part", *key[1:], "words", "tags", "ner", "constituents", "coref"])

    out = sents.mapInPandas(run, f"file_id long, doc string, part string, number int, gap int, words array<string>, tags array<string>, ner {SPANS}, constituents {SPANS}, coref {SPANS}")
    out = out.withColumn("sent", F.dense_rank().over(Window.partitionBy("file_id", "number").orderBy("gap")) - 1)
    return out.select(name.alias("file"), "doc", "part", "number", "words", "tags", "ner", "constituents", "coref", "sent")


def coref_column(mentions: DataFrame, toks: DataFrame) -> DataFrame:
    """(doc_id, pos, coref): token rows with the bracket marks of mentions (doc_id, first, last, entity)."""
    e = F.col("entity").cast("string")
    mark = lambda pos, k, m: F.struct(F.col(pos).alias("pos"), F.lit(k).alias("k"), m.alias("m"))
    of = F.when(F.col("first") < F.col("last"), F.array(mark("first", 0, F.concat(F.lit("("), e)), mark("last", 2, F.concat(e, F.lit(")"))))).when(F.col("first") == F.col("last"), F.array(mark("first", 1, F.concat(F.lit("("), e, F.lit(")")))))
    marks = mentions.select("doc_id", F.explode(of).alias("x")).select("doc_id", "x.*")
    per = marks.groupBy("doc_id", "pos").agg(_joined_marks(F.array_sort(F.collect_list(F.struct("k", "m")))).alias("coref"))
    return toks.select("doc_id", "pos").join(per, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("coref", F.lit("-")).alias("coref"))


def _joined_marks(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda x: x["m"]), "|")


def coref_marks(n: Column, mentions: Column) -> Column:
    """The column of coref_column() for one text of n tokens: an array, from an array of mentions (first, last, entity). Every place looks
    at every mention, so it is for short texts."""

    def at(i):
        own = F.transform(F.filter(mentions, lambda m: (m["first"] == i) | (m["last"] == i) & (m["first"] < m["last"])), lambda m: _mark(m, i))
        return F.when(F.size(own) > 0, _joined_marks(F.array_sort(own))).otherwise("-")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), at)).otherwise(F.array().cast("array<string>"))


def _mark(m: Column, i: Column) -> Column:
    e, long = m["entity"].cast("string"), m["first"] < m["last"]
    opens = m["first"] == i
    return F.struct(F.when(~long, 1).when(opens, 0).otherwise(2).alias("k"), F.when(~long, F.concat(F.lit("("), e, F.lit(")"))).when(opens, F.concat(F.lit("("), e)).otherwise(F.concat(e, F.lit(")"))).alias("m"))


def read_treebank(spark: SparkSession, path: str) -> DataFrame:
    """Rows of word, tag, head and relation, tab-separated, heads from 1 with 0 as root."""
    return read_columns(spark, path, ["form", "pos_tag", "head", "deprel"], r"\t").withColumn("head", F.col("head").try_cast("int"))


def read_sectioned(spark: SparkSession, path: str, begin: str = r"(?i)<doc[^>]*\bid=\"([^\"]+)\"[^>]*>", end: str = "</DOC>", kind: str = r"(?i)<doctype[^>]*>\s*([^<]*?)\s*</doctype>") -> DataFrame:
    """(doc, kind, text) of files that hold many marked documents, read one by one: `end` is the literal mark that closes each."""
    records = spark.read.option("lineSep", end).text(path).where(F.col("value").rlike(begin))
    docs = records.select(F.regexp_replace("value", rf"(?s)^.*?(?={begin})", "").alias("raw"))
    body = F.regexp_replace(F.regexp_replace("raw", begin, ""), kind, "")
    return docs.select(F.regexp_extract("raw", begin, 1).alias("doc"), F.regexp_extract("raw", kind, 1).alias("kind"), F.trim(F.regexp_replace(body, "<[^>]+>", " ")).alias("text"))


def read_encyclopedia(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of plain-text dumps whose articles begin with `[[title]]` alone on a line."""
    title = F.regexp_extract("line", r"^\[\[([^\]]+)\]\][ \t]*$", 1)
    lines = marked_lines(spark, path, document=title != "").withColumn("title", title).withColumnRenamed("doc", "article").where("article > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title") == "", F.struct("n", "line")))), lambda x: x["line"]), "\n")
    rows = lines.groupBy("file", "article").agg(F.max("title").alias("title"), body.alias("text"))
    return rows.select("title", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text"))


def read_synsets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Synsets (synset, kind, words) and relations (synset, relation, target) of a lexical database's data files."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\d{8} "))
    f = F.split(F.split("value", r" \| ")[0], " ")
    n = F.conv(F.get(f, F.lit(3)), 16, 10).cast("int")
    words = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lower(F.get(f, i * 2 + 4)))
    at = n * 2 + 4
    m = F.get(f, at).cast("int")
    links = F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(F.get(f, at + 1 + i * 4).alias("relation"), F.concat(F.get(f, at + 3 + i * 4), F.get(f, at + 2 + i * 4)).alias("target"))))
    rows = lines.select(F.concat(F.get(f, F.lit(2)), F.get(f, F.lit(0))).alias("synset"), F.get(f, F.lit(2)).alias("kind"), words.alias("words"), links.alias("links"))
    return rows.select("synset", "kind", "words"), rows.select("synset", F.explode("links").alias("l")).select("synset", "l.relation", "l.target")


def read_exceptions(spark: SparkSession, path: str) -> DataFrame:
    """(form, base) of irregular word forms."""
    f = F.split("value", " ")
    return spark.read.text(path).where(F.size(f) > 1).select(f[0].alias("form"), f[1].alias("base"))


def to_json(rows: DataFrame, into: str = "json") -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(into))


def from_json(rows: DataFrame, schema: str, column: str = "json") -> DataFrame:
    return rows.select(F.from_json(column, schema).alias("r")).select("r.*")


def read_mentions_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, entity, mention, kind, start, end) of entity mentions in annotation files, one file a value: raw character offsets, the end
    exclusive."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    base = "//entity/entity_mention"
    x = lambda q: F.xpath("value", F.lit(q))
    cols = {"mention": f"{base}/@ID", "kind": f"{base}/@TYPE", "start": f"{base}/extent/charseq/@START", "end": f"{base}/extent/charseq/@END"}
    rows = files.select(F.input_file_name().alias("file"), F.explode(F.arrays_zip(*(x(q).alias(c) for c, q in cols.items()))).alias("m"))
    entity = F.regexp_replace("m.mention", r"-[^-]*$", "")
    return rows.select("file", entity.alias("entity"), "m.mention", "m.kind", F.col("m.start").cast("int").alias("start"), (F.col("m.end").cast("int") + 1).alias("end"))


def mentions_on_tokens(mentions: DataFrame, toks: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, mention, first, last): raw offsets mapped to the tokens (by, pos, start, end) that they overlap; mentions between tokens have
    none and are left out."""
    t = toks.select(by, "pos", F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = mentions.join(t, by).where("_s < end and start < _e")
    return met.groupBy(by, "mention").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
