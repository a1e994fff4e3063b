"""Readers and writers of text corpora. Line-based formats are read by Spark's text source; sentence and document numbers are
running sums over a file's lines, from sums per split of the files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def read_documents(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(name, text): one document per file, or one per match of `separator`, whose first group is its name. Text before the first
    separator is a document without a name; nothing is dropped."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("text"))
    if separator is None:
        return files
    parts = F.split("text", separator, -1)
    names = F.concat(F.array(F.lit("").cast("string")), F.regexp_extract_all("text", F.lit(separator), F.lit(1)))
    cut = files.select(F.explode(F.arrays_zip(names.alias("name"), parts.alias("text"))).alias("d")).select("d.name", "d.text")
    return cut.where("name <> '' or trim(text) <> ''")


def read_directories(spark: SparkSession, path: str) -> DataFrame:
    """(label, name, text): each file's directory is its label."""
    return read_documents(spark, path).withColumn("label", F.element_at(F.split("name", "/"), -2))


def read_line_groups(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(name, text) per line: the text joins the pattern's groups; lines that don't match are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    groups = F.expr(f"filter(array({', '.join(f'regexp_extract(value, r' + repr(pattern) + f', {g})' for g in range(1, _groups(pattern) + 1))}), x -> x <> '')")
    return lines.select(F.xxhash64("value").alias("name"), F.array_join(groups, " ").alias("text"))


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def _spans_of_splits(keys: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the runs of equal rows."""
    if not len(keys):
        return []
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True))


class _Split:
    """Counts down the lines of one split: lines, gaps, documents, the last gap's place and the lines that follow a gap."""

    def __init__(self, base=(0, 0, 0, -1, 0, True)):
        self.n, self.gaps, self.docs, self.last, self.sents, self.after = base

    def take(self, marks: np.ndarray) -> tuple[np.ndarray, ...]:
        """(n, gap, doc, pos, sent) of the next lines, from their marks: 1 for a gap, 2 for a document's start."""
        gap, n = (marks & 1).astype(bool), self.n + np.arange(len(marks))
        begins = ~gap & np.concatenate([[self.after], gap[:-1]])
        last = np.maximum.accumulate(np.where(gap, n, self.last))
        gaps, docs, sents = self.gaps + np.cumsum(gap), self.docs + np.cumsum(marks >> 1 & 1), self.sents + np.cumsum(begins)
        self.n, self.gaps, self.docs, self.last, self.sents, self.after = int(n[-1]) + 1, int(gaps[-1]), int(docs[-1]), int(last[-1]), int(sents[-1]), bool(gap[-1])
        return n, gaps, docs, n - last - 1, sents - 1


def marked_lines(spark: SparkSession, path: str, gap: Column | None = None, document: Column | None = None) -> DataFrame:
    """(file, file_id, n, line, gap, doc, pos, sent): lines with their place in their file, the gaps and the starts of documents so far,
    the place after the last gap and the number of runs of other lines so far, from 0. Conditions are on `line`.

    Files are split like any text. Each split is counted once for itself, a row a split goes to the driver, and the lines are numbered
    where they are read from the sums of the splits before: nothing is shuffled or sorted, and no file or split is held."""
    lines, name = lines_and_names(spark, path, gap, document)
    return lines.withColumn("file", name)


def lines_and_names(spark: SparkSession, path: str, gap: Column | None = None, document: Column | None = None) -> tuple[DataFrame, Column]:
    """marked_lines() without file, and that column: a name by file_id, so that names need not be shuffled."""
    mark = (F.coalesce(gap, F.lit(False)) if gap is not None else F.lit(False)).cast("int") + (F.coalesce(document, F.lit(False)) if document is not None else F.lit(False)).cast("int") * 2
    m = F.col("_metadata")
    same = lambda p: F.xxhash64(F.regexp_replace(p, "^([^:/]+):/+", "$1:/"))  # one of Spark's two lists of paths has file:///, the other file:/
    lines = spark.read.text(path).select(same(m["file_path"]).alias("f"), m["file_block_start"].alias("b"), m["file_block_length"].alias("z"), F.col("value").alias("line"))
    lines = lines.withColumn("mark", mark.cast("byte"))
    at = ["f", "b", "z"]
    key = lambda batch: np.stack([batch.column(c).to_numpy() for c in at], 1)

    def count(batches):
        open_: dict[tuple, list] = {}
        for batch in batches:
            keys, marks = key(batch), batch.column("mark").to_numpy()
            for i, j in _spans_of_splits(keys):
                k = tuple(keys[i].tolist())
                if k not in open_:
                    open_[k] = [not marks[i] & 1, _Split((0, 0, 0, -1, 0, False))]
                open_[k][1].take(marks[i:j])
        rows = [(*k, token, s.n, s.gaps, s.docs, s.last, s.sents, s.after) for k, (token, s) in open_.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["f", "b", "z", "token", "n", "gaps", "docs", "last", "sents", "after"])

    per = lines.select(*at, "mark").mapInArrow(count, "f long, b long, z long, token boolean, n long, gaps long, docs long, last long, sents long, after boolean")
    names = spark.read.text(path).inputFiles()
    hashed = {r.f: r.p for r in spark.createDataFrame([(x,) for x in names], "p string").select("p", same(F.col("p")).alias("f")).collect()} if names else {}
    bases: dict[tuple, tuple] = {}
    files: dict[int, int] = {}
    for f, b, z, token, n, gaps, docs, last, sents, after in sorted(map(tuple, per.collect())):
        if f not in files:
            files[f], so_far = len(files), (0, 0, 0, -1, 0, True)
        bases[f, b, z] = (files[f], so_far)
        so_far = (so_far[0] + n, so_far[1] + gaps, so_far[2] + docs, so_far[0] + last if last >= 0 else so_far[3], so_far[4] + sents + (token and so_far[5]), after)
    shared = spark.sparkContext.broadcast(bases)

    def number(batches):
        now, split, file = None, None, 0
        for batch in batches:
            keys, marks = key(batch), batch.column("mark").to_numpy()
            parts, ids = [], []
            for i, j in _spans_of_splits(keys):
                k = tuple(keys[i].tolist())
                if k != now:
                    if k not in shared.value:
                        raise RuntimeError("files were split differently when they were counted")
                    now, (file, base) = k, shared.value[k]
                    split = _Split(base)
                parts.append(split.take(marks[i:j]))
                ids.append(np.full(j - i, file))
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), batch.column("line"), *(pa.array(c) for c in columns)], names=["file_id", "line", "n", "gap", "doc", "pos", "sent"])

    out = lines.select(*at, "mark", "line").mapInArrow(number, "file_id long, line string, n long, gap long, doc long, pos long, sent long")
    return out, F.get(F.split(F.lit("\n".join(hashed.get(f, str(f)) for f in files)), "\n"), F.col("file_id").cast("int"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line): lines in their order in each file."""
    return marked_lines(spark, path).select("file", "n", "line")


def read_columns(spark: SparkSession, path: str, names: list[str], separator: str = r"\s+", document: str | None = None) -> DataFrame:
    """(file, doc, sent, pos, *names): a token per line; blank lines end sentences, lines that begin with `document` documents."""
    blank = F.trim("line") == ""
    starts = F.col("line").startswith(document) if document else F.lit(False)
    rows = marked_lines(spark, path, blank | starts, starts).where(~blank & ~starts)
    fields = F.split("line", separator)
    return rows.select("file", "doc", F.col("sent").cast("int").alias("sent"), F.col("pos").cast("int").alias("pos"), *(F.get(fields, i).alias(name) for i, name in enumerate(names)))


def read_owpl(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    return read_columns(spark, path, names or ["word", "label"])


def read_conll2000(spark: SparkSession, path: str) -> DataFrame:
    return read_columns(spark, path, ["word", "pos_tag", "chunk"])


def read_conll2002(spark: SparkSession, path: str) -> DataFrame:
    return read_columns(spark, path, ["word", "ner"], document="-DOCSTART-")


def read_conll2003(spark: SparkSession, path: str) -> DataFrame:
    return read_columns(spark, path, ["word", "pos_tag", "chunk", "ner"], document="-DOCSTART-")


def read_germeval(spark: SparkSession, path: str) -> DataFrame:
    rows = read_columns(spark, path, ["number", "word", "ner", "inner_ner"], r"\t")
    return rows.where(~F.col("number").startswith("#"))


def read_dependencies(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a head and a relation, heads counted from 1 with 0 as root, from ten or more tab-separated fields."""
    names = ["id", "form", "lemma", "lemma2", "pos_tag", "pos_tag2", "feats", "feats2", "head", "head2", "deprel", "deprel2"]
    rows = read_columns(spark, path, names, r"\t")
    return rows.withColumns({c: F.col(c).try_cast("int") for c in ("id", "head", "head2")})


def write_columns(rows: DataFrame, path: str, names: list[str], by: tuple[str, ...] = ("doc", "sent"), separator: str = "\t") -> None:
    """A token per line in its order, an empty line after each sentence; a sentence is one output row, so it stays whole."""
    lines = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(separator, *(F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in names)).alias("line")))).alias("t"))
    lines.orderBy(*by).select(F.concat(F.array_join(F.transform("t", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value")).write.text(path)


def write_owpl(rows: DataFrame, path: str, attributes: list[str]) -> None:
    """Position in the document, position in the sentence from 1, word, attributes."""
    w = Window.partitionBy("doc").orderBy("sent", "pos")
    out = rows.withColumn("at", F.row_number().over(w)).withColumn("in_sentence", F.col("pos") + 1)
    write_columns(out, path, ["at", "in_sentence", "word", *attributes])


def write_dependencies(rows: DataFrame, path: str) -> None:
    write_columns(rows, path, ["id", "form", "lemma", "lemma2", "pos_tag", "pos_tag2", "feats", "feats2", "head", "deprel"])


def read_xml_articles(spark: SparkSession, path: str, title: str = "//title/text()", body: str = "//body//p/text()", date: str = "//pubdata/@date.publication") -> DataFrame:
    """(file, title, body, date) of one XML article per file."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    x = lambda q: F.array_join(F.xpath("value", F.lit(q)), "\n")
    return files.select(F.input_file_name().alias("file"), x(title).alias("title"), x(body).alias("body"), x(date).alias("date"))


def read_relations_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, relation, type, subtype, first, second) of relation mentions in annotation files: ids of both arguments."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    n = F.size(F.xpath("value", F.lit("//relation_mention/@ID")))
    cols = {"relation": "//relation_mention/@ID", "first": "//relation_mention/relation_mention_argument[@ROLE='Arg-1']/@REFID", "second": "//relation_mention/relation_mention_argument[@ROLE='Arg-2']/@REFID"}
    arrays = [F.xpath("value", F.lit(q)).alias(c) for c, q in cols.items()]
    rows = files.where(n > 0).select(F.input_file_name().alias("file"), F.explode(F.arrays_zip(*arrays)).alias("r"))
    return rows.select("file", "r.relation", "r.first", "r.second")


def read_kb(spark: SparkSession, path: str, entity_columns: int = 2) -> DataFrame:
    """(entity, relation, value) of tab-separated cells; the last column is the value, the one before it the relation."""
    fields = F.split("value", r"\t")
    return spark.read.text(path).where("value <> ''").select(F.array_join(F.slice(fields, 1, entity_columns), "\t").alias("entity"), F.get(fields, F.lit(entity_columns)).alias("relation"), F.element_at(fields, -1).try_cast("double").alias("value"))


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) of a text file whose first line is its sizes; vectors come with length one."""
    from textloom.functions.maths import normalised

    fields = F.split(F.trim("value"), " ")
    rows = spark.read.text(path).select(fields.alias("f")).where(F.size("f") > 2)
    return rows.select(F.get("f", F.lit(0)).alias("word"), normalised(F.transform(F.slice("f", 2, F.size("f") - 1), lambda x: x.cast("double"))).alias("vector"))


def read_svmlight(spark: SparkSession, path: str) -> DataFrame:
    """(row, label, features): sparse lines `label index:value ...`; what follows # is a remark."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    f = F.split(line, r"\s+")
    rows = spark.read.text(path).where(line != "")
    pairs = F.transform(F.slice(f, 2, F.size(f)), lambda x: F.struct(F.split(x, ":")[0].cast("int").alias("index"), F.split(x, ":")[1].cast("double").alias("value")))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.get(f, F.lit(0)).alias("label"), pairs.alias("features"))


def write_svmlight(rows: DataFrame, path: str) -> None:
    pairs = F.transform(F.array_sort("features"), lambda x: F.concat(x["index"].cast("string"), F.lit(":"), x["value"].cast("string")))
    rows.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(pairs, " ")).alias("value")).write.text(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(phrase): lower-cased lines, their white space made single; remarks and blank lines are left out."""
    phrase = F.lower(F.trim(F.regexp_replace("value", r"\s+", " ")))
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(phrase.alias("phrase")).where("phrase <> ''").distinct()


def skip_until(text, pattern: str):
    """The text after the first match of a pattern, or all of it."""
    return F.when(text.rlike(pattern), F.regexp_replace(text, rf"(?s)^.*?(?:{pattern})", "")).otherwise(text)


def skip_header(text):
    """The text after its first blank line."""
    return skip_until(text, r"\r?\n\r?\n")


def write_topic_state(docs: DataFrame, alphas: list[float], path: str) -> None:
    """Documents (name, words, topics) of a topic model as text: a line `/alphas ...`, then for each document `/name` and a line `word topic`
    for each word."""
    head = docs.sparkSession.createDataFrame([("/alphas " + " ".join(map(str, alphas)),)], "value string")
    body = F.array_join(F.zip_with("words", "topics", lambda w, z: F.concat_ws(" ", w, z.cast("string"))), "\n")
    head.union(docs.select(F.concat(F.lit("/name "), "name", F.when(F.size("words") > 0, F.concat(F.lit("\n"), body)).otherwise("")))).write.text(path)


def read_topic_state(spark: SparkSession, path: str) -> tuple[DataFrame, list[float]]:
    """What write_topic_state() wrote: (name, words, topics), and the alphas."""
    alphas = spark.read.text(path).where("value like '/alphas %'").first()
    named = F.col("line").startswith("/name ")
    rows = marked_lines(spark, path, document=named).where("line not like '/alphas %'")
    word = F.struct("n", F.split("line", " ")[0].alias("w"), F.split("line", " ")[1].cast("int").alias("z"))
    per = rows.groupBy("file_id", "doc").agg(F.max(F.when(named, F.expr("substring(line, 7)"))).alias("name"), F.array_sort(F.collect_list(F.when(~named, word))).alias("x"))
    return per.select("name", F.transform("x", lambda x: x["w"]).alias("words"), F.transform("x", lambda x: x["z"]).alias("topics")), [float(a) for a in alphas["value"].split()[1:]] if alphas else []


def save_documents(annotated: DataFrame, path: str) -> None:
    """Stores annotated documents, one row each or one per token, so that they can be read by id."""
    annotated.write.mode("append").parquet(path)


def stored_documents(spark: SparkSession, path: str, ids: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if ids is None else rows.join(ids.select(key), key, "left_semi")
