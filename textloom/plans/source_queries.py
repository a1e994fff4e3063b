"""Queries that write tables in the formats of text corpora and read them back: what comes back is told by SQL on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import maths as M
from textloom.operators import tokens as tk
from textloom.plans.registry import query
from textloom.sources import bibliography as bib, corpora, text as src
from textloom.sources.tables import load, scratch

_LINES = "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1 as pos"


def _rows(spark, d):
    """Orders as sentences, their lines as tokens."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")) - 1
    x = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("sent"), pos.alias("pos"), F.concat(F.lit("p"), "l_partkey").alias("word"), F.col("l_returnflag").alias("tag"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("supplier"))
    return x


def _written(spark, rows, name, columns, separator=" "):
    path = scratch(spark, name)
    src.write_columns(rows, path, columns, separator=separator)
    return path


@query(f"select l_orderkey as doc, {_LINES}, 'p' || l_partkey as word, l_returnflag as tag from lineitem")
def owpl_round_trip(spark, d):
    path = scratch(spark, "owpl")
    src.write_owpl(_rows(spark, d), path, ["tag", "doc"])
    back = src.read_columns(spark, path, ["at", "in_sentence", "word", "tag", "doc_id"], "\t")
    return back.select(F.col("doc_id").cast("long").alias("doc"), (F.col("in_sentence").cast("int") - 1).alias("pos"), "word", "tag")


@query(f"select {_LINES}, 'p' || l_partkey as word, l_returnflag as pos_tag, l_linestatus || '-' || l_orderkey as chunk from lineitem")
def conll2000_round_trip(spark, d):
    rows = _rows(spark, d).withColumn("chunk", F.concat_ws("-", "status", "doc"))
    return src.read_conll2000(spark, _written(spark, rows, "conll2000", ["word", "tag", "chunk"])).select("pos", "word", "pos_tag", "chunk")


def _with_document_starts(spark, rows, name, columns, start):
    """A line `start` and an empty line before each document."""
    path = scratch(spark, name)
    line = F.concat_ws(" ", *columns)
    docs = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("t"))
    docs.select(F.concat(F.lit(start + "\n\n"), F.array_join(F.transform("t", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value")).write.text(path)
    return path


@query(f"select {_LINES}, 'p' || l_partkey as word, 'N-' || l_orderkey as ner, count(*) over (partition by l_orderkey) as size from lineitem")
def conll2002_round_trip(spark, d):
    from pyspark.sql import Window

    rows = _rows(spark, d).withColumn("ner", F.concat(F.lit("N-"), "doc"))
    back = src.read_conll2002(spark, _with_document_starts(spark, rows, "conll2002", ["word", "ner"], "-DOCSTART- O"))
    return back.select("pos", "word", "ner", F.count("*").over(Window.partitionBy("file", "doc", "sent")).alias("size"))


@query(f"select {_LINES}, 'p' || l_partkey as word, l_returnflag as pos_tag, l_linestatus as chunk, 'I-' || l_orderkey as ner from lineitem")
def conll2003_round_trip(spark, d):
    rows = _rows(spark, d).withColumn("ner", F.concat(F.lit("I-"), "doc"))
    return src.read_conll2003(spark, _with_document_starts(spark, rows, "conll2003", ["word", "tag", "status", "ner"], "-DOCSTART- -X- O O")).select("pos", "word", "pos_tag", "chunk", "ner")


@query(f"select {_LINES}, 'p' || l_partkey as word, 'B-' || l_returnflag as ner, cast(l_orderkey as varchar) as inner_ner from lineitem")
def germeval_round_trip(spark, d):
    rows = _rows(spark, d).withColumns({"number": F.col("pos") + 1, "ner": F.concat(F.lit("B-"), "tag"), "inner": F.col("doc")})
    return src.read_germeval(spark, _written(spark, rows, "germeval", ["number", "word", "ner", "inner"], "\t")).select("pos", "word", "ner", "inner_ner")


@query(f"select pos, cast(pos + 1 as integer) as id, form, lemma, cast(pos as integer) as head, deprel from (select {_LINES}, 'p' || l_partkey as form, 'o' || l_orderkey as lemma, l_returnflag as deprel from lineitem)")
def dependencies_round_trip(spark, d):
    """Every token's head is the one before it."""
    rows = _rows(spark, d).withColumns({"id": F.col("pos") + 1, "form": F.col("word"), "lemma": F.concat(F.lit("o"), "doc"), "head": F.col("pos"), "deprel": F.col("tag"), **{c: F.lit("_") for c in ("lemma2", "pos_tag", "pos_tag2", "feats", "feats2")}})
    path = scratch(spark, "dependencies")
    src.write_dependencies(rows, path)
    back = src.read_columns(spark, path, ["id", "form", "lemma", "lemma2", "pos_tag", "pos_tag2", "feats", "feats2", "head", "deprel"], "\t")
    return back.select("pos", F.col("id").cast("int").alias("id"), "form", "lemma", F.col("head").cast("int").alias("head"), "deprel")


@query(f"select *, pos + 1 as head from (select {_LINES}, 'p' || l_partkey as form, l_returnflag as pos_tag, 'o' || l_orderkey as deprel from lineitem)")
def treebank_round_trip(spark, d):
    rows = _rows(spark, d).withColumns({"form": F.col("word"), "head": F.col("pos") + 1, "deprel": F.concat(F.lit("o"), "doc")})
    return corpora.read_treebank(spark, _written(spark, rows, "treebank", ["form", "tag", "head", "deprel"], "\t")).select("pos", "form", "pos_tag", "head", "deprel")


@query("with t as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1 as pos, l_suppkey, l_returnflag from lineitem), m as (select doc, pos as first, pos as last, l_suppkey as label from t where l_returnflag = 'R' union all select doc, 0, max(pos), 1000000 + doc from t group by doc having max(pos) > 0) select 'd' || doc as doc, cast(first as integer) as first, cast(last as integer) as last, cast(label as varchar) as label, count(*) as n from m group by 1, 2, 3, 4")
def coref_round_trip(spark, d):
    """Mentions as bracket marks in a column of twelve, read back as spans; a mention of a whole order encloses the others."""
    # an order's lines in their order, dealt out once; mentions, marks and text are made within the row
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    t = load(spark, d, "lineitem").where("l_orderkey is not null").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(line)).alias("t"))
    last = F.size("t") - 1
    mention = lambda first, last, entity: F.struct(first.alias("first"), last.alias("last"), entity.cast("long").alias("entity"))
    one = F.filter(F.transform("t", lambda x, i: F.when(x["l_returnflag"] == "R", mention(i, i, x["l_suppkey"]))), lambda m: m.isNotNull())
    whole = F.when(last > 0, F.array(mention(F.lit(0), last, F.col("doc") + 1_000_000))).otherwise(F.slice(one, 1, 0))
    docs = t.select("doc", "t", F.concat(one, whole).alias("m")).select("doc", "t", corpora.coref_marks(F.size("t"), F.col("m")).alias("marks"))
    cells = lambda x, i: F.concat_ws(" ", F.concat(F.lit("d"), "doc"), F.lit("0"), i.cast("string"), F.concat(F.lit("p"), x["l_partkey"]), x["l_returnflag"], F.lit("* - - - -"), F.lit("*"), F.get("marks", i))
    path = scratch(spark, "coref")
    docs.select(F.concat(F.lit("#begin document (d"), F.col("doc").cast("string"), F.lit("); part 000\n"), F.array_join(F.transform("t", cells), "\n"), F.lit("\n\n#end document")).alias("value")).write.text(path)
    back = corpora.read_conll2011(spark, path).select("doc", F.explode("coref").alias("m"))
    return back.groupBy("doc", "m.first", "m.last", "m.label").agg(F.count("*").alias("n"))


@query("select 'label=' || o_orderpriority as label, count(*) as n, cast(sum(length(cast(o_orderkey as varchar))) as bigint) as chars from orders group by 1")
def labelled_directories(spark, d):
    path = scratch(spark, "directories")
    load(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").cast("string").alias("value")).write.partitionBy("label").text(path)
    back = src.read_directories(spark, path).select(F.url_decode("label").alias("label"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return back.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query("select n_name || ' ' || cast(n_regionkey as varchar) as text from nation where n_nationkey % 3 <> 0")
def line_groups(spark, d):
    path = scratch(spark, "lines")
    load(spark, d, "nation").select(F.concat(F.when(F.col("n_nationkey") % 3 == 0, "skip ").otherwise("id "), F.col("n_nationkey").cast("string"), F.lit("\t"), "n_name", F.lit("\t"), F.col("n_regionkey").cast("string")).alias("value")).write.text(path)
    return src.read_line_groups(spark, path, "^id [0-9]+\t([^\t]+)\t([0-9]+)$").select("text")


@query("select l_suppkey || chr(9) || l_partkey as entity, l_returnflag as relation, count(*)::double as value from lineitem group by 1, 2")
def kb_round_trip(spark, d):
    path = scratch(spark, "kb")
    load(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey", "l_returnflag").count().select(F.concat_ws("\t", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag", F.col("count").cast("string")).alias("value")).write.text(path)
    return src.read_kb(spark, path, 2)


@query("select 'v' || vec_id as word, 64 as n, list_position(embedding, list_max(embedding)) - 1 as top, 1.0 as norm from embeddings")
def embedding_file_round_trip(spark, d):
    path = scratch(spark, "embeddings")
    load(spark, d, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.lit(" "), F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("value")).write.text(path)
    return src.read_embeddings(spark, path).select("word", F.size("vector").alias("n"), M.index_of_max(F.col("vector")).cast("int").alias("top"), F.round(M.norm(F.col("vector")), 6).alias("norm"))


@query("select l_returnflag as label, l_suppkey as index, l_linenumber::double as value, count(*) as n from lineitem group by 1, 2, 3")
def svmlight_round_trip(spark, d):
    path = scratch(spark, "svmlight")
    rows = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), F.array(F.struct(F.col("l_suppkey").cast("int").alias("index"), F.col("l_linenumber").cast("double").alias("value"))).alias("features"))
    src.write_svmlight(rows, path)
    return src.read_svmlight(spark, path).select("label", F.explode("features").alias("f")).groupBy("label", F.col("f.index").cast("long").alias("index"), "f.value").agg(F.count("*").alias("n"))


@query("select distinct lower(trim(regexp_replace(p_name, '[ \\t]+', ' ', 'g'))) as phrase from part where p_size > 2 union select distinct lower(n_name) from nation")
def lexicon_union(spark, d):
    from textloom.operators.relations import any_of

    path = scratch(spark, "lexicon")
    load(spark, d, "part").select(F.when(F.col("p_size") > 2, F.concat(F.lit("  "), F.regexp_replace("p_name", " ", "   "))).otherwise(F.concat(F.lit("# "), "p_name")).alias("value")).write.text(path)
    return any_of(src.read_lexicon(spark, path), load(spark, d, "nation").select(F.lower("n_name").alias("phrase")))


@query("select n_name as title, 'line ' || n_nationkey || chr(10) || 'more' as body, cast(1990 + n_regionkey as varchar) as date from nation")
def xml_articles(spark, d):
    path = scratch(spark, "articles")
    n = load(spark, d, "nation").select(F.format_string("<nitf><head><title>%s</title><pubdata date.publication='%d'/></head><body><p>line %d</p><p>more</p></body></nitf>", "n_name", F.col("n_regionkey") + 1990, "n_nationkey").alias("value"))
    n.write.option("maxRecordsPerFile", 1).text(path)
    return src.read_xml_articles(spark, path).select("title", "body", "date")


@query("select 'R' || n_nationkey as relation, 'E' || n_nationkey as first, 'E' || n_regionkey as second from nation")
def xml_relations(spark, d):
    path = scratch(spark, "relations")
    n = load(spark, d, "nation").select(F.format_string("<doc><relation ID='x'><relation_mention ID='R%1$d'><relation_mention_argument ROLE='Arg-1' REFID='E%1$d'/><relation_mention_argument ROLE='Arg-2' REFID='E%2$d'/></relation_mention></relation></doc>", "n_nationkey", "n_regionkey").alias("value"))
    n.write.option("maxRecordsPerFile", 1).text(path)
    return src.read_relations_xml(spark, path).select("relation", "first", "second")


@query("select cast(doc_id as varchar) as doc, lang as kind, trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g')) as text from documents where text not like '%<%'")
def sectioned_documents(spark, d):
    path = scratch(spark, "sections")
    x = load(spark, d, "documents").where("text not like '%<%'").select(F.concat(F.lit("<DOC id=\""), F.col("doc_id").cast("string"), F.lit("\"><DOCTYPE> "), "lang", F.lit(" </DOCTYPE><BODY>"), F.regexp_replace("text", "[ \\t\\r\\n\\f]+", " "), F.lit("</BODY></DOC>")).alias("value"))
    x.write.text(path)
    return corpora.read_sectioned(spark, path)


@query("select n_name as title, 'about ' || n_nationkey || chr(10) || '[[x]] inside ' || n_regionkey as text from nation")
def encyclopedia_articles(spark, d):
    path = scratch(spark, "encyclopedia")
    load(spark, d, "nation").select(F.format_string("[[%s]]\n\nabout %d\n[[x]] inside %d\n", "n_name", "n_nationkey", "n_regionkey").alias("value")).coalesce(1).write.text(path)
    return corpora.read_encyclopedia(spark, path)


@query("select 'n' || lpad(cast(n_nationkey as varchar), 8, '0') as synset, lower(n_name) as word, '@' as relation, 'n' || lpad(cast(100 + n_regionkey as varchar), 8, '0') as target from nation")
def lexical_database(spark, d):
    path = scratch(spark, "synsets")
    load(spark, d, "nation").select(F.format_string("%08d 03 n 01 %s 0 001 @ %08d n 0000 | a nation", "n_nationkey", "n_name", F.col("n_regionkey") + 100).alias("value")).write.text(path)
    synsets, links = corpora.read_synsets(spark, path)
    return synsets.join(links, "synset").select("synset", F.explode("words").alias("word"), "relation", "target")


@query("with n as (select s_suppkey, 'Given' || s_suppkey % 7 as given, case when s_suppkey % 3 = 0 then 'van ' else '' end || 'Sur' || s_suppkey as surname, case when s_suppkey % 5 = 0 then 'Jr.' else '' end as heredity from supplier) select 'k' || s_suppkey as key, 'Title ' || s_suppkey as title, cast(1900 + s_suppkey % 100 as varchar) as year, given, surname, heredity, 'gsur' || s_suppkey as canopy from n")
def bibtex_authors(spark, d):
    """Entries written as BibTeX, parsed, and their authors' names parsed."""
    k = F.col("s_suppkey")
    given, surname = F.concat(F.lit("Given"), (k % 7).cast("string")), F.concat(F.when(k % 3 == 0, "van ").otherwise(""), F.lit("Sur"), k.cast("string"))
    author = F.when(k % 2 == 0, F.concat(given, F.lit(" "), surname, F.when(k % 5 == 0, ", Jr.").otherwise(""))).otherwise(F.concat(surname, F.when(k % 5 == 0, " Jr.").otherwise(""), F.lit(", "), given))
    text = F.concat(F.lit("@string{t = \"Title \"}\n@article{k"), k.cast("string"), F.lit(",\n author = {"), author, F.lit("},\n title = t # \""), k.cast("string"), F.lit("\", year = "), (k % 100 + 1900).cast("string"), F.lit("}"))
    entries = bib.bibtex_entries(load(spark, d, "supplier").select(text.alias("text")))
    names = bib.entry_names(entries).select("key", "parsed")
    return entries.join(names, "key").select("key", F.col("fields")["title"].alias("title"), F.col("fields")["year"].alias("year"), F.array_join("parsed.given", " ").alias("given"), F.col("parsed.surname").alias("surname"), F.col("parsed.heredity").alias("heredity"), F.col("parsed.canopy").alias("canopy"))


@query("select doc_id, len(w) as n, cast(list_sum(list_transform(w, lambda x: len(x))) as bigint) as chars from (select doc_id, regexp_extract_all(text, '[^ \\n]+') as w from documents) where len(w) > 0")
def packed_token_offsets(spark, d):
    """Offsets packed into integers and back: the tokens' lengths come out again."""
    sizes = F.transform(F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0)), lambda x: F.length(x))
    x = load(spark, d, "documents").select("doc_id", sizes.alias("size")).where("size(size) > 0")
    x = x.select("doc_id", tk.unpacked_offsets(F.transform("size", lambda n: F.shiftleft(F.lit(1).cast("long"), 16) + n)).alias("o"))  # each token one after the last
    x = x.select("doc_id", F.transform("o", lambda t: t["start"]).alias("s"), F.transform("o", lambda t: t["end"]).alias("e"))
    x = x.select("doc_id", tk.packed_offsets(F.col("s"), F.col("e")).alias("p"))
    return x.select("doc_id", F.size("p").cast("long").alias("n"), F.aggregate(tk.unpacked_offsets(F.col("p")), F.lit(0).cast("long"), lambda a, t: a + t["end"] - t["start"]).alias("chars"))


@query("select conv_id || '-' || turn as name, len(w) as n, cast(sum(i % 4) as bigint) as topics, 3 as alphas, any_value(w[1]) as first from (select conv_id, turn, w, unnest(range(0, len(w))) as i from (select conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') as w from conversations where text is not null)) group by conv_id, turn, w")
def topic_state_round_trip(spark, d):
    path = scratch(spark, "topics")
    x = load(spark, d, "conversations").where("text is not null").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("name"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("words")).where("size(words) > 0")
    src.write_topic_state(x.withColumn("topics", F.transform("words", lambda w, i: i % 4)), [0.1, 0.2, 0.3], path)
    back, alphas = src.read_topic_state(spark, path)
    return back.select("name", F.size("words").cast("long").alias("n"), F.aggregate("topics", F.lit(0).cast("long"), lambda a, z: a + z).alias("topics"), F.lit(len(alphas)).alias("alphas"), F.get("words", F.lit(0)).alias("first"))


@query("select doc_id, n_chars, length(text) as size from documents where doc_id in (select doc_id from labels)")
def document_store(spark, d):
    path = scratch(spark, "store")
    src.save_documents(load(spark, d, "documents").select("doc_id", "n_chars", F.length("text").cast("long").alias("size")), path)
    return src.stored_documents(spark, path, load(spark, d, "labels"))


@query("select page_id, case when html like '%<body>%' then substring(html, strpos(html, '<body>') + 6) else html end as body, case when strpos(url, '?') > 0 then substring(url, strpos(url, '?') + 1) else url end as after from pages")
def skipped_headers(spark, d):
    return load(spark, d, "pages").select("page_id", src.skip_until(F.col("html"), "<body>").alias("body"), src.skip_until(F.col("url"), r"\?").alias("after"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey offset 10 limit 25")
def cursor_page(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25)


@query("select 'E' || n_nationkey as entity, 'E' || n_nationkey || '-1' as mention, case when n_regionkey < 2 then 'NAM' else 'NOM' end as kind, n_nationkey * 3 as first, n_nationkey * 3 + length(n_name) // 4 as last from nation")
def mention_annotations(spark, d):
    """Mentions of annotation files by raw offsets, mapped to tokens of four characters."""
    path = scratch(spark, "mentions")
    n = load(spark, d, "nation")
    at = F.col("n_nationkey") * 12
    xml = F.format_string("<doc><entity ID='E%1$d'><entity_mention ID='E%1$d-1' TYPE='%2$s'><extent><charseq START='%3$d' END='%4$d'>x</charseq></extent></entity_mention></entity></doc>", "n_nationkey", F.when(F.col("n_regionkey") < 2, "NAM").otherwise("NOM"), at, at + F.length("n_name"))
    n.select(xml.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    found = corpora.read_mentions_xml(spark, path).withColumn("doc_id", F.lit(1))
    toks = spark.range(400).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), (F.col("id") * 4).cast("int").alias("start"), (F.col("id") * 4 + 4).cast("int").alias("end"))
    return found.join(corpora.mentions_on_tokens(found, toks), ["doc_id", "mention"]).select("entity", "mention", "kind", "first", "last")


@query("select vec_id, i - 1 as dim, embedding[i]::double as x from (select vec_id, embedding, unnest(range(1, 9)) as i from embeddings)")
def stored_arrays(spark, d):
    """Vectors as one array of a model, stored in blocks and read back."""
    import numpy as np

    from textloom.sources import models

    path = scratch(spark, "model")
    e = load(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 8).alias("v")).orderBy("vec_id").toArrow()
    models.save_arrays(spark, {"v": np.array(e.column("v").to_pylist(), np.float32), "ids": e.column("vec_id").to_numpy()}, path)
    a = models.load_arrays(spark, path)
    rows = [(int(i), k, float(x)) for i, v in zip(a["ids"], a["v"], strict=True) for k, x in enumerate(v)]
    return spark.createDataFrame(rows, "vec_id long, dim int, x double")
