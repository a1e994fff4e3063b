from pyspark.sql import functions as F

from textloom.operators import tokens as tk
from textloom.sources import bibliography as bib, text as src
from textloom.streaming import events as ev


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_columns_and_spans(spark, tmp_path):
    p = put(tmp_path / "ner.txt", "-DOCSTART- -X- O O\n\nEU NNP B I-ORG\nrejects VBZ B O\nGerman JJ B I-MISC\ncall NN I O\n\nPeter NNP B I-PER\nBlack NNP I I-PER\n-DOCSTART- -X- O O\n\nBonn NNP B I-LOC\n")
    rows = src.read_conll2003(spark, p)
    assert rows.groupBy("doc", "sent").count().count() == 3 and rows.agg(F.max("doc")).first()[0] == 2
    b = tk.iob_to_bilou(rows.select("sent", "pos", "word", F.col("ner").alias("tag")), "sent")
    assert [r.tag for r in b.orderBy("sent", "pos").collect()] == ["U-ORG", "O", "U-MISC", "O", "B-PER", "L-PER", "U-LOC"]
    spans = {(r.label, r.first, r.last) for r in tk.decode_bilou(b, "sent").collect()}
    assert spans == {("ORG", 0, 0), ("MISC", 2, 2), ("PER", 0, 1), ("LOC", 0, 0)}
    src.write_owpl(rows, str(tmp_path / "out"), ["ner"])
    again = src.read_columns(spark, str(tmp_path / "out"), ["at", "i", "word", "ner"], "\t")
    assert sorted(r.word for r in again.collect()) == sorted(r.word for r in rows.collect())


def test_dependencies(spark, tmp_path):
    line = lambda i, w, h: "\t".join([str(i), w, w, w, "N", "N", "_", "_", str(h), str(h), "x", "x"])
    rows = src.read_dependencies(spark, put(tmp_path / "d.txt", line(1, "a", 2) + "\n" + line(2, "b", 0) + "\n\n" + line(1, "c", 0) + "\n"))
    assert [(r.sent, r.form, r["head"]) for r in rows.orderBy("sent", "pos").collect()] == [(0, "a", 2), (0, "b", 0), (1, "c", 0)]
    src.write_dependencies(rows, str(tmp_path / "o"))


def test_documents(spark, tmp_path):
    put(tmp_path / "c/x/1.txt", "one")
    put(tmp_path / "c/y/2.txt", "two")
    assert {(r.label, r.text) for r in src.read_directories(spark, str(tmp_path / "c")).collect()} == {("x", "one"), ("y", "two")}
    p = put(tmp_path / "s.txt", "=a=\nfirst\n=b=\nsecond")
    assert {(r.name, r.text.strip()) for r in src.read_documents(spark, p, "=([a-z])=").collect()} == {("a", "first"), ("b", "second")}
    e = src.read_embeddings(spark, put(tmp_path / "v.txt", "2 2\nup 3 4\ndown 0 2\n"))
    assert {r.word: list(r.vector) for r in e.collect()} == {"up": [0.6, 0.8], "down": [0.0, 1.0]}
    s = src.read_svmlight(spark, put(tmp_path / "f.txt", "1 3:0.5 7:2 # no\n-1 1:1\n"))
    assert {r.label: [tuple(f) for f in r.features] for r in s.collect()} == {"1": [(3, 0.5), (7, 2.0)], "-1": [(1, 1.0)]}
    k = src.read_kb(spark, put(tmp_path / "k.tsv", "a\tb\tknows\t1\n")).first()
    assert (k.entity, k.relation, k.value) == ("a\tb", "knows", 1.0)
    x = src.read_xml_articles(spark, put(tmp_path / "n.xml", "<nitf><head><title>T</title><pubdata date.publication='2001'/></head><body><p>one</p><p>two</p></body></nitf>")).first()
    assert (x.title, x.body, x.date) == ("T", "one\ntwo", "2001")


def test_names_and_bibtex(spark):
    n = bib.parse_name("Dr. Ludwig van Beethoven Jr., PhD")
    assert (n.given, n.surname, n.heredity, n.degrees) == (["Ludwig"], "van Beethoven", "Jr.", ["PhD"])
    m = bib.parse_name("Beethoven, L.")
    assert m.surname == "Beethoven" and not bib.compatible(n, m) and bib.compatible(bib.parse_name("L. Lee"), bib.parse_name("Lucy Ann Lee"))
    assert bib.merge_names(bib.parse_name("L. Lee"), bib.parse_name("Lucy Lee")).given == ["Lucy"] and bib.author_canopy(n) == "lbeethoven"
    text = '@string{acm = "ACM"} @comment{x} @article{k1, author = {Ann Lee and Bob {van Ray}}, title = "A {B} c", journal = acm # " Press", year = 1999, month = jan}'
    e = bib.parse_bibtex(text)
    assert e == [{"type": "article", "key": "k1", "fields": {"author": "Ann Lee and Bob {van Ray}", "title": "A {B} c", "journal": "ACM Press", "year": "1999", "month": "jan"}}]
    df = spark.createDataFrame([(text,)], "text string")
    assert [r.parsed.surname for r in bib.entry_names(bib.bibtex_entries(df)).collect()][0] == "Lee"


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    q = ev.windowed_counts(ev.read_stream(spark, str(tmp_path / "in"), e.schema), "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    a = {(r.window_start, r.event_type): r.n for r in spark.table("w").collect()}
    b = {(r.window_start, r.event_type): r.n for r in ev.windowed_counts(e, "1 hour").collect()}
    assert a == b
    docs = spark.createDataFrame([(1, "a b a")], "doc_id long, text string")
    for k in (0, 0, 1):
        ev.incremental_vocabulary(docs, k, str(tmp_path / "voc"))
    assert {r.term: r.n for r in ev.vocabulary_so_far(spark, str(tmp_path / "voc")).collect()} == {"a": 4, "b": 2}


def test_entities_of_a_stream_keep_their_first_document(spark, tmp_path):
    schema = "doc_id long, string string"
    for k, rows in enumerate([[(3, "Ann"), (2, "ann"), (4, "Bob")], [(1, "ANN"), (5, "Eve"), (6, None)], [(9, "bob")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = ev.stream_entities(stream).writeStream.outputMode("append").format("memory").queryName("entities").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    rows = {(r.name, r.doc_id): (r.entity, r.seen) for r in spark.table("entities").collect()}
    assert len(rows) == 6 and len({rows[k][0] for k in rows if k[0] == "ann"}) == 1 and {rows[k][1] for k in rows if k[0] == "ann"} == {1, 2, 3}
    assert rows[("eve", 5)] == (5, 1) and rows[("bob", 4)][0] == rows[("bob", 9)][0]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """Splits shorter than a line, than a sentence and than a file give what whole files give, and no file meets in one task."""
    import random

    r = random.Random(3)
    want = set()
    for f in range(3):
        lines = [r.choice(["", "a b", "# x", "c" * 30, "-D-"]) for _ in range(400 * f)]
        put(tmp_path / "in" / f"f {f}.txt", "\n".join(lines) + "\n" * bool(lines))
        doc, sent, pos, fresh = 0, -1, 0, True
        for line in lines:
            if line in ("", "-D-"):
                doc, fresh = doc + (line == "-D-"), True
                continue
            sent, pos, fresh = (sent + 1, 0, False) if fresh else (sent, pos + 1, False)
            want.add((f"{f}", doc, sent, pos, line.split(" ")[0]))
    for size in ("64b", "1000b", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = src.read_columns(spark, str(tmp_path / "in"), ["w"], " ", document="-D-")
            assert {(x.file[-5], x.doc, x.sent, x.pos, x.w) for x in rows.collect()} == want
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert "Window" not in plan and "Exchange" not in plan
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
