import random

from textloom.operators import tagging as tg


def sentences(spark, n=80):
    r = random.Random(1)
    nouns, verbs, marks = ["dog", "cat", "house", "walk"], ["runs", "sees", "walk"], ["the", "a"]
    rows = []
    for _ in range(n):
        words, tags = [], []
        for kind in "DNVDN":
            words.append(r.choice({"D": marks, "N": nouns, "V": verbs}[kind]))
            tags.append({"D": "DT", "N": "NN", "V": "VB"}[kind])
        rows.append((words, tags))
    return spark.createDataFrame(rows, "words array<string>, tags array<string>")


def test_forward_tagger_uses_the_tags_before(spark):
    rows = sentences(spark)
    model = tg.train_forward(rows, ["DT", "NN", "VB"], passes=3, shards=2, size=1 << 12, sure_count=20)
    assert model.sure["the"] == 0 and "walk" not in model.sure
    out = tg.tag_forward(rows, model).collect()
    assert sum(r.tags == r.predicted for r in out) >= 0.95 * len(out)
    empty = spark.createDataFrame([([],), (None,)], "words array<string>")
    assert [r.predicted for r in tg.tag_forward(empty, model).collect()] == [[], []]


def test_stacked_chains_see_the_first(spark):
    rows = spark.createDataFrame([(["Ann", "Lee", "saw", "Bonn"], ["B-P", "I-P", "O", "B-L"]), (["in", "Bonn", "Lee", "ran"], ["O", "B-L", "B-P", "O"])] * 10, "words array<string>, tags array<string>")
    models = tg.train_stacked(rows, ["O", "B-P", "I-P", "B-L", "I-L"], passes=4, shards=1, size=1 << 12)
    out = tg.tag_stacked(rows, models).collect()
    assert all(r.tags == r.predicted for r in out) and out[0].words[0] in ("Ann", "in")


def test_segmenter_learns_words(spark):
    r = random.Random(2)
    rows = spark.createDataFrame([([r.choice(["我们", "喜欢", "中国", "人", "好"]) for _ in range(6)],) for _ in range(60)], "words array<string>")
    model = tg.train_segmenter(rows, passes=3, shards=1, size=1 << 12)
    out = tg.cut_words(spark.createDataFrame([("我们喜欢中国",), ("好人",)], "text string"), model).collect()
    assert [x.words for x in out] == [["我们", "喜欢", "中国"], ["好", "人"]]


def test_unsupervised_sentences(spark):
    text = "He met Dr. Smith at approx. noon. She left. It was approx. five! \"Why?\" he asked. J. Doe came."
    assert [text[a:b] for a, b in tg.cut_sentences(text, {"dr", "approx"})] == ["He met Dr. Smith at approx. noon.", "She left.", "It was approx. five!", "\"Why?\" he asked.", "J. Doe came."]
    assert tg.own_abbreviations(text) == {"approx"}
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    for mode, n in (("document", 6), ("none", 6), ("joint", None)):
        rows = tg.unsupervised_sentences(docs, mode).collect()
        assert {r.doc_id for r in rows} == {1} and (n is None or len(rows) == n)


def test_tags_and_forms(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("NNS", "city", "cities"), ("VBZ", "box", "boxes"), ("??", "wolf", "wolves"), ("PRP$", "day", "days"), ("IN", "child", "children")], "t string, one string, many string")
    out = df.select(tg.universal_tag(F.col("t")).alias("u"), "one", "many", tg.plural(F.col("one")).alias("p"), tg.singular(F.col("many")).alias("s")).collect()
    assert [r.u for r in out] == ["NOUN", "VERB", "X", "PRON", "ADP"] and all((r.p, r.s) == (r.many, r.one) for r in out)


def test_words_of_tags_by_batches(spark):
    """Nulls, empty arrays, characters of several bytes, unequal lengths and long arrays; the time is in proportion to the characters."""
    import time

    from pyspark.sql import functions as F

    from textloom.operators import tagging as tg

    rows = [(["a", "é", "𝄞", "b"], ["B", "E", "S", "S"]), (None, ["S"]), (["a"], None), ([], []), (["a", "b"], ["M", "M", "S"]), (["a", "b", "c"], ["M", "B"]), (["x", None, "y"], ["B", "M", "E"]), (["p", "q"], [None, "M"])]
    df = spark.createDataFrame(rows, "c array<string>, t array<string>").coalesce(1)
    got = [r.w for r in df.select(tg.words_of_tags(F.col("c"), F.col("t")).alias("w")).collect()]
    assert got == [["aé", "𝄞", "b"], None, None, [], ["ab", ""], ["a", "b"], ["xy"], ["pq"]]
    long = spark.range(1).select(F.array_repeat(F.lit("word"), 50_000).alias("w"))
    start = time.time()
    back = long.select("w", tg.words_of_tags(F.split(F.array_join("w", ""), ""), tg.boundary_tags(F.col("w"))).alias("b"))
    assert back.where("w = b").count() == 1 and time.time() - start < 30


def test_abbreviations_from_counted_tokens(spark, monkeypatch):
    """Counts of tokens, passed on in parts, give the scores of a row a token; only different tokens reach the patterns."""
    import re

    from pyspark.sql import functions as F

    from textloom.functions.segmentation import abbreviation_scores
    from textloom.operators import tokens as tk

    docs = spark.createDataFrame([(1, "Dr. No met  dr. Who.\u00a0x\nHe left. etc. " * 20), (2, None), (3, ""), (4, " No. 5 e.g. this e.g. that; No dr")], "doc_id long, text string")
    monkeypatch.setattr(tk, "MOST_COUNTED", 4)
    rows = lambda toks: sorted((r.word, r.n, r.d, round(r.score, 9)) for r in abbreviation_scores(toks).collect())
    each = docs.select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "string"))
    counted = tk.counted(docs, re.compile(r"[^ \t\n\x0b\f\r]+").findall, "string")
    assert rows(counted) == rows(each) != [] and counted.count() < each.count() / 2
