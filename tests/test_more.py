import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.__main__ import main
from textloom.operators import evaluation as ev, lexicon as lx, relations as rel, structured as st
from textloom.sources import corpora as co


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_brackets():
    assert co.bracket_spans(["(1", "(2)|(3", "3)", "1)"]) == [("1", 0, 3), ("3", 1, 2), ("2", 1, 1)]
    assert co.constituents(["(S(NP*", "*)", "(VP*))"]) == [("S", 0, 2), ("NP", 0, 1), ("VP", 2, 2)]


def test_coreference_corpus(spark, tmp_path):
    line = lambda i, w, tree, ner, ref: f"d/x 0 {i} {w} NN {tree} - - - spk {ner} {ref}"
    p = put(tmp_path / "c.txt", "#begin document (d/x); part 000\n" + "\n".join([line(0, "Ann", "(S(NP*", "(PERSON*)", "(0)"), line(1, "ran", "*))", "*", "-")]) + "\n\n" + line(0, "She", "(NP*)", "*", "(0)") + "\n#end document\n")
    rows = co.read_conll2011(spark, p).orderBy("sent").collect()
    assert [list(r.words) for r in rows] == [["Ann", "ran"], ["She"]]
    assert [tuple(x) for x in rows[0].ner] == [("PERSON", 0, 0)] and [tuple(x) for x in rows[0].coref] == [("0", 0, 0)]
    toks = spark.createDataFrame([(1, i) for i in range(4)], "doc_id long, pos long")
    m = spark.createDataFrame([(1, 0, 2, 5), (1, 0, 0, 6), (1, 2, 2, 7)], "doc_id long, first long, last long, entity long")
    assert [r.coref for r in co.coref_column(m, toks).orderBy("pos").collect()] == ["(5|(6)", "-", "(7)|5)", "-"]


def test_other_corpora(spark, tmp_path):
    s = co.read_sectioned(spark, put(tmp_path / "t.xml", '<DOC id="a"><DOCTYPE> news </DOCTYPE><p>one</p></DOC>\n<DOC id="b"><p>two</p></DOC>')).orderBy("doc").collect()
    assert [(r.doc, r.kind, r.text) for r in s] == [("a", "news", "one"), ("b", "", "two")]
    w = co.read_encyclopedia(spark, put(tmp_path / "w.txt", "[[One]]\nfirst text\n\n[[Two]]\nsecond")).collect()
    assert [(r.title, r.text) for r in w] == [("One", "first text"), ("Two", "second")]
    syn, links = co.read_synsets(spark, put(tmp_path / "data.noun", "  1 licence\n00001740 03 n 02 dog 0 Domestic_Dog 0 001 @ 00001930 n 0000 | an animal\n"))
    assert syn.first().words == ["dog", "domestic_dog"] and tuple(links.first()) == ("n00001740", "@", "n00001930")
    j = co.from_json(co.to_json(spark.createDataFrame([(1, "x")], "a int, b string")), "a int, b string").first()
    assert tuple(j) == (1, "x")


def test_lexicons(spark):
    a = lx.PhraseAutomaton(["new york", "new york city", "city hall", "hall"])
    words = "In New York City Hall".split()
    assert a.find(words) == [(1, 2), (1, 3), (3, 2), (4, 1)] and a.tag(words) == ["O", "B", "I", "L", "U"]
    df = spark.createDataFrame([(words,), (None,)], "words array<string>")
    assert [r.marks for r in lx.tag_phrases(df, ["city hall"]).collect()] == [["O", "O", "O", "B", "L"], None]
    t = lx.contains(spark.createDataFrame([("The",), ("dog",)], "w string"), "w", lx.word_list(spark, "stop"), "stop")
    assert {r.w: r.stop for r in t.collect()} == {"The": True, "dog": False}


@pytest.mark.parametrize("kind", ["likelihood", "perceptron", "margin", "pseudo_likelihood", "contrastive_divergence"])
def test_structured_training(kind):
    examples = [((0, 1, 2), (0, 1, 0)), ((2, 1), (0, 1)), ((1, 0), (1, 0))]
    m = st.chain_templates(2, 3).fit(examples, kind)
    assert all(tuple(m.best(x)) == y for x, y in examples)


def test_sample_rank_and_ranking():
    gold = (0, 1, 0)
    m = st.chain_templates(2, 3)
    for k in range(10):
        m.sample_rank((0, 1, 2), lambda y: sum(a == b for a, b in zip(y, gold)), (1, 0, 1), rng=np.random.default_rng(k))
    assert tuple(m.best((0, 1, 2))) == gold
    u, v = st.rank_labels([(i, i % 3) for i in range(12)], 12, 3, passes=200)
    assert all(int((u[i] @ v.T).argmax()) == i % 3 for i in range(12))


def test_more_scores(spark):
    rows = spark.createDataFrame([("a", "1", "x", 1), ("b", "1", "x", 1), ("c", "2", "y", 2)], "point string, gold string, predicted string, doc_id int")
    assert ev.same_partition(rows) and ev.blanc(rows).first().f1 == 1.0 and ev.without_singletons(rows).count() == 2
    assert ev.linking_accuracy(rows.withColumn("predicted", F.when(F.col("point") == "c", "2").otherwise("1"))).first().macro == 1.0
    g = rows.withColumn("doc_id", F.lit(1))
    assert ev.ceaf(g, True).first().score == 2.0 and ev.ceaf(g, False).first().score == 3.0


def test_commands(spark, tmp_path):
    put(tmp_path / "in/x/1.txt", "One two. Three four.")
    put(tmp_path / "in/y/2.txt", "Five six seven.")
    main(["annotate", "--input", str(tmp_path / "in"), "--output", str(tmp_path / "a")], spark)
    assert spark.read.parquet(str(tmp_path / "a")).count() == 10
    main(["classify", "--input", str(tmp_path / "in"), "--test", str(tmp_path / "in"), "--output", str(tmp_path / "c")], spark)
    assert {r.predicted for r in spark.read.parquet(str(tmp_path / "c")).collect()} == {"x", "y"}
    main(["query", "line_cube", "--input", "/root/testdata/sf0.001", "--output", str(tmp_path / "q")], spark)
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0


def test_model_queries_take_their_whole_tables(spark):
    from textloom.operators import tokens as tk
    from textloom.plans.catalog import QUERIES

    from .oracle import SF

    docs, lines = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "lineitem"))
    toks = tk.tokens(docs)
    shares = QUERIES["topic_shares"](spark, SF)
    assert (shares.count(), shares.agg({"n": "sum"}).first()[0]) == (docs.count(), toks.count())
    assert QUERIES["word_vectors"](spark, SF).count() == toks.select("term").distinct().count()
    assert QUERIES["ranked_cells"](spark, SF).count() == lines.select("l_suppkey", "l_partkey").distinct().count()


def test_divergence_of_all_languages(spark, tmp_path):
    from textloom.plans.catalog import QUERIES

    n = 70
    spark.createDataFrame([(i, f"both {chr(97 + i % 26) * (2 + i // 26)}", f"l{i:02d}") for i in range(n)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["lang_js_divergence"](spark, str(tmp_path)).collect()
    assert len(out) == n * (n - 1) // 2 and {r.js for r in out} == {0.5}


def test_forests_are_stored_and_moved():
    from collections import Counter

    from textloom.operators import resolution as rs

    s = rs.Settings(cosines={"w": 1.0})
    f = rs.Forest([{"w": Counter(x)} for x in (["a", "b"], ["a", "b"], ["c"])], s)
    assert {k for k, *_ in rs.moves(f, 0, 1)} == {"none", "merge left", "merge right"}
    f.merge(0, 1)
    assert ("split", 0, None) in rs.moves(f, 0, 1) and all(k != "split" for k, *_ in rs.moves(f, 0, 1, split=False))
    g = rs.forest_of(rs.forest_rows(f), s)
    assert g.score() == f.score() and g.root(0) == g.root(1) != g.root(2) and g.next == f.next
    pairs = list(rs.pair_sequence(5, 50, 3))
    assert pairs == list(rs.pair_sequence(5, 50, 3)) and all(a != b for a, b in pairs) and not list(rs.pair_sequence(1, 5))
    assert abs(rs.dense_entropy([1, 1, 1, 1]) - 1) < 1e-12 and rs.dense_entropy([0, 2]) == 0 and rs.dense_entropy([]) == 0


def test_topic_shares_of_new_documents(spark):
    import numpy as np

    from textloom.sources.models import topic_shares_of

    phi = np.array([[0.9, 0.05], [0.05, 0.9], [0.05, 0.05]])
    docs = spark.createDataFrame([(1, [0, 0, 0]), (2, [1, 1, 99]), (3, []), (4, None)], "doc_id long, words array<int>")
    out = {r.doc_id: r.theta for r in topic_shares_of(docs, phi, np.array([0.1, 0.1])).collect()}
    assert out[1][0] > 0.9 and out[2][1] > 0.9 and out[3] == [0.5, 0.5] == out[4]


def test_offsets_by_batches(spark):
    from pyspark.sql import functions as F

    from textloom.operators import tokens as tk

    rows = [([0, 5], [4, 9]), ([], []), (None, [1]), ([1], None), ([3], [70000]), ([2], [3]), ([5], [2])]
    df = spark.createDataFrame(rows, "s array<long>, e array<long>").coalesce(1).select("s", "e", tk.packed_offsets(F.col("s"), F.col("e")).alias("p"))
    got = df.select("s", "e", "p", tk.unpacked_offsets(F.col("p")).alias("o")).collect()
    assert [r.p for r in got] == [[4, (1 << 16) + 4], [], None, None, None, [(2 << 16) + 1], None]
    assert [r.o and [tuple(x) for x in r.o] for r in got] == [[(0, 4), (5, 9)], [], None, None, None, [(2, 3)], None]
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()
    assert tk.packed_offsets.evalType == 250  # an Arrow function: no Python object for each offset


def test_only_lengths_of_the_phrases_are_looked_up(spark):
    from textloom.operators import tokens as tk

    docs = spark.createDataFrame([(1, "a b c d"), (2, None), (3, "c")], "doc_id long, text string")
    for phrases, want in ((["b c d", "x y z"], {(1, 1, 3, "b c d")}), (["c", "a b", "a b c d"], {(1, 2, 1, "c"), (3, 0, 1, "c"), (1, 0, 2, "a b")}), ([], set())):
        found = tk.phrases_in(docs, spark.createDataFrame([(p,) for p in phrases], "phrase string"), 3)
        assert {tuple(r) for r in found.collect()} == want
    plan = tk.phrases_in(docs, spark.createDataFrame([("b c d",)], "phrase string"), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "+ 2)" not in plan and "+ 3)" in plan


def test_ceaf_of_repeated_documents(spark):
    """Equal documents get equal scores, whatever their number, next to documents with other cells and a large one."""
    from textloom.operators import evaluation as ev

    kinds = [[("a", "x"), ("a", "x"), ("b", "y")], [("a", "x"), ("a", "y"), ("b", "y")], [(f"g{i}", f"p{i // 2}") for i in range(40)]]
    rows = [(d, i, g, p) for d in range(300) for i, (g, p) in enumerate(kinds[d % 3])]
    df = spark.createDataFrame(rows, "doc_id long, point long, gold string, predicted string")
    for by_entity, want in ((False, [(3.0, 3, 3), (2.0, 3, 3), (20.0, 40, 40)]), (True, [(2.0, 2, 2), (4 / 3, 2, 2), (20 * 2 / 3, 40, 20)])):
        got = {r.doc_id: (round(r.score, 6), r.n_gold, r.n_predicted) for r in ev.ceaf(df, by_entity).collect()}
        assert got == {d: (round(want[d % 3][0], 6), *want[d % 3][1:]) for d in range(300)}


def test_canopy_pairs_are_made_once_and_not_shuffled(spark):
    from textloom.operators import relations as rel

    rows = [(i, [k for k in "abcd" if (i * 5 + ord(k)) % 3]) for i in range(30)]
    out = rel.canopy_pairs(spark.createDataFrame(rows, "i long, ks array<string>"), "i", F.col("ks"))
    want = sorted((a, b) for a, x in rows for b, y in rows if a < b and set(x) & set(y))
    assert sorted(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_nearest_by_blocks_with_copies_and_odd_vectors(spark):
    """Ties go to the smaller id, null and short vectors are paired one by one, and no row per pair is made in the plan."""
    from textloom.operators import embeddings

    rows = [(i, [float(i % 4), 1.0, float(i % 3)]) for i in range(50)] + [(50, None)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    plain = v.where("v is not null")
    out = embeddings.nearest_by_blocks(plain, plain.where("id % 10 = 0"), 5)
    got = {(r.query, r["rank"]): r.id for r in out.collect()}
    held = dict(rows)
    for q in range(0, 50, 10):
        best = sorted((-sum(x * y for x, y in zip(held[q], held[i], strict=True)), i) for i in range(50) if i != q)[:5]
        assert [got[q, r] for r in range(1, 6)] == [i for _, i in best]
    assert "zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()
    odd = embeddings.nearest_by_blocks(v, v.where("id = 50"), 60).collect()
    assert len(odd) == 50 and all(r.score is None for r in odd)


def test_pairs_of_a_frequent_key_are_dealt_to_many_tasks(spark):
    """One key has most pairs; all pairs come out once, and no task makes a large share of them."""
    from collections import Counter

    left = spark.range(330).select(F.when(F.col("id") < 300, "x").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), F.col("id").alias("a"))
    right = spark.range(240).select(F.when(F.col("id") < 200, "x").otherwise(F.concat(F.lit("k"), F.col("id") % 9)).alias("k"), F.col("id").alias("c"))
    out = rel.pairs_by_key(left, right, "k", "a", "c", block=32, task_rows=2000).withColumn("p", F.spark_partition_id()).collect()
    want = Counter((x.k, x.a, y.c) for x in left.collect() for y in right.collect() if x.k == y.k)
    assert Counter((r.k, r.a, r.c) for r in out) == want
    assert max(Counter(r.p for r in out).values()) < len(out) / 4


def test_marks_within_a_row_are_those_of_the_tables(spark):
    """Nested, crossing, touching and single mentions, several at one place, none, and a text without tokens."""
    texts = {1: (5, [(0, 4, 9), (0, 2, 8), (2, 4, 7), (3, 3, 6), (3, 3, 10)]), 2: (2, []), 3: (0, []), 4: (1, [(0, 0, 5)])}
    rows = spark.createDataFrame([(d, n, m) for d, (n, m) in texts.items()], "doc_id long, n int, m array<struct<first:int,last:int,entity:long>>")
    got = {r.doc_id: r.marks for r in rows.select("doc_id", co.coref_marks(F.col("n"), F.col("m")).alias("marks")).collect()}
    toks = spark.createDataFrame([(d, i) for d, (n, _) in texts.items() for i in range(n)], "doc_id long, pos int")
    table = co.coref_column(rows.select("doc_id", F.explode("m").alias("x")).select("doc_id", "x.*"), toks).orderBy("doc_id", "pos").collect()
    assert got == {d: [r.coref for r in table if r.doc_id == d] for d in texts}


def test_corpus_is_dealt_out_by_sentences(spark, tmp_path):
    """Sentences longer than an Arrow batch come back whole and in order; what is shuffled are rows of lines, not of fields or names."""
    n = 25_000
    text = "#begin document (d); part 000\n" + "\n".join(f"d 0 {i} w{i} N * - - - - * {'(1' if i == 0 else '1)' if i == n - 1 else '-'}" for i in range(n)) + "\n\nd 0 0 x N * - - - - * (2)\n#end document\n"
    out = co.read_conll2011(spark, put(tmp_path / "c.txt", text))
    long, short = out.orderBy("sent").collect()
    assert long.words == [f"w{i}" for i in range(n)] and [tuple(s) for s in long.coref] == [("1", 0, n - 1)] and short.words == ["x"] and (long.sent, short.sent) == (0, 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [file_id" in plan and "split(trim(line" not in plan
