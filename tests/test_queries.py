from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import segmentation as sg, strings as S
from textloom.plans.catalog import ORACLES, QUERIES

from .oracle import SF, assert_same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert_same(spark, name, QUERIES[name], ORACLES[name])


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_annotated_tokens(spark, texts):
    got = Counter((r.doc_id, r.pos, r.start, r.end, r.string, r.sent, r.lemma) for r in QUERIES["annotated_tokens"](spark, SF).select("doc_id", "pos", "start", "end", "string", "sent", "lemma").collect())
    n = 0
    for d, t in texts.items():
        found = sg.tokenize(t)
        for i, ((a, b, s), k) in enumerate(zip(found, sg.sentence_numbers(found), strict=True)):
            assert t[a:b] == s
            plain = not s.isalpha() or got[(d, i, a, b, s, k, s.lower())] == 1
            assert plain, (d, s)
        n += len(found)
    assert n == sum(got.values())
    assert "Exchange" not in QUERIES["annotated_tokens"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_sentence_counts(spark, texts):
    want = {d: (max(sg.sentence_numbers(f)) + 1, len(f)) for d, t in texts.items() if (f := sg.tokenize(t))}
    assert {r.doc_id: (r.n_sentences, r.n_tokens) for r in QUERIES["sentence_counts"](spark, SF).collect()} == want


def test_named_entities(spark):
    rows = QUERIES["named_entities"](spark, SF).collect()
    names = {}
    for r in rows:
        assert names.setdefault((r.doc_id, r.string.lower()), r.entity) == r.entity and r.first <= r.last
    assert len({(d, e) for (d, _), e in names.items()}) == len(names) > 0


def test_stems(spark, texts):
    import re

    words = Counter(w for t in texts.values() for w in re.findall("[A-Za-z]+", t.lower()))
    want = {}
    for w, n in words.items():
        c = want.setdefault(S.porter(w), [0, 0])
        c[0] += n
        c[1] += 1
    assert {r.stem: [r.n, r.forms] for r in QUERIES["tok_stems"](spark, SF).collect()} == want


def test_sentences_by_training(spark, texts):
    from textloom.operators import tagging as tg

    rows = {r.doc_id: r.n for r in QUERIES["sentences_by_training"](spark, SF).collect()}
    assert set(rows) == {d for d, t in texts.items() if t.split()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert {r.doc_id: r["count"] for r in tg.unsupervised_sentences(docs, "none").groupBy("doc_id").count().collect()} == {d: len(tg.cut_sentences(t, set())) for d, t in texts.items() if t.split()}


def test_models_beat_the_most_frequent_answer(spark):
    for name in ("chain_tags", "forward_tags"):
        r = QUERIES[name](spark, SF).agg(F.sum("right"), F.sum("n")).first()
        assert r[0] / r[1] > 0.7, name
    for name in ("tree_quality", "boosted_quality"):
        rows = QUERIES[name](spark, SF).collect()
        most = max(Counter(r.y for r in rows).values())
        assert sum(float(r.y) == float(r.predicted) for r in rows) >= most, name
    rows = QUERIES["linear_quality"](spark, SF).collect()
    assert sum((r.score > 0) == (r.y > 0) for r in rows) > 0.8 * len(rows)


def test_topic_shares(spark, texts):
    import re

    rows = {r.doc_id: (r.n, r.topic0) for r in QUERIES["topic_shares"](spark, SF).collect()}
    assert {d: n for d, (n, _) in rows.items()} == {d: len(re.findall("[A-Za-z]+", t.lower())) for d, t in texts.items()}
    assert all(0 <= k <= n for n, k in rows.values())


def test_topics_do_not_depend_on_how_rows_are_dealt_out(spark):
    from textloom.operators import topics

    docs = spark.createDataFrame([(i, [(i * 7 + j * j) % 20 for j in range(15)]) for i in range(40)], "doc_id long, words array<int>")
    a, b = (topics.lda(docs.repartition(n), 3, 20, sweeps=3) for n in (1, 5))
    assert {r.doc_id: r.z for r in a[0].collect()} == {r.doc_id: r.z for r in b[0].collect()} and (a[1] == b[1]).all()


def test_vectors_and_cells(spark):
    v = QUERIES["word_vectors"](spark, SF)
    assert v.count() == v.select("term").distinct().count() and v.where("size(vector) <> 8").count() == 0
    c = QUERIES["ranked_cells"](spark, SF)
    cells = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct()
    assert c.count() == cells.count() and c.where("score < 0 or score > 1").count() == 0


def test_resolved_parts(spark):
    part = {r.p_partkey: r for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    block = lambda p: (p.p_brand, p.p_type, p.p_size)
    rows = {r.id: r.entity for r in QUERIES["resolved_parts"](spark, SF).collect()}
    assert set(rows) == set(part) and all(e <= i and block(part[e]) == block(part[i]) for i, e in rows.items())


def test_every_query_without_sql_is_tested_here():
    tested = "annotated_tokens sentence_counts named_entities tok_stems sentences_by_training chain_tags forward_tags tree_quality boosted_quality linear_quality topic_shares word_vectors ranked_cells resolved_parts"
    assert set(QUERIES) - set(ORACLES) <= set(tested.split())


def test_names_are_compared_once_for_all_their_copies(spark, tmp_path):
    """Rows of repeated names give all their pairs, from a comparison of different names alone; ids below and above each other's."""
    rows = [(i, ["tin can", "tin pan", "steel rod", None][i * 7 % 4], "B", 1 if i % 5 else None) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    out = QUERIES["edit_distance_pairs"](spark, str(tmp_path))
    want = {(a, b, S.edit_distance(n, m)) for a, n, _, s in rows for b, m, _, t in rows if a < b and n and m and s and t and S.edit_distance(n, m) <= 6}
    got = [tuple(r) for r in out.select("a", "b", "distance").collect()]
    assert len(got) == len(want) and set(got) == want
    assert "levenshtein" not in out._jdf.queryExecution().optimizedPlan().toString()  # names were compared before parts were paired


@pytest.mark.parametrize("name", ["tree_quality", "boosted_quality", "linear_quality"])
def test_learners_read_what_was_written_once(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "documents" not in plan and "regexp" not in plan and "Join" not in plan
