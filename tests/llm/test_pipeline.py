import random

import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline

from . import brute
from .test_documents import ODD, edited, prose


def test_stages_do_what_the_plain_versions_do(spark, folder):
    import public_tokenizers

    base = [(i, prose(i, 120)) for i in range(40)]
    copies = [(100 + i, edited(base[i][1], i, i % 3)) for i in range(10)]
    passage, item = prose(77, 60), prose(78, 40)
    rows = base + copies + [(200 + i, prose(300 + i, 60) + " " + passage + " " + prose(400 + i, 40)) for i in range(4)] + [(300, prose(500, 50) + " " + item + " " + prose(501, 50))] + ODD
    sf = folder(True, documents=[(i, t, "en", "s", 1) for i, t in rows], benchmark=[(1, item)])
    random.seed(1)
    left = [(d, t) for d, t in rows if t and any(map(str.isalpha, t))]
    near = {d: kept for d, _, _, kept in brute.near(left, 80)}
    left = [(d, t) for d, t in left if near[d]]
    cut = brute.without_repeats(left)
    left = [(d, cut[d][3].decode(errors="ignore")) for d, _ in left]
    dirty = brute.decontaminated(left, [(1, item)])
    left = [(d, t) for d, t in left if not dirty[d][4]]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: (len(ids), brute.sha(",".join(map(str, ids)))) for d, t in left for ids in [sp.encode(t)]}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 300 not in got and 200 in got


def test_stages_keep_the_columns(spark, folder):
    sf = folder(True, documents=[(1, "some text here", None, None, None), (None, "no id", "en", "s", 5)], benchmark=[])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() == 2
    empty = docs.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_the_language_stage_decides_by_language(spark, folder):
    r = random.Random(3)
    gibberish = " ".join("".join(r.choice("qxzjkvw") for _ in range(8)) for _ in range(80))
    rows = [(i, prose(i, 120), "en", "s", 1) for i in range(60)] + [(100, gibberish, "en", "s", 1), (101, "1234 !", "en", "s", 1), (102, None, None, "s", None), (103, prose(103, 40), None, "s", 1)]
    sf = folder(True, documents=rows)
    out = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    assert out == {**dict.fromkeys(range(60), "en"), 103: "en"}


def test_columns_of_any_name_and_repeated_rows(spark, folder):
    sf = folder(benchmark=[(1, "a b")], documents=[])
    text = prose(1, 60)
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, "has a b in it", "en", "s", 1), (3, "another text of it", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").withColumns({"my-col": F.lit("x"), "a.b": F.lit(1), "doc": F.lit(2), "accepted": F.lit(3)})
    want = {"language": 5, "near_dedup": 4, "repeats": 4, "decontamination": 3}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf), name)
        assert docs.columns[5:] == ["my-col", "a.b", "doc", "accepted"] and docs.count() == want[name], name
    assert corpus_pipeline.encoding(spark, docs, sf).count() == 3
