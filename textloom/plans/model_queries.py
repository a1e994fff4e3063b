"""Queries over annotated text and trained models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import maths as M
from textloom.operators import chains, classify, embeddings, evaluation as ev, graphs, mentions as mn, optimise, relations as rel, resolution, statistics as st, tokens as tk, topics
from textloom.plans import annotators
from textloom.plans.registry import TOKENS, query
from textloom.sources.tables import load


def _labelled(spark, d, label="quality"):
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels").where(f"{label} is not null")
    toks = tk.tokens(docs.join(labels, "doc_id", "left_semi")).select(F.col("doc_id").alias("id"), F.col("term").alias("feature"))
    return toks, labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y"))


_NB = f"with {TOKENS}, l as (select doc_id, quality as y from labels where quality is not null), s as (select y, term, count(*) as n from t join l using (doc_id) group by 1, 2), e as (select distinct term from s), z as (select y, sum(n) as t from s group by y), v as (select count(*) as v from e), w as (select z.y, e.term, ln((coalesce(s.n, 0) + 1) / (z.t + v.v)) as w from e cross join z cross join v left join s on s.y = z.y and s.term = e.term)"


@query(f"{_NB} select y, term as feature, round(w, 6) as w from w")
def nb_weights(spark, d):
    return classify.naive_bayes(*_labelled(spark, d)).select("y", "feature", F.round("w", 6).alias("w"))


@query(f"{_NB}, c as (select doc_id, term, count(*) as n from t where doc_id in (select doc_id from l) group by 1, 2), p as (select doc_id, w.y, sum(c.n * w.w) as score from c join w using (term) group by 1, 2) select id, predicted from (select doc_id as id, y as predicted, row_number() over (partition by doc_id order by round(score, 6) desc, y) as r from p) where r = 1")
def nb_predict(spark, d):
    toks, labels = _labelled(spark, d)
    return classify.predict_naive_bayes(toks, classify.naive_bayes(toks, labels)).select("id", "predicted")


@query(f"{_NB}, c as (select doc_id, term, count(*) as n from t where doc_id in (select doc_id from l) group by 1, 2), p as (select doc_id, w.y, sum(c.n * w.w) as score from c join w using (term) group by 1, 2), b as (select doc_id, y as predicted, row_number() over (partition by doc_id order by round(score, 6) desc, y) as r from p) select l.y as gold, b.predicted, count(*) as n from b join l using (doc_id) where r = 1 group by 1, 2")
def confusion_nb(spark, d):
    toks, labels = _labelled(spark, d)
    p = classify.predict_naive_bayes(toks, classify.naive_bayes(toks, labels)).join(labels, "id")
    return ev.confusion(p.select(F.col("y").alias("gold"), "predicted"))


def _gini(a, b):
    return f"(1 - pow({a} / ({a} + {b}), 2) - pow({b} / ({a} + {b}), 2))"


@query(
    f"with x as (select cast(floor(n_chars / 250) as bigint) as cut, quality as y from documents join labels using (doc_id) where quality is not null), k as (select distinct cut from x), g as (select k.cut, sum((x.cut <= k.cut and y = 1)::int)::double as l1, sum((x.cut <= k.cut and y = 0)::int)::double as l0, sum((x.cut > k.cut and y = 1)::int)::double as r1, sum((x.cut > k.cut and y = 0)::int)::double as r0 from x, k group by 1) select cut, round({_gini('(l1 + r1)', '(l0 + r0)')} - (l1 + l0) / (l1 + l0 + r1 + r0) * {_gini('l1', 'l0')} - (r1 + r0) / (l1 + l0 + r1 + r0) * {_gini('r1', 'r0')}, 6) as gain from g where r1 + r0 > 0 and l1 + l0 > 0"
)
def stump_gain(spark, d):
    """The gain of every threshold on document length for the quality label, from one pass of counts."""
    from pyspark.sql import Window

    x = load(spark, d, "documents").join(load(spark, d, "labels").where("quality is not null"), "doc_id").groupBy(F.floor(F.col("n_chars") / 250).alias("cut")).agg(F.sum("quality").cast("double").alias("a"), F.sum(1 - F.col("quality")).cast("double").alias("b"))
    up = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)  # a row per threshold
    whole = Window.partitionBy()
    g = x.select("cut", F.sum("a").over(up).alias("l1"), F.sum("b").over(up).alias("l0"), F.sum("a").over(whole).alias("t1"), F.sum("b").over(whole).alias("t0")).withColumn("r1", F.expr("t1 - l1")).withColumn("r0", F.expr("t0 - l0")).where("r1 + r0 > 0 and l1 + l0 > 0")
    gini = lambda p, q: f"(1 - pow({p} / ({p} + {q}), 2) - pow({q} / ({p} + {q}), 2))"
    return g.select("cut", F.round(F.expr(f"{gini('t1', 't0')} - (l1 + l0) / (t1 + t0) * {gini('l1', 'l0')} - (r1 + r0) / (t1 + t0) * {gini('r1', 'r0')}"), 6).alias("gain"))


def _numbers(spark, d):
    """Four numbers for each labelled text, written once: the learners read them many times."""
    docs = load(spark, d, "documents").join(load(spark, d, "labels").where("quality is not null"), "doc_id")
    text = F.col("text")
    return rel.cut(docs.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y"), F.col("n_chars").cast("double").alias("chars"), (F.length(F.regexp_replace(text, "[^A-Z]", "")) / F.greatest(F.length(text), F.lit(1))).alias("upper"), (F.length(F.regexp_replace(text, r"[\p{L}\s]", "")) / F.greatest(F.length(text), F.lit(1))).alias("marks"), (F.size(F.split(text, "\n")) / F.greatest(F.length(text), F.lit(1))).alias("lines")))


COLUMNS = ["chars", "upper", "marks", "lines"]


@query()
def tree_quality(spark, d):
    rows = _numbers(spark, d)
    return classify.predict_tree(rows, classify.grow_tree(rows, COLUMNS, depth=3)).select("id", "y", "predicted")


@query()
def boosted_quality(spark, d):
    rows = _numbers(spark, d)
    return classify.vote(rows, classify.ada_boost(rows, COLUMNS, rounds=4), [0.0, 1.0]).select("id", "y", "predicted")


@query()
def linear_quality(spark, d):
    """A linear model over hashed words, trained by full-gradient steps."""
    toks, labels = _labelled(spark, d)
    f = toks.groupBy("id", "feature").agg(F.count("*").alias("n")).withColumn("h", M.hashed_feature(F.col("feature"), 4096))
    f = f.groupBy("id", F.col("h.slot").cast("int").alias("slot")).agg(F.sum(F.col("h.sign") * F.log1p("n")).alias("v"))
    rows = f.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", "v"))).alias("x")).join(labels, "id").select("id", (2 * F.col("y") - 1).cast("double").alias("y"), F.transform("x", lambda p: p["slot"]).alias("index"), F.transform("x", lambda p: p["v"]).alias("value"))
    rows = rel.cut(rows)
    model = optimise.train(rows, 4096, "log", optimise.AdaGrad(rate=0.5), passes=5)
    return model.score(rows).select("id", "y", F.round("score", 4).alias("score"))


@query()
def annotated_tokens(spark, d):
    return annotators.run(load(spark, d, "documents").select("doc_id", "text"), ["sent", "lemma", "shape"])


@query()
def sentence_counts(spark, d):
    x = annotators.run(load(spark, d, "documents").select("doc_id", "text"), ["sent"])
    return x.groupBy("doc_id").agg(F.count_distinct("sent").alias("n_sentences"), F.count("*").alias("n_tokens"))


@query()
def named_entities(spark, d):
    x = annotators.run(load(spark, d, "documents").select("doc_id", "text"), ["sent"])
    tagged = x.withColumn("pos_tag", F.when(F.col("string").rlike(r"^\p{Lu}\p{L}+$") & (F.col("pos") > 0), "NNP").otherwise("X"))
    m = mn.same_name_entities(mn.named_mentions(tagged, every_pos=True))
    return m.select("doc_id", "sent", "first", "last", "string", "entity")


@query()
def chain_tags(spark, d):
    """A chain model learns which words of the conversations are capitalised from lower-cased text."""
    words = load(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    rows = words.select("conv_id", "turn", F.transform("w", lambda x: F.lower(x)).alias("words"), F.transform("w", lambda x: F.when(x.rlike(r"^\p{Lu}"), "B").otherwise("O")).alias("tags"))
    model = chains.train_chain(rows, ["O", "B"], passes=1, likelihood=False, size=1 << 14)
    out = chains.tag(rows, model)
    right = F.size(F.filter(F.zip_with("tags", "predicted", lambda a, b: a == b), lambda x: x))
    return out.select("conv_id", "turn", F.size("tags").alias("n"), right.alias("right"))


#: what stands for no bound on a vocabulary
ALL = (1 << 63) - 1


def _indexed(docs, toks, vocab):
    """(doc_id, words): the indexes of each document's words in their order; documents without words have none."""
    words = toks.join(vocab.select("term", "index"), "term").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "index"))), lambda x: x["index"].cast("int")).alias("words"))
    return docs.select("doc_id").join(words, "doc_id", "left").select("doc_id", F.coalesce("words", F.array().cast("array<int>")).alias("words"))


@query()
def topic_shares(spark, d):
    docs = load(spark, d, "documents")
    toks = tk.tokens(docs)
    vocab = rel.cut(embeddings.vocabulary(toks, 1, ALL))
    rows, _ = topics.lda(_indexed(docs, toks, vocab), 4, vocab.count(), sweeps=1)
    return rows.select("doc_id", F.size("z").alias("n"), F.size(F.filter("z", lambda t: t == 0)).alias("topic0"))


@query()
def word_vectors(spark, d):
    docs = load(spark, d, "documents")
    toks = tk.tokens(docs)
    vocab = rel.cut(embeddings.vocabulary(toks, 1, ALL))
    words = vocab.select("term", "n", "index").orderBy("index").toArrow()
    v = embeddings.skip_grams(_indexed(docs, toks, vocab), words["term"], words["n"].to_numpy(), size=8, width=2, negatives=2, passes=1)
    shared = spark.sparkContext.broadcast(np.round(v, 4))

    def run(batches):
        for b in batches:
            own = shared.value[b.column("index").to_numpy()]
            vector = pa.FixedSizeListArray.from_arrays(pa.array(own.reshape(-1)), own.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("term"), vector], names=["term", "vector"])

    return vocab.select("term", "index").mapInArrow(run, "term string, vector array<double>")


@query()
def ranked_cells(spark, d):
    """Supplier by part cells of all lots, ranked by factor vectors."""
    x = load(spark, d, "lineitem").select("l_suppkey", "l_partkey").dropna().distinct()
    r, c = (st.encode(st.counts(x.select(F.col(k).alias("term")))).select(F.col("term").alias(k), F.col("index").cast("int").alias(i)) for k, i in (("l_suppkey", "r"), ("l_partkey", "c")))
    cells = x.join(r, "l_suppkey").join(c, "l_partkey")
    u, v = embeddings.rank_cells(cells, r.count(), c.count(), size=8, passes=1)
    return embeddings.score_cells(cells, u, v, "cosine01").select(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c"), F.round("score", 4).alias("score"))


@query()
def resolved_parts(spark, d):
    """Parts blocked by brand, type and size, resolved by the words of their names."""
    words = F.array_distinct(F.split(F.lower("p_name"), "[^a-z]+"))
    p = load(spark, d, "part").select(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("canopy"), F.col("p_partkey").alias("id"), F.map_from_arrays(words, F.transform(words, lambda _: F.lit(1.0))).alias("words"))
    return resolution.resolve(p, resolution.Settings(cosines={"words": 1.0}), ["words"], 10)


_CHAIN = "c as (select conv_id, row_number() over (partition by conv_id order by turn, length(coalesce(text, ''))) - 1 as i, count(*) over (partition by conv_id) as k, (1 + length(coalesce(text, ''))) * exp(-5) as w from conversations), f as (select conv_id, i, 1.0::double as a0, w as a1 from c where i = 0 union all select c.conv_id, c.i, a0 + a1 * exp(1), c.w * (a0 * exp(1) + a1) from f join c on c.conv_id = f.conv_id and c.i = f.i + 1), b as (select conv_id, i, w, 1.0::double as b0, 1.0::double as b1 from c where i = k - 1 union all select c.conv_id, c.i, c.w, b0 + b.w * b1 * exp(1), b0 * exp(1) + b.w * b1 from b join c on c.conv_id = b.conv_id and c.i = b.i - 1), p as (select f.conv_id, f.i, a1 * b1 / (a0 * b0 + a1 * b1) as p from f join b using (conv_id, i))"


@query(f"with recursive {_CHAIN} select conv_id, cast(i as integer) as variable, 0 as value, round(1 - p, 6) as p from p union all select conv_id, cast(i as integer), 1, round(p, 6) from p")
def chain_marginals(spark, d):
    """Marginals of whether each turn of a conversation is long, in a chain where neighbours differ."""
    c = load(spark, d, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))

    def build(pdf):
        pdf = pdf.sort_values(["turn", "n"])
        unary = [((i,), np.array([0.0, np.log1p(n) - 5])) for i, n in enumerate(pdf["n"])]
        pair = np.array([[0.0, 1.0], [1.0, 0.0]])
        return graphs.Graph([2] * len(pdf), unary + [((i, i + 1), pair) for i in range(len(pdf) - 1)])

    return graphs.infer_groups(c, "conv_id", build, "tree", sweeps=400).select("conv_id", "variable", "value", F.round("p", 6).alias("p"))
