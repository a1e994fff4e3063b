"""Queries over taggers, tag sequences and small relational operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from textloom.operators import relations as rel, tagging as tg, tokens as tk
from textloom.plans.registry import TOKENS, query
from textloom.sources.tables import load

_KIND = "case when l_linestatus = 'O' then 'O' when l_discount > 0.05 then 'B-' || l_returnflag else 'I-' || l_returnflag end"
_BY = "partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _tag_rows(spark, d):
    kind = F.when(F.col("l_linestatus") == "O", "O").when(F.col("l_discount") > 0.05, F.concat(F.lit("B-"), "l_returnflag")).otherwise(F.concat(F.lit("I-"), "l_returnflag"))
    x = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", kind.alias("t")))).alias("x"))
    return x.select("l_orderkey", F.transform("x", lambda r: r["t"]).alias("tags"))


@query(f"with t as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {_KIND} as t from lineitem), p as (select *, coalesce(lag(t) over ({_BY}), 'O') as b from t), f as (select *, case when left(t, 2) = 'I-' and (b = 'O' or substring(b, 3) <> substring(t, 3)) then 'B-' || substring(t, 3) else t end as r from p) select l_orderkey, string_agg(r, ' ' order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as tags from f group by 1")
def well_formed_tags(spark, d):
    return _tag_rows(spark, d).select("l_orderkey", F.array_join(tg.well_formed(F.col("tags")), " ").alias("tags"))


@query("with w as (select conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') as w from conversations where text is not null) select conv_id, turn, array_to_string(w, ' ') as words, count(*) as n from w where len(w) > 0 group by 1, 2, 3")
def words_from_boundaries(spark, d):
    """Words to boundary tags of their characters, and back from characters and tags."""
    x = load(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("w")).where("size(w) > 0")
    x = x.select("conv_id", "turn", F.split(F.array_join("w", ""), "").alias("chars"), tg.boundary_tags(F.col("w")).alias("tags"))
    return x.select("conv_id", "turn", F.array_join(tg.words_of_tags(F.col("chars"), F.col("tags")), " ").alias("words")).groupBy("conv_id", "turn", "words").agg(F.count("*").alias("n"))


@query(f"with {TOKENS}, v as (select distinct term as w from t) select w, case when w = 'man' then 'men' when w = 'person' then 'people' when regexp_matches(w, '(s|x|z|ch|sh)$') then w || 'es' when regexp_matches(w, '[^aeiou]y$') then left(w, length(w) - 1) || 'ies' when regexp_matches(w, 'fe$') then left(w, length(w) - 2) || 'ves' when regexp_matches(w, '[lr]f$') then left(w, length(w) - 1) || 'ves' else w || 's' end as many from v where w not in ('woman', 'child', 'foot', 'tooth', 'mouse', 'goose')")
def plural_forms(spark, d):
    v = tk.tokens(load(spark, d, "documents")).select(F.col("term").alias("w")).distinct().where(~F.col("w").isin("woman", "child", "foot", "tooth", "mouse", "goose"))
    return v.select("w", tg.plural(F.col("w")).alias("many"))


@query()
def sentences_by_training(spark, d):
    """Sentence counts of each text by bounds learned from all texts."""
    return tg.unsupervised_sentences(load(spark, d, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n"))


def _capitals(spark, d):
    w = load(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    return w.select("conv_id", "turn", F.transform("w", lambda x: F.lower(x)).alias("words"), F.transform("w", lambda x: F.when(x.rlike(r"^\p{Lu}"), "NNP").otherwise("NN")).alias("tags"))


@query()
def forward_tags(spark, d):
    """The greedy tagger learns which words are capitalised."""
    rows = _capitals(spark, d)
    out = tg.tag_forward(rows, tg.train_forward(rows, ["NN", "NNP"], passes=1, size=1 << 14))
    return out.select("conv_id", "turn", F.size("tags").alias("n"), F.size(F.filter(F.zip_with("tags", "predicted", lambda a, b: a == b), lambda x: x)).alias("right"))


# small relational operators


@query("with s as (select doc_id, i as section, i * 300 as first, least((i + 1) * 300, n_chars) as last from (select doc_id, n_chars, unnest(range(0, cast(ceil(n_chars / 300) as bigint))) as i from documents)), p as (select doc_id, j * 77 as start, j * 77 + 50 as stop from (select doc_id, unnest(range(0, n_chars // 77)) as j from documents)) select p.doc_id, p.start, s.section from p join s on s.doc_id = p.doc_id and s.first <= p.start and p.stop <= s.last")
def spans_in_sections(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "n_chars")
    n = F.ceil(F.col("n_chars") / 300)
    sections = docs.where("n_chars > 0").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("section")).select("doc_id", "section", (F.col("section") * 300).alias("first"), F.least((F.col("section") + 1) * 300, F.col("n_chars")).alias("last"))
    spans = docs.where("n_chars >= 77").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n_chars") / 77) - 1)).alias("j")).select("doc_id", (F.col("j") * 77).alias("start"), (F.col("j") * 77 + 50).alias("end"))
    return rel.sections_at(sections, spans).select("doc_id", "start", "section")


@query("select coalesce(value > 50, false) as passed, count(*) as n, count(distinct user_id) as users from events group by 1")
def split_by_value(spark, d):
    a, b = rel.split_by(load(spark, d, "events"), F.col("value") > 50)
    count = lambda df, p: df.agg(F.lit(p).alias("passed"), F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return count(a, True).union(count(b, False)).where("n > 0")


@query("select 'nation' as factor, s_suppkey as a, cast(s_nationkey as bigint) as b from supplier union all select 'segment', c_custkey, length(c_mktsegment) from customer")
def factors_of_kind(spark, d):
    s = load(spark, d, "supplier").select(F.lit("nation").alias("factor"), F.col("s_suppkey").alias("a"), F.col("s_nationkey").cast("long").alias("b"))
    c = load(spark, d, "customer").select(F.lit("segment").alias("factor"), F.col("c_custkey").alias("a"), F.length("c_mktsegment").cast("long").alias("b"))
    o = load(spark, d, "orders").select(F.lit("order").alias("factor"), F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    return rel.of_kind(s.union(c).union(o), ["nation", "segment"])


@query("select user_id, string_agg(event_type, ' ' order by event_id) as seq from events where value > 20 group by user_id")
def event_subsequences(spark, d):
    return rel.subsequence(load(spark, d, "events"), F.col("value") > 20, "user_id", "event_id", "event_type").select("user_id", F.array_join("values", " ").alias("seq"))


@query("with p as (select o_orderkey, case o_orderpriority when '1-URGENT' then 2.0 else 0.5 end::double as score from orders union all select o_orderkey, o_totalprice / 100 from orders where o_orderstatus = 'F') select o_orderkey, round(sum(score), 4) as score from p group by 1")
def combined_scores(spark, d):
    o = load(spark, d, "orders")
    a = o.select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", 2.0).otherwise(0.5).alias("score"))
    b = o.where("o_orderstatus = 'F'").select("o_orderkey", (F.col("o_totalprice") / 100).alias("score"))
    return rel.combined([a, b], "o_orderkey").select("o_orderkey", F.round("score", 4).alias("score"))


@query("with c as (select l_suppkey, l_partkey, count(*) as n, row_number() over (partition by l_suppkey order by count(*) desc, l_partkey) as r from lineitem group by 1, 2) select l_suppkey, string_agg(l_partkey || ':' || n, ' ' order by r) as top from c where r <= 5 group by 1")
def sorted_counts(spark, d):
    return rel.top_counts(load(spark, d, "lineitem"), "l_suppkey", "l_partkey", 5).select("l_suppkey", F.array_join(F.transform("counts", lambda x: F.concat_ws(":", x["item"].cast("string"), x["n"].cast("string"))), " ").alias("top"))


@F.pandas_udf(DoubleType())
def _log_sum(x: pd.Series) -> float:
    top = x.max()
    return float(np.log(np.exp(x - top).sum()) + top)


@query("select l_returnflag, l_linestatus, round(max(l_quantity / 10) + ln(sum(exp(l_quantity / 10 - 5))) + 5 - max(l_quantity / 10), 4) as total from lineitem group by 1, 2")
def user_accumulator(spark, d):
    """A user-defined aggregate in Arrow batches."""
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(_log_sum(F.col("l_quantity") / 10), 4).alias("total"))


@query("select c_custkey, case when c_custkey % 4 = 0 then 'person' when c_custkey % 4 = 1 then 'organisation' when c_custkey % 4 = 2 then 'location' else 'other' end as entity_type from customer")
def mention_entity_types(spark, d):
    from textloom.operators import mentions as mn

    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Mrs. "), "c_name")).when(k == 1, F.concat("c_name", F.lit(" Inc."))).otherwise(F.col("c_name"))
    c = load(spark, d, "customer")
    return mn.entity_types(c.select("c_custkey", name.alias("string")), {"location": c.where("c_custkey % 4 = 2").select(F.col("c_name").alias("phrase"))}).select("c_custkey", "entity_type")


@query("with t as (select l_orderkey as sent_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1 as pos, l_returnflag as f from lineitem), n as (select sent_id, max(pos) as last from t group by 1) select sent_id, pos as head, pos as first, last from t join n using (sent_id) where f = 'N'")
def phrases_of_trees(spark, d):
    """Every token hangs from the one before it; those with flag N are nouns."""
    from textloom.operators import mentions as mn
    from textloom.plans.source_queries import _rows

    rows = _rows(spark, d).select(F.col("doc").alias("sent_id"), "pos", F.when(F.col("pos") > 0, F.col("pos") - 1).alias("head"), F.when(F.col("tag") == "N", "NN").otherwise("X").alias("pos_tag"))
    return mn.tree_phrases(rows)


@query("with t as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1 as pos, l_partkey, l_returnflag as f from lineitem), m as (select * from t where f = 'R'), o as (select *, lead(pos) over (partition by doc_id order by pos) as next, lead(l_partkey) over (partition by doc_id order by pos) as np from m), p as (select doc_id, pos as x, next as y, l_partkey as a, np as b, 'a<b' as dir from o where next is not null union all select doc_id, pos, next, np, l_partkey, 'b<a' from o where next is not null) select doc_id, 'p' || a as a, 'p' || b as b, 'a=p' || a || ' b=p' || b || ' ' || dir || ' between=' || case when y - x - 1 < 1 then 'none' when y - x - 1 < 4 then 'few' else 'many' end as features, count(*) as n from p group by 1, 2, 3, 4")
def relation_pair_features(spark, d):
    from textloom.operators import mentions as mn
    from textloom.plans.source_queries import _rows

    toks = _rows(spark, d).select(F.col("doc").alias("doc_id"), "sent", "pos", F.col("word").alias("string"), "tag")
    m = toks.where("tag = 'R'").select("doc_id", "sent", F.col("pos").alias("first"), F.col("pos").alias("last"), "string")
    f = mn.relation_features(mn.relation_candidates(m, 1), toks)
    return f.select("doc_id", "a", "b", F.array_join(F.slice("features", 1, 4), " ").alias("features")).groupBy("doc_id", "a", "b", "features").agg(F.count("*").alias("n"))
