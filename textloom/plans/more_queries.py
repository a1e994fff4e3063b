"""Further queries: spans, tags, lexicons, scores and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import maths as M, strings as S
from textloom.operators import evaluation as ev, lexicon as lx, relations as rel, statistics as st, tokens as tk
from textloom.plans.registry import TOKENS, query
from textloom.sources.tables import load

_NUM = ", ".join(f"'{w}'" for w in S.NUMBER_WORDS)


@query(f"with {TOKENS} select replaced, count(*) as n from (select case when term in ({_NUM}) then '<NUM>' else regexp_replace(term, '[0-9]+', '0', 'g') end as replaced from t) group by replaced")
def tok_digits_replaced(spark, d):
    return tk.tokens(load(spark, d, "documents")).groupBy(S.replace_digits(F.col("term")).alias("replaced")).agg(F.count("*").alias("n"))


@query("select lang, sum(length(text)) as chars, sum(len(regexp_extract_all(text, '[^ \\t\\r\\n\\f]+'))) as words, sum(len(string_split(text, chr(10)))) as lines from documents group by lang")
def text_sizes(spark, d):
    text = F.col("text")
    n = F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\r\n\f]+"), F.lit(0)))
    return load(spark, d, "documents").groupBy("lang").agg(F.sum(F.length(text)).alias("chars"), F.sum(n).alias("words"), F.sum(F.size(F.split(text, "\n"))).alias("lines"))


_FROM, _TO = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


@query(f"select doc_id, md5(translate(text, '{_FROM}', '{_TO}')) as plain from documents")
def strip_accents(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(S.strip_accents(F.col("text")).cast("binary")).alias("plain"))


_TAGS = "x as (select user_id, event_id, case when event_type = 'view' then 'O' else 'I-' || event_type end as tag from events)"


@query(
    f"with {_TAGS}, y as (select *, lag(tag) over w as p, lead(tag) over w as n from x window w as (partition by user_id order by event_id)) select user_id, event_id, case when tag = 'O' then 'O' else case when (p is null or p <> tag) and (n is null or n <> tag) then 'U' when p is null or p <> tag then 'B' when n is null or n <> tag then 'L' else 'I' end || '-' || substring(tag, 3) end as tag from y"
)
def tags_to_bilou(spark, d):
    x = load(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", "O").otherwise(F.concat(F.lit("I-"), "event_type")).alias("tag"))
    return tk.iob_to_bilou(x, "user_id", "event_id")


@query(
    f"with {_TAGS}, y as (select *, coalesce(lag(tag) over (partition by user_id order by event_id) <> tag, true)::int as new from x), z as (select *, sum(new) over (partition by user_id order by event_id rows unbounded preceding) as run from y) select user_id, substring(tag, 3) as label, min(event_id) as first, max(event_id) as last from z where tag <> 'O' group by user_id, run, tag"
)
def decode_spans(spark, d):
    x = load(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "view", "O").otherwise(F.concat(F.lit("I-"), "event_type")).alias("tag"))
    return tk.decode_bilou(tk.iob_to_bilou(x, "user_id", "event_id"), "user_id", "event_id")


def _spans(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("by"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4 + 1).alias("end"))


_SPANS = "s as (select l_orderkey as by, l_linenumber as id, l_linenumber as start, l_linenumber + l_quantity::int % 4 + 1 as stop from lineitem)"


@query(f"with {_SPANS} select 'overlapping' as how, count(*) as n from s a join s b on a.by = b.by where a.start < b.stop and b.start < a.stop union all select 'starting_at', count(*) from s a join s b on a.by = b.by where a.start = b.start union all select 'ending_at', count(*) from s a join s b on a.by = b.by where a.stop = b.stop union all select 'following', count(*) from s a join s b on a.by = b.by where a.start >= b.stop")
def span_relations(spark, d):
    s = _spans(spark, d)
    one = lambda how: rel.spans_at(s, s, "by", how).agg(F.lit(how).alias("how"), F.count("*").alias("n")).select("how", "n")
    return one("overlapping").union(one("starting_at")).union(one("ending_at")).union(one("following"))


_LISTS = " union all ".join(f"select unnest([{', '.join(repr(w) for w in ws)}]) as phrase, '{k}' as list" for k, ws in lx.WORD_LISTS.items())


@query(f"with {TOKENS}, l as ({_LISTS}) select list, count(*) as n, count(distinct doc_id) as docs from t join l on term = phrase group by list")
def lexicon_counts(spark, d):
    lists = spark.createDataFrame([(w, k) for k, ws in lx.WORD_LISTS.items() for w in ws], "term string, list string")
    c = tk.tokens(load(spark, d, "documents")).join(lists, "term")
    return c.groupBy("list").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


_POINTS = "p as (select doc_id as point, source as gold, lang || cast(doc_id % 3 as varchar) as predicted from documents)"


@query(
    f"with {_POINTS}, c as (select gold, predicted, count(*)::double as n from p group by 1, 2), o as (select *, sum(n) over (partition by gold) as ng, sum(n) over (partition by predicted) as np from c), s as (select sum(n * (n - 1)) as rc, sum(n * (np - 1)) as pc, sum(n * (ng - 1)) as gc, sum(n) * (sum(n) - 1) as e from o), r as (select rc / pc as p1, rc / gc as r1, (e - pc - gc + rc) / (e - pc) as p2, (e - pc - gc + rc) / (e - gc) as r2 from s) select round((p1 + p2) / 2, 6) as precision, round((r1 + r2) / 2, 6) as recall, round((2 * p1 * r1 / (p1 + r1) + 2 * p2 * r2 / (p2 + r2)) / 2, 6) as f1 from r"
)
def cluster_blanc(spark, d):
    return ev.blanc(_points(spark, d))


def _points(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("point"), F.col("source").alias("gold"), F.concat("lang", (F.col("doc_id") % 3).cast("string")).alias("predicted"))


@query(f"with {_POINTS} select sum((n > 1)::int * n)::bigint as points, sum((n > 1)::int)::bigint as clusters from (select predicted, count(*) as n from p group by 1)")
def clusters_without_singletons(spark, d):
    return ev.without_singletons(_points(spark, d), "predicted").agg(F.count("*").alias("points"), F.count_distinct("predicted").alias("clusters"))


@query("with x as (select source, (quality = (n_chars > 2000)::int)::int as r from documents join labels using (doc_id)) select round((select avg(r) from x), 6) as micro, round(avg(a), 6) as macro from (select avg(r) as a from x group by source)")
def linking_accuracy(spark, d):
    x = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").select("source", F.col("quality").alias("gold"), (F.col("n_chars") > 2000).cast("int").alias("predicted"))
    return ev.linking_accuracy(x, "source")


@query("with r as (select source, quality as hit, row_number() over (partition by source order by n_chars desc, doc_id) as r, sum(quality) over (partition by source order by n_chars desc, doc_id rows unbounded preceding) as h from documents join labels using (doc_id)), a as (select source, round(coalesce(sum(h / r) filter (hit = 1) / nullif(sum(hit), 0), 0), 6) as ap from r group by source) select round(avg(ap), 4) as map from a")
def mean_avg_precision(spark, d):
    x = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id")
    return ev.mean_average_precision(ev.average_precision(x, "source", "n_chars", "quality", "doc_id")).select(F.round("map", 4).alias("map"))


@query("select l_returnflag, round(avg(l_quantity), 6) as mean, round(var_pop(l_quantity), 4) as variance, count(l_quantity) as n from lineitem group by 1")
def gaussian_fits(spark, d):
    from textloom.operators.topics import gaussian_fits as fits

    return fits(load(spark, d, "lineitem"), "l_returnflag", "l_quantity").select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"), "n")


@query("select round(covar_pop(l_quantity, l_extendedprice), 2) as qp, round(corr(l_quantity, l_extendedprice), 6) as r, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 2) as intercept from lineitem")
def linear_fit(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return load(spark, d, "lineitem").agg(F.round(F.covar_pop(q, p), 2).alias("qp"), F.round(F.corr(q, p), 6).alias("r"), F.round(F.regr_slope(p, q), 4).alias("slope"), F.round(F.regr_intercept(p, q), 2).alias("intercept"))


@query(f"with {TOKENS}, p as (select term as a, unnest([lead(term, 1) over w, lead(term, 2) over w]) as b from t window w as (partition by doc_id order by pos)) select a, b, count(*) as n from p where b is not null group by 1, 2 having count(*) >= 3")
def context_pair_counts(spark, d):
    from textloom.operators.embeddings import context_pairs

    return context_pairs(tk.tokens(load(spark, d, "documents")), 2).groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 3")


@query("select conv_id, string_agg(role || ':' || length(coalesce(text, '')), ',' order by turn, text) as shape, count(*) as turns from conversations group by conv_id")
def conversation_shapes(spark, d):
    c = load(spark, d, "conversations")
    t = F.array_sort(F.collect_list(F.struct("turn", "text", F.concat("role", F.lit(":"), F.length(F.coalesce("text", F.lit(""))).cast("string")).alias("s"))))
    return c.groupBy("conv_id").agg(t.alias("t"), F.count("*").alias("turns")).select("conv_id", F.array_join(F.transform("t", lambda x: x["s"]), ",").alias("shape"), "turns")


@query("select e.vec_id, (select arg_min(c.label, (list_sum(list_transform(list_zip(e.embedding, c.m), lambda z: (z[1]::double - z[2]) * (z[1]::double - z[2]))), c.label)) from (select label, list(m order by i) as m from (select label, i, avg(embedding[i]::double) as m from (select label, embedding, unnest(range(1, 65)) as i from embeddings) group by 1, 2) group by label) c) as nearest from embeddings e")
def nearest_centroid(spark, d):
    e = load(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    means = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    c = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("m"))
    # centroids in blocks of about a thousand: a vector meets each block once, and no array grows with the number of labels
    blocks = c.count() // 1000 + 1
    every = c.groupBy(F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("label", "m")).alias("cs"))
    far = lambda v, m: M.total(F.zip_with(v, m, lambda a, b: (a - b) * (a - b)))
    x = e.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(every, "block")
    best = F.array_min(F.transform("cs", lambda s: F.struct(far(F.col("v"), s["m"]).alias("d"), s["label"].alias("label"))))
    return x.select("vec_id", best.alias("b")).groupBy("vec_id").agg(F.min("b")["label"].alias("nearest"))


@query("with c as (select source, count(*) as n from documents group by 1) select source, n, round(n / sum(n) over (), 6) as share, rank() over (order by n desc) as rank from c")
def source_shares(spark, d):
    c = load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    t = c.agg(F.sum("n").alias("t"))
    from pyspark.sql import Window

    return c.join(F.broadcast(t)).select("source", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), F.rank().over(Window.orderBy(F.desc("n"))).alias("rank"))  # a row per source


@query(f"with {TOKENS}, v as (select term, count(*) as n from t group by term), k as (select term from v where n >= 10) select doc_id, count(k.term) as known, count(*) - count(k.term) as unknown from t left join k using (term) group by doc_id")
def frozen_vocabulary(spark, d):
    """Tokens by whether a vocabulary frozen at ten occurrences knows them."""
    t = tk.tokens(load(spark, d, "documents"))
    k = st.trim_below(st.counts(t), 10).select("term", F.lit(1).alias("k"))
    return t.join(k, "term", "left").groupBy("doc_id").agg(F.count("k").alias("known"), (F.count("*") - F.count("k")).alias("unknown"))


@query("select o_orderkey, json_extract_string(j, '$.status') as status, cast(json_extract_string(j, '$.total') as double) as total from (select o_orderkey, to_json({'status': o_orderstatus, 'total': o_totalprice}) as j from orders)")
def json_round_trip(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"))).alias("j"))
    return o.select("o_orderkey", F.from_json("j", "status string, total double").alias("r")).select("o_orderkey", "r.status", "r.total")
