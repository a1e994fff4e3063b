"""Queries over relations, vectors, entity resolution and evaluation."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from textloom.functions import dates as D, maths as M, strings as S
from textloom.operators import embeddings, evaluation as ev, relations as rel, tokens as tk
from textloom.plans.registry import query
from textloom.sources.tables import load


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus in ('O', 'F') and o_totalprice between 1000 and 50000 and o_orderpriority = '1-URGENT'")
def qbe_orders(spark, d):
    return rel.by_example(load(spark, d, "orders"), {"o_orderstatus": ["O", "F"], "o_totalprice": (1000, 50000), "o_orderpriority": "1-URGENT"}, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("select c_custkey, c_name from customer where c_custkey in (select s_suppkey from supplier)")
def ids_in(spark, d):
    return load(spark, d, "customer").join(load(spark, d, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left_semi").select("c_custkey", "c_name")


@query("select r_name, n_name, count(*) as n_orders, round(sum(o_totalprice), 2) as total from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey group by 1, 2")
def ref_traverse(spark, d):
    n, c, o = (load(spark, d, t) for t in ("nation", "customer", "orders"))
    out = rel.traverse(load(spark, d, "region"), [(n, "n_regionkey", "r_regionkey"), (c, "c_nationkey", "n_nationkey"), (o, "o_custkey", "c_custkey")], 3)
    return out.groupBy("r_name", "n_name").agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_custkey, array_to_string(coalesce(list(o_orderkey order by o_orderkey) filter (o_orderkey is not null), []), ',') as orders, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by c_custkey")
def inverse_refs(spark, d):
    out = rel.inverse(load(spark, d, "customer").select("c_custkey"), "c_custkey", load(spark, d, "orders"), "o_custkey", "o_orderkey", "orders")
    return out.select("c_custkey", F.array_join(F.col("orders").cast("array<string>"), ",").alias("orders"), F.size("orders").cast("long").alias("n"))


@query("select s_suppkey, case when s_suppkey % 7 = 0 then 'renamed' else s_name end as s_name, s_acctbal from supplier where s_suppkey % 5 <> 0 union all select 1000000 + s_suppkey, 'new', 0.0 from supplier where s_suppkey % 11 = 0 and s_suppkey % 5 <> 0")
def update_delta(spark, d):
    s = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    none = F.lit(None)
    renamed = s.where("s_suppkey % 7 = 0 and s_suppkey % 5 <> 0").select("s_suppkey", F.lit("renamed").alias("s_name"), none.cast("double").alias("s_acctbal"), F.lit(False).alias("gone"))
    gone = s.where("s_suppkey % 5 = 0").select("s_suppkey", none.cast("string"), none.cast("double"), F.lit(True))
    new = s.where("s_suppkey % 11 = 0 and s_suppkey % 5 <> 0").select(F.col("s_suppkey") + 1000000, F.lit("new"), F.lit(0.0), F.lit(False))
    return rel.apply_delta(s, renamed.union(gone).union(new), "s_suppkey", ["s_name", "s_acctbal"], "gone")


@query("select distinct x.l_orderkey as l_orderkey, x.l_partkey as a, y.l_partkey as b from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_partkey < y.l_partkey")
def pairs_within_order(spark, d):
    return rel.pairs_within(load(spark, d, "lineitem"), "l_orderkey", "l_partkey")


@query("select 'same_order' as factor, x.l_suppkey as a, y.l_suppkey as b, count(*) as n from lineitem x join lineitem y on x.l_orderkey = y.l_orderkey and x.l_linenumber < y.l_linenumber group by 2, 3 union all select 'nation', s_suppkey, s_nationkey, 1 from supplier")
def template_unroll(spark, d):
    x = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    y = x.select("l_orderkey", F.col("l_linenumber").alias("m"), F.col("l_suppkey").alias("b"))
    pairs = x.join(y, "l_orderkey").where("l_linenumber < m").groupBy(F.col("l_suppkey").alias("a"), "b").agg(F.count("*").alias("n"))
    one = load(spark, d, "supplier").select(F.lit("nation").alias("factor"), F.col("s_suppkey").alias("a"), F.col("s_nationkey").cast("long").alias("b"), F.lit(1).cast("long").alias("n"))
    return pairs.select(F.lit("same_order").alias("factor"), "a", "b", "n").union(one)


@query("with x as (select conv_id, turn, role, coalesce(lag(role) over (partition by conv_id order by turn, text) <> role, true) as new from conversations), r as (select *, sum(new::int) over (partition by conv_id order by turn rows unbounded preceding) as run from x) select conv_id, role, min(turn) as first, max(turn) as last, count(*) as length from r group by conv_id, run, role")
def label_runs(spark, d):
    return tk.runs(load(spark, d, "conversations"), "conv_id", "turn", "role")


@query("with x as (select user_id, event_id, event_type, lag(event_type) over w is distinct from event_type as new, event_id as e from events window w as (partition by user_id order by event_id)), r as (select *, sum(new::int) over (partition by user_id order by event_id rows unbounded preceding) as run from x) select user_id, event_type, min(e) as first, max(e) as last, count(*) as length from r group by user_id, run, event_type")
def event_runs(spark, d):
    return tk.runs(load(spark, d, "events"), "user_id", "event_id", "event_type")


@query("with x as (select user_id, ts, event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over w) > 3600000000, false)::int as new from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from x) select user_id, cast(session as bigint) as session, min(ts) as start, max(ts) as stop, count(*) as n from s group by 1, 2")
def gap_sessions(spark, d):
    return tk.sessions(load(spark, d, "events"), "user_id", "ts", 3600, "event_id")


@query("select e.event_id, e.user_id, (select max_by(p.value, p.ts) from events p where p.event_type = 'purchase' and p.user_id = e.user_id and p.ts <= e.ts) as last_purchase from events e where e.event_type = 'error'")
def as_of_purchase(spark, d):
    e = load(spark, d, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_purchase"))
    return rel.as_of(left, right, "user_id", "ts", "last_purchase").select("event_id", "user_id", "last_purchase")


@query("with s as (select l_orderkey as by, l_linenumber as id, l_linenumber as start, l_linenumber + l_quantity::int % 4 + 1 as stop from lineitem) select a.by, a.id as a, b.id as b from s a join s b on a.by = b.by where a.start <= b.start and b.stop <= a.stop and a.id <> b.id")
def span_containing(spark, d):
    s = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("by"), F.col("l_linenumber").alias("id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 4 + 1).alias("end"))
    return rel.spans_at(s, s, "by", "containing").where("a_id <> b_id").select("by", F.col("a_id").alias("a"), F.col("b_id").alias("b"))


# vectors


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::double))), 4) as l1, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) as l2, round(list_max(list_transform(embedding, lambda x: abs(x::double))), 6) as linf, list_position(embedding, list_max(embedding)) - 1 as top from embeddings")
def emb_norms(spark, d):
    e = F.col("embedding")
    return load(spark, d, "embeddings").select("vec_id", F.round(M.norm(e, 1), 4).alias("l1"), F.round(M.norm(e), 4).alias("l2"), F.round(M.norm(e, 0), 6).alias("linf"), M.index_of_max(e).cast("int").alias("top"))


@query("with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), n as (select vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from e), s as (select q.vec_id as query, x.vec_id as vec_id, round(list_dot_product(q.v, x.v) / (q.n * x.n), 6) as score from n q, n x where q.vec_id % 100 = 0 and q.vec_id <> x.vec_id) select * from (select query, vec_id, score, row_number() over (partition by query order by score desc, vec_id) as rank from s) where rank <= 10")
def emb_cosine_topk(spark, d):
    """The ten nearest of each query vector (ids divisible by 100) among all: blocks of vectors meet blocks of queries."""
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), M.normalised(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    e = rel.cut(e)  # else each use of a vector would find its norm again
    return embeddings.nearest_by_blocks(e, e.where("id % 100 = 0"), 10).withColumnRenamed("id", "vec_id")


@query("with x as (select label, i, embedding[i]::double as v from (select label, embedding, unnest(range(1, 65)) as i from embeddings)) select label, i - 1 as dim, round(avg(v), 5) as mean, round(var_samp(v), 5) as variance from x group by label, i")
def emb_centroid_by_label(spark, d):
    x = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return x.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"), F.round(F.var_samp(F.col("v").cast("double")), 5).alias("variance"))


@query("with t as (select source, unnest(regexp_extract_all(lower(text), '[A-Za-z]+')) as term from documents), c as (select source, term, count(*)::double as n from t group by 1, 2), z as (select source, sqrt(sum(n * n)) as z from c group by 1) select a.source as a, b.source as b, round(sum(a.n * b.n) / (any_value(x.z) * any_value(y.z)), 6) as cosine from c a join c b on a.term = b.term and a.source < b.source join z x on x.source = a.source join z y on y.source = b.source group by 1, 2")
def bag_cosine_pairs(spark, d):
    c = tk.tokens(load(spark, d, "documents").withColumn("doc_id", F.col("source"))).groupBy(F.col("doc_id").alias("source"), "term").agg(F.count("*").cast("double").alias("n"))
    z = c.groupBy("source").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("z"))
    # per term an array of its sources: pairs are made of the few sources, inside a row
    per = c.groupBy("term").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("s"))
    pairs = per.select(F.explode("s").alias("x"), "s").select("x", F.explode("s").alias("y")).where("x.source < y.source")
    dots = pairs.groupBy(F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(F.col("x.n") * F.col("y.n")).alias("dot"))
    out = dots.join(z.withColumnRenamed("source", "a").withColumnRenamed("z", "za"), "a").join(z.withColumnRenamed("source", "b").withColumnRenamed("z", "zb"), "b")
    return out.select("a", "b", F.round(F.col("dot") / (F.col("za") * F.col("zb")), 6).alias("cosine"))


@query("select user_id, round(-sum(p * log2(p)), 6) as bits from (select user_id, n / sum(n) over (partition by user_id) as p from (select user_id, event_type, count(*) as n from events group by 1, 2)) group by 1")
def event_entropy(spark, d):
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg(F.array_sort(F.collect_list(F.col("n").cast("double"))).alias("n")).select("user_id", F.round(M.entropy(F.col("n")), 6).alias("bits"))


@query("with x as (select o_custkey, max(ln(o_totalprice)) as m, list(ln(o_totalprice)) as v from orders group by 1) select o_custkey, round(m + ln(list_sum(list_transform(v, lambda y: exp(y - m)))), 6) as total from x")
def log_sum_exp_orders(spark, d):
    x = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.log("o_totalprice"))).alias("v"))
    return x.select("o_custkey", F.round(M.log_sum_exp(F.col("v")), 6).alias("total"))


@query("select slot, cast(sum(sign) as bigint) as weight, count(*) as n from (select cast('0x' || left(md5(term), 8) as bigint) % 256 as slot, case when cast('0x' || substring(md5(term), 9, 1) as bigint) < 8 then 1 else -1 end as sign from (select unnest(regexp_extract_all(lower(text), '[A-Za-z]+')) as term from documents)) group by slot")
def hashing_trick(spark, d):
    t = tk.tokens(load(spark, d, "documents")).groupBy("term").agg(F.count("*").alias("n")).withColumn("h", M.hashed_feature(F.col("term"), 256))
    return t.groupBy("h.slot").agg(F.sum(F.col("h.sign") * F.col("n")).alias("weight"), F.sum("n").alias("n"))


# dates


@query("select o_orderkey, cast(year(o_orderdate) as integer) as y, cast(month(o_orderdate) as integer) as m, cast(day(o_orderdate) as integer) as dd, cast(cast(o_orderdate as date) as varchar) as as_date from orders")
def date_phrases(spark, d):
    """Order dates written out in four ways and read back."""
    o, k = load(spark, d, "orders"), F.pmod("o_orderkey", F.lit(4))
    written = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "d MMMM yyyy")).when(k == 2, F.date_format("o_orderdate", "MMM. d, yyyy")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    x = o.select("o_orderkey", D.date_phrase(F.concat(F.lit("shipped on "), written, F.lit(" by sea"))).alias("p"))
    return x.select("o_orderkey", F.col("p.year").alias("y"), F.col("p.month").alias("m"), F.col("p.day").alias("dd"), D.to_date(F.col("p")).cast("string").alias("as_date"))


@query("with r as (select min(epoch(ts)) as lo, max(epoch(ts)) as hi from events) select event_id, round((epoch(ts) - lo) / (hi - lo), 6) as t from events, r")
def time_min_max(spark, d):
    e = load(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    r = e.agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    return e.join(F.broadcast(r)).select("event_id", F.round(D.min_max(F.col("u"), F.col("lo"), F.col("hi")), 6).alias("t"))  # one row


# entity resolution


@query("select distinct least(x.c_custkey, y.c_custkey) as a, greatest(x.c_custkey, y.c_custkey) as b from customer x join customer y on x.c_nationkey = y.c_nationkey and x.c_mktsegment = y.c_mktsegment and floor(x.c_acctbal / 500) = floor(y.c_acctbal / 500) and x.c_custkey < y.c_custkey")
def canopy_pairs(spark, d):
    c = load(spark, d, "customer")
    key = F.array(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_acctbal") / 500).cast("string")))
    return rel.canopy_pairs(c, "c_custkey", key)


@query("with p as (select p_partkey, p_name, p_brand, p_size from part) select x.p_partkey as a, y.p_partkey as b, levenshtein(x.p_name, y.p_name) as distance from p x join p y on x.p_brand = y.p_brand and x.p_size = y.p_size and x.p_partkey < y.p_partkey where levenshtein(x.p_name, y.p_name) <= 6")
def edit_distance_pairs(spark, d):
    """Each two different names of a block are compared once; the parts that have them are joined to the near ones."""
    p = load(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    block = ["p_brand", "p_size"]
    n = p.select(*block, F.col("p_name").alias("na")).distinct()
    near = n.join(n.withColumnRenamed("na", "nb"), block).where("na <= nb").withColumn("distance", S.weighted_edit_distance(F.col("na"), F.col("nb")).cast("long")).where("distance <= 6")
    x, y = (p.select(*block, F.col("p_name").alias(name), F.col("p_partkey").alias(key)) for name, key in (("na", "x"), ("nb", "y")))
    near = rel.cut(near)
    sizes = p.groupBy(*block, "p_name").count()
    total = near.join(sizes.toDF(*block, "na", "ca"), [*block, "na"]).join(sizes.toDF(*block, "nb", "cb"), [*block, "nb"]).agg(F.sum(F.col("ca") * F.col("cb"))).first()[0] or 0
    # few parts make many pairs: each name's parts are dealt out, so that tasks are as many as the pairs ask for
    tasks, deals = max(1, min(10_000, total // 1_000_000)), 16
    left = near.join(x, [*block, "na"]).withColumn("deal", F.pmod(F.xxhash64("x"), F.lit(deals)).cast("int")).repartition(tasks, *block, "nb", "deal")
    right = y.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).repartition(tasks, *block, "nb", "deal")
    pairs = left.join(right, [*block, "nb", "deal"]).where("na < nb or x < y").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


@query("with recursive e as (select distinct l_suppkey as s, l_partkey as p from lineitem), g as (select s as a, list(distinct b) as bs from (select x.s, y.s as b from e x join e y on x.p = y.p) group by 1), r as (select s as node, s as component from (select distinct s from e) union select g.a, r.component from r join (select a, unnest(bs) as b from g) g on g.b = r.node where r.component < g.a) select node, min(component) as component from r group by node")
def supplier_components(spark, d):
    """Suppliers connected through parts that both deliver: parts are nodes too, so no pairs of suppliers are made."""
    e = load(spark, d, "lineitem").select((F.col("l_suppkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b")).distinct()
    c = rel.components(e).where("node % 2 = 0")
    least = c.groupBy("component").agg(F.min("node").alias("m"))
    return c.join(least, "component").select((F.col("node") / 2).cast("long").alias("node"), (F.col("m") / 2).cast("long").alias("component"))


@query("with recursive e as (select distinct user_id as a, date_trunc('hour', ts) as h from events), l as (select x.a as a, y.a as b from e x join e y on x.h = y.h and x.a < y.a group by 1, 2 having count(*) >= 2), g as (select a, b from l union all select b, a from l), r as (select a as node, least(a, b) as component from g union select g.a, r.component from r join g on g.b = r.node where r.component < g.a) select node, min(component) as component from r group by node")
def user_components(spark, d):
    """Users connected through two or more hours in which both were seen. No two users of an hour are paired."""
    e = load(spark, d, "events").select(F.col("user_id").alias("id"), F.date_trunc("hour", "ts").alias("item"))
    return rel.shared_components(e)


@query("with x as (select l_suppkey as r, l_returnflag || l_linestatus || cast(l_linenumber as varchar) as c, count(*) as v from lineitem group by 1, 2) select c, count(*) as nnz, cast(sum(v) as bigint) as total, max(v) as top from x group by c")
def cooc_columns(spark, d):
    x = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("r"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("c")).agg(F.count("*").alias("v"))
    return x.groupBy("c").agg(F.count("*").alias("nnz"), F.sum("v").alias("total"), F.max("v").alias("top"))


@query("with recursive x as (select l_suppkey as r, l_partkey as c, count(*) as v from lineitem group by 1, 2), k as (select x.* from x join (select r from x group by 1 having count(*) > 1) using (r) join (select c from x group by 1 having count(*) > 1) using (c)), e as (select distinct p.r as a, q.r as b from k p join k q on p.c = q.c and p.r <> q.r), n as (select distinct r from k), w as (select r as node, r as component from n union select e.a, w.component from w join e on e.b = w.node where w.component < e.a), z as (select node, min(component) as component from w group by 1), t as (select component, count(*) as n from z group by 1 order by n desc, component limit 1) select r, c, v from k join z on z.node = r join t using (component)")
def cooc_prune(spark, d):
    """The largest connected part of the supplier by part matrix, thin rows and columns left out."""
    x = load(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c")).agg(F.count("*").alias("v"))
    return rel.prune(x, 1, 1)


# evaluation: sources as gold, parity classes as predictions

_POINTS = "p as (select doc_id as point, source as gold, lang || cast(doc_id % 3 as varchar) as predicted from documents)"


def _points(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("point"), F.col("source").alias("gold"), F.concat("lang", (F.col("doc_id") % 3).cast("string")).alias("predicted"))


_CELLS = f"with {_POINTS}, c as (select gold, predicted, count(*) as n from p group by 1, 2), o as (select *, sum(n) over (partition by gold) as ng, sum(n) over (partition by predicted) as np from c)"
_F1 = "select round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from s"


@query(f"{_CELLS}, s as (select sum(n * (n - 1)) / sum(n * (np - 1)) as p, sum(n * (n - 1)) / sum(n * (ng - 1)) as r from o) {_F1}")
def cluster_pairwise(spark, d):
    return ev.pairwise(_points(spark, d))


@query(f"{_CELLS}, s as (select sum(n * n / np) / sum(n) as p, sum(n * n / ng) / sum(n) as r from o) {_F1}")
def cluster_bcubed(spark, d):
    return ev.b_cubed(_points(spark, d))


@query(f"with {_POINTS}, a as (select sum(n - k) / sum(n - 1) as p from (select predicted, count(*) as n, count(distinct gold) as k from p group by 1)), b as (select sum(n - k) / sum(n - 1) as r from (select gold, count(*) as n, count(distinct predicted) as k from p group by 1)), s as (select p, r from a, b) {_F1}")
def cluster_muc(spark, d):
    return ev.muc(_points(spark, d))


_CEAF = "c as (select l_orderkey as d, l_returnflag as g, l_linestatus as p, count(*) as n from lineitem group by 1, 2, 3), s as (select *, sum(n) over (partition by d, g) as ng, sum(n) over (partition by d, p) as np from c), f as (select * from (values ('A', 'N'), ('A', 'R'), ('N', 'A'), ('N', 'R'), ('R', 'A'), ('R', 'N')) v(x, y)), o as (select distinct l_orderkey as d from lineitem), k as (select l_orderkey as d, count(*) as n, count(distinct l_returnflag) as eg, count(distinct l_linestatus) as ep from lineitem group by 1)"


@query(f"with {_CEAF}, m as (select o.d, max(coalesce(a.n, 0) + coalesce(b.n, 0))::double as m, max(coalesce(2.0 * a.n / (a.ng + a.np), 0) + coalesce(2.0 * b.n / (b.ng + b.np), 0)) as e from o cross join f left join s a on a.d = o.d and a.g = f.x and a.p = 'O' left join s b on b.d = o.d and b.g = f.y and b.p = 'F' group by o.d) select 'mention' as kind, m.d as doc_id, round(m, 6) as score, n as n_gold, n as n_predicted from m join k on k.d = m.d union all select 'entity', m.d, round(e, 6), eg, ep from m join k on k.d = m.d")
def cluster_ceaf(spark, d):
    """Flags against statuses of the lines of each order: a small matching for every order."""
    x = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("point"), F.col("l_returnflag").alias("gold"), F.col("l_linestatus").alias("predicted"))
    one = lambda kind, by_entity: ev.ceaf(x, by_entity).select(F.lit(kind).alias("kind"), "doc_id", F.round("score", 6).alias("score"), "n_gold", "n_predicted")
    return one("mention", False).union(one("entity", True))


_LABELS = "x as (select doc_id, cast(quality as varchar) as gold, case when n_chars > 2000 then '1' else '0' end as predicted from documents join labels using (doc_id))"


def _predictions(spark, d):
    return load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id").select("doc_id", F.col("quality").cast("string").alias("gold"), F.when(F.col("n_chars") > 2000, "1").otherwise("0").alias("predicted"))


_PER = f"with {_LABELS}, l as (select gold as label from x union select predicted from x), c as (select label, count(*) filter (gold = label and predicted = label) as tp, count(*) filter (gold <> label and predicted = label) as fp, count(*) filter (gold = label and predicted <> label) as fn from x, l group by label), m as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from c)"
_PERF = "round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6)"


@query(f"{_PER} select label, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, {_PERF} as f1 from m")
def eval_per_label(spark, d):
    return ev.per_label(_predictions(spark, d))


@query(f"{_PER} select round(avg(round(p, 6)), 4) as precision, round(avg(round(r, 6)), 4) as recall, round(avg({_PERF}), 4) as f1 from m")
def eval_macro(spark, d):
    return ev.macro(ev.per_label(_predictions(spark, d)))


@query(f"with {_LABELS}, s as (select avg((gold = predicted)::int) as p, avg((gold = predicted)::int) as r from x) {_F1}")
def eval_micro(spark, d):
    return ev.micro(ev.per_label(_predictions(spark, d)))


@query("with r as (select source, quality as hit, row_number() over (partition by source order by n_chars desc, doc_id) as r, sum(quality) over (partition by source order by n_chars desc, doc_id rows unbounded preceding) as h from documents join labels using (doc_id)) select source, round(coalesce(sum(h / r) filter (hit = 1) / nullif(sum(hit), 0), 0), 6) as ap from r group by source")
def avg_precision(spark, d):
    x = load(spark, d, "documents").join(load(spark, d, "labels"), "doc_id")
    return ev.average_precision(x, "source", "n_chars", "quality", "doc_id")


@query("select * from (select l_returnflag, l_orderkey, l_linenumber, l_extendedprice, row_number() over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber) as rank from lineitem) where rank <= 20")
def top_n_per_group(spark, d):
    w = Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return load(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice", F.row_number().over(w).alias("rank")).where("rank <= 20")


@query("select part, count(*) as n, min(doc_id) as least from (select doc_id, case when left(md5(cast(doc_id as varchar)), 1) < 'c' then 'train' when left(md5(cast(doc_id as varchar)), 1) < 'e' then 'dev' else 'test' end as part from documents) group by part")
def hashed_split(spark, d):
    h = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1)
    part = F.when(h < "c", "train").when(h < "e", "dev").otherwise("test")
    return load(spark, d, "documents").groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def line_cube(spark, d):
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("select event_type, n, round(v, 4) as v, w as window_start from (select event_type, time_bucket(interval '1 hour', ts) as w, count(*) as n, sum(value) as v from events group by 1, 2)")
def event_windows(spark, d):
    from textloom.streaming.events import windowed_counts

    return windowed_counts(load(spark, d, "events"), "1 hour").select("event_type", "n", F.round("v", 4).alias("v"), "window_start")
