"""Queries over numeric functions, distributions, tensors, objectives and update rules, each with SQL that says the same in another way."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from textloom.functions import maths as M
from textloom.operators import distributions as D, evaluation as ev, graphs, optimise as O, tensors as T, topics
from textloom.plans.registry import query
from textloom.sources.tables import load


def _lines(spark, d):
    return load(spark, d, "lineitem")


@query("select l_orderkey, l_linenumber, round(exp(l_quantity / 10 - m) / sum(exp(l_quantity / 10 - m)) over (partition by l_orderkey), 6) as p from (select *, max(l_quantity / 10) over (partition by l_orderkey) as m from lineitem)")
def softmax_lines(spark, d):
    x = _lines(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_quantity") / 10).alias("q")))).alias("x"))
    p = M.softmax(F.transform("x", lambda t: t["q"]))
    return x.select("l_orderkey", F.explode(F.arrays_zip(F.transform("x", lambda t: t["l_linenumber"]).alias("n"), p.alias("p"))).alias("t")).select("l_orderkey", F.col("t.n").alias("l_linenumber"), F.round("t.p", 6).alias("p"))


@query("select distinct cast(l_quantity as bigint) as n, l_linenumber as k, round(lgamma(l_quantity + 1), 6) as log_factorial, round(lgamma(l_quantity) + lgamma(l_linenumber) - lgamma(l_quantity + l_linenumber), 6) as log_beta, cast(round(exp(lgamma(l_quantity + 1) - lgamma(l_quantity - least(l_quantity, l_linenumber) + 1))) as bigint) as permutations, cast(round(exp(lgamma(l_quantity + 1) - lgamma(least(l_quantity, l_linenumber) + 1) - lgamma(l_quantity - least(l_quantity, l_linenumber) + 1))) as bigint) as combinations, round(-0.5772156649015329 + coalesce(list_sum(list_transform(range(1, cast(l_quantity as bigint)), lambda i: 1.0::double / i)), 0), 6) as digamma from lineitem where l_linenumber <= 4")
def gamma_functions(spark, d):
    x = _lines(spark, d).where("l_linenumber <= 4").select(F.col("l_quantity").cast("long").alias("n"), F.col("l_linenumber").alias("k")).distinct()
    n, k = F.col("n"), F.least("n", "k")
    return x.select("n", "k", F.round(M.log_factorial(n), 6).alias("log_factorial"), F.round(M.log_beta(n.cast("double"), F.col("k").cast("double")), 6).alias("log_beta"), M.permutations(n, k).alias("permutations"), M.combinations(n, k).alias("combinations"), F.round(M.digamma(n.cast("double")), 6).alias("digamma"))


@query("select distinct cast(l_quantity as integer) as n, l_linenumber as k, round(lgamma(l_quantity + 1) - lgamma(l_linenumber + 1) - lgamma(l_quantity - l_linenumber + 1) + l_linenumber * ln(0.3) + (l_quantity - l_linenumber) * ln(0.7), 6) as log_p, round(list_sum(list_transform(range(0, l_linenumber + 1), lambda i: exp(lgamma(l_quantity + 1) - lgamma(i + 1) - lgamma(l_quantity - i + 1) + i * ln(0.3) + (l_quantity - i) * ln(0.7)))), 6) as at_most from lineitem where l_quantity >= 10")
def binomial_chances(spark, d):
    x = _lines(spark, d).where("l_quantity >= 10").select(F.col("l_quantity").cast("int").alias("n"), F.col("l_linenumber").alias("k")).distinct()
    n, k, p = F.col("n"), F.col("k"), F.lit(0.3)
    return x.select("n", "k", F.round(M.log_binomial(n, k, p), 6).alias("log_p"), F.round(M.binomial_cdf(n, k, p), 6).alias("at_most"))


@query("select distinct l_discount as x, round(1 / (1 + exp(-l_discount)), 6) as sigmoid, round(ln((l_discount + 0.1) / (0.9 - l_discount)), 6) as logit, round(1 + 2 * l_discount + 3 * l_discount * l_discount, 6) as poly, round((exp(l_discount) + exp(-l_discount)) / 2, 6) as cosh, round((exp(2 * l_discount) - 1) / (exp(2 * l_discount) + 1), 6) as tanh, abs(l_discount - 0.05) < 1e-6 as near from lineitem")
def real_functions(spark, d):
    x = F.col("x")
    rows = _lines(spark, d).select(F.col("l_discount").alias("x")).distinct()
    return rows.select("x", F.round(M.sigmoid(x), 6).alias("sigmoid"), F.round(M.logit(x + 0.1), 6).alias("logit"), F.round(M.poly(x, [1, 2, 3]), 6).alias("poly"), F.round(F.cosh(x), 6).alias("cosh"), F.round(F.tanh(x), 6).alias("tanh"), M.almost_equal(x, F.lit(0.05)).alias("near"))


_SHARES = "s as (select l_suppkey, sum((l_returnflag = 'A')::int)::double as a, sum((l_returnflag = 'N')::int)::double as n, sum((l_returnflag = 'R')::int)::double as r from lineitem group by 1), p as (select l_suppkey, (a + 1) / (a + n + r + 3) as a, (n + 1) / (a + n + r + 3) as n, (r + 1) / (a + n + r + 3) as r from s)"


def _shares(spark, d):
    c = lambda f: (F.sum((F.col("l_returnflag") == f).cast("double")) + 1)
    x = _lines(spark, d).groupBy("l_suppkey").agg(F.array(c("A"), c("N"), c("R")).alias("p"))
    return x.select("l_suppkey", M.normalised(F.col("p"), 1).alias("p"))


@query(f"with {_SHARES}, k as (select l_suppkey, a * log2(a * 3) + n * log2(n * 3) + r * log2(r * 3) as kl, {' + '.join(f'{x} * log2({x} / (({x} + 1.0 / 3) / 2)) / 2 + log2((1.0 / 3) / (({x} + 1.0 / 3) / 2)) / 6' for x in 'anr')} as js, (abs(a - 1.0 / 3) + abs(n - 1.0 / 3) + abs(r - 1.0 / 3)) / 2 as tv from p) select l_suppkey, round(kl, 6) as kl, round(js, 6) as js, round(tv, 6) as variation from k")
def share_divergences(spark, d):
    even = F.array(*[F.lit(1 / 3)] * 3)
    x = _shares(spark, d)
    return x.select("l_suppkey", F.round(M.kl_divergence(F.col("p"), even), 6).alias("kl"), F.round(M.js_divergence(F.col("p"), even), 6).alias("js"), F.round(M.norm(F.zip_with("p", even, lambda a, b: a - b), 1) / 2, 6).alias("variation"))


@query(f"with {_SHARES} select l_suppkey, round(lgamma(6.0) - lgamma(1.5) - lgamma(2.5) - lgamma(2.0) + 0.5 * ln(a) + 1.5 * ln(n) + ln(r), 6) as log_p from p")
def dirichlet_density(spark, d):
    return _shares(spark, d).select("l_suppkey", F.round(D.log_dirichlet(F.col("p"), [1.5, 2.5, 2.0]), 6).alias("log_p"))


@query("select l_suppkey, round(sum(ln(case l_returnflag when 'A' then 0.25 when 'N' then 0.5 else 0.25 end)), 4) as plated, round(sum((l_returnflag = 'A')::int) * ln(0.25) + sum((l_returnflag = 'N')::int) * ln(0.5) + sum((l_returnflag = 'R')::int) * ln(0.25), 4) as multinomial from lineitem group by 1")
def discrete_densities(spark, d):
    v = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    x = _lines(spark, d).groupBy("l_suppkey").agg(F.collect_list(v).alias("v"))
    n = F.array(*(F.size(F.filter("v", lambda t: t == i)) for i in (F.lit(0), F.lit(1), F.lit(2))))
    return x.select("l_suppkey", F.round(D.log_plated(F.col("v"), [0.25, 0.5, 0.25]), 4).alias("plated"), F.round(D.log_multinomial(n, [0.25, 0.5, 0.25]), 4).alias("multinomial"))


@query("select distinct cast(l_quantity as integer) as q, round(-0.5 * ln(2 * pi() * 200) - (l_quantity - 25) * (l_quantity - 25) / 400, 6) as gaussian, round(3 * ln(0.1) - lgamma(3) + 2 * ln(l_quantity) - 0.1 * l_quantity, 6) as gamma, round(l_quantity * ln(25) - 25 - lgamma(l_quantity + 1), 6) as poisson, round(ln(l_quantity / 51) + 2 * ln(1 - l_quantity / 51) - (lgamma(2) + lgamma(3) - lgamma(5)), 6) as beta from lineitem")
def densities(spark, d):
    x = _lines(spark, d).select(F.col("l_quantity").cast("int").alias("q")).distinct()
    q = F.col("q")
    return x.select("q", F.round(D.log_gaussian(q, 25.0, 200.0), 6).alias("gaussian"), F.round(D.log_gamma_density(q, 3.0, 0.1), 6).alias("gamma"), F.round(D.log_poisson(q, 25.0), 6).alias("poisson"), F.round(D.log_beta_density(q / 51, 2.0, 3.0), 6).alias("beta"))


@query("with g as (select distinct cast(l_quantity as integer) as q, ln(0.3) - 0.5 * ln(2 * pi() * 50) - (l_quantity - 10) * (l_quantity - 10) / 100 as a, ln(0.7) - 0.5 * ln(2 * pi() * 100) - (l_quantity - 35) * (l_quantity - 35) / 200 as b from lineitem) select q, round(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) as log_p, round(1 / (1 + exp(b - a)), 6) as first, case when a >= b then 0 else 1 end as gate from g")
def mixture_gates(spark, d):
    x = _lines(spark, d).select(F.col("l_quantity").cast("int").alias("q")).distinct()
    parts = [(0.3, D.log_gaussian(F.col("q"), 10.0, 50.0)), (0.7, D.log_gaussian(F.col("q"), 35.0, 100.0))]
    r = D.responsibilities(parts)
    return x.select("q", F.round(D.log_mixture(parts), 6).alias("log_p"), F.round(F.get(r, F.lit(0)), 6).alias("first"), M.index_of_max(r).cast("int").alias("gate"))


@query("with m as (select avg(l_discount + 0.01) as m, var_pop(l_discount + 0.01) as v from lineitem), g as (select sum(l_quantity * l_tax) / sum(l_quantity) as mean, sum(l_quantity * l_tax * l_tax) / sum(l_quantity) - pow(sum(l_quantity * l_tax) / sum(l_quantity), 2) as variance from lineitem) select round(m * (m * (1 - m) / v - 1), 4) as alpha, round((1 - m) * (m * (1 - m) / v - 1), 4) as beta, round(mean, 6) as mean, round(variance, 8) as variance from m, g")
def moment_fits(spark, d):
    x = _lines(spark, d).select((F.col("l_discount") + 0.01).alias("x"), "l_tax", "l_quantity")
    a, b = D.fit_beta(x, "x")
    mean, variance = D.fit_weighted_gaussian(x, "l_tax", "l_quantity")
    return spark.createDataFrame([(round(a, 4), round(b, 4), round(mean, 6), round(variance, 8))], "alpha double, beta double, mean double, variance double")


# bags

_BAGS = "c as (select user_id, event_type, count(*)::double as n from events group by 1, 2), t as (select event_type, sum(n) as n from c group by 1)"


def _bags(spark, d):
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n"))
    bag = lambda rows: F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))
    whole = c.groupBy("event_type").agg(F.sum("n").alias("n")).agg(bag(None).alias("parent"))
    return c.groupBy("user_id").agg(bag(None).alias("bag")).join(F.broadcast(whole))  # one row


@query(f"with {_BAGS}, x as (select user_id, sum(c.n) as l1, sqrt(sum(c.n * c.n)) as l2, sum(c.n * t.n) as dot, sum(c.n * (t.n - c.n)) as without from c join t using (event_type) group by 1), p as (select sqrt(sum(n * n)) as z from t), w as (select u.user_id, sqrt(sum(pow(t.n - coalesce(c.n, 0), 2))) as z from (select distinct user_id from c) u cross join t left join c on c.user_id = u.user_id and c.event_type = t.event_type group by 1) select user_id, l1, round(l2, 6) as l2, round(dot / (l2 * p.z), 6) as cosine, round(without / (l2 * w.z), 6) as deducted from x join w using (user_id), p")
def bag_measures(spark, d):
    x = _bags(spark, d)
    bag, parent = F.col("bag"), F.col("parent")
    return x.select("user_id", M.bag_norm(bag, 1).alias("l1"), F.round(M.bag_norm(bag), 6).alias("l2"), F.round(M.bag_cosine(bag, parent), 6).alias("cosine"), F.round(M.deducted_cosine(bag, parent), 6).alias("deducted"))


@query("with u as (select distinct user_id from events), o as (select * from (values ('view', 2.0), ('click', 1.0), ('other', 4.0)) v(term, w)), c as (select user_id, event_type as term, count(*)::double as n from events group by 1, 2), f as (select coalesce(c.user_id, x.user_id) as user_id, coalesce(c.term, x.term) as term, coalesce(c.n, 0) as n, coalesce(x.w, 0) as w from c full join (select user_id, term, w::double as w from u cross join o) x on x.user_id = c.user_id and x.term = c.term) select user_id, term, n + w as both, case when abs(n - w) > 1e-6 then n - w end as less from f")
def bag_arithmetic(spark, d):
    x = _bags(spark, d).select("user_id", "bag", F.create_map(F.lit("view"), F.lit(2.0), F.lit("click"), F.lit(1.0), F.lit("other"), F.lit(4.0)).alias("more"))
    x = x.select("user_id", M.bag_sum(F.col("bag"), F.col("more")).alias("both"), M.bag_sum(F.col("bag"), F.col("more"), -1).alias("less"))
    return x.select("user_id", "less", F.explode("both").alias("term", "both")).select("user_id", "term", "both", F.col("less")[F.col("term")].alias("less"))


# tensors: quantities by supplier, line number and flag

_A = "a as (select l_suppkey as r, l_linenumber as c, sum(l_quantity) as v from lineitem group by 1, 2), b as (select l_suppkey as r, l_linenumber as c, count(*)::double as v from lineitem where l_returnflag = 'N' group by 1, 2)"


def _matrix(spark, d, flag=None):
    x = _lines(spark, d)
    return T.tensor(x.where(F.col("l_returnflag") == flag) if flag else x, {"r": F.col("l_suppkey"), "c": F.col("l_linenumber")}, F.lit(1) if flag else F.col("l_quantity"))


@query(f"with {_A}, s as (select r, c, sum(v) as v from (select r, c, v from a union all select r, c, -2 * v from b) group by 1, 2) select r, c, round(v, 6) as v from s where v <> 0")
def tensor_sum(spark, d):
    return T.add(_matrix(spark, d), _matrix(spark, d, "N"), -2.0).select("r", "c", F.round("v", 6).alias("v"))


@query(f"with {_A} select x.r as i, y.r as j, round(sum(x.v * y.v), 4) as v from a x join b y on x.c = y.c where x.r <= 20 group by 1, 2")
def tensor_matmul(spark, d):
    a = _matrix(spark, d).where("r <= 20")
    b = T.renamed(_matrix(spark, d, "N"), r="j")
    return T.contract(T.renamed(a, r="i"), b, ["c"]).select("i", "j", F.round("v", 4).alias("v"))


@query(f"with {_A}, x as (select c, sum(v) as w from b group by 1), y as (select r, sum(v) as w from b group by 1) select 'right' as side, a.r as k, round(sum(a.v * w), 4) as v from a join x using (c) group by 2 union all select 'left', a.c, round(sum(a.v * w), 4) from a join y using (r) group by 2")
def tensor_by_vector(spark, d):
    a, b = _matrix(spark, d), _matrix(spark, d, "N")
    right = T.contract(a, T.sums(b, "c"), ["c"]).select(F.lit("right").alias("side"), F.col("r").alias("k"), F.round("v", 4).alias("v"))
    return right.union(T.contract(a, T.sums(b, "r"), ["r"]).select(F.lit("left"), F.col("c").cast("long"), F.round("v", 4)))


@query(f"with {_A} select 'trace' as what, round(sum(v) filter (r = c), 4) as v from a union all select 'dot', round(sum(a.v * b.v), 4) from a join b using (r, c) union all select 'l1', round(sum(abs(v)), 4) from a union all select 'l2', round(sqrt(sum(v * v)), 4) from a union all select 'linf', round(max(abs(v)), 4) from a union all select 'active', count(distinct r)::double from b union all select 'diagonal', count(*)::double from a where r = c")
def tensor_numbers(spark, d):
    a, b = _matrix(spark, d), _matrix(spark, d, "N")
    one = lambda what, df: df.select(F.lit(what).alias("what"), F.round("v", 4).alias("v"))
    out = one("trace", T.trace(a, "r", "c")).union(one("dot", T.dot(a, b)))
    for name, p in (("l1", 1), ("l2", 2), ("linf", 0)):
        out = out.union(one(name, T.norm(a, p)))
    count = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").cast("double").alias("v"))
    return out.union(count("active", T.active(b, "r"))).union(count("diagonal", T.diagonal(a, "r", "c")))


@query("with t as (select l_suppkey as i, l_linenumber as j, l_returnflag as k, sum(l_quantity) as v from lineitem group by 1, 2, 3), w as (select l_returnflag as k, count(*)::double as w from lineitem group by 1) select i, j, round(sum(v * w), 4) as v from t join w using (k) where j <> 3 group by 1, 2 union all select i, -1, round(sum(v), 4) from t where j = 3 and k = 'A' group by 1")
def tensor_order_three(spark, d):
    x = _lines(spark, d)
    t = T.tensor(x, {"i": F.col("l_suppkey"), "j": F.col("l_linenumber"), "k": F.col("l_returnflag")}, F.col("l_quantity"))
    w = T.tensor(x, {"k": F.col("l_returnflag")}, F.lit(1))
    by_vector = T.contract(t.where("j <> 3"), w, ["k"]).select("i", "j", F.round("v", 4).alias("v"))
    return by_vector.union(T.part(T.part(t, "j", 3), "k", "A").select("i", F.lit(-1), F.round("v", 4)))


@query("with a as (select l_linenumber as i, sum(l_quantity) as v from lineitem group by 1), b as (select l_returnflag as k, count(*)::double as v from lineitem group by 1) select i, k, round(a.v * b.v / 1000, 4) as v from a, b")
def tensor_outer(spark, d):
    x = _lines(spark, d)
    a, b = T.tensor(x, {"i": F.col("l_linenumber")}, F.col("l_quantity")), T.tensor(x, {"k": F.col("l_returnflag")}, F.lit(1))
    return T.scale(T.outer(a, b), 0.001).select("i", "k", F.round("v", 4).alias("v"))


@query(f"with {_A}, h as (select cast('0x' || left(md5(r || '|' || c), 8) as bigint) % 64 as slot, case when cast('0x' || substring(md5(r || '|' || c), 9, 1) as bigint) < 8 then 1 else -1 end * v as v from a) select slot, round(sum(v), 4) as v from h group by 1")
def tensor_hashed(spark, d):
    return T.hashed(_matrix(spark, d), 64).select("slot", F.round("v", 4).alias("v"))


@query(f"with {_A}, x as (select r, c, v, v + 0.5 as w, sum(v + 0.5) over (partition by r) as z from b) select r, c, v, round(w / z, 6) as p, round(ln(w / z), 6) as log_p from x")
def masses_to_proportions(spark, d):
    return T.proportions(_matrix(spark, d, "N"), ["r"], 0.5).select("r", "c", "v", F.round("p", 6).alias("p"), F.round("log_p", 6).alias("log_p"))


@query(f"with {_A} select r, c, round(a.v * b.v, 4) as v, 0 as block from a join b using (r, c) union all select r, c, round(v * w, 4), 1 from a join (select c, sum(v) as w from b group by 1) using (c)")
def tensor_products(spark, d):
    a, b = _matrix(spark, d), _matrix(spark, d, "N")
    return T.concatenated([T.times(a, b), T.times(a, T.sums(b, "c"))]).select("r", "c", F.round("v", 4).alias("v"), "block")


# objectives and update rules


@query("with x as (select distinct round(l_discount * 40 - 2, 2) as s, case when l_returnflag = 'R' then 1.0 else -1.0 end::double as y from lineitem) select s, y, round(ln(1 + exp(-y * s)), 6) as log, round(greatest(0, 1 - y * s), 6) as hinge, round(pow(greatest(0, 1 - y * s), 2), 6) as hinge_squared, round(case when y * s >= 1 then 0 when y * s <= 0 then 0.5 - y * s else 0.5 * pow(1 - y * s, 2) end, 6) as smooth_hinge, round(greatest(0, -y * s), 6) as perceptron, round(0.5 * pow(s - y, 2), 6) as squared, round(abs(s - y), 6) as absolute, round(greatest(0, abs(s - y) - 0.1), 6) as insensitive, round(-y / (1 + exp(y * s)), 6) as log_slope, case when y * s < 1 then -y else 0 end as hinge_slope, round(s - y, 6) as squared_slope from x")
def objective_values(spark, d):
    x = _lines(spark, d).select(F.round(F.col("l_discount") * 40 - 2, 2).alias("s"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("y")).distinct()
    names = ["log", "hinge", "hinge_squared", "smooth_hinge", "perceptron", "squared", "absolute", "insensitive"]

    def run(batches):
        for pdf in batches:
            s, y = pdf["s"].to_numpy(), pdf["y"].to_numpy()
            for name in names:
                pdf[name] = np.round(O.OBJECTIVES[name](s, y)[0] + 1e-12, 6)
            for name in ("log", "hinge", "squared"):
                pdf[name + "_slope"] = np.round(O.OBJECTIVES[name](s, y)[1], 6)
            yield pdf

    return x.mapInPandas(run, "s double, y double, " + ", ".join(f"{n} double" for n in [*names, "log_slope", "hinge_slope", "squared_slope"]))


def _steps_sql() -> str:
    """Two steps of each rule from w = (0.5, 0.5) with the gradients g and h, written out."""
    w0, out = "0.5", []
    z = "sqrt(g0 * g0 + g1 * g1)"
    zz = "sqrt(h0 * h0 + h1 * h1)"
    for k in (0, 1):
        g, h = f"g{k}", f"h{k}"
        rules = {
            "constant": f"{w0} - 0.1 * {g} - 0.1 * {h}",
            "sqrt_rate": f"{w0} - 0.1 * {g} - 0.1 / sqrt(2) * {h}",
            "linear_rate": f"{w0} - 0.1 * {g} - 0.05 * {h}",
            "constant_length": f"{w0} - 0.1 * {g} / {z} - 0.1 * {h} / {zz}",
            "length_linear": f"{w0} - 0.1 * {g} / {z} - 0.05 * {h} / {zz}",
            "adagrad": f"{w0} - {g} / (0.1 + abs({g})) - {h} / (0.1 + sqrt({g} * {g} + {h} * {h}))",
            "rda": f"-sign({g} + {h}) * greatest(0, abs({g} + {h}) - 0.02) / (10 + 0.2)",
            "adagrad_rda": f"-sign({g} + {h}) * greatest(0, abs({g} + {h}) - 0.02) / (0.1 + sqrt({g} * {g} + {h} * {h}) + 0.2)",
            "averaged": f"({w0} - 0.1 * {g} + {w0} - 0.1 * {g} - 0.1 * {h}) / 2",
            "decayed": f"({w0} * 0.99 - 0.1 * {g}) * 0.99 - 0.1 * {h}",
            "cube": f"greatest(-0.2, least(0.2, greatest(-0.2, least(0.2, {w0} - 0.1 * {g})) - 0.1 * {h}))",
            "group_lasso": f"-0.1 * greatest(0, 1 - 0.02 / sqrt(pow(g0 + h0, 2) + pow(g1 + h1, 2))) * ({g} + {h})",
        }
        out += [f"select '{n}' as rule, {k} as k, round({e}, 6) as w from x" for n, e in rules.items()]

        out.append(f"select 'exponentiated', {k}, round(a{k} * exp(-0.1 * (h{k} - least(h0, h1))) / (a0 * exp(-0.1 * (h0 - least(h0, h1))) + a1 * exp(-0.1 * (h1 - least(h0, h1)))), 6) from (select *, exp(-0.1 * (g0 - least(g0, g1))) as a0, exp(-0.1 * (g1 - least(g0, g1))) as a1 from x)")

        out.append(f"select 'ftrl', {k}, round(-(z2 - sign(z2) * 0.01) / ((1 + sqrt(g{k} * g{k} + h{k} * h{k})) / 0.5 + 0.1) * (abs(z2) > 0.01)::int, 6) from (select *, z1 + h{k} - (sqrt(g{k} * g{k} + h{k} * h{k}) - abs(g{k})) / 0.5 * w1 as z2 from (select *, -(z1 - sign(z1) * 0.01) / ((1 + abs(g{k})) / 0.5 + 0.1) * (abs(z1) > 0.01)::int as w1 from (select *, g{k} - abs(g{k}) / 0.5 * 0.5 as z1 from x)))")
        out.append(f"select 'pegasos', {k}, round(w{k} * least(1, 1 / (sqrt(0.1) * sqrt(w0 * w0 + w1 * w1))), 6) from (select *, u0 - (h0 + 0.1 * u0) / 0.2 as w0, u1 - (h1 + 0.1 * u1) / 0.2 as w1 from (select *, p0 * least(1, 1 / (sqrt(0.1) * sqrt(p0 * p0 + p1 * p1))) as u0, p1 * least(1, 1 / (sqrt(0.1) * sqrt(p0 * p0 + p1 * p1))) as u1 from (select *, 0.5 - (g0 + 0.05) / 0.1 as p0, 0.5 - (g1 + 0.05) / 0.1 as p1 from x)))")
        out.append(f"select 'ball', {k}, round(b{k} * least(1, 0.4 / sqrt(b0 * b0 + b1 * b1)), 6) from (select *, 0.5 - 0.1 * g0 as b0, 0.5 - 0.1 * g1 as b1 from x)")
        out.append(f"select 'mira', {k}, round(0.5 + least(1.0, 0.75 / (g0 * g0 + g1 * g1)) * g{k}, 6) from x")
    return "with x as (select avg(l_discount) * 20 as g0, avg(l_tax) * 20 - 1.5 as g1, avg(l_quantity) / 50 as h0, -avg(l_linenumber) / 7 as h1 from lineitem) " + " union all ".join(out)


@query(_steps_sql())
def update_rules(spark, d):
    """Two steps of each update rule from gradients that are means over the table."""
    r = _lines(spark, d).agg(F.avg("l_discount") * 20, F.avg("l_tax") * 20 - 1.5, F.avg("l_quantity") / 50, -F.avg("l_linenumber") / 7).first()
    g, h = np.array(r[:2]), np.array(r[2:])
    rules = {
        "constant": O.Constant(0.1), "sqrt_rate": O.Constant(0.1, "sqrt"), "linear_rate": O.Constant(0.1, "linear"), "constant_length": O.ConstantLength(0.1), "length_linear": O.ConstantLength(0.1, "linear"), "adagrad": O.AdaGrad(1.0, 0.1),
        "rda": O.RDA(0.1, 0.01, 0.1), "adagrad_rda": O.AdaGradRDA(1.0, 0.1, 0.01, 0.1), "decayed": O.WeightDecay(O.Constant(0.1), 0.01), "cube": O.Projected(O.Constant(0.1), lambda w: O.project_cube(w, -0.2, 0.2)),
        "group_lasso": O.GroupLassoRDA(np.array([0, 0]), 0.1, 0.01), "exponentiated": O.ExponentiatedGradient(0.1), "ftrl": O.FTRL(0.5, 1.0, 0.01, 0.1), "pegasos": O.Pegasos(0.1),
    }
    out = {name: rule.step(rule.step(np.array([0.5, 0.5]), g), h) for name, rule in rules.items()}
    mean = O.Averaged(O.Constant(0.1))
    mean.step(mean.step(np.array([0.5, 0.5]), g), h)
    out |= {"averaged": mean.mean, "ball": O.project_ball(O.Constant(0.1).step(np.array([0.5, 0.5]), g), 0.4), "mira": O.mira_step(np.array([0.5, 0.5]), g, 0.75)}
    return spark.createDataFrame([(name, k, round(float(w[k]), 6)) for name, w in out.items() for k in (0, 1)], "rule string, k int, w double")


# graphs of three variables for each nation: exact inference is a sum over eight settings

_G = "n as (select c_nationkey as nation, avg(c_acctbal) / 5000 as u0, count(*) / 100.0::double - 0.5 as u1, min(c_acctbal) / 1000 as u2 from customer group by 1), v as (select unnest([0, 1]) as x), s as (select nation, a.x as x0, b.x as x1, c.x as x2, u0 * a.x + u1 * b.x + u2 * c.x + case when a.x = b.x then 0.8 else 0 end + case when b.x = c.x then -0.6 else 0 end as score from n, v a, v b, v c)"


def _graph(pdf: pd.DataFrame) -> graphs.Graph:
    r = pdf.iloc[0]
    pair = lambda w: np.array([[w, 0.0], [0.0, w]])
    return graphs.Graph([2, 2, 2], [((i,), np.array([0.0, r[f"u{i}"]])) for i in range(3)] + [((0, 1), pair(0.8)), ((1, 2), pair(-0.6))])


def _nations(spark, d):
    return load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg((F.avg("c_acctbal") / 5000).alias("u0"), (F.count("*") / 100 - 0.5).alias("u1"), (F.min("c_acctbal") / 1000).alias("u2"))


_MARGINALS = " union all ".join(f"select nation, {i} as variable, x{i} as value, round(sum(exp(score)) / any_value(z), 6) as p from s join (select nation, sum(exp(score)) as z from s group by 1) using (nation) group by nation, x{i}" for i in range(3))


@query(f"with {_G} {_MARGINALS}")
def graph_marginals(spark, d):
    """Belief propagation on trees, which is exact."""
    return graphs.infer_groups(_nations(spark, d), "nation", _graph, "tree", sweeps=6).select("nation", "variable", "value", F.round("p", 6).alias("p"))


@query(f"with {_G}, b as (select *, row_number() over (partition by nation order by score desc) as r from s) " + " union all ".join(f"select '{m}' as method, nation, x0, x1, x2, round(score, 6) as score from b where r = 1" for m in ("max_product", "dual", "linear_program", "enumerated")))
def graph_best_settings(spark, d):
    """The best setting by four methods, each of which is exact on trees."""

    def run(batches):
        for pdf in batches:
            rows = []
            for _, r in pdf.iterrows():
                g = _graph(pd.DataFrame([r]))
                best = {"max_product": graphs.propagate(g, 6, best=True)[1], "dual": graphs.dual_decomposition(g, 400)[0], "linear_program": graphs.max_product_lp(g, 200)[0], "enumerated": graphs.enumerate_all(g)[2]}
                rows += [(m, int(r["nation"]), *map(int, x), round(g.score(x), 6)) for m, x in best.items()]
            yield pd.DataFrame(rows, columns=["method", "nation", "x0", "x1", "x2", "score"])

    return _nations(spark, d).mapInPandas(run, "method string, nation int, x0 int, x1 int, x2 int, score double")


# evaluation over spans and heads


@query("with g as (select distinct l_orderkey as doc, l_linenumber as first from lineitem where l_returnflag = 'R'), p as (select distinct l_orderkey as doc, l_linenumber as first from lineitem where l_discount > 0.05), s as (select (select count(*) from g join p using (doc, first)) as tp, (select count(*) from p) as n_predicted, (select count(*) from g) as n_gold) select tp, n_predicted, n_gold, round(tp / n_predicted, 6) as precision, round(tp / n_gold, 6) as recall, round(2 * (tp / n_predicted) * (tp / n_gold) / (tp / n_predicted + tp / n_gold), 6) as f1 from s")
def segment_scores(spark, d):
    x = _lines(spark, d).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("first"), "l_returnflag", "l_discount")
    return ev.span_scores(x.where("l_returnflag = 'R'").select("doc", "first").distinct(), x.where("l_discount > 0.05").select("doc", "first").distinct(), ["doc", "first"])


@query("select round(avg((l_linenumber % 3 = l_partkey % 3)::int), 6) as uas, round(avg((l_linenumber % 3 = l_partkey % 3 and l_returnflag = 'N')::int), 6) as las from lineitem")
def attachment_scores(spark, d):
    return ev.attachment(_lines(spark, d).select((F.col("l_linenumber") % 3).alias("gold_head"), (F.col("l_partkey") % 3).alias("head"), F.lit("N").alias("gold_label"), F.col("l_returnflag").alias("label")))


_MIX = "s as (select l_returnflag as flag, l_shipmode as value from (select l_returnflag, l_linenumber as l_shipmode from lineitem)), p as (select flag, value, count(*) / sum(count(*)) over (partition by flag) as p from s group by 1, 2), w as (select flag, case flag when 'A' then 0 when 'N' then 1 else 2 end as part, case flag when 'A' then 0.25 when 'N' then 0.5 else 0.25 end as w from (select distinct flag from s))"


@query(f"with {_MIX}, g as (select value, part, row_number() over (partition by value order by w * p desc, part) as r from p join w using (flag)) select l_orderkey, l_linenumber, part as gate, count(*) as n from lineitem join g on value = l_linenumber and r = 1 group by 1, 2, 3")
def categorical_gates(spark, d):
    """Which of three categorical parts most likely gave a line its number."""
    x = _lines(spark, d)
    part = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    n = T.tensor(x, {"part": part, "value": F.col("l_linenumber")}, F.lit(1))
    shares = T.proportions(n, ["part"]).select("part", "value", "p")
    return topics.best_gates(x.select("l_orderkey", "l_linenumber"), "l_linenumber", [0.25, 0.5, 0.25], shares).groupBy("l_orderkey", "l_linenumber", "gate").agg(F.count("*").alias("n"))


@query("with c as (select user_id, event_type, count(*) as n from events group by 1, 2) select user_id, event_type from (select *, row_number() over (partition by user_id order by n desc, event_type) as r from c) where r = 1")
def discrete_modes(spark, d):
    c = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return topics.most_likely(c, ["user_id"], "event_type")
