"""URL filtering by rules and by a ratio of character language models (operator 8), in DataFrame functions only.

Rules decide first: the longest rule whose host (or a parent domain of the url's host) and path prefix fit. Accepted and rejected
urls are those that rules allow and block. Of each class a variable-order Markov model over characters is kept as counts of all
n-grams up to ORDER + 1; P(c | context) interpolates the orders by Witten-Bell smoothing, so rare contexts lean on shorter ones.

The log-likelihood difference is found once per distinct n-gram of full order, not per position, in whole micro-nats so that sums
don't depend on their order. A url's score is its sum over all positions divided by their number. The threshold is calibrated on
labelled urls that the models were not fitted on: midway between the means of the two classes.

Null urls, and urls without `://`, have empty host and path; null and empty urls have score 0. Without labelled urls of both classes all
scores are 0 and the verdict is allow. Every row gives one row, repeated rows too; equal scores have equal verdicts, and a score at the
threshold is allowed. Urls are taken whole, however long. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textloom.llm.common import materialise, table

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
ORDER = 4
ALPHABET = 256
MICRO = 1_000_000
PAD = "\x02"
BROADCAST_ROWS, FREQUENT = 1_000_000, 200_000
#: first hex digits of the md5 of urls that calibrate the threshold; the models are fitted on the others
HELD_OUT = ("0", "1", "2")


def host_of(url: Column) -> Column:
    # the first :// counts, also where the text before it holds line ends
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule (the longest that fits, else null) and ruled (its verdict)."""
    df = df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule = ruled = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, ruled = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    return df.withColumn("rule", rule).withColumn("ruled", ruled)


def grams_of(url: Column, order: int) -> Column:
    """The n-gram that ends at each character, order characters of context before it; the start is padded."""
    padded = F.concat(F.lit(PAD * order), F.coalesce(url, F.lit("")))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - order, F.lit(1))), lambda i: F.substring(padded, i, F.lit(order + 1)))


def fit(labelled: DataFrame, grams: DataFrame, order: int) -> DataFrame:
    """(gram, score): for each distinct n-gram the micro-nats by which the accepted model prefers its last character."""
    accepted, rejected = (F.sum((F.col("ruled") == v).cast("long") * F.col("n")) for v in ("allow", "block"))
    full = labelled.select("ruled", F.explode(grams_of(F.col("url"), order)).alias("gram")).groupBy("ruled", "gram").agg(F.count("*").alias("n")).groupBy("gram").agg(accepted.alias("a"), rejected.alias("b"))
    full = materialise(full, "grams")
    scored = grams
    for k in range(order + 1):  # k characters of context
        suffix = F.substring("gram", order + 1 - k, k + 1)
        counts = full.groupBy(suffix.alias("g")).agg(F.sum("a").alias(f"a{k}"), F.sum("b").alias(f"b{k}"))
        contexts = counts.groupBy(F.substring("g", 1, k).alias("c")).agg(
            F.sum(f"a{k}").alias(f"ca{k}"), F.sum(f"b{k}").alias(f"cb{k}"), F.sum((F.col(f"a{k}") > 0).cast("long")).alias(f"ta{k}"), F.sum((F.col(f"b{k}") > 0).cast("long")).alias(f"tb{k}")
        )
        if k:
            scored = scored.join(contexts.withColumnRenamed("c", f"c{k}"), F.substring("gram", order + 1 - k, k) == F.col(f"c{k}"), "left")
        else:
            total = contexts.first()  # one row
            scored = scored.withColumns({f"{x}0": F.lit(total[f"{x}0"] if total else 0).cast("long") for x in ("ca", "cb", "ta", "tb")})
        scored = scored.join(counts.withColumnRenamed("g", f"g{k}"), suffix == F.col(f"g{k}"), "left")
    p = {}
    for v in "ab":
        prob = F.lit(1.0 / ALPHABET)
        for k in range(order + 1):
            n, c, t = (F.coalesce(F.col(f"{x}{k}"), F.lit(0)) for x in (v, "c" + v, "t" + v))
            prob = F.when(c > 0, (n + t * prob) / F.when(c > 0, c + t)).otherwise(prob)
        p[v] = prob
    return scored.select("gram", F.round((F.log(p["a"]) - F.log(p["b"])) * MICRO).cast("long").alias("score"))


def filter_urls(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row of (page_id, url)."""
    ruled = apply_rules(pages.select("page_id", "url"), rules)
    ruled = materialise(ruled.withColumn("row", F.monotonically_increasing_id()).withColumn("fold", F.when(F.substring(F.md5(F.col("url").cast("binary")), 1, 1).isin(*HELD_OUT), 0).otherwise(1)), "ruled")
    fitted = ruled.where("ruled is not null and fold <> 0 and length(url) > 0")
    asked = ruled.where("(ruled is null or fold = 0) and length(url) > 0")  # those to decide, and those to calibrate with
    grams = materialise(asked.select(F.explode(grams_of(F.col("url"), order)).alias("gram")).groupBy("gram").agg(F.count("*").alias("uses")), "asked")
    model = materialise(fit(fitted, grams.select("gram"), order), "model")
    positions = asked.select("row", "ruled", F.explode(grams_of(F.col("url"), order)).alias("gram"))
    if model.count() <= BROADCAST_ROWS:
        positions = positions.join(F.broadcast(model), "gram")
    else:
        # the most frequent n-grams, a table of fixed size, are joined where the urls are; any other is too rare to be hot
        often = materialise(grams.orderBy(F.desc("uses"), "gram").limit(FREQUENT).select("gram").join(model, "gram"), "often")
        both = positions.join(F.broadcast(often), "gram", "left")
        rare = both.where("score is null").drop("score").join(model, "gram")
        positions = both.where("score is not null").unionByName(rare)
    scores = materialise(positions.groupBy("row", "ruled").agg(F.round(F.sum("score") / F.count("*")).cast("long").alias("score")), "scores")
    means = {r["ruled"]: r["sum"] / r["n"] for r in scores.where("ruled is not null").groupBy("ruled").agg(F.sum("score").alias("sum"), F.count("*").alias("n")).collect()}
    known = len(means) == 2 and all(map(math.isfinite, means.values()))
    threshold = math.floor((means["allow"] + means["block"]) / 2) if known else 0
    score = F.coalesce(F.col("score"), F.lit(0)) if known else F.lit(0)
    out = ruled.join(scores.select("row", "score"), "row", "left")
    verdict = F.coalesce("ruled", F.when(score >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (score / MICRO).alias("score"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    counts = ", ".join(f"n{k} as (select right(left(gram, 5), {k + 1}) as g, sum(a) as a, sum(b) as b from full5 group by 1), c{k} as (select left(g, {k}) as c, sum(a) as ca, sum(b) as cb, count(*) filter (a > 0) as ta, count(*) filter (b > 0) as tb from n{k} group by 1)" for k in range(5))
    joins = " ".join(f"left join c{k} on c{k}.c = left(right(gram, {k + 1}), {k}) left join n{k} on n{k}.g = right(gram, {k + 1})" for k in range(5))
    last = {"a": "cast(0.00390625 as double)", "b": "cast(0.00390625 as double)"}
    source = f"(select gram, {', '.join(f'coalesce(n{k}.{v}, 0) as {v}{k}, coalesce(c{k}.c{v}, 0) as c{v}{k}, coalesce(c{k}.t{v}, 0) as t{v}{k}' for k in range(5) for v in 'ab')} from asked5 {joins})"
    for k in range(5):
        cols = {v: f"case when c{v}{k} > 0 then ({v}{k} + t{v}{k} * {last[v]}) / (c{v}{k} + t{v}{k}) else {last[v]} end" for v in "ab"}
        source = f"(select *, {cols['a']} as pa{k}, {cols['b']} as pb{k} from {source})"
        last = {v: f"p{v}{k}" for v in "ab"}
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    order = sorted(RULES, key=lambda r: (-len(r[0]) - len(r[1]), r))
    rule = "case " + " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in order) + " end"
    ruled = "case " + " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in order) + " end"
    grams = lambda rel, cond: f"(select row, ruled, substring(chr(2) || chr(2) || chr(2) || chr(2) || url, i, 5) as gram from (select row, ruled, url, unnest(range(1, length(url) + 1)) as i from {rel} where {cond}))"
    return f"""
with raw as (select row_number() over () as row, page_id, url, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) end as rest from pages),
parts as (select row, page_id, url, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from raw),
r as (select *, {rule} as rule, {ruled} as ruled, left(md5(url), 1) in ('0', '1', '2') as held from parts),
full5 as (select gram, count(*) filter (ruled = 'allow') as a, count(*) filter (ruled = 'block') as b from {grams("r", "ruled is not null and not held and length(url) > 0")} group by gram),
asked as (select * from r where (ruled is null or held) and length(url) > 0),
spots as {grams("asked", "true")},
asked5 as (select distinct gram from spots),
{counts},
model as (select gram, cast(round((ln({last['a']}) - ln({last['b']})) * 1000000) as bigint) as score from {source}),
scores as (select row, ruled, cast(round(sum(score) / count(*)) as bigint) as score from spots join model using (gram) group by row, ruled),
means as (select sum(score) filter (ruled = 'allow') / count(*) filter (ruled = 'allow') as a, sum(score) filter (ruled = 'block') / count(*) filter (ruled = 'block') as b from scores),
t as (select floor((a + b) / 2) as threshold from means)
select page_id, host, path, rule, coalesce(r.ruled, case when threshold is null or coalesce(score, 0) >= threshold then 'allow' else 'block' end) as verdict, case when threshold is null then 0.0 else coalesce(score, 0) / 1000000 end::double as score
from r left join scores using (row) cross join t
"""


OP8_SQL = _sql()
