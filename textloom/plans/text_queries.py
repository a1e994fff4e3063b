"""Queries over tokens, vocabularies and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from textloom.functions import strings as S
from textloom.operators import statistics as st, tokens as tk
from textloom.operators.relations import cut, pairs_by_key
from textloom.plans.registry import CASED, TOKENS, query
from textloom.sources.tables import load

STOP = ("the", "a", "an", "of", "and", "to", "in", "is", "it", "that", "for", "on", "was", "with", "be", "as", "by", "at")
_STOP = ", ".join(f"'{w}'" for w in STOP)


def _tokens(spark, d):
    return tk.tokens(load(spark, d, "documents"))


def _cased(spark, d):
    return load(spark, d, "documents").select("doc_id", F.explode_outer(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("term")).where("term is not null")


@query(f"with {TOKENS} select doc_id, pos, term from t")
def tok_alpha(spark, d):
    return _tokens(spark, d)


@query(f"with {TOKENS} select doc_id, count(*) as n_tokens, count(distinct term) as n_terms from t group by doc_id")
def tok_count_per_doc(spark, d):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-z]+"), F.lit(0))
    return load(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_terms")).where("n_tokens > 0")


@query(
    f"with {CASED} select shape, count(*) as n from (select regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(term, '[A-Z]', '\x01', 'g'), '[a-z]', '\x02', 'g'), '[0-9]', '\x03', 'g'), '\x01{{3,}}', '\x01\x01', 'g'), '\x02{{3,}}', '\x02\x02', 'g'), '\x03{{3,}}', '\x03\x03', 'g'), '\x01', 'A', 'g'), '\x02', 'a', 'g'), '\x03', '1', 'g') as shape from t) group by shape"
)
def tok_shape(spark, d):
    return _cased(spark, d).groupBy("term").agg(F.count("*").alias("n")).groupBy(S.shape(F.col("term"), 2).alias("shape")).agg(F.sum("n").alias("n"))


@query(f"with {TOKENS} select left(term, 3) as prefix3, right(term, 3) as suffix3, count(*) as n from t group by 1, 2")
def tok_affixes(spark, d):
    return _tokens(spark, d).groupBy(F.left("term", F.lit(3)).alias("prefix3"), F.right("term", F.lit(3)).alias("suffix3")).agg(F.count("*").alias("n"))


@query(
    f"with {CASED} select s, count(*) as n from (select case when regexp_matches(term, '^(?:19|20)[0-9]{{2}}$') then '<YEAR>' when regexp_matches(term, '^[0-9]+$') then '<NUM>' else regexp_replace(term, '[0-9]', '#', 'g') end as s from t where regexp_matches(term, '[0-9]')) group by s"
)
def tok_digits_simplified(spark, d):
    return _cased(spark, d).where(F.col("term").rlike("[0-9]")).groupBy(S.simplify_digits(F.col("term")).alias("s")).agg(F.count("*").alias("n"))


@query(f"with {TOKENS} select collapsed, count(*) as n from (select case when term in ({', '.join(repr(w) for w in S.NUMBER_WORDS)}) or regexp_matches(term, '[0-9]') then '0' else term end as collapsed from t) group by collapsed")
def tok_digits_collapsed(spark, d):
    return _tokens(spark, d).groupBy(S.collapse_digits(F.col("term")).alias("collapsed")).agg(F.count("*").alias("n"))


@query(f"with {TOKENS} select doc_id, count(*) as n from t where term not in ({_STOP}) group by doc_id")
def tok_stop_removed(spark, d):
    return _tokens(spark, d).where(~F.col("term").isin(*STOP)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    f"with {CASED} select count(*) as n, count(*) filter (regexp_matches(term, '^[A-Z]')) as capitalised, count(*) filter (regexp_matches(term, '^[a-z]+$')) as lower, count(*) filter (regexp_matches(term, '^[A-Z]+$')) as upper, count(*) filter (regexp_matches(term, '^[0-9]+$')) as digits, count(*) filter (regexp_matches(term, '[0-9]')) as has_digit from t"
)
def tok_predicates(spark, d):
    t = F.col("term")
    return _cased(spark, d).agg(F.count("*").alias("n"), *(F.count(F.when(S.token_is(t, k), 1)).alias(k) for k in ("capitalised", "lower", "upper", "digits", "has_digit")))


@query("with w as (select doc_id, regexp_extract_all(lower(text), '[A-Za-z]+') as w from documents), g as (select w[i] || ' ' || w[i + 1] as gram from (select w, unnest(range(1, len(w))) as i from w)) select gram, count(*) as n from g group by gram having count(*) >= 2")
def ngram_bigrams(spark, d):
    return tk.ngrams(load(spark, d, "documents"), 2).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 2")


@query("with w as (select doc_id, regexp_extract_all(lower(text), '[A-Za-z]+') as w from documents), g as (select w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram from (select w, unnest(range(1, len(w) - 1)) as i from w)) select gram, count(*) as n from g group by gram having count(*) >= 2")
def ngram_trigrams(spark, d):
    return tk.ngrams(load(spark, d, "documents"), 3).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 2")


@query(
    f"with {TOKENS}, v as (select distinct '<' || term || '>' as w from t), g as (select w, unnest([2, 3, 4]) as n from v) select gram, count(*) as n from (select left(w, n) as gram from g where n < length(w) union all select right(w, n) from g where n < length(w)) group by gram"
)
def char_ngrams(spark, d):
    return _tokens(spark, d).select("term").distinct().select(F.explode(S.affix_ngrams(F.col("term"), 2, 4)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"with {TOKENS} select term, count(*) as n from t group by term")
def vocab_counts(spark, d):
    return st.counts(_tokens(spark, d))


@query(f"with {TOKENS} select term, count(*) as n from t group by term having count(*) >= 5")
def vocab_trim_below(spark, d):
    return st.trim_below(st.counts(_tokens(spark, d)), 5)


@query(f"with {TOKENS} select term, count(*) as n from t group by term having count(*) <= 3")
def vocab_trim_above(spark, d):
    return st.trim_above(st.counts(_tokens(spark, d)), 3)


@query(f"with {TOKENS}, v as (select term, count(*) as n from t group by term), c as (select n, sum(count(*)) over (order by n desc) as up from v group by n) select term, n from v where n >= (select min(n) from c where up < 1000 and n >= 2)")
def vocab_trim_size(spark, d):
    return st.trim_to_size(st.counts(_tokens(spark, d)), 1000)


@query(f"with {TOKENS}, v as (select term, count(*) as n from t group by term) select n, count(*) as terms, cast(sum(count(*)) over (order by n desc) as bigint) as at_or_above from v group by n")
def vocab_count_of_counts(spark, d):
    return st.count_of_counts(st.counts(_tokens(spark, d)))


@query(f"with {TOKENS}, v as (select term, count(*) as n from t group by term) select term, n, row_number() over (order by n desc, term) - 1 as index from v")
def vocab_encode(spark, d):
    return st.encode(st.counts(_tokens(spark, d)))


@query(
    f"with {TOKENS}, f as (select doc_id, term, count(*) as tf from t group by doc_id, term) select doc_id, term, tf, round(1 + ln(tf), 6) as log_norm, round(0.5 + 0.5 * tf / max(tf) over (partition by doc_id), 6) as half_norm, round(tf / count(*) over (partition by doc_id), 6) as scaled from f"
)
def tf_variants(spark, d):
    w = Window.partitionBy("doc_id")
    f = st.term_frequencies(_tokens(spark, d)).withColumn("hi", F.max("tf").over(w)).withColumn("v", F.count("*").over(w))
    tf = F.col("tf")
    return f.select("doc_id", "term", "tf", F.round(st.tf_weight(tf, "log_norm"), 6).alias("log_norm"), F.round(st.tf_weight(tf, "k_norm", F.col("hi")), 6).alias("half_norm"), F.round(st.tf_weight(tf, "scaled", distinct=F.col("v")), 6).alias("scaled"))


@query(f"with {TOKENS}, n as (select count(*) as n from documents), v as (select term, count(distinct doc_id) as df from t group by term) select term, df, round(ln(n / (1 + df)), 6) as idf, round(ln(1 + n / (1 + df)), 6) as idf_smooth from v, n")
def idf_variants(spark, d):
    docs = load(spark, d, "documents")
    df, n = F.col("df"), F.lit(docs.count())
    return st.document_frequencies(_tokens(spark, d)).select("term", "df", F.round(st.idf(df, n), 6).alias("idf"), F.round(st.idf(df, n, 1.0), 6).alias("idf_smooth"))


@query(
    f"with {TOKENS}, n as (select count(*) as n from documents), f as (select doc_id, term, count(*) as tf from t group by doc_id, term), v as (select term, count(*) as df from f group by term), s as (select doc_id, term, round(tf * ln(1.0 + n / (1 + df)), 6) as score from f join v using (term), n) select * from (select doc_id, term, score, row_number() over (partition by doc_id order by score desc, term) as rank from s) where rank <= 10"
)
def tfidf_topk(spark, d):
    docs = load(spark, d, "documents")
    return st.tfidf_top(tk.tokens(docs), docs.count(), 10)


_BI = "b as (select a, b, count(*) as n from (select term as a, lead(term) over (partition by doc_id order by pos) as b from t) where b is not null group by a, b), u as (select term, count(*) as n from t group by term)"


def _bigrams(spark, d):
    return tk.word_windows(load(spark, d, "documents"), 2).groupBy(F.col("w0").alias("a"), F.col("w1").alias("b")).agg(F.count("*").alias("n"))


@query(f"with {TOKENS}, {_BI}, s as (select count(*) as total from t) select b.a, b.b, b.n, round(total * b.n / (x.n * y.n), 6) as pmi from b join u x on x.term = b.a join u y on y.term = b.b, s where b.n > 5 and x.n > 40 and y.n > 40")
def pmi_bigrams(spark, d):
    words = cut(st.counts(_tokens(spark, d)))
    total = words.agg(F.sum("n")).first()[0] or 0
    return st.pmi(_bigrams(spark, d), words, total, 5, 40)


@query("with g as (select w[i] as a, w[i + 1] as b from (select w, unnest(range(1, len(w))) as i from (select regexp_extract_all(lower(text), '[A-Za-z]+') as w from documents))), k as (select a, b, count(*) as n from g group by a, b having count(*) > 5) select x.a, x.b, y.b as c, least(x.n, y.n) as n from k x join k y on x.b = y.a")
def likely_trigrams(spark, d):
    k = cut(_bigrams(spark, d).where("n > 5"))
    y = k.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("m"))
    return pairs_by_key(k, y, "b", "a", "c").select("a", "b", "c", F.least("n", "m").alias("n"))


@query(
    f"with {TOKENS}, l as (select doc_id, quality as y from labels where quality is not null), tot as (select sum(y) as t1, count(*) - sum(y) as t0 from l), h as (select term, sum(y) as a1, count(*) - sum(y) as a0 from (select distinct doc_id, term from t) join l using (doc_id) group by term), x as (select term, cast(a1 as double) as a1, cast(a0 as double) as a0, cast(t1 as double) as t1, cast(t0 as double) as t0, cast(t1 - a1 as double) as b1, cast(t0 - a0 as double) as b0 from h, tot), e as (select term, t1 + t0 as n, a1 + a0 as na, "
    + ", ".join(f"(case when {p} > 0 then -({p} / ({p} + {q})) * log2({p} / ({p} + {q})) else 0 end + case when {q} > 0 then -({q} / ({p} + {q})) * log2({q} / ({p} + {q})) else 0 end) as {name}" for p, q, name in (("t1", "t0", "ht"), ("a1", "a0", "ha"), ("b1", "b0", "hb")))
    + " from x) select term, round(ht - na / n * ha - case when n > na then (n - na) / n * hb else 0 end, 6) as gain from e"
)
def infogain_quality(spark, d):
    labels = load(spark, d, "labels").where("quality is not null").select("doc_id", F.col("quality").alias("y"))
    return st.information_gain(_tokens(spark, d), labels)


@query(
    f"with {TOKENS}, x as (select term, sum(toxic) as a, count(*) - sum(toxic) as b from t join labels using (doc_id) where toxic is not null group by term), z as (select sum(a) as ta, sum(b) as tb, count(*) as v from x) select term, round(case when a > 0 then ((a + 1) / (ta + v)) * ln(((a + 1) / (ta + v)) / ((b + 1) / (tb + v))) else 0.0 end, 9) as score from x, z"
)
def logodds_toxic(spark, d):
    labels = load(spark, d, "labels").where("toxic is not null").select("doc_id", F.col("toxic").alias("y"))
    return st.log_odds(_tokens(spark, d), labels)


@query(f"with {TOKENS} select doc_id, pos, coalesce(lag(term) over w || '@-1', '<START>') as at_m1, coalesce(lead(term) over w || '@1', '<END>') as at_p1, term from t window w as (partition by doc_id order by pos)")
def neighbor_features(spark, d):
    return tk.neighbours_in(load(spark, d, "documents"), (-1, 1))


@query(f"with {TOKENS}, x as (select doc_id, pos, term as l, lead(term) over (partition by doc_id order by pos) as r from t) select feature, count(*) as n from (select l || '@0_&_' || r || '@1' as feature from x where r is not null) group by feature having count(*) > 1")
def feature_conjunctions(spark, d):
    return tk.conjunction_counts(load(spark, d, "documents"), 0, 1).where("n > 1")


@query(f"with {TOKENS} select doc_id, pos, string_agg(term, ' ') over (partition by doc_id order by pos rows between 4 preceding and 1 preceding) as prev_bag, string_agg(term, ' ') over (partition by doc_id order by pos rows between 1 following and 4 following) as next_bag from t")
def context_bag(spark, d):
    bags = tk.bags_in(load(spark, d, "documents"), 4, 4)
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, " ")).alias(c)
    return bags.select("doc_id", "pos", joined("prev_bag"), joined("next_bag"))


@query("with w as (select doc_id, regexp_extract_all(text, '[A-Za-z]+') as w from documents), t as (select doc_id, i - 1 as pos, w[i] as term from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from w)) select doc_id, lower(term) as word, cast(min(pos) as bigint) as first_pos, arg_min(term, pos) as first_form, count(*) as n from t where regexp_matches(term, '^[A-Z]') group by 1, 2")
def first_mention(spark, d):
    t = tk.tokens(load(spark, d, "documents"), lower=False).where(F.col("term").rlike("^[A-Z]"))
    return t.groupBy("doc_id", F.lower("term").alias("word")).agg(F.min("pos").cast("long").alias("first_pos"), F.min_by("term", "pos").alias("first_form"), F.count("*").alias("n"))


@query(f"with {TOKENS}, x as (select term, lang from t join documents using (doc_id)), a as (select distinct term from x where lang = 'en'), b as (select distinct term from x where lang = 'fr') select 'both' as kind, count(*) as n from (select * from a intersect select * from b) union all select 'either', count(*) from (select * from a union select * from b) union all select 'only_en', count(*) from (select * from a except select * from b)")
def setops_vocab_by_lang(spark, d):
    x = tk.tokens(load(spark, d, "documents").withColumn("doc_id", F.struct("doc_id", "lang"))).select("term", F.col("doc_id.lang").alias("lang"))
    a, b = (x.where(F.col("lang") == lang).select("term").distinct() for lang in ("en", "fr"))
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")).select("kind", "n")
    return n(a.intersect(b), "both").union(n(a.union(b).distinct(), "either")).union(n(a.exceptAll(b), "only_en"))


@query(f"with {TOKENS}, c as (select lang, term, count(*) as n from t join documents using (doc_id) group by lang, term), p as (select lang, term, n / sum(n) over (partition by lang) as p from c), l as (select distinct lang from c), g as (select x.lang as a, y.lang as b from l x join l y on x.lang < y.lang), v as (select distinct term from c), z as (select a, b, coalesce(p.p, 0) as p, coalesce(q.p, 0) as q from g cross join v left join p on p.lang = a and p.term = v.term left join p q on q.lang = b and q.term = v.term) select a, b, round(sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2, 6) as js from z group by a, b")
def lang_js_divergence(spark, d):
    docs = load(spark, d, "documents")
    x = tk.tokens(docs.withColumn("doc_id", F.col("lang")))
    c = x.groupBy(F.col("doc_id").alias("lang"), "term").agg(F.count("*").alias("n"))
    totals = c.groupBy("lang").agg(F.sum("n").alias("s"))
    p = c.join(totals, "lang").select("lang", "term", (F.col("n") / F.col("s")).alias("p"))
    # of a word that only one of two languages has, its whole share counts; so only shared words are joined
    half = lambda p, q: p * F.log2(p / ((p + q) / 2)) - p
    a, b = (p.where("lang is not null").select(F.col("lang").alias(x), "term", F.col("p").alias(f"p_{x}")) for x in "ab")
    shared = a.join(b, "term").where("a < b").groupBy("a", "b").agg(F.sum(half(F.col("p_a"), F.col("p_b")) + half(F.col("p_b"), F.col("p_a"))).alias("s"))
    langs = totals.where("lang is not null").select("lang")
    pairs = langs.toDF("a").join(langs.toDF("b"), F.col("a") < F.col("b"))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.round(F.coalesce("s", F.lit(0.0)) / 2 + 1, 6).alias("js"))


@query(f"with {TOKENS}, c as (select source, term, count(*) as n from t join documents using (doc_id) group by source, term) select * from (select source, term, n, row_number() over (partition by source order by n desc, term) as rank from c) where rank <= 5")
def top_words_per_source(spark, d):
    x = tk.tokens(load(spark, d, "documents").withColumn("doc_id", F.col("source"))).groupBy(F.col("doc_id").alias("source"), "term").agg(F.count("*").alias("n"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "term"))).where("rank <= 5")


@query("with p as (select distinct w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as phrase from (select w, unnest(range(1, len(w) - 1)) as i from (select regexp_extract_all(lower(text), '[A-Za-z]+') as w from benchmark))), g as (select doc_id, i - 1 as pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as phrase from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from (select doc_id, regexp_extract_all(lower(text), '[A-Za-z]+') as w from documents))) select doc_id, pos, 3 as length, phrase from g where phrase in (select phrase from p)")
def lexicon_match(spark, d):
    """Every three words of the benchmark, looked up in the documents."""
    phrases = tk.ngrams(load(spark, d, "benchmark").withColumnRenamed("item_id", "doc_id"), 3).select(F.col("gram").alias("phrase"))
    return tk.phrases_in(load(spark, d, "documents"), phrases, 3)


@query("select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')) as text from pages")
def html_strip(spark, d):
    html = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return load(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]+>", " "), r"[ \t\r\n\f]+", " ")).alias("text"))


@query("select page_id, regexp_extract(url, '^([A-Za-z]+)://', 1) as scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path, cast(len(list_filter(regexp_split_to_array(url, '[/.?=&:#]+'), lambda x: x <> '')) as bigint) as parts from pages")
def url_parts(spark, d):
    u = F.col("url")
    return load(spark, d, "pages").select("page_id", F.regexp_extract(u, "^([A-Za-z]+)://", 1).alias("scheme"), F.lower(F.regexp_extract(u, "^[A-Za-z]+://([^/?#]*)", 1)).alias("host"), F.regexp_extract(u, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1).alias("path"), F.size(S.segment(u, "url")).cast("long").alias("parts"))


@query()
def tok_stems(spark, d):
    """Porter stems of the vocabulary with their counts: each distinct word is stemmed once."""
    return st.counts(_tokens(spark, d)).groupBy(S.porter_stem("term").alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("forms"))
