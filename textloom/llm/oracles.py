"""DuckDB SQL for operators whose results SQL can express in other ways than the operators do."""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Counts shared shingles of all pairs, and follows links.
OP5_SQL = rf"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
c as (select a as doc_id, least(a, min(b)) as component_id from r group by a)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(component_id, doc_id) as component_id, coalesce(component_id, doc_id) = doc_id as kept
from documents left join n using (doc_id) left join c using (doc_id)
"""

#: Every window of 100 bytes as a row, and the first place of each.
OP9_SQL = """
with d as (select doc_id, encode(coalesce(text, '')) as b, strlen(coalesce(text, '')) as size from documents),
w as (select doc_id, i, md5(b[i : i + 99]) as h from (select doc_id, b, unnest(range(1, size - 98)) as i from d where size >= 100)),
f as (select doc_id, i, row_number() over (partition by h order by doc_id, i) > 1 as again from w),
g as (select doc_id, i, coalesce(i > max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) + 100, true) as new from f where again),
x as (select doc_id, i, sum(new::int) over (partition by doc_id order by i) as run from g),
r as (select doc_id, run, min(i) as first, max(i) + 99 as last from x group by 1, 2),
k as (select doc_id, coalesce(lag(last) over o, 0) + 1 as first, first - 1 as last from r window o as (partition by doc_id order by first)
  union all select d.doc_id, coalesce(max(r.last), 0) + 1, any_value(size) from d left join r using (doc_id) group by d.doc_id),
p as (select doc_id, list_reduce(list(case when first <= last then b[first : last] else ''::blob end order by first), lambda a, b: a || b) as kept from k join d using (doc_id) group by doc_id),
t as (select doc_id, sum(last - first + 1) as n_removed, count(*) as n_spans from r group by doc_id)
select doc_id, size::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(kept) as kept_sha256
from d join p using (doc_id) left join t using (doc_id)
"""
