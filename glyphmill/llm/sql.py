"""DuckDB SQL with the results of the operators that SQL can express, by plain comparison."""

HAMMING = """
with codes as (select vec_id, list_transform(embedding, lambda x: case when x >= 0 then 1 else 0 end) as bits from embeddings where vec_id is not null and len(embedding) > 0),
pairs as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: abs(z[1] - z[2]))) as integer) as distance
  from codes q, codes c where q.vec_id % 50 = 0
),
ranked as (select query_id, cast(row_number() over (partition by query_id order by distance, vec_id) as integer) as rank, vec_id, distance from pairs)
select query_id, rank, vec_id, distance from ranked where rank <= 10
"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
with d as (select doc_id, row_number() over () as rid, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
bw as (
  select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)
),
dw as (
  select rid, n, i, array_to_string(w[i : i + n - 1], ' ') as g
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from bw) where len(w) >= n)
),
hit as (select rid, i, dw.n, item_id from dw join bw on dw.n = bw.n and dw.g = bw.g),
places as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from hit) group by rid),
found as (select rid, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct rid, cast(item_id as varchar) as item_id from hit) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join places using (rid) left join found using (rid)
"""

JACCARD = rf"""
with recursive d as (select doc_id, row_number() over () as rid, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct rid, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') as g
  from (select rid, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)
),
n as (select rid, count(*) as n from s group by rid),
overlap as (select a.rid as x, b.rid as y, count(*) as c from s a join s b on a.g = b.g and a.rid <> b.rid group by 1, 2),
link as (select x, y from overlap join n a on a.rid = x join n b on b.rid = y where 100 * c >= 90 * (a.n + b.n - c)),
reach as (select rid as x, rid as y from d union select reach.x, link.y from reach join link on reach.y = link.x)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, r.component_id
from d left join n using (rid) join (select x as rid, min(e.doc_id) as component_id from reach join d e on e.rid = reach.y group by 1) r using (rid)
"""

RESAMPLING = rf"""
with recursive step as (
  select i, 0 as k, cast(i as bigint) as c from range(256) t(i)
  union all select i, k + 1, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from step where k < 8
),
crc as (select list(c order by i) as entry from step where k = 8),
d as (select doc_id, row_number() over () as rid, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
df as (select rid, f, count(*) as n from (select rid, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as f from d) group by rid, f),
bf as (select f, count(*) as n from (select unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as f from b) group by f),
names as (select f, hex(encode(f)) as h from (select f from df union select f from bf)),
codes as (
  select f, xor(4294967295, list_reduce(
    list_transform(range(0, len(h) // 2), lambda i: cast('0x' || substr(h, cast(2 * i + 1 as bigint), 2) as bigint)),
    lambda c, x: xor(c >> 8, entry[xor(c, x) % 256 + 1]), cast(4294967295 as bigint))) % 10000 as bucket
  from names, crc
),
s as (select bucket, sum(n) as s from df join codes using (f) group by bucket),
t as (select bucket, sum(n) as t from bf join codes using (f) group by bucket),
tot as (select coalesce((select sum(s) from s), 0) as S1, coalesce((select sum(t) from t), 0) as T1),
gain as (
  select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1.0::double) * (S1 + 10000.0::double) / ((coalesce(s, 0) + 1.0::double) * (T1 + 10000.0::double)))) as bigint) as g
  from (select distinct bucket from codes) left join s using (bucket) left join t using (bucket), tot
),
weights as (select rid, cast(sum(n) as bigint) as n_features, cast(sum(n * g) as bigint) as total from df join codes using (f) join gain using (bucket) group by rid),
scored as (
  select doc_id, rid, len(w) as n_words, coalesce(n_features, 0) as n_features,
         case when n_features is null then 0 else (total - ((total % n_features) + n_features) % n_features) // n_features end as weight,
         cast('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h
  from d left join weights using (rid)
),
final as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296.0::double))) as bigint) as score from scored),
ranked as (select rid, row_number() over (order by score desc, doc_id nulls last, n_features) as r, count(*) over () as n from final where n_words >= 20)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score,
       cast(case when r <= (25 * n) // 100 then r end as bigint) as rank
from final left join ranked using (rid)
"""

NEGATIVES = """
with v as (
  select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as code
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
score as (
  select a.vec_id as anchor_id, c.vec_id as vec_id, a.label = c.label as same,
         cast(coalesce(list_sum(list_transform(list_zip(a.code, c.code), lambda z: z[1] * z[2])), 0) as bigint) as score
  from v a, v c where a.vec_id % 50 = 0 and a.vec_id <> c.vec_id
),
positive as (
  select anchor_id, vec_id as positive_id, score as positive_score
  from (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from score where same) where n <= 5
),
negative as (
  select anchor_id, positive_id, positive_score, vec_id as negative_id, score as negative_score,
         cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank
  from positive join score using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negative where rank <= 3
"""

SUBSTRINGS = r"""
with d as (select doc_id, row_number() over () as rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select rid, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) as g from (select rid, doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50 and doc_id is not null)),
least as (select g, min(doc_id) as least from win group by g),
gone as (select distinct rid, unnest(range(i, i + 50)) as p from win join least using (g) where least < doc_id),
kept as (
  select rid, count(*) as n, string_agg(word, ' ' order by p) as text
  from (select rid, unnest(w) as word, generate_subscripts(w, 1) as p from d) anti join gone using (rid, p) group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (rid)
"""
