"""DuckDB SQL of the operators that SQL can express."""

QUALITY_RULES = r"""
with d as (
  select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words from d),
tok as (select rid, unnest(words) as word, generate_subscripts(words, 1) as pos from w),
tri as (
  select rid, pos, word || ' ' || lead(word) over (partition by rid order by pos) || ' '
    || lead(word, 2) over (partition by rid order by pos) as g from tok),
rep as (select rid, pos from (select *, count(*) over (partition by rid, g) as c from tri where g is not null) where c > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest([pos, pos + 1, pos + 2]) as p from rep) group by rid),
ln as (select rid, unnest(string_split(text, chr(10))) as line from d),
lc as (select rid, count(*) - count(distinct line) as dup, count(*) as n from ln where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid),
s as (
  select w.rid, doc_id, lang, source, len(words)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(lc.dup, 0)::bigint as n_dup_lines, coalesce(lc.n, 0)::bigint as n_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint as n_upper, length(regexp_replace(text, '[^.!?]', '', 'g'))::bigint as n_marks
  from w left join lc using (rid) left join covered using (rid)),
base as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from s),
v as (
  select rid, lang, source, base_failed, unnest([
    {'stat': 'symbols', 'percent': 90, 'v': 100 * n_symbols // greatest(word_chars, 1)},
    {'stat': 'dups', 'percent': 99, 'v': 1000 * n_dup_lines // greatest(n_lines, 1)},
    {'stat': 'repeats', 'percent': 99, 'v': 1000 * n_repeat_words // greatest(n_words, 1)},
    {'stat': 'upper', 'percent': 90, 'v': 1000 * n_upper // greatest(word_chars, 1)},
    {'stat': 'marks', 'percent': 90, 'v': 1000 * n_marks // greatest(n_words, 1)},
    {'stat': 'word_len', 'percent': 90, 'v': 100 * word_chars // greatest(n_words, 1)}], recursive := true) from base),
b as (select *, v - v % (1::bigint << greatest(length(bin(v)) - 7, 0)::int) + (1::bigint << greatest(length(bin(v)) - 7, 0)::int) - 1 as bucket
  from v where not base_failed),
-- level 0: all documents, 1: a language, 2: a language and source
k as (
  select 0 as level, null as lang, null as source, stat, percent, bucket from b
  union all select 1, lang, null, stat, percent, bucket from b union all select 2, lang, source, stat, percent, bucket from b),
sk as (select level, lang, source, stat, percent, bucket, count(*) as n from k group by all),
cum as (
  select *, sum(n) over (partition by level, lang, source, stat order by bucket) as c, sum(n) over (partition by level, lang, source, stat) as total
  from sk),
q as (
  select level, lang, source, stat, max(total)::bigint as n, min(bucket) filter (c * 100 >= total * 50) as mid,
    min(bucket) filter (c * 100 >= total * percent) as tail from cum group by level, lang, source, stat),
lq as (
  select l.lang, l.stat, (l.mid * l.n + 30 * a.mid)::double / (l.n + 30) as mid, (l.tail * l.n + 30 * a.tail)::double / (l.n + 30) as tail
  from q l join q a using (stat) where l.level = 1 and a.level = 0),
gq as (
  select g.lang, g.source, g.stat, (g.mid * g.n + 30 * lq.mid) / (g.n + 30) as mid, (g.tail * g.n + 30 * lq.tail) / (g.n + 30) as tail
  from q g join lq on g.level = 2 and g.stat = lq.stat and g.lang is not distinct from lq.lang),
fence as (select lang, source, stat, tail + 5 * (tail - mid) as fence from gq),
ok as (
  select v.rid, bool_and(v <= fence) as ok from v join fence f
    on v.stat = f.stat and v.lang is not distinct from f.lang and v.source is not distinct from f.source group by v.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(ok, false) as kept
from base left join ok using (rid)
"""

MIXING = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
    md5('mix' || coalesce(doc_id::varchar, '')) as key, coalesce(doc_id, -9223372036854775808) as id from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s0),
s2 as (select *, 3 * source_size as cap, (3 * source_size)::double / weight as level from s1),
s3 as (
  select *, coalesce(sum(cap) over before, 0)::bigint as capped, coalesce(sum(weight) over before, 0)::bigint as gone,
    (sum(source_size) over ())::bigint as budget, (sum(weight) over ())::bigint as weights
  from s2 window before as (order by level, source nulls last rows between unbounded preceding and 1 preceding)),
s4 as (select *, (budget - capped)::double / (weights - gone) as w, row_number() over (order by level, source nulls last) as pos from s3),
s5 as (select *, (select arg_min(w, pos) from s4 where w <= level) as water from s4),
t as (select source, source_size, budget, case when level <= coalesce(water, level) then cap::double else weight * water end as target from s5),
q as (
  select d.*, t.source_size, t.target, t.budget, (sum(size) over (partition by d.source order by key, id, size))::bigint as cum
  from d join t on d.source is not distinct from t.source where size > 0),
c as (select *, unnest([0, 1, 2]) as epoch from q),
v as (select *, (epoch * source_size + cum)::double / target as vft from c),
m as (select *, sum(size) over (order by vft, key, id, size, epoch) as total from v),
n as (select source, key, id, size, epoch, count(*) as k from m where total <= budget group by all),
k as (select source, key, id, size, count(*) as copies from n group by all)
select d.doc_id, d.size, t.source_size, t.target, (d.size * coalesce(k.copies, 0))::bigint as taken
from d join t on d.source is not distinct from t.source
left join k on d.source is not distinct from k.source and d.key = k.key and d.id = k.id and d.size = k.size
"""

KNN = r"""
with v as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.rid, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on c.rid <> q.rid where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by rid order by score desc, vec_id nulls last) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20
"""

WARC = r"""
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as n, sha256(coalesce(html, '')) as digest from pages),
f as (select *, case when n >= 100 then min(page_id) over (partition by digest) end as first from p)
select page_id, n as payload_bytes, digest as payload_digest,
  case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from f
"""

URLS = r"""
with recursive u as (
  select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from u),
p as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
x as (
  select *, regexp_replace(path, '[0-9]+', '{n}', 'g') as shape, case
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
    when (host = 'com' or host like '%.com') and starts_with(path, '/en/') then 'com/en/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/de/') then 'net/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/es/') then 'org/es/' end as rule from p),
y as (select *, case when rule in ('example.com/en/7', 'net/de/') then 'allow' when rule is not null then 'block' end as ruled from x),
a as (
  select host, shape, count(*) as n, count(ruled) as labels, count(*) filter (ruled = 'block') as blocked from y group by host, shape),
-- level by level down the paths; a step sees the rows of the step before
t as (
  select host, shape, n, labels, blocked, '' as node, string_split(shape, '/')[2:] as rest,
    case when len(string_split(shape, '/')) = 1 then [''] else []::varchar[] end as up from a
  union all
  select host, shape, n, labels, blocked, longer, case when below <= 20 then []::varchar[] else rest[2:] end, list_append(up, longer)
  from (
    select *, node || '/' || case when below <= 20 then array_to_string(rest, '/') when children > 20 and own * 20 < total then '*' else rest[1] end as longer
    from (
      select *, count(*) over (partition by host, node) as below, count(distinct rest[1]) over (partition by host, node) as children,
        sum(n) over (partition by host, node) as total, sum(n) over (partition by host, node, rest[1]) as own
      from t where len(rest) > 0))),
leaf as (select host, shape, labels, blocked, up from t where len(rest) = 0),
-- level by level up the labelled branches; final rows are merged branches' templates, with their branch's number
m as (
  select max(len(up)) over () as d, host, up, labels, blocked, false as split, null::bigint as grp, false as final
  from (select host, up, sum(labels)::bigint as labels, sum(blocked)::bigint as blocked from leaf where labels > 0 group by host, up)
  union all
  select d - 1, host, up, sum(labels)::bigint, sum(blocked)::bigint, bool_or(split), grp, final
  from (
    select d, host, labels, blocked, k = 1 as final, case when k = 1 then grp end as grp,
      case when len(up) < d or k = 1 then up else up[:d - 1] end as up,
      case when len(up) < d then split when k = 1 then false else split or stays end as split
    from (
      select *, bool_or(split or grp0 > 0) over (partition by host, len(up) = d, up[:d - 1]) as stays, grp0 as grp
      from (
        select * exclude (grp), sum(coalesce(apart, false)::int) over (w order by blocked / labels, up[-1]) as grp0
        from (
          select *, pow(n1::double * blocked - b1::double * labels, 2) * (n1 + labels) > 3.8416::double * n1 * labels * (b1 + blocked) * (n1 + labels - b1 - blocked) as apart
          from (
            select *, lag(labels) over (v order by blocked / labels, up[-1]) as n1, lag(blocked) over (v order by blocked / labels, up[-1]) as b1
            from m where d > 0 and not final window v as (partition by host, len(up) = d, up[:d - 1], split)))
        window w as (partition by host, len(up) = d, up[:d - 1], split))),
      (select unnest([0, 1]) as k)
    where k = 0 and (len(up) < d or d > 1) or k = 1 and len(up) = d and not split and (stays or d = 1))
  group by d, host, up, grp, final),
g as (select coalesce(sum(blocked)::double / nullif(sum(labels), 0), 0.0) as share from a),
q as (select host, (sum(blocked)::double + 4 * (select share from g)) / (sum(labels) + 4) as prior from a group by host),
f as (
  select host, up[-1] as template, sum(labels) over w as labels, sum(blocked) over w as blocked
  from m where final window w as (partition by d, host, up[:-2], grp)),
bad as (
  select distinct leaf.host, shape from (select *, unnest(up) as template from leaf) leaf join f using (host, template) join q using (host)
  where f.labels >= 10 and (f.blocked + 4 * prior) / (f.labels + 4) >= 0.5)
select page_id, y.host, path, rule, coalesce(ruled, case when bad.host is not null and y.host <> '' then 'block' else 'allow' end) as verdict
from y left join bad on y.host = bad.host and y.shape = bad.shape
"""
