"""DuckDB SQL for the operators that SQL can express over whole tables."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_URL = r"""
with u as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(h, p, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit as (
  select u.page_id, u.host, u.path, h || p as rule, verdict,
         row_number() over (partition by u.page_id, u.host, u.path order by length(h) desc nulls last, length(p) desc) as k
  from u left join rules on (u.host = h or ends_with(u.host, '.' || h)) and starts_with(u.path, p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fit where k = 1
"""

_MIX = rf"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size,
         md5(concat_ws(':', 'mix', coalesce(cast(doc_id as varchar), 'null'))) as m
  from documents),
n as (select *, row_number() over (partition by doc_id order by source nulls first, size) - 1 as nth from d),
e as (select *, case when nth > 0 then md5(m || ':' || nth) else m end as o from n),
s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) - 1 as rank from d group by source),
w as (select *, cast(case rank % 3 when 0 then 5 when 1 then 2 else 1 end as double) as weight, 3 * source_size as cap from s),
l as (
  select *, cast(sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as double)
            / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level
  from w),
t as (
  select source, source_size, least(cast(cap as double), coalesce(max(case when cap / weight >= level then level end) over () * weight, 0)) as target, cap from l),
b as (select *, least(cap, cast(floor(target + 0.5) as bigint)) as budget from t),
p as (
  select e.*, b.source_size, b.target, b.budget, case when b.source_size > 0 then b.budget // b.source_size else 0 end as epochs,
         cast(coalesce(sum(size) over (partition by e.source order by o, doc_id, size rows between unbounded preceding and 1 preceding), 0) as bigint) as prefix
  from e join b on e.source is not distinct from b.source)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - prefix)) as bigint) as taken from p
"""

_CHAT = r"""
with c as (
  select *, cast((row_number() over (partition by conv_id order by turn nulls first, name, said) - 1) // 256 as bigint) as part
  from (select conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') as name, replace(coalesce(text, ''), '<|', '< |') as said from conversations)),
s as (select distinct conv_id, name as speaker from c where name <> 'system'),
v as (
  select c.*, speaker, name = speaker as mine,
         '<|im_start|>' || case when name = speaker then 'assistant' when name = 'system' then name else 'user name=' || name end || chr(10) as opened
  from c join s on c.conv_id is not distinct from s.conv_id),
r as (select *, opened || said || '<|im_end|>' || chr(10) as shown from v),
e as (select *, sum(length(shown)) over (partition by conv_id, speaker, part order by turn nulls first, name, said rows between unbounded preceding and current row) as e,
             row_number() over (partition by conv_id, speaker, part order by turn nulls first, name, said) as k from r),
p as (
  select conv_id, speaker, part, count(*) as n_turns, count(*) filter (where mine) as n_masked_turns, string_agg(shown, '' order by k) as text,
         coalesce(string_agg(cast(cast(e - length(shown) + length(opened) as bigint) as varchar) || ':' || cast(cast(e - 1 as bigint) as varchar), ',' order by k) filter (where mine), '') as mask
  from e group by conv_id, speaker, part)
select conv_id, speaker, part, cast(coalesce(sum(length(text)) over (partition by conv_id, speaker order by part rows between unbounded preceding and 1 preceding), 0) as bigint) as start_char,
       n_turns, n_masked_turns, text, mask
from p
"""

_TOPK = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as x
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x)
  where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

_DEDUP = rf"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') as norm, length(coalesce(text, '')) as n from documents),
k as (
  select doc_id, norm, first_value(doc_id) over (partition by norm order by n desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
         count(*) over (partition by norm) as group_size
  from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from k
"""

_NEAR = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
s as materialized (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
m as (select a, min(b) as b from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) as component_id, coalesce(m.b, d.doc_id) >= d.doc_id as kept
from d left join n using (doc_id) left join m on m.a = d.doc_id
"""


def _matches(kind: str, place: int, pattern: str) -> str:
    """Leftmost matches of a pattern with their starts: the pieces between matches give the offsets."""
    return f"""select doc_id, t, '{kind}' as kind, {place} as place, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) as bigint), 'm': m[i]}})) as x
  from (select doc_id, t, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as p from d) where len(m) > 0"""


_CARD = r"[0-9](?:[\x20-]?[0-9])+"
_PII_PARTS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"), ("card", _CARD), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"), ("national_phone", r"(?:\([0-9]{2,5}\)\x20?|0)[0-9]+(?:[\x20.-][0-9]+)+"), ("short_card", _CARD),
    ("secret", r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,})\b"),
)
_LUHN = "list_sum(list_transform(range(1, length(g) + 1), lambda i: case when i % 2 = 0 then cast(reverse(g)[i] as integer) * 2 - case when cast(reverse(g)[i] as integer) > 4 then 9 else 0 end else cast(reverse(g)[i] as integer) end)) % 10 = 0"
_APART = "not exists (select 1 from {taken} b where b.doc_id is not distinct from c.doc_id and b.s < c.e and c.s < b.e)"


def _pii() -> str:
    found = " union all ".join(_matches(kind, i, pattern) for i, (kind, pattern) in enumerate(_PII_PARTS))
    near = lambda words: f"regexp_matches(translate(substr(t, greatest(s - 40, 0) + 1, least(s, 40)) || ' ' || substr(t, e + 1, 40), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:^|[^a-z])(?:{words})')"
    out = rf"""with d as (select doc_id, coalesce(text, '') as t from documents),
f as materialized (select doc_id, t, kind, place, x.s as s, x.s + length(x.m) as e, x.m as m, regexp_replace(x.m, '[^0-9]', '', 'g') as g, replace(x.m, ' ', '') as w from ({found})),
c as materialized (select * from f where case kind when 'email' then true
  when 'ip' then len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 or try_cast(p as bigint) > 255)) = 0
  when 'card' then length(g) between 16 and 19 and {_LUHN}
  when 'phone' then length(g) between 8 and 15
  when 'iban' then length(w) between 15 and 34 and list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(regexp_replace(substr(w, 5) || substr(w, 1, 4), '(.)', '\1 ', 'g'), ' '), lambda z: case when z = '' then null when z between '0' and '9' then cast(z as bigint) else cast(ascii(z) - 55 as bigint) end)),
    lambda a, z: case when z is null then a when z > 9 then (a * 100 + z) % 97 else (a * 10 + z) % 97 end) = 1
  when 'national_phone' then length(g) between 8 and 13 and (s = 0 or not regexp_matches(substr(t, s, 1), '[0-9+.-]')) and {near('phone|tel|call|mobile|fax|telefon|tfno')}
  when 'short_card' then length(g) between 13 and 15 and {_LUHN} and {near('card|visa|credit|payment|amex|karte|tarjeta|carte')}
  else true end),
a0 as materialized (select doc_id, kind, place, s, e from c where place < 4)"""
    for step in range(4):
        out += f",\na{step + 1} as materialized (select * from a{step} union all select doc_id, kind, place, s, e from c where place = {4 + step} and {_APART.format(taken=f'a{step}')})"
    total = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k, _ in _PII_PARTS[:4])
    return out + rf""",
g as (select doc_id, {total}, coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by place, s) filter (where place < 4), '') as base, string_agg(kind || ':' || s || ':' || e, ',' order by place, s) as spans from a4 group by doc_id)
select d.doc_id, {', '.join(f'coalesce(n_{k}, 0) as n_{k}' for k, _ in _PII_PARTS[:4])}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join g on g.doc_id is not distinct from d.doc_id"""


ORACLES = {"op2_url_filter": _URL, "op3_minhash": _NEAR, "op4_pii": _pii(), "op5_mixing": _MIX, "op6_chat": _CHAT, "op7_topk": _TOPK, "op8_exact_dedup": _DEDUP}
