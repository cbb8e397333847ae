"""DuckDB SQL that makes the rows of operators.episodes from the same keyed draws: the oracle of the queries over real rows."""

from __future__ import annotations

from ..functions import words as W
from ..operators.episodes import CAP_SHARE, DRAWS, SIZES, SMALLEST_POOL, SODIUM_SHARE
from ..operators.relations import DEV_SHARE, POOL_ROWS, SEALED_SHARE
from .rung_sql import by_language, filled, listed, looked_up, quoted

NAMES = list(W.COLUMNS)
FMT = "case when {0} >= 100 then printf('%.0f', {0}) else rtrim(rtrim(printf('%.1f', {0}), '0'), '.') end"
PRINT = "case when {0} >= 100 then cast(printf('%.0f', {0}) as double) else cast(printf('%.1f', {0}) as double) end"


def draw(*parts: str) -> str:
    key = " || '/' || ".join(("key", *parts))
    return f"(('0x' || substr(sha256({key}), 1, 12))::bigint / 281474976710656::double)"


def unit(key: str) -> str:
    return f"(('0x' || substr(sha256({key}), 1, 8))::bigint / 4294967295::double)"


def chosen(values: str, n: int, u: str) -> str:
    return f"{values}[floor({u} * {n})::bigint + 1]"


def winner(values: str) -> str:
    """Position (from 0) of a clear extreme of a list, null if there is none; most and least_gap are columns."""
    best = f"case when most then list_max({values}) else list_min({values}) end"
    second = f"case when most then list_sort({values})[-2] else list_sort({values})[2] end"
    return f"case when len({values}) >= 2 and abs({best} - {second}) >= least_gap and abs({best} - {second}) >= 0.15::double * greatest({best}, {second}) then list_position({values}, {best}) - 1 end"


def seen(name: str, p: str, i: str) -> str:
    """What a reader gets of a product's value: salt is printed in mg of sodium on every other card where asked."""
    return f"case when mg and {i} % 2 = 1 and {name} = 'salt' then ({PRINT.format(f'({p}.sodium * 1000)')}) * 2.5::double / 1000 else {PRINT.format(f'{p}.v[list_position(names, {name})]')} end"


#: Parts as products, as plans.extra.products has them.
PARTS = """select lpad(p_partkey::varchar, 13, '0') as code, p_name as name, p_brand as brand, p_size || ' g' as quantity, p_type as category, p_type as grp, case when p_partkey % 3 = 0 then 'es' else 'en' end as language, v, v[2] / 2.5::double as sodium, p_partkey as file_pos
  from (select *, [u[4], u[7] / 20::double, u[2], u[3] / 2::double, u[6] / 2::double, u[5] / 4::double, u[1] * 9 + 1] as v from (
        select *, list_transform(['e', 'f', 's', 'u', 'b', 'p', 't'], lambda n: (('0x' || substr(sha256(p_partkey || '/' || n), 1, 8))::bigint % 1000) / 10::double) as u from part))"""


def built(products: str, per_category: int = 12, seed: int = 20261015) -> str:
    """CTEs up to `made`: the rows of episodes.build with the products they show, for a query of products."""
    names = listed(NAMES)
    texts = by_language(lambda c: " || ', ' || ".join(f"{quoted(W.PRINTED[c][n] + ' ')} || {FMT.format(f'p.v[{NAMES.index(n) + 1}]')} || '{' kcal' if n == 'energy' else ' g'}'" for n in W.NUTRIENTS[:-1]))
    salt = f"case when mg and i % 2 = 1 then ({by_language(lambda c: quoted(W.PRINTED[c]['sodium']))}) || ' ' || {FMT.format('(p.sodium * 1000)')} || ' mg' else ({by_language(lambda c: quoted(W.PRINTED[c]['salt']))}) || ' ' || {FMT.format('p.v[2]')} || ' g' end"
    card = f"p.brand || ' · ' || p.name || ' (' || p.quantity || ')' || '. ' || {texts} || ', ' || {salt} || '.'"
    side = "case when most then 'max' else 'min' end"
    asked = lambda n: f"({looked_up(W.ASKED, n)})"
    template = lambda table: "(" + by_language(lambda c: chosen(listed(table[c]), len(table[c]), draw("'template'"))) + ")"
    extremes = f"case when most then {template({c: W.EXTREME[c]['max'] for c in W.EXTREME})} else {template({c: W.EXTREME[c]['min'] for c in W.EXTREME})} end"
    capped = filled(template(W.CAPPED), limit=f"({FMT.format('lim')})", c_cap=f"(upper({asked('cap')}[1]) || lower({asked('cap')}[2:]))", c=asked("cap"), dir=f"({looked_up(W.DIRECTION, side)})", a=asked("attr"))
    least = "case attr " + " ".join(f"when {quoted(n)} then {W.FLOORS[n]}::double" for n in NAMES) + " end"
    return f"""raw as ({products}),
pooled as (select * from (select *, row_number() over (partition by split, language, category order by file_pos) as place from (
  select *, case when {unit("'off/' || code")} < {DEV_SHARE} then 'dev' else 'train' end as split from raw)) where place <= {POOL_ROWS}),
sizes as (select split, language, category, max(place) as n, case when split = 'dev' then {per_category} else {4 * per_category} end as budget from pooled group by all having max(place) >= {SMALLEST_POOL}),
keyed as (select *, '{seed}/' || split || '/' || language || '/' || category || '/' || attempt as key from (select *, unnest(range(budget * 2)) as attempt from sizes)),
drawn as (select *, {chosen(listed(SIZES), len(SIZES), draw("'size'"))} as k, list_transform(range({DRAWS}), lambda i: floor({draw("'place'", 'i')} * n)::bigint + 1) as ds from keyed),
places as (select *, list_filter(ds, lambda x, i: list_position(ds, x) = i)[1:k] as picks from drawn),
spread as (select split, language, category, attempt, budget, key, unnest(picks) as place, unnest(range(len(picks))) as pos from places where len(picks) = k),
tries as (select split, language, category, attempt, any_value(budget) as budget, any_value(key) as key, count(*) as k,
  list({{'code': code, 'name': name, 'brand': brand, 'quantity': quantity, 'grp': grp, 'v': v, 'sodium': sodium}} order by pos) as ps from spread join pooled using (split, language, category, place) group by 1, 2, 3, 4),
asked0 as (select *, language as lang, {names} as names, {chosen(names, len(NAMES), draw("'attr'"))} as attr, {draw("'direction'")} >= 0.5 as most from tries),
asked1 as (select *, {least} as least_gap, list_transform(ps, lambda p: p.v[list_position(names, attr)]) as target from asked0),
asked2 as materialized (select *, {winner('target')} as overall from asked1),
caps0 as (select key, n, {draw("'cap'", 'n')} as u, overall, most, least_gap, target, k, list_transform(ps, lambda p: p.v[list_position(names, n)]) as c from (select *, unnest(names) as n from asked2)
  where n <> 'energy' and n <> attr and overall is not null and {draw("'capped'")} < {CAP_SHARE}),
caps1 as (select *, printf('%.1f', (list_sort(c)[k // 2] + list_sort(c)[k // 2 + 1]) / 2)::double as lim from caps0),
caps2 as (select *, list_filter(range(k), lambda i: c[i + 1] <= lim) as within from caps1),
caps3 as (select *, list_transform(within, lambda i: target[i + 1]) as w from caps2 where len(within) >= 2 and len(within) < k),
caps4 as (select key, n as cap, lim, u, within[1 + {winner('w')}] as gold, overall from caps3),
capped as (select key, cap, lim, gold from caps4 where gold is not null and gold <> overall qualify row_number() over (partition by key order by u, cap) = 1),
either0 as (select *, cap is not null as limited, coalesce(gold, overall) as winner from asked2 left join capped using (key)),
either as (select *, (attr = 'salt' or coalesce(cap = 'salt', false)) and {draw("'sodium'")} < {SODIUM_SHARE} as mg, case when limited then {capped} else {filled(f'({extremes})', a=asked('attr'))} end as question from either0),
shown as materialized (select *, list_transform(ps, lambda p, i: {card}) as texts, list_transform(ps, lambda p, i: {seen('attr', 'p', 'i')}) as seen_target,
  case when limited then list_transform(ps, lambda p, i: {seen('cap', 'p', 'i')}) end as seen_cap, {PRINT.format('lim')} as seen_limit, array_to_string(list_sort(list_transform(ps, lambda p: p.code)), '+') as codes from either),
accepted as (select * from shown where winner is not null and len(list_distinct(texts)) = k qualify row_number() over (partition by split, language, category order by attempt) <= budget),
made as materialized (select *, not limited or len(list_filter(range(k), lambda i: (seen_cap[i + 1] <= seen_limit) <> (ps[i + 1].v[list_position(names, cap)] <= lim))) = 0 as decidable,
  'v3-prod-' || substr(sha256(codes || question), 1, 16) as id, 'off/' || codes as group_id from accepted)"""


#: The columns of a published row, candidates as JSON.
ROW = f"""id, {filled("(" + by_language(lambda c: quoted(W.STATE[c])) + ")", cat='lower(category)')} as state, question, '[' || array_to_string(list_transform(texts, lambda t, i: '{{"id":"c' || (i - 1) || '","text":"' || t || '"}}'), ',') || ']' as candidates,
 'c' || winner as answer, group_id, lang, 'product_specs' as capability, 'food_' || left(replace(lower(ps[winner + 1].grp), ' ', '_'), 40) as domain,
 case when limited then 'constrained' else 'extreme' end || case when mg then '+sodium_mg' else '' end as difficulty, decidable, 'off-computed' as origin, 'ODbL-1.0' as license, 'openfoodfacts' as source_id"""

PUBLISHABLE = f"decidable and (split = 'train' or {unit(chr(39) + 'v3-sealed/' + chr(39) + ' || group_id')} >= {SEALED_SHARE})"


def episodes(products: str = PARTS) -> str:
    return f"with {built(products)} select split, {ROW} from made where {PUBLISHABLE}"


def ruled(products: str = PARTS) -> str:
    """CTEs up to `ruled`: each row with the position that the rules pick from what is printed."""
    return f"""{built(products)},
open_ as (select *, list_filter(range(k), lambda i: not limited or seen_cap[i + 1] <= seen_limit) as within from made),
ruled as (select *, case when len(within) > 0 then within[list_position(list_transform(within, lambda i: seen_target[i + 1]), case when most then list_max(list_transform(within, lambda i: seen_target[i + 1])) else list_min(list_transform(within, lambda i: seen_target[i + 1])) end)] end as picked from open_)"""


WILSON = "case when {1} <= 0 then 0 else greatest(0, ({0} / {1} + 1.959964::double * 1.959964 / (2 * {1}) - 1.959964::double * sqrt(({0} / {1} * (1 - {0} / {1}) + 1.959964::double * 1.959964 / (4 * {1})) / {1})) / (1 + 1.959964::double * 1.959964 / {1})) end"


def system_scores(products: str = PARTS) -> str:
    return f"""with {ruled(products)},
s as (select 'rules' as system, count(*) as rows, count(*) filter (where picked = winner) as hits, count(*) filter (where decidable) as decidable_rows, count(*) filter (where decidable and picked = winner) as dh,
  count(*) filter (where picked is null) as unparsed, avg(1 / k) as chance from ruled)
select system, rows, hits, decidable_rows, unparsed, round(hits / rows, 6) as accuracy, round({WILSON.format('hits', 'rows')}, 6) as wilson_lower, round(case when decidable_rows > 0 then dh / decidable_rows end, 6) as decidable_accuracy, round(chance, 6) as chance from s where rows > 0"""


def manifest(products: str = PARTS) -> str:
    """The counts of plans.build.counted, with histograms as text."""
    histogram = lambda column: f"(select string_agg({column} || '=' || n, ',' order by {column}) from (select {column}, count(*) as n from (select {ROW} from made where split = 'train' and {PUBLISHABLE}) group by 1))"
    return f"""with {built(products)},
c as (select split, {PUBLISHABLE} as kept from made)
select (select count(distinct code) from raw) as products, count(*) filter (where split = 'train' and kept) as train_rows, count(*) filter (where split = 'train' and not kept) as train_undecidable_dropped,
  count(*) filter (where split = 'dev' and kept) as dev_pool_rows, count(*) filter (where split = 'dev' and not kept) as dev_sealed_or_undecidable_dropped, {histogram('difficulty')} as by_difficulty, {histogram('lang')} as by_language from c"""
