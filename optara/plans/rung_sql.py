"""DuckDB SQL that makes the rows of operators.synth from the same keyed digests: the oracle of the rung queries."""

from __future__ import annotations

from ..functions import words as W
from ..operators.synth import BLOCKS, CAPPED_SHARE, GRAMS, KINDS, SODIUM_SHARE


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) if isinstance(v, str) else repr(v) for v in values) + "]"


def word(h: str, n) -> str:
    return f"('0x' || substr({h}, 8 * {n} + 1, 8))::bigint"


def part(h: str, n) -> str:
    return f"({word(h, n)} / 4294967296::double)"


def by_language(of) -> str:
    return f"case when lang = 'es' then {of('es')} else {of('en')} end"


def chosen(values, u: str) -> str:
    return f"{listed(values)}[floor({u} * {len(values)})::bigint + 1]"


def looked_up(table: dict, key: str) -> str:
    return by_language(lambda c: f"case {key} " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in table[c].items()) + " end")


def filled(template: str, **values: str) -> str:
    for name, v in values.items():
        template = f"replace({template}, {quoted('{' + name + '}')}, {v})"
    return template


LOW, HIGH = (listed([float(W.RANGES[n][side]) for n in W.NUTRIENTS]) for side in (0, 1))


def value(h: str, n: str) -> str:
    raw = f"({LOW}[{n} + 1]::double + ({HIGH}[{n} + 1]::double - {LOW}[{n} + 1]::double) * {part(h, n)})"
    return f"case when {n} = 0 or (({word(h, 7)} >> {n}) & 1) = 0 then round_even({raw}, 0) else printf('%.1f', {raw})::double end"


PLAIN = "case when {0} = floor({0}) then cast(cast({0} as bigint) as varchar) else printf('%.1f', {0}) end"


def _attempts(source: str, first: int, n: int) -> str:
    """Rows of source with each of the attempts, and whether it is good."""
    return f"""
  select *, case when capped then clear and len(within) >= 2 and len(within) < k and trap else true end and len(within) >= 2 and apart as good from (
  select *, (case when most then list_max(w) else list_min(w) end) as top,
         len(list_filter(w, lambda y: abs(top - y) / greatest(abs(top), 1e-9::double) >= 0.15 and abs(top - y) >= 0.2)) >= len(w) - 1 as apart,
         within[list_position(w, top)] as gold,
         len(list_filter(range(k), lambda i: not list_contains(within, i) and case when most then v[i + 1] > top else v[i + 1] < top end)) > 0 as trap,
         len(list_filter(cs, lambda y: abs(y - lim) <= greatest(0.1::double * lim, 0.2::double))) = 0 as clear from (
  select *, list_transform(within, lambda i: v[i + 1]) as w from (
  select *, case when capped then list_filter(range(k), lambda i: cs[i + 1] <= lim) else range(k) end as within from (
  select *, case when capped then printf('%.1f', list_sort(cs)[2] + (list_max(cs) - list_sort(cs)[2]) * u)::double end as lim from (
  select *, list_transform(hs, lambda h: {value('h', 'asked')}) as v, case when capped then list_transform(hs, lambda h: {value('h', 'cap')}) end as cs from (
  select *, case when capped then 1 + c1 end as cap, case when capped then 1 + (case when c2 >= c1 then c2 + 1 else c2 end) else target end as asked from (
  select *, floor({part('ha', 0)} * {len(GRAMS)})::bigint as c1, floor({part('ha', 1)} * {len(GRAMS) - 1})::bigint as c2, {part('ha', 2)} as u from (
  select b.*, a, sha256(s || '/' || a) as ha, list_transform(range(k), lambda i: sha256(s || '/' || a || '/' || i)) as hs from {source} b, range({first}, {first + n}) t(a)))))))))"""


def rows(base: str, seed: int) -> str:
    """SQL of the rows for base, a query of (index, rung): the columns of synth.rows with candidates as JSON."""
    k = "case rung " + " ".join(f"when {quoted(r)} then {chosen(list(sizes), part('h', 4))}" for r, sizes in KINDS.items()) + " end"
    out = f"""with x as (select rung, rung || '-' || index as id from ({base})), y as (select *, '{seed}/' || id as s, sha256('{seed}/' || id) as h from x),
b0 as materialized (select rung, id, s, case when {part('h', 0)} < 0.5 then 'en' else 'es' end as lang, {part('h', 1)} as u_item, rung = 'r0-most' or {part('h', 2)} < 0.5 as most,
  floor({part('h', 3)} * {len(W.NUTRIENTS)})::bigint as target, {k}::bigint as k, rung = 'r4-constraints' and {part('h', 5)} < {CAPPED_SHARE} as capped, {part('h', 6)} as u_template from y)"""
    for i, n in enumerate(BLOCKS):
        out += f""",
g{i} as materialized (select * from ({_attempts(f'b{i}', sum(BLOCKS[:i]), n)}) where good qualify row_number() over (partition by id order by a) = 1),
b{i + 1} as materialized (select * from b{i} anti join g{i} using (id))"""
    found = " union all by name ".join(f"select * from g{i}" for i in range(len(BLOCKS)))
    names, printed = listed(W.NUTRIENTS), lambda n: f"({looked_up(W.PRINTED, quoted(n))})"
    panel = " || ', ' || ".join(f"{printed(n)} || ' ' || p[{j + 1}] || '{' kcal' if n == 'energy' else ' g'}'" for j, n in enumerate(W.NUTRIENTS[:-1]))
    salt = f"case when rung in ('r3-units', 'r4-constraints') and {part('hc', 2)} < {SODIUM_SHARE} then {printed('sodium')} || ' ' || mg || ' mg' else {printed('salt')} || ' ' || p[7] || ' g' end"
    item = by_language(lambda c: chosen(W.ITEMS[c], "u_item"))
    extreme = "case when most then " + by_language(lambda c: chosen(W.RUNG_EXTREME[c]["max"], "u_template")) + " else " + by_language(lambda c: chosen(W.RUNG_EXTREME[c]["min"], "u_template")) + " end"
    side = "case when most then 'max' else 'min' end"
    capped = filled("(" + by_language(lambda c: quoted(W.CAPPED[c][0])) + ")", limit=PLAIN.format("lim"), c=looked_up(W.RUNG_ASKED, "cap_name"), dir=looked_up(W.RUNG_DIRECTION, side), a=looked_up(W.RUNG_ASKED, "asked_name"))
    text = f"""case when rung in ('r0-most', 'r1-pair') then ({looked_up(W.PRINTED, 'asked_name')}) || ' ' || p[asked + 1] || case when asked = 0 then ' kcal' else ' g' end
    else case when rung in ('r3-units', 'r4-constraints') then {chosen(W.BRANDS, part('hc', 0))} || ' · ' || upper(item[1]) || lower(item[2:]) || ' ' || (floor({part('hc', 1)} * 99)::bigint + 1) || '. ' else '' end || {panel} || ', ' || {salt} || '.' end"""
    return out + f""",
f as (select *, {names}[asked + 1] as asked_name, {names}[cap + 1] as cap_name, {item} as item from ({found})),
o as (select *, unnest(hs) as ho, unnest(range(k)) as i from f),
q as (select *, sha256(s || '/card/' || i) as hc, list_transform(range(7), lambda n: {value('ho', 'n')}) as vs from o),
r as (select *, list_transform(vs, lambda z: {PLAIN.format('z')}) as p, cast(round_even(vs[7] * 400, 0)::bigint as varchar) as mg from q),
t as (select id, string_agg('{{"id":"c' || i || '","text":"' || {text} || '"}}', ',' order by i) as texts from r group by id)
select id, {filled("(" + by_language(lambda c: quoted(W.STATE[c])) + ")", cat='item')} as state, case when capped then {capped} else {filled(f'({extreme})', a=looked_up(W.RUNG_ASKED, 'asked_name'))} end as question,
  '[' || texts || ']' as candidates, 'c' || gold as answer, lang, 'product_specs' as capability, 'curriculum:' || rung as origin from f join t using (id)"""


def replayed(indices: str, rung: str, seed: int, replay: float) -> str:
    """SQL of (index, rung) for a query of index, a share of it from earlier rungs."""
    earlier = list(W.RUNGS[: W.RUNGS.index(rung)])
    if not earlier or not replay:
        return f"select index, '{rung}' as rung from ({indices})"
    return f"select index, case when {part('h', 0)} < {replay} then {chosen(earlier, part('h', 1))} else '{rung}' end as rung from (select index, sha256('{seed}/replay/' || index) as h from ({indices}))"
