"""All registered queries over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exact, text, words
from .functions.schedule import schedule
from .operators import answer, pick, relations, rows, score, scorer
from .plans import benchmark, extra
from .plans.decisions import decisions, item_cards, questions, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: DuckDB: an order's items as arrays in option order, for orders with 3 to 5 items.
D = """
d as (
  select l_orderkey as id, count(*) as k,
         list(l_linenumber order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as line,
         list(l_partkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as part,
         list(l_quantity order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as quantity,
         list(l_extendedprice order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as price,
         list(l_discount order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as discount,
         list(l_tax order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) as tax
  from lineitem group by 1 having count(*) between 3 and 5)"""
#: DuckDB: one row per option of those orders, pos from 0.
O = f"""{D},
o as (select id, k, unnest(range(k)) as pos, unnest(quantity) as quantity, unnest(price) as price, unnest(discount) as discount, unnest(tax) as tax from d)"""
#: DuckDB: clear winners overall and under the cap on quantity.
P = f"""{O},
c as (select id, k, cast(printf('%.1f', (list_sort(quantity)[k // 2] + list_sort(quantity)[k // 2 + 1]) / 2) as double) as cap from d),
r as (
  select o.*, cap, row_number() over (partition by id order by price desc, pos) as n, lead(price) over (partition by id order by price desc, pos) as next from o join c using (id)),
w as (select id, k, cap, pos as overall from r where n = 1 and price - next >= 20 and price - next >= 0.15 * price),
f as (
  select *, count(*) over (partition by id) as m, row_number() over (partition by id order by price desc, pos) as n2, lead(price) over (partition by id order by price desc, pos) as next2 from r where quantity <= cap),
l as (select id, pos as local, m, price from f where n2 = 1 and m >= 2 and m < k and price - next2 >= 20 and price - next2 >= 0.15 * price)"""
FMT = "case when {0} >= 100 then printf('%.0f', {0}) else rtrim(rtrim(printf('%.1f', {0}), '0'), '.') end"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    most, price = F.lit(True), F.col("price")
    d = decisions(spark, sf_dir).withColumn("cap", pick.middle_cap(F.col("quantity")))

    def local(within):
        return F.when((F.size(within) >= 2) & (F.size(within) < F.col("k")), pick.capped_winner(price, within, most, 20.0))

    # One expression with bound parts, so that a filter on the winners repeats it once and not each part in turn.
    c = exact.let(F.col("cap"), lambda cap: exact.let(pick.allowed(F.col("quantity"), cap), lambda w: F.struct(w.alias("within"), local(w).alias("local"))))
    return d.withColumn("c", c).withColumn("overall", pick.clear_winner(price, most, 20.0)).select("*", "c.within", "c.local")


@query(f"with {P} select w.id, w.k, w.cap, w.overall, l.local from w join l using (id) where overall <> local")
def capped_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose clear winner by price changes under a cap on quantity."""
    return _picked(spark, sf_dir).where("overall <> local").select("id", "k", "cap", F.col("overall").cast("long").alias("overall"), F.col("local").cast("long").alias("local"))


def _extreme(spark, sf_dir, most: bool) -> DataFrame:
    d = decisions(spark, sf_dir)
    return d.select("id", "k", pick.first_extreme(F.col("price"), F.lit(most)).cast("long").alias("choice"), pick.clear_winner(F.col("price"), F.lit(most), 20.0).cast("long").alias("clear"))


_EXTREME = f"""with {O}, r as (select *, row_number() over w as n, lead(price) over w as next from o window w as (partition by id order by price DIR, pos))
select id, k, pos as choice, case when abs(price - next) >= 20 and abs(price - next) >= 0.15 * greatest(price, next) then pos end as clear from r where n = 1"""


@query(_EXTREME.replace("DIR", "asc"))
def extreme_pick_min(spark, sf_dir):
    return _extreme(spark, sf_dir, False)


@query(_EXTREME.replace("DIR", "desc"))
def extreme_pick_max(spark, sf_dir):
    return _extreme(spark, sf_dir, True)


@query(f"""with {O}, b as (select id, k, arg_min(pos, (-tax * 100, pos)) as best, max(tax * 100) as top from o group by 1, 2)
select b.id, b.k, best as choice, bool_and(abs(top - tax * 100) / greatest(abs(top), 1e-9) >= 0.15 and abs(top - tax * 100) >= 0.2) filter (where pos <> best) as separated
from b join o using (id) group by 1, 2, 3""")
def clear_margin_all_rivals(spark, sf_dir):
    d = decisions(spark, sf_dir).withColumn("v", F.transform("tax", lambda x: x * F.lit(100.0)))
    d = d.withColumn("choice", pick.first_extreme(F.col("v"), F.lit(True)).cast("long"))
    return d.select("id", "k", "choice", pick.separated(F.col("v"), F.col("choice")).alias("separated"))


_PRINT = "case when {0} >= 100 then cast(printf('%.0f', {0}) as double) else cast(printf('%.1f', {0}) as double) end"


@query(f"""with {D}, c as (select *, cast(printf('%.1f', (list_sort(price)[k // 2] + list_sort(price)[k // 2 + 1]) / 2000) as double) as cap from d),
o as (select id, k, cap, unnest(price) / 1000 as v from c)
select id, k, cap, bool_and(({_PRINT.format('v')} <= {_PRINT.format('cap')}) = (v <= cap)) as decidable from o group by 1, 2, 3""")
def cap_decidable(spark, sf_dir):
    d = decisions(spark, sf_dir).withColumn("v", F.transform("price", lambda x: x / F.lit(1000.0)))
    ranked, half = F.sort_array("price"), F.floor(F.col("k") / 2).cast("int")
    d = d.withColumn("cap", exact.round1((F.element_at(ranked, half) + F.element_at(ranked, half + 1)) / F.lit(2000.0)))
    return d.select("id", "k", "cap", pick.decidable(F.col("v"), F.col("cap")).alias("decidable"))


@query(f"with {P} select l.id, l.local as gold, count(*) filter (where r.quantity > r.cap and r.price > l.price) > 0 as trap from l join r using (id) group by 1, 2")
def cap_trap(spark, sf_dir):
    d = _picked(spark, sf_dir).where("local is not null")
    return d.select("id", F.col("local").cast("long").alias("gold"), pick.trap(F.col("price"), F.col("within"), F.col("local"), F.lit(True)).alias("trap"))


_UNIT = "(('0x' || substr(sha256({0}), 1, 8))::bigint / 4294967295::double)"


@query(f"select case when {_UNIT.format("('order/' || o_orderkey::varchar)")} < 0.2 then 'dev' else 'train' end as split, o_orderpriority, count(*) as n, sum(o_orderkey)::bigint as keys from orders group by 1, 2")
def hash_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.concat(F.lit("order/"), F.col("o_orderkey").cast("string"))
    return o.groupBy(relations.split_of(key).alias("split"), "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"select o_orderkey, {_UNIT.format("('order/' || o_orderkey::varchar)")} as u, {_UNIT.format("('sealed/order/' || o_orderkey::varchar)")} < 0.25 as sealed from orders where {_UNIT.format("('order/' || o_orderkey::varchar)")} < 0.2")
def sealed_cut(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("key"))
    return o.where(relations.split_of(F.col("key")) == "dev").select("o_orderkey", exact.unit(F.col("key")).alias("u"), relations.sealed(F.col("key")).alias("sealed"))


@query("select p_brand, p_type, p_partkey, p_size from part qualify row_number() over (partition by p_brand, p_type order by p_partkey) <= 4")
def pool_cap(spark, sf_dir):
    return relations.pool_cap(table(spark, sf_dir, "part"), ["p_brand", "p_type"], [F.col("p_partkey")], 4).select("p_brand", "p_type", "p_partkey", "p_size")


@query("select doc_id, source, n_chars from documents qualify row_number() over (partition by text order by doc_id) = 1")
def dedupe_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    # Equal texts meet under a digest and their length, so that no text is shuffled.
    d = d.select(F.sha2(F.encode("text", "UTF-8"), 256).alias("k"), F.length("text").alias("n"), "doc_id", "source", "n_chars")
    return relations.first_of(d, ["k", "n"], [F.col("doc_id")]).select("doc_id", "source", "n_chars")


@query("""with d as (select doc_id, lang, source, count(*) over (partition by lang, source) as n, count(*) over () as total, row_number() over (partition by lang, source order by doc_id) - 1 as j from documents),
s as (select *, greatest(1, round_even(n * 137 / total, 0)) as share from d)
select doc_id, lang, source from s where total <= 137 or list_contains(list_transform(range(0, share::bigint), lambda i: floor(i * (n / share))::bigint), j)""")
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return relations.stratified(d, ["lang", "source"], [F.col("doc_id")], 137)


_SCORED = """e as (
  select d.doc_id, d.lang, 2 + n_chars % 3 as k, d.source, case when l.quality = 1 then 'c' || (d.doc_id % 4) when l.toxic = 1 then null else 'c9' end as choice,
         'c' || (d.doc_id % 4) as answer, case when d.doc_id % 7 = 0 then null else d.doc_id % 5 <> 0 end as decidable, case when n_chars > 2000 then 'constrained' else 'extreme' end || case when d.doc_id % 3 = 0 then '+sodium_mg' else '' end as difficulty
  from documents d join labels l using (doc_id))"""


def _scored(spark, sf_dir) -> DataFrame:
    """Documents with labels as answered rows: right where quality is 1, unparsed where toxic."""
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), table(spark, sf_dir, "labels")
    gold = F.concat(F.lit("c"), (F.col("doc_id") % 4).cast("string"))
    return d.join(lab, "doc_id").select(
        "doc_id", "lang", "source", (F.col("n_chars") % 3 + 2).alias("k"),
        F.when(F.col("quality") == 1, gold).when(F.col("toxic") == 1, F.lit(None)).otherwise("c9").alias("choice"), gold.alias("answer"),
        F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 5 != 0).alias("decidable"),
        F.concat(F.when(F.col("n_chars") > 2000, "constrained").otherwise("extreme"), F.when(F.col("doc_id") % 3 == 0, "+sodium_mg").otherwise("")).alias("difficulty"),
    )


_WILSON = "case when {1} <= 0 then 0 else greatest(0, ({0} / {1} + 1.959964::double * 1.959964 / (2 * {1}) - 1.959964::double * sqrt(({0} / {1} * (1 - {0} / {1}) + 1.959964::double * 1.959964 / (4 * {1})) / {1})) / (1 + 1.959964::double * 1.959964 / {1})) end"


@query(f"""with {_SCORED}, c as (
  select coalesce(choice = answer, false) as hit, unnest(['difficulty:' || split_part(difficulty, '+', 1), 'options:' || k, 'lang:' || lang, 'units:' || case when difficulty like '%+sodium_mg' then 'sodium_mg' else 'salt_g' end]) as cell from e)
select cell, count(*) as rows, count(*) filter (where hit) as hits, round(count(*) filter (where hit) / count(*), 6) as accuracy from c group by 1""")
def cell_accuracy(spark, sf_dir):
    e = _scored(spark, sf_dir)
    keys = score.cell_keys(F.col("difficulty"), F.col("k"), F.col("lang"), F.col("difficulty").endswith("+sodium_mg"))
    return score.cells(e, [], keys, F.col("choice") == F.col("answer")).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""with {_SCORED}, s as (select source, count(*) as rows, count(*) filter (where choice = answer) as hits, count(*) filter (where coalesce(decidable, true)) as decidable_rows,
  count(*) filter (where coalesce(decidable, true) and choice = answer) as dh, count(*) filter (where choice is null) as unparsed from e group by 1)
select source, rows, hits, decidable_rows, unparsed, round(hits / rows, 6) as accuracy, round({_WILSON.format('hits', 'rows')}, 6) as wilson_lower,
  round(case when decidable_rows > 0 then dh / decidable_rows end, 6) as decidable_accuracy from s""")
def forced_score(spark, sf_dir):
    out = score.totals(_scored(spark, sf_dir), ["source"], F.col("choice"), F.col("answer"), F.col("decidable"))
    return out.select("source", "rows", "hits", "decidable_rows", "unparsed", *(F.round(c, 6).alias(c) for c in ("accuracy", "wilson_lower", "decidable_accuracy")))


@query(f"with g as (select lang, sum(quality)::bigint as hits, count(*) as n from documents join labels using (doc_id) group by 1) select lang, hits, n, round({_WILSON.format('hits', 'n')}, 6) as wilson from g")
def wilson_by_group(spark, sf_dir):
    g = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.sum("quality").alias("hits"), F.count("*").alias("n"))
    return g.withColumn("wilson", F.round(exact.wilson_lower(F.col("hits"), F.col("n")), 6))


@query("with k as (select conv_id, count(*) as k, max(turn) as last from conversations group by 1) select last % 2 as odd, round(avg(1 / k), 6) as chance from k group by 1")
def chance_level(spark, sf_dir):
    k = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("k"), F.max("turn").alias("last"))
    return score.chance(k.withColumn("odd", F.col("last") % 2), ["odd"], F.col("k")).withColumn("chance", F.round("chance", 6))


@query("""with e as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, n, round(median(value), 6) as p50, round(max(value) filter (where r = floor(0.95::double * (n - 1)) + 1), 6) as p95, round(avg(value), 6) as mean from e group by 1, 2""")
def latency_percentiles(spark, sf_dir):
    out = score.latency(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")))


_EV = "(partition by user_id order by ts, event_id)"
_BEFORE = "(partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding)"


def _history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return e, ["user_id"], [F.col("ts"), F.col("event_id")]


@query(f"select event_id, user_id, round(sum(value) over {_EV}, 4) as total from events")
def running_total(spark, sf_dir):
    e, key, order = _history(spark, sf_dir)
    return relations.running_total(e, key, order, F.col("value")).select("event_id", "user_id", F.round("total", 4).alias("total"))


@query(f"select event_id, user_id, coalesce(max(value) over {_BEFORE}, 0) as best_before, coalesce(value > coalesce(max(value) over {_BEFORE}, 0), false) as champion from events")
def champion(spark, sf_dir):
    e, key, order = _history(spark, sf_dir)
    return relations.champions(e, key, order, "value").select("event_id", "user_id", "best_before", "champion")


@query(f"""with a as (select *, case when event_type is distinct from lag(event_type) over {_EV} and row_number() over {_EV} > 1 then 1 else 0 end as new from events),
b as (select *, sum(new) over {_EV} as island from a) select user_id, island::bigint as island, event_type, count(*) as n, min(event_id) as first_id from b group by 1, 2, 3""")
def islands(spark, sf_dir):
    e, key, order = _history(spark, sf_dir)
    return relations.islands(e, key, order, "event_type").groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(f"select event_id, user_id, least(coalesce(sum((value >= 90)::int) over {_BEFORE}, 0), 5)::bigint as rung_index from events")
def rung_index(spark, sf_dir):
    e, key, order = _history(spark, sf_dir)
    return relations.rung_index(e, key, order, F.col("value") >= 90).select("event_id", "user_id", "rung_index")


@query(f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, {FMT.format('(l_extendedprice / 977)')} as shown, {FMT.format('l_tax')} as tax_shown from lineitem")
def fmt_tenths(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    return i.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", exact.fmt(F.col("l_extendedprice") / F.lit(977.0)).alias("shown"), exact.fmt(F.col("l_tax")).alias("tax_shown"))


def _f(x: str) -> str:
    return FMT.format(f"({x})")


@query(f"""select p_partkey, p_brand || ' · ' || p_name || ' (' || p_size || ' g)' || '. ' || case when p_partkey % 2 = 0 then
 'energía ' || {_f('p_retailprice / 7')} || ' kcal, grasas ' || {_f('p_size / 3')} || ' g, de las cuales saturadas ' || {_f('p_size / 9')} || ' g, azúcares ' || {_f('p_retailprice / 71')} || ' g, fibra ' || {_f('p_size / 11')} || ' g, proteínas ' || {_f('p_size / 7')} || ' g, ' ||
 case when p_partkey % 3 = 0 then 'sodio ' || {_f('p_size / 31 / 2.5::double * 1000')} || ' mg' else 'sal ' || {_f('p_size / 31')} || ' g' end
 else 'energy ' || {_f('p_retailprice / 7')} || ' kcal, fat ' || {_f('p_size / 3')} || ' g, of which saturates ' || {_f('p_size / 9')} || ' g, sugars ' || {_f('p_retailprice / 71')} || ' g, fibre ' || {_f('p_size / 11')} || ' g, protein ' || {_f('p_size / 7')} || ' g, ' ||
 case when p_partkey % 3 = 0 then 'sodium ' || {_f('p_size / 31 / 2.5::double * 1000')} || ' mg' else 'salt ' || {_f('p_size / 31')} || ' g' end end || '.' as card from part""")
def render_card(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    values = F.struct((price / F.lit(7.0)).alias("energy"), (size / F.lit(3.0)).alias("fat"), (size / F.lit(9.0)).alias("saturated_fat"), (price / F.lit(71.0)).alias("sugars"), (size / F.lit(11.0)).alias("fiber"), (size / F.lit(7.0)).alias("proteins"), (size / F.lit(31.0)).alias("salt"))
    product = {"brand": F.col("p_brand"), "name": F.col("p_name"), "quantity": F.concat(F.col("p_size").cast("string"), F.lit(" g")), "values": values, "sodium": size / F.lit(31.0) / F.lit(2.5)}
    lang = F.when(F.col("p_partkey") % 2 == 0, "es").otherwise("en")
    return p.select("p_partkey", text.card(product, lang, F.col("p_partkey") % 3 == 0).alias("card"))


@query(f"with {O} select id, pos, {_PRINT.format('(price / 100)')} as energy, {_PRINT.format('(discount * 100)')} as fat, {_PRINT.format('quantity')} as salt from o")
def parse_card(spark, sf_dir):
    """Cards printed from items and read back: what a reader recovers."""
    c = item_cards(spark, sf_dir).select("id", F.posexplode("texts").alias("pos", "t"))
    return c.withColumn("p", text.panel(F.col("t"))).select("id", F.col("pos").cast("long").alias("pos"), "p.energy", "p.fat", "p.salt")


@query(f"""with {D}, c as (select *, cast(printf('%.1f', (list_sort(quantity)[k // 2] + list_sort(quantity)[k // 2 + 1]) / 2) as double) as cap from d),
o as (select id, k, cap, unnest(range(k)) as pos, unnest(quantity) as q, unnest(price) / 100 as e from c),
r as (select *, row_number() over (partition by id order by {_PRINT.format('e')} desc, pos) as n from o where {_PRINT.format('q')} <= cap)
select id, pos as choice from r where n = 1""")
def decide_rules(spark, sf_dir):
    """Questions and cards as text, answered by the rules alone."""
    c = questions(item_cards(spark, sf_dir), pick.middle_cap(F.col("quantity")))
    return c.select("id", answer.decide(F.col("question"), F.col("texts")).cast("long").alias("choice"))


@query("""with d as (select doc_id, case when doc_id % 2 = 0 then 'Less salt, sugar and saturated fat; fibre like ' || lang || ' fat ' || source || ' protein' else 'Más sal y grasa saturada, menos azúcar que ' || source || ', ¿fibra o grasa?' end as q from documents)
select doc_id, case when doc_id % 2 = 0 then 'salt,sugars,saturated_fat,fiber,fat,proteins' else 'salt,saturated_fat,sugars,fiber,fat' end as named from d""")
def mentions_in_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    q = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Less salt, sugar and saturated fat; fibre like "), F.col("lang"), F.lit(" fat "), F.col("source"), F.lit(" protein"))).otherwise(F.concat(F.lit("Más sal y grasa saturada, menos azúcar que "), F.col("source"), F.lit(", ¿fibra o grasa?")))
    return d.select("doc_id", F.array_join(text.mentions(q, text.language(q)), ",").alias("named"))


@query("""with i as (select l_orderkey, l_linenumber, l_partkey, l_quantity, try_cast(case when l_partkey % 5 = 0 then 'n/a' when l_partkey % 7 = 0 then '' else ' ' || l_extendedprice::varchar || ' ' end as double) as price, l_tax, l_discount from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_quantity, price from i where price is not null and price > 0 and price <= 50000 and l_quantity between 0 and 40 and abs(l_tax * 2.5::double - l_discount) <= greatest(0.05, 0.1::double * l_discount)""")
def normalise_range_consistency(spark, sf_dir):
    """Safe number parsing, range filters and the check of one column against another."""
    i = table(spark, sf_dir, "lineitem")
    raw = F.when(F.col("l_partkey") % 5 == 0, "n/a").when(F.col("l_partkey") % 7 == 0, "").otherwise(F.concat(F.lit(" "), F.col("l_extendedprice").cast("string"), F.lit(" ")))
    i = i.withColumn("price", exact.to_number(raw)).where((F.col("price") > 0) & (F.col("price") <= 50000) & F.col("l_quantity").between(0, 40))
    return i.where(F.abs(F.col("l_tax") * F.lit(2.5) - F.col("l_discount")) <= F.greatest(F.lit(0.05), F.lit(0.1) * F.col("l_discount"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "price")


def _episodes(spark, sf_dir) -> DataFrame:
    """Conversations as pick-one rows: turns are options, the first role is the answer."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    turns = F.transform("t", lambda x: F.struct(F.concat(F.lit("c"), (x["turn"] % 5).cast("string")).alias("id"), F.when(x["turn"] % 6 == 5, "").otherwise(x["text"]).alias("text")))
    return c.select("conv_id", F.when(F.col("conv_id") % 11 == 0, " ").otherwise("shelf").alias("state"), F.when(F.col("conv_id") % 13 == 0, F.lit(None)).otherwise("which?").alias("question"), turns.alias("candidates"), F.concat(F.lit("c"), (F.col("conv_id") % 6).cast("string")).alias("answer"))


_EPISODES = """e as (
  select conv_id, case when conv_id % 11 = 0 then ' ' else 'shelf' end as state, case when conv_id % 13 = 0 then null else 'which?' end as question, 'c' || (conv_id % 6) as answer,
         list('c' || (turn % 5) order by turn, role, text) as ids, list(case when turn % 6 = 5 then '' else text end order by turn, role, text) as texts
  from conversations group by conv_id)"""


@query(f"with {_EPISODES} select conv_id, coalesce(state <> '' and question <> '' and len(ids) >= 2 and len(list_distinct(ids)) = len(ids) and len(list_filter(texts, lambda t: t = '')) = 0 and list_contains(ids, answer), false) as valid from e")
def valid_rows(spark, sf_dir):
    e = _episodes(spark, sf_dir)
    return e.select("conv_id", rows.valid_episode({c: F.col(c) for c in e.columns}).alias("valid"))


@query(f"""with {_EPISODES} select conv_id, case when trim(state) = '' then 'state must be non-empty text' when question is null then 'question must be non-empty text' when len(ids) not between 2 and 26 then 'candidates must hold 2 to 26 options'
 when len(list_filter(texts, lambda t: trim(t) = '')) > 0 then 'every candidate needs a non-empty text' when len(list_distinct(ids)) <> len(ids) then 'candidate ids must be present and unique' end as problem from e""")
def request_check(spark, sf_dir):
    e = _episodes(spark, sf_dir)
    return e.select("conv_id", rows.request_problem({c: F.col(c) for c in e.columns}).alias("problem"))


_HARD = f"""{D}, h as (select id, k, case when id % 3 = 0 then 'with at most 2 g' else 'the most' end as q, id % 10 = 0 as mg from d)"""


def _hard(spark, sf_dir):
    d = decisions(spark, sf_dir)
    q = F.when(F.col("id") % 3 == 0, "with AT MOST 2 g").otherwise("the most")
    texts = F.transform("line", lambda x, i: F.concat(F.when((F.col("id") % 10 == 0) & (i == 1), "sodium ").otherwise("salt "), x.cast("string")))
    return d.select("id", "k", rows.hard(q, texts).alias("hard"))


@query(f"with {_HARD} select id, k, q = 'with at most 2 g' or k >= 5 or mg as hard from h")
def hard_rows(spark, sf_dir):
    return _hard(spark, sf_dir)


@query(f"with {_HARD}, g as (select id, k, q = 'with at most 2 g' or k >= 5 or mg as hard from h) select id, k, hard, unnest(case when hard then [0, 1, 2] else [0] end)::integer as copy from g")
def oversample(spark, sf_dir):
    return rows.oversample(_hard(spark, sf_dir), F.col("hard"), 2)


_BUDGET = """b as (select lim, n, least(160, greatest(8, lim // 8)) as q, least(256, greatest(16, lim // 8)) as s0 from (select unnest([64, 128, 300, 512, 1536]) as lim), (select unnest(range(0, 27)) as n)),
b2 as (select *, greatest(n, 1) as m from b), b3 as (select *, case when lim - (m + 1) - q - s0 < 4 * m then greatest(8, lim - (m + 1) - q - 4 * m) else s0 end as s from b2)"""


@query(f"with {_BUDGET} select lim::bigint as lim, n::bigint as n, q::bigint as question, s::bigint as state, greatest(1, floor((lim - (m + 1) - q - s) / m))::bigint as option from b3")
def budget_table(spark, sf_dir):
    grid = spark.range(0, 27).withColumnRenamed("id", "n").withColumn("lim", F.explode(F.array(*(F.lit(x).cast("long") for x in (64, 128, 300, 512, 1536)))))
    return grid.withColumn("b", rows.budgets(F.col("lim"), F.col("n"))).select("lim", "n", "b.question", "b.state", "b.option")


@query("""with c as (select conv_id, list(text order by turn, role, text) as t, first(text order by turn, role, text) as q, count(*) as n from conversations group by 1),
b as (select *, case when 1536 - (n + 1) - 160 - 192 < 4 * n then greatest(8, 1536 - (n + 1) - 160 - 4 * n) else 192 end as s from c)
select conv_id, strlen(q) + 2 <= 160 and list_max(list_transform(t, lambda x: strlen(x))) + 2 <= greatest(1, floor((1536 - (n + 1) - 160 - s) / n)) as fits from b""")
def byte_fit(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text")))["text"].alias("t"))
    return c.select("conv_id", rows.fits(F.col("t")[0], F.col("t")).alias("fits"))


@query(f"""with {D}, x as (select id, k, 50 + id % 200 as st, 10 + id % 170 as qu, list_transform(part, lambda p: 20 + p % 400) as o from d),
y as (select *, least(160, greatest(64, qu)) as qw, floor((1536 - (k + 1) - 160 - 192) / k)::bigint as ol from x), z as (select *, least(ol, greatest(96, list_max(o))) as ow from y)
select id, 192::bigint as state_width, least(st, 192)::bigint as state_used, 193::bigint as question_start, qw::bigint as question_width, ow::bigint as option_width,
 array_to_string(list_transform(range(k), lambda i: 194 + qw + i * (ow + 1)), ',') as option_starts from z""")
def slot_layout(spark, sf_dir):
    d = decisions(spark, sf_dir)
    lay = rows.layout(F.col("id") % 200 + 50, F.col("id") % 170 + 10, F.transform("part", lambda p: p % 400 + 20), question_slot=64, option_slot=96)
    return d.withColumn("l", lay).select("id", "l.state_width", "l.state_used", "l.question_start", "l.question_width", "l.option_width", F.array_join(F.col("l.option_starts").cast("array<string>"), ",").alias("option_starts"))


@query("select conv_id, turn, case when strlen(text) <= 192 then hex(text) else right(hex(text), 384) end as tail from conversations")
def tail_truncate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", rows.tail_bytes(F.col("text"), 192).alias("tail"))


@query("with c as (select conv_id, count(*) as k from conversations group by 1) select conv_id, k, (row_number() over (partition by k order by conv_id) - 1) // 8 as batch from c")
def batch_by_options(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("k"))
    return rows.batches(c, "k", [F.col("conv_id")], 8)


@query(f"""with {D}, o as (select id, unnest(part) as part, unnest(range(k)) as pos from d) select id, string_agg(part::varchar, ',' order by sha256('7/' || id || '/' || pos)) as parts from o group by 1""")
def shuffle_options(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return d.select("id", F.array_join(rows.shuffle_options(F.col("part"), F.lit("7"), F.col("id").cast("string")).cast("array<string>"), ",").alias("parts"))


@query("select s::bigint as step, round(case when s < 100 then (s + 1) / 100 else 0.1 + 0.45::double * (1 + cos(pi() * least(1, (s - 100) / 900))) end, 9) as rate from range(0, 1200) t(s)")
def lr_schedule(spark, sf_dir):
    return spark.range(1200).select(F.col("id").alias("step"), F.round(schedule(F.col("id"), 1000, 100), 9).alias("rate"))


@query(f"""with {_SCORED}, s as (select source as label, count(*) as rows, count(*) filter (where choice = answer) as hits, count(*) filter (where coalesce(decidable, true)) as dr, count(*) filter (where coalesce(decidable, true) and choice = answer) as dh,
  median(doc_id % 100 + 0.25) as p50, max(doc_id % 100) + 0.25 as p95 from e group by 1),
t as (select *, hits / rows as a, {_WILSON.format("hits", "rows")} as w, case when dr > 0 then dh / dr end as d from s)
select row_number() over (order by a desc, label) as rank, '| ' || label || ' | ' || rows || ' | ' || printf('%.1f', 100 * a) || ' | ' || printf('%.1f', 100 * w) || ' | ' || coalesce(printf('%.1f', 100 * d), '') || ' | ' || printf('%.1f', p50 + 0.01) || ' | ' || printf('%.1f', p95 + 0.01) || ' |' as line from t""")
def leaderboard_pivot(spark, sf_dir):
    e = _scored(spark, sf_dir)
    t = score.totals(e, ["source"], F.col("choice"), F.col("answer"), F.col("decidable"))
    ms = e.withColumn("ms", F.col("doc_id") % 100 + F.lit(0.25)).groupBy("source").agg((F.percentile("ms", F.lit(0.5)) + F.lit(0.01)).alias("p50"), (F.max("ms") + F.lit(0.01)).alias("p95"))
    return score.leaderboard(t.join(ms, "source").withColumnRenamed("source", "label")).withColumn("rank", F.col("rank").cast("long"))


_SHAPES = " || ' | ' || ".join(f"coalesce((select printf('%.1f', 100 * accuracy) from c where c.source = t.label and c.cell = '{cell}'), '')" for cell in score.CELLS)


@query(f"""with {_SCORED}, s as (select source as label, count(*) as rows, count(*) filter (where choice = answer) as hits, count(*) filter (where coalesce(decidable, true)) as dr, count(*) filter (where coalesce(decidable, true) and choice = answer) as dh,
  avg(1 / k) as chance, median(doc_id % 100 + 0.26) as p50, max(doc_id % 100) + 0.26 as p95 from e group by 1),
c as (select source, cell, avg(hit::int) as accuracy from (select source, coalesce(choice = answer, false) as hit, unnest(['difficulty:' || split_part(difficulty, '+', 1), 'options:' || k, 'lang:' || lang, 'units:' || case when difficulty like '%+sodium_mg' then 'sodium_mg' else 'salt_g' end]) as cell from e) group by 1, 2),
t as (select *, hits / rows as a, {_WILSON.format("hits", "rows")} as w, case when dr > 0 then dh / dr end as d, row_number() over (order by hits / rows desc, label) as n from s),
lines as (
  select 1 as part, 0 as n, unnest(['# Results', '', 'Forced accuracy per system. Latency is per decision.', '', '| System | Rows | Accuracy % | Wilson low % | Decidable % | p50 ms | p95 ms |', '|---|---:|---:|---:|---:|---:|---:|']) as line, unnest(range(6)) as k
  union all select 2, n, '| ' || label || ' | ' || rows || ' | ' || printf('%.1f', 100 * a) || ' | ' || printf('%.1f', 100 * w) || ' | ' || coalesce(printf('%.1f', 100 * d), '') || ' | ' || printf('%.1f', p50) || ' | ' || printf('%.1f', p95) || ' |', 0 from t
  union all select 3, 0, '', 0 union all select 4, 0, (select 'Chance (uniform pick): ' || printf('%.1f', 100 * chance) || '%.' from t where n = 1), 0
  union all select 5, 0, unnest(['', '## By question shape', '', '| System | {" | ".join(cell.split(":")[1] for cell in score.CELLS)} |', '|---|{"---:|" * len(score.CELLS)}']), unnest(range(5))
  union all select 6, n, '| ' || label || ' | ' || {_SHAPES} || ' |', 0 from t)
select (row_number() over (order by part, n, k) - 1)::integer as n, line from lines""")
def report_lines(spark, sf_dir):
    """The whole report over one result document per source."""
    e = _scored(spark, sf_dir)
    t = score.totals(e, ["source"], F.col("choice"), F.col("answer"), F.col("decidable")).join(score.chance(e, ["source"], F.col("k")), "source")
    keys = score.cell_keys(F.col("difficulty"), F.col("k"), F.col("lang"), F.col("difficulty").endswith("+sodium_mg"))
    cells = score.cells(e, ["source"], keys, F.col("choice") == F.col("answer")).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("accuracy", "rows")))).alias("by"))
    ms = e.withColumn("ms", F.col("doc_id") % 100 + F.lit(0.26)).groupBy("source").agg(F.percentile("ms", F.lit(0.5)).alias("p50"), F.max("ms").alias("p95"))
    documents = t.join(cells, "source").join(ms, "source").withColumns({"system": F.struct(F.col("source").alias("name"), F.lit("rules").alias("kind"), F.lit("cpu").alias("device")), "latency_ms": F.struct("p50", "p95")})
    return benchmark.report(documents)


@query("""with l as (select vec_id, list_transform(embedding, lambda x: x::double)[1:len(embedding) - 1] as l from embeddings), e as (select vec_id, l, list_transform(l, lambda x: exp(x - list_max(l))) as e from l)
select vec_id, list_position(l, list_max(l))::bigint - 1 as choice, round(e[1] / list_sum(e), 6) as p0, round(e[len(e)] / list_sum(e), 6) as p_last from e""")
def softmax_choice(spark, sf_dir):
    """All components but the last as logits of options, the last as that of `unknown`, which is left out."""
    logits = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, sf_dir, "embeddings").withColumn("s", score.softmax_choice(logits, F.size("embedding") - 1))
    return e.select("vec_id", "s.choice", F.get("s.probabilities", F.lit(0)).alias("p0"), F.try_element_at("s.probabilities", F.lit(-1)).alias("p_last"))


@query("""with x as (select vec_id, list_filter(list_zip(range(0, 8), list_transform(range(0, 8), lambda i: embedding[i * 8 + 1 : i * 8 + 8])), lambda z: (vec_id + z[1]) % 3 <> 0) as kept from embeddings)
select vec_id, round(list_sum(list_transform(kept, lambda z: z[2][1]::double)) / len(kept), 6) as m0, round(list_sum(list_transform(kept, lambda z: z[2][8]::double)) / len(kept), 6) as m7 from x""")
def masked_mean_pool(spark, sf_dir):
    v = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, F.lit(8)), lambda x: x.cast("double")))
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("vec_id") + i) % 3 != 0)
    e = table(spark, sf_dir, "embeddings").withColumn("m", score.masked_mean(v, m, 8))
    return e.select("vec_id", F.round(F.col("m")[0], 6).alias("m0"), F.round(F.col("m")[7], 6).alias("m7"))


@query(f"with s as (select text, {_UNIT.format("('doc/' || doc_id::varchar)")} < 0.2 as dev from documents) select count(*) as shared from (select distinct text from s where dev and text in (select text from s where not dev))")
def leakage_check(spark, sf_dir):
    """Texts on both sides of a split by document: copies under other ids leak, which the check must find."""
    d = table(spark, sf_dir, "documents").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), relations.split_of(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).alias("split"))
    return relations.disjoint(d.where("split = 'dev'"), d.where("split = 'train'"), ["digest"])


@query("select event_id, (props->>'$.k')::bigint as k, case when (props->>'$.k')::bigint % 2 = 0 then 'even' else 'odd' end as choice from events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")).withColumn("choice", F.when(F.col("k") % 2 == 0, "even").otherwise("odd"))


@query("select p_partkey, left(replace(lower(p_name || ' ' || p_type), ' ', '_'), 40) as domain, regexp_replace(p_type || '/' || p_brand, '[^A-Za-z0-9._-]+', '-', 'g') as file from part")
def slugs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_type")).alias("domain"), text.file_name(F.concat_ws("/", "p_type", "p_brand")).alias("file"))


@query("select conv_id, turn, '257,' || array_to_string(list_transform(range(1, least(strlen(text), 1534) + 1), lambda i: ('0x' || substr(hex(text), (2 * i - 1)::integer, 2))::integer), ',') || ',258' as ids from conversations")
def byte_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.byte_ids(F.col("text"), rows.MAX_LENGTH, scorer.BOS, scorer.EOS).cast("array<string>"), ",").alias("ids"))


@query("select * from (select conv_id, turn, role from conversations order by conv_id desc, turn, role limit 25)")
def first_rows(spark, sf_dir):
    return relations.first_n(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), 25, [F.col("conv_id").desc(), F.col("turn"), F.col("role")])


@query("with c as (select conv_id, list('c' || turn order by turn, role, text) as ids, case when conv_id % 9 = 0 then null when conv_id % 9 = 1 then 'unknown' else 'c' || (conv_id % 3) end as a from conversations group by 1) select conv_id, case when a is null then -1 when a = 'unknown' then len(ids) else coalesce(list_position(ids, a), 0) - 1 end::integer as gold from c")
def gold_index(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    ids = F.transform("t", lambda x: F.concat(F.lit("c"), x["turn"].cast("string")))
    a = F.when(F.col("conv_id") % 9 == 0, F.lit(None)).when(F.col("conv_id") % 9 == 1, "unknown").otherwise(F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string")))
    return c.select("conv_id", rows.gold_position(ids, a).cast("int").alias("gold"))


extra.register(query)
del words
