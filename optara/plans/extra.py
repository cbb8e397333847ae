"""Queries over generated rows, real episodes, answering systems and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.text import letter_choice
from ..operators import episodes, relations, rows, scorer, synth, systems
from ..shared import partitions, shared_dir
from ..sources import dump, files
from ..streaming import history
from . import benchmark, build, episode_sql, rung_sql
from .decisions import table

TINY = scorer.Config(max_length=512, d_model=32, n_heads=4, n_layers=1, d_ff=64, pointer_layers=1)
SEED, REPLAY_SEED, REPLAY = 7, 11, 0.5


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products: numbers keyed by the part stand in for a nutrition panel."""
    p = table(spark, sf_dir, "part")
    u = lambda n: F.pmod(synth.word(synth.digest(F.col("p_partkey").cast("string"), n), 0), F.lit(1000)) / F.lit(10.0)
    values = F.struct((u("e") * 9 + 1).alias("energy"), u("f").alias("fat"), (u("s") / 2).alias("saturated_fat"), u("u").alias("sugars"), (u("b") / 4).alias("fiber"), (u("p") / 2).alias("proteins"), (u("t") / 20).alias("salt"))
    return p.select(F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.concat(F.col("p_size").cast("string"), F.lit(" g")).alias("quantity"), F.col("p_type").alias("category"), F.col("p_type").alias("group"), F.when(F.col("p_partkey") % 3 == 0, "es").otherwise("en").alias("language"), values.alias("values"), (values["salt"] / F.lit(2.5)).alias("sodium"), F.col("p_partkey").alias("file_pos"))


def indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row to make for each part; spread, since making it costs more than reading its number."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("index")).repartition(partitions(spark))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("candidates", F.to_json("candidates"))


def dump_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as raw lines of a product dump, all strings, with every kind of flaw that cleaning meets."""
    i = "p_partkey"
    tenths = lambda x: f"concat(({x}) div 10, '.', ({x}) % 10)"
    return table(spark, sf_dir, "part").select(
        F.expr(f"lpad({i}, 13, '0') as code"), F.col(i).alias("file_pos"),
        F.expr(f"case when {i} % 17 = 0 then '' when {i} % 19 = 0 then '  ' else concat('  ', p_name, ' ') end as product_name"),
        F.expr(f"case when {i} % 13 = 0 then '' else concat(p_brand, ' , Other') end as brands"), F.expr("concat(' ', p_size, ' g') as quantity"),
        F.expr(f"case when {i} % 23 = 0 then 'France, Spain' else element_at(array('France,Spain', 'United States', 'France', 'United Kingdom,Spain', 'Spain'), cast({i} % 5 + 1 as int)) end as countries_en"),
        F.expr(f"case when {i} % 29 = 0 then concat('en:', p_type) when {i} % 31 = 0 then '' else p_type end as main_category_en"), F.expr(f"case when {i} % 7 = 0 then '' else concat(p_type, ',x') end as categories_en"),
        F.expr(f"case when {i} % 11 = 0 then 'bad' when {i} % 37 = 0 then 'nan' when {i} % 41 = 0 then '1e1' when {i} % 43 = 0 then '1_0' when {i} % 53 = 0 then '1.5f' else {tenths(f'{i} % 1100')} end as sugars_100g"),
        F.expr(f"{tenths(f'{i} % 30')} as salt_100g"), F.expr(f"case when {i} % 47 = 0 then '9' when {i} % 30 = 0 and {i} % 4 = 0 then '-0.01' else concat({i} % 30 * 4 div 100, '.', lpad({i} % 30 * 4 % 100, 2, '0')) end as sodium_100g"),
        F.expr(f"{tenths(f'{i} * 7 % 1010')} as fat_100g"), F.expr(f"{tenths(f'{i} * 3 % 400')} as `saturated-fat_100g`"), F.expr(f"{tenths(f'{i} * 11 % 600')} as proteins_100g"), F.expr(f"concat('', {i} % 31) as fiber_100g"), F.expr(f"concat({i} % 1000, '') as `energy-kcal_100g`"),
    )


_TENTHS = "(({0}) // 10 || '.' || ({0}) % 10)"
CLEAN = f"""with r as (select p_partkey as i, lpad(p_partkey::varchar, 13, '0') as code, case when i % 17 = 0 then '' when i % 19 = 0 then '' else p_name end as name, case when i % 13 = 0 then '' else p_brand end as brand, p_size || ' g' as quantity,
  case when i % 23 = 0 or i % 5 = 2 then null when i % 5 in (0, 4) then 'es' else 'en' end as language, case when i % 29 = 0 then 'en:' || p_type when i % 31 = 0 then '' else p_type end as category, case when i % 7 = 0 then category else p_type end as "group",
  try_cast(case when i % 11 = 0 then 'bad' when i % 37 = 0 then 'nan' when i % 41 = 0 then '1e1' when i % 43 = 0 then '1_0' when i % 53 = 0 then '1.5f' else {_TENTHS.format('i % 1100')} end as double) as sugars,
  {_TENTHS.format('i % 30')}::double as salt, case when i % 47 = 0 then 9 when i % 30 = 0 and i % 4 = 0 then -0.01::double else (i % 30 * 4 // 100 || '.' || lpad((i % 30 * 4 % 100)::varchar, 2, '0'))::double end as sodium,
  {_TENTHS.format('i * 7 % 1010')}::double as fat, {_TENTHS.format('i * 3 % 400')}::double as saturated_fat, {_TENTHS.format('i * 11 % 600')}::double as proteins, (i % 31)::double as fiber, (i % 1000)::double as energy from part)
select code, name, brand, quantity, category, "group", language, sugars, salt, fat, saturated_fat, proteins, fiber, energy, sodium, i as file_pos from r
where language is not null and name <> '' and category <> '' and not contains(category, ':') and sugars is not null and not isnan(sugars) and sugars between 0 and 100 and salt between 0 and 100 and fat between 0 and 100 and saturated_fat between 0 and 100
  and proteins between 0 and 100 and fiber between 0 and 100 and energy > 0 and energy <= 900 and abs(sodium * 2.5::double - salt) <= greatest(0.05::double, 0.1::double * salt)"""

REQUESTS = f"""with {episode_sql.built(episode_sql.PARTS)}, e as (select {episode_sql.ROW}, texts from made)
select id, '{{"state":"' || state || '","questions":{{"pick":{{"type":"choice","instructions":"' || question || '","criteria":{{' || array_to_string(list_transform(texts, lambda t, i: '"c' || (i - 1) || '":"' || t || '"'), ',') || '}}}}}}}}' as body from e"""

REPLIES = """with e as (select event_id, 'c' || (event_id % 4) as c, event_id % 5 as r, event_id % 2 as odd, event_id % 6 as l from events)
select event_id, case when r in (0, 1) then c when r = 2 then case when odd = 1 then 'x' else 'y' end end as choice, case l when 0 then 1 when 1 then 2 when 2 then 0 end::integer as letter from e"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as replies of external systems: flat, nested, with probabilities alone, empty and broken; and as letters in prose."""
    e, c = table(spark, sf_dir, "events").select("event_id"), "c', event_id % 4, '"
    pick = lambda body: "concat('{\"answers\":{\"pick\":{" + body + "}}}')"
    choice = '"choice":"' + c + '"'
    odds = '"probabilities":{"z":0.7,"x":' + "', if(event_id % 2 = 1, 0.9, 0.1), '" + ',"y":0.7}'
    nested = "concat('{\"states\":[', " + pick(choice) + ", ',{\"answers\":{}}]}')"
    return e.select("event_id", F.expr(f"case event_id % 5 when 0 then {pick(choice)} when 1 then {nested} when 2 then {pick(odds)} when 3 then '{{}}' else 'broken {{' end").alias("reply"), F.expr("element_at(array(' b', 'The answer is C.', 'A or B', 'none of them', 'Z', ''), cast(event_id % 6 + 1 as int))").alias("said"))


INDICES = "select p_partkey as index from part"
RUNS = "select user_id::varchar as run, event_id as cycle, value / 100::double as accuracy, value >= 90 as cleared from events"
BEFORE = "over (partition by run order by cycle rows between unbounded preceding and 1 preceding)"


def register(query) -> None:
    for rung in W.RUNGS:

        def synth_rung(spark, sf_dir, rung=rung):
            return _flat(synth.mixed(indices(spark, sf_dir), rung, SEED))

        synth_rung.__name__ = f"synth_rung_{rung[:2]}"
        query(rung_sql.rows(rung_sql.replayed(INDICES, rung, SEED, 0.0), SEED))(synth_rung)

    @query(rung_sql.rows(rung_sql.replayed(INDICES, "r3-units", REPLAY_SEED, REPLAY), REPLAY_SEED))
    def replay_mix(spark, sf_dir):
        """A rung with a share of earlier ones."""
        return _flat(synth.mixed(indices(spark, sf_dir), "r3-units", REPLAY_SEED, REPLAY))

    @query(episode_sql.episodes())
    def real_episodes(spark, sf_dir):
        return _flat(episodes.publishable(episodes.build(products(spark, sf_dir))))

    @query(episode_sql.system_scores())
    def system_scores(spark, sf_dir):
        """The rule program over the real rows: all of the decidable ones are right, some of the others."""
        made = episodes.build(products(spark, sf_dir)).drop("split")
        t = benchmark.totals(benchmark.answered(made, {"rules": systems.rules}))
        return t.select("system", "rows", "hits", "decidable_rows", "unparsed", *(F.round(c, 6).alias(c) for c in ("accuracy", "wilson_lower", "decidable_accuracy", "chance")))

    @query(CLEAN)
    def clean_products(spark, sf_dir):
        """Raw dump lines through the cleaning rules."""
        c = dump.clean(dump_rows(spark, sf_dir))
        return c.select("code", "name", "brand", "quantity", "category", "group", "language", *(F.col(f"values.{n}").alias(n) for n in W.COLUMNS), "sodium", "file_pos")

    @query(CLEAN.replace(", i as file_pos from r", " from r"))
    def dump_round_trip(spark, sf_dir):
        """The same lines written as a compressed, tab-separated dump and read from it."""
        path = f"{shared_dir(spark)}/dump-{uuid.uuid4().hex}"
        written = dump_rows(spark, sf_dir).drop("file_pos").write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("compression", "gzip")
        written.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
        c = dump.read_products(spark, path, partitions(spark))
        return c.select("code", "name", "brand", "quantity", "category", "group", "language", *(F.col(f"values.{n}").alias(n) for n in W.COLUMNS), "sodium")

    @query(f"with {episode_sql.built(episode_sql.PARTS)}, e as (select {episode_sql.ROW}, split, k from made) select id, question, answer, lang, difficulty, decidable, k as options from e where {episode_sql.PUBLISHABLE}")
    def jsonl_round_trip(spark, sf_dir):
        """Published rows written as JSON lines and read back."""
        path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
        files.write_jsonl(episodes.publishable(episodes.build(products(spark, sf_dir))).drop("split"), path)
        return files.read_jsonl(spark, path).select("id", "question", "answer", "lang", "difficulty", "decidable", F.size("candidates").cast("long").alias("options"))

    @query("""with a as (select distinct lang, source from documents), e as (select distinct lang, source from documents where lang = 'en')
select 'sample' as side, 0 as only_left, 0 as only_right union all select 'english', (select count(*) from (select * from a except all select * from e)), (select count(*) from (select * from e except all select * from a))""")
    def same_cells(spark, sf_dir):
        """A stratified sample holds every cell, one language alone doesn't."""
        d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
        cells = lambda df: df.select("lang", "source").distinct()
        sides = {"sample": relations.stratified(d, ["lang", "source"], [F.col("doc_id")], 137), "english": d.where("lang = 'en'")}
        found = [relations.unequal(cells(d), cells(other)).select(F.lit(name).alias("side"), "only_left", "only_right") for name, other in sides.items()]
        return found[0].unionByName(found[1])

    @query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, date_diff('day', timestamp '2020-01-01', ts)::integer as days from events")
    def iso_times(spark, sf_dir):
        """Times as ISO text, and days from the text read back."""
        e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
        return e.withColumn("days", F.date_diff(F.to_date("iso", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("2020-01-01").cast("date")))

    @query(episode_sql.manifest())
    def build_manifest(spark, sf_dir):
        """The counts that a build writes beside its files."""
        p = products(spark, sf_dir)
        c = build.counted(p, episodes.build(p))
        shown = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
        return c.withColumns({m: shown(m) for m in ("by_difficulty", "by_language")})

    @query(REQUESTS)
    def request_bodies(spark, sf_dir):
        """Rows as questions of the external decision protocol."""
        made = episodes.build(products(spark, sf_dir))
        return made.select("id", systems.request_of({c: F.col(c) for c in made.columns}).alias("body"))

    @query(REPLIES)
    def reply_choices(spark, sf_dir):
        r = replies(spark, sf_dir)
        return r.select("event_id", systems.choice_of(F.col("reply")).alias("choice"), letter_choice(F.col("said"), F.lit(4)).alias("letter"))

    @query("""with c as (select conv_id, count(*) as k from conversations group by 1), b as (select conv_id, k, (row_number() over (partition by k order by conv_id) - 1) // 8 as batch from c),
o as (select k, batch, row_number() over (order by sha256('5/' || k || '/' || batch)) - 1 as "at" from (select distinct k, batch from b)) select * from b join o using (k, batch)""")
    def seeded_batches(spark, sf_dir):
        """Batches of equal option counts in a seeded order."""
        c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("k"))
        return rows.shuffled_batches(rows.batches(c, "k", [F.col("conv_id")], 8), "k", 5)

    @query("select user_id, ts, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
    def last_events(spark, sf_dir):
        return relations.last_of(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])

    @query()
    def model_predictions(spark, sf_dir):
        """A small model with invented weights over synthetic rows: one forced choice each."""
        out = scorer.predict(synth.mixed(indices(spark, sf_dir), "r1-pair", 3), scorer.random_model(TINY))
        return out.select("id", "choice", F.size("probabilities").alias("options"))

    @query(f"""with h as ({RUNS}), a as (select *, greatest(0, coalesce(max(accuracy) {BEFORE}, 0)) as best_before, least(coalesce(sum(cleared::int) {BEFORE}, 0), 5)::bigint as rung_index from h)
select run, cycle, accuracy, best_before, coalesce(accuracy, 0) > best_before as champion, rung_index from a""")
    def history_stream(spark, sf_dir):
        """Events of each user as a history log, read as a stream with state per user."""
        path = f"{shared_dir(spark)}/history-log-{uuid.uuid4().hex}"
        log = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("cycle"), (F.col("value") / F.lit(100.0)).alias("accuracy"), (F.col("value") >= 90).alias("cleared"))
        log.write.json(path)
        return history.drain(history.champions(history.read_log(spark, path)), "history_stream")
