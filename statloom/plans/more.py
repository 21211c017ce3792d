"""More queries with the SQL that must give the same rows: assistant, sheets, reports, texts, forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import DISTRICTS, DUPLICATES_FOLDER, LABOUR_DISTRICTS, MODULES
from ..functions import colour, numbers, period, text
from ..lineage import cut, scratch
from ..operators import assistant, boosting, catalog, changepoints, forecasting, load, map_layer, models, observations, panel, plan_actual, questions, reference, reports, retrieval, series, shapes, tasks
from ..sources import domain, files, grammar, workbook, workbook_source
from . import tables
from .catalogue import FORECASTS, RANK, YEAR, _forecasts, _layer, _macro, _ramp_sql, layer_sql, parsed_sql, query, series_sql
from .catalogue import MACRO as MACRO_SQL
from .catalogue import TOPICS
from .tables import INDICATORS, OBSERVATIONS, PANEL, PLANS, TASKS

#: Market segments as indicators, each primary in a module.
SEGMENTS = [("AUTOMOBILE", "transport"), ("BUILDING", "qurilis"), ("FURNITURE", "sawda"), ("HOUSEHOLD", "xizmetler"), ("MACHINERY", "sanaat")]
SEGS = "segs AS (SELECT id, lower(id) AS name, 'mln. som' AS unit, module, sort FROM (VALUES " + ", ".join(f"('{i}', '{m}', {MODULES[m][3]})" for i, m in SEGMENTS) + ") t(id, module, sort))"
PRIM = """prim AS (SELECT module, id, name, unit FROM (SELECT i.*, row_number() OVER (PARTITION BY module ORDER BY has_districts DESC,
  NOT (lower(name || ' ' || unit) LIKE '%osim%' OR lower(name || ' ' || unit) LIKE '%osiw%' OR contains(name || ' ' || unit, '%')) DESC, coalesce(c, 0) DESC, id) AS place
  FROM inds i LEFT JOIN (SELECT indicator_id, count(*) AS c FROM pobs GROUP BY 1) ON id = indicator_id) WHERE place = 1)"""


def segments(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(SEGMENTS, "id string, module string")
    return rows.select("id", F.lower("id").alias("name"), F.lit("mln. som").alias("unit"), F.lit("c").alias("category_id"), "module", F.lit(True).alias("has_districts"))


def _flat(items: str, *fields: str) -> Column:
    """Rows of an array as one text, to compare them."""
    return F.array_join(F.transform(items, lambda p: F.concat_ws(":", *[p[f].cast("string") for f in fields])), ",")


# --- assistant ------------------------------------------------------------------------------


@query(INDICATORS, PRIM, sql=""" SELECT r.id, r.indicator_id, r.module, CASE WHEN r.indicator_id IS NOT NULL THEN i.id ELSE p.id END AS indicator FROM
  (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN -1 WHEN p_partkey % 3 = 0 THEN p_partkey END AS indicator_id, 'm' || (p_partkey % 9) AS module FROM part) r
  LEFT JOIN inds i ON i.id = r.indicator_id LEFT JOIN prim p ON p.module = r.module""")
def resolved_indicators(spark, sf_dir):
    inds, key = tables.indicators(spark, sf_dir), F.col("p_partkey")
    asked = tables.read(spark, sf_dir, "part").select(key.alias("id"), F.when(key % 9 == 0, -1).when(key % 3 == 0, key).alias("indicator_id"), F.concat(F.lit("m"), (key % 9).cast("string")).alias("module"))
    return assistant.resolved(asked, inds, catalog.primary_indicators(inds, tables.part_observations(spark, sf_dir)))


KINDS = ["dynamics", "ranking", "growth", "share", "structure", "compare", "pie"]
REQUESTS = f"""req AS (SELECT n_nationkey AS id, p AS place, {KINDS}[(n_nationkey + p) % 7 + 1] AS kind, ['sanaat', 'qurilis', 'sawda', 'none'][n_nationkey % 4 + 1] AS module,
  CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey AS VARCHAR) END AS district_id FROM nation, (SELECT unnest([1, 2, 3, 4]) AS p)),
asked AS (SELECT r.* EXCLUDE (module), coalesce(s.id, 'MACHINERY') AS indicator FROM req r LEFT JOIN segs s USING (module) WHERE place <= 3)"""


def _told(label: str, value: str, order: str) -> str:
    return f"string_agg({label}, ',' ORDER BY {order}) AS labels, string_agg(printf('%.3f', CAST({value} AS DOUBLE)), ',' ORDER BY {order}) AS figures"


BUILT = f"""built AS (
  SELECT 'dynamics' AS kind, indicator_id AS i, '' AS d, {_told('label', 'value', 'year')} FROM points WHERE year <= {YEAR} GROUP BY ALL HAVING count(*) >= 2
  UNION ALL SELECT 'dynamics', indicator_id, district_id, {_told('label', 'value', 'year')} FROM dpoints WHERE year <= {YEAR} GROUP BY ALL HAVING count(*) >= 2
  UNION ALL SELECT 'ranking', indicator_id, '', {_told('name', 'value', 'rank')} FROM layer WHERE rank <= 17 GROUP BY ALL
  UNION ALL SELECT 'growth', indicator_id, '', {_told('name', 'yoy', 'yoy DESC, district_id')} FROM (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY yoy DESC, district_id) AS g FROM layer WHERE yoy IS NOT NULL) WHERE g <= 17 GROUP BY ALL
  UNION ALL SELECT 'share', '', district_id, {_told('module', 'share', 'share DESC, module')} FROM layer JOIN segs ON id = indicator_id WHERE share IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'structure', '', '', {_told('module', 'yoy', 'yoy DESC, module')} FROM points JOIN segs ON id = indicator_id WHERE year = {YEAR} AND yoy IS NOT NULL
  UNION ALL SELECT 'compare', indicator_id, district_id, 'local,mean', printf('%.3f', value) || ',' || printf('%.3f', mean) FROM (SELECT *, avg(value) OVER (PARTITION BY indicator_id) AS mean FROM layer WHERE value IS NOT NULL))"""


def _figures_of(items: str) -> Column:
    return F.array_join(F.transform(items, lambda p: F.format_string("%.3f", p["value"].cast("double"))), ",")


@query(OBSERVATIONS, layer_sql(YEAR), series_sql(False), series_sql(True, prefix="d"), SEGS, REQUESTS, BUILT, sql=""" SELECT a.id, a.place, a.kind, a.indicator, a.district_id, labels, figures FROM asked a JOIN built b
  ON a.kind = b.kind AND CASE WHEN a.kind IN ('share', 'structure') THEN '' ELSE a.indicator END = b.i AND CASE WHEN a.kind IN ('dynamics', 'share', 'compare') THEN coalesce(a.district_id, '') ELSE '' END = b.d""")
def requested_charts(spark, sf_dir):
    n = F.col("n_nationkey").cast("int")
    places = tables.read(spark, sf_dir, "nation").select(n.alias("id"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("place"))
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    asked = places.select("id", "place", pick(KINDS, (F.col("id") + F.col("place")) % 7).alias("kind"), pick(["sanaat", "qurilis", "sawda", "none"], F.col("id") % 4).alias("module"), F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("district_id"))
    made = assistant.charts(asked, tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), segments(spark), YEAR)
    return made.select("id", "place", "kind", "indicator", "district_id", _flat("points", "label").alias("labels"), _figures_of("points").alias("figures"))


@query(OBSERVATIONS, layer_sql(YEAR), series_sql(False), series_sql(True, prefix="d"), SEGS, BUILT, sql=""" SELECT CASE kind WHEN 'dynamics' THEN 1 WHEN 'ranking' THEN 2 ELSE 3 END AS place, kind, labels, figures FROM built
  WHERE d = '' AND (kind IN ('dynamics', 'ranking') AND i = 'BUILDING' OR kind = 'structure')""")
def panel_charts(spark, sf_dir):
    made = assistant.default_charts(tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), segments(spark), YEAR, "qurilis")
    return made.select("place", "kind", _flat("points", "label").alias("labels"), _figures_of("points").alias("figures"))


def _amount(v: str) -> str:
    """A number with spaces by thousands and one digit unless it is 0, in SQL."""
    said = f"printf('%.1f', abs(CAST({v} AS DOUBLE)))"
    return f"(CASE WHEN {v} < 0 THEN '-' ELSE '' END || replace(format('{{:,}}', CAST(split_part({said}, '.', 1) AS BIGINT)), ',', chr(160)) || CASE WHEN {said} NOT LIKE '%.0' THEN '.' || split_part({said}, '.', 2) ELSE '' END)"


def _pct(v: str) -> str:
    return f"coalesce(printf('%+.1f%%', {v}), '—')"


INTENTS = ["recommend", "weak", "compare", "district", "annual", "module", "overview"]
ASKED = f"""asked AS (SELECT n_nationkey AS id, {INTENTS}[n_nationkey % 7 + 1] AS intent, coalesce(s.id, 'MACHINERY') AS indicator, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS district_id
  FROM nation LEFT JOIN segs s ON s.module = ['sanaat', 'qurilis', 'sawda', 'none'][n_nationkey % 4 + 1])"""
SEVERE = "CASE WHEN yoy IS NULL THEN 'in_progress' WHEN yoy < -5 THEN 'critical' WHEN yoy < 0 THEN 'at_risk' WHEN yoy < 5 THEN 'in_progress' ELSE 'completed' END"
POINT = f"CAST(year AS VARCHAR) || CASE WHEN partial THEN ' [' || caption || ']' ELSE '' END || ': ' || {_amount('value')} || ' (' || {_pct('yoy')} || ')'"
TOLD = f"""worst AS (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY yoy, district_id) AS w FROM layer WHERE yoy < 0),
ends AS (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY value, district_id DESC) AS back FROM layer WHERE value IS NOT NULL),
told AS (
  SELECT 'weak' AS kind, indicator_id AS i, '' AS d, string_agg(w || '. ' || name || ': ' || {_amount('value')} || ' mln. som, ' || {_pct('yoy')}, chr(10) ORDER BY w) AS text FROM worst WHERE w <= 6 GROUP BY ALL
  UNION ALL SELECT 'recommend', indicator_id, '', name || ': ' || {_pct('yoy')} || ', ' || {SEVERE} || ', ' || rank || '-orın' FROM worst WHERE w = 1
  UNION ALL SELECT 'compare', indicator_id, '', string_agg(rank || '. ' || name || ': ' || {_amount('value')} || ' (' || printf('%.1f', share) || '%)', chr(10) ORDER BY rank > 3, CASE WHEN rank <= 3 THEN rank ELSE -rank END) FROM ends WHERE rank <= 3 OR back <= 3 GROUP BY ALL
  UNION ALL SELECT 'district', '', district_id, string_agg(module || ': ' || printf('%.1f', share) || '%, ' || {_amount('value')} || ', ' || {_pct('yoy')}, chr(10) ORDER BY share DESC, module) FROM layer JOIN segs ON id = indicator_id WHERE share IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'series', indicator_id, '', string_agg({POINT}, chr(10) ORDER BY year) FROM points WHERE year <= {YEAR} GROUP BY ALL
  UNION ALL SELECT 'series', indicator_id, district_id, string_agg({POINT}, chr(10) ORDER BY year) FROM dpoints WHERE year <= {YEAR} GROUP BY ALL
  UNION ALL SELECT 'overview', '', '', string_agg(module || ': ' || {_amount('value')} || ' mln. som (' || {_pct('yoy')} || ')', chr(10) ORDER BY sort) FROM points JOIN segs ON id = indicator_id WHERE year = {YEAR}),
kinds AS (SELECT *, CASE WHEN intent IN ('annual', 'module') THEN 'series' WHEN intent IN ('recommend', 'weak', 'compare', 'overview') THEN intent WHEN district_id IS NOT NULL THEN 'district' ELSE 'overview' END AS kind FROM asked)"""


@query(OBSERVATIONS, layer_sql(YEAR), series_sql(False), series_sql(True, prefix="d"), SEGS, ASKED, TOLD, sql=""" SELECT a.id, a.intent, a.indicator, a.district_id,
  coalesce(t.text, CASE WHEN a.kind IN ('weak', 'recommend') THEN 'Barlıq rayonlarda kólem óskan.' ELSE 'Maǵlıwmat joq.' END) AS text FROM kinds a LEFT JOIN told t
  ON a.kind = t.kind AND CASE WHEN a.kind IN ('district', 'overview') THEN '' ELSE a.indicator END = t.i AND CASE WHEN a.kind IN ('series', 'district') THEN coalesce(a.district_id, '') ELSE '' END = t.d""")
def assistant_answers(spark, sf_dir):
    n = F.col("n_nationkey").cast("int")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    asked = tables.read(spark, sf_dir, "nation").select(n.alias("id"), pick(INTENTS, n % 7).alias("intent"), F.when(n % 2 == 0, n.cast("string")).alias("district_id"), pick(["sanaat", "qurilis", "sawda", "none"], n % 4).alias("module"))
    return assistant.answers(asked, tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), segments(spark), YEAR)


ASKED_FOR = ["sanaat qalay", "mashqala bar ma", "rayonlardi salistir", "qurilis ushin usinis", "jilliq juwmaq", "sawda qanday", "ne jaǵday"]
#: Every user's turn, with a nation's name for some and something that is asked for.
PROMPTS = f"""prompts AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, coalesce(text, '') || ' ' || CASE WHEN conv_id % 2 = 0 THEN lower(n_name) || 'da ' ELSE '' END || {ASKED_FOR}[(conv_id + turn) % 7 + 1] AS prompt
  FROM conversations JOIN nation ON n_nationkey = conv_id % 25 WHERE role = 'user')"""
REPLIED = "asked AS (SELECT p.id, intent, coalesce(s.id, 'MACHINERY') AS indicator, district_id FROM parsed p LEFT JOIN segs s ON s.module = p.module)"


@query(OBSERVATIONS, layer_sql(YEAR), series_sql(False), series_sql(True, prefix="d"), SEGS, PROMPTS, parsed_sql("prompts"), REPLIED, TOLD, sql=""" SELECT a.id, a.intent, a.indicator, a.district_id,
  coalesce(t.text, CASE WHEN a.kind IN ('weak', 'recommend') THEN 'Barlıq rayonlarda kólem óskan.' ELSE 'Maǵlıwmat joq.' END) AS text FROM kinds a LEFT JOIN told t
  ON a.kind = t.kind AND CASE WHEN a.kind IN ('district', 'overview') THEN '' ELSE a.indicator END = t.i AND CASE WHEN a.kind IN ('series', 'district') THEN coalesce(a.district_id, '') ELSE '' END = t.d""")
def replies_to_prompts(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations").where("role = 'user'")
    n = tables.read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    what = F.get(F.array(*map(F.lit, ASKED_FOR)), ((F.col("conv_id") + F.col("turn")) % 7).cast("int"))
    where = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lower("n_name"), F.lit("da "))).otherwise("")
    rows = c.join(n, F.col("conv_id") % 25 == F.col("n_nationkey"))
    prompts = rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), where, what).alias("prompt"))
    return assistant.replies(prompts, tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), segments(spark), YEAR)


def _num(v: str) -> str:
    return f"coalesce(printf('%.1f', {v}), '—')"


@query(OBSERVATIONS, layer_sql(YEAR), series_sql(False), series_sql(True, "district_id = '7'", "d"), SEGS, sql=f"""
SELECT 1 AS section, CAST(sort * 100000 AS BIGINT) AS place, '### ' || s.name || ' (mln. som)' AS line FROM segs s WHERE s.id IN (SELECT indicator_id FROM layer WHERE value IS NOT NULL)
UNION ALL SELECT 1, sort * 100000 + rank, concat_ws(' | ', l.name, {_num('value')}, {_num('yoy')}, {_num('share')}, CAST(rank AS VARCHAR)) FROM layer l JOIN segs s ON s.id = indicator_id WHERE value IS NOT NULL
UNION ALL SELECT 2, sort, '- ' || name || ': ' || {_num('value')} || ' mln. som (' || {_num('yoy')} || '%)' FROM points JOIN segs ON id = indicator_id WHERE year = {YEAR}
UNION ALL SELECT 3, year, '- ' || year || CASE WHEN partial THEN ' [' || caption || ']' ELSE '' END || ': ' || {_num('value')} || ' (' || {_num('yoy')} || '%)' FROM dpoints WHERE indicator_id = 'MACHINERY' AND year <= {YEAR}
UNION ALL SELECT 4, sort, '- ' || s.name || ': ' || {_num('value')} || ' mln. som, ' || {_num('share')} || '%, ' || rank || '/' || (SELECT count(*) FROM layer x WHERE x.indicator_id = l.indicator_id AND x.value IS NOT NULL) || ', ' || {_num('yoy')} || '%'
  FROM layer l JOIN segs s ON s.id = indicator_id WHERE district_id = '7' AND value IS NOT NULL""")
def context_lines(spark, sf_dir):
    return assistant.context(tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), segments(spark), YEAR, "sanaat", "7")


@query(PLANS, sql=""" SELECT count(*) AS rows, coalesce(string_agg(concat_ws(' | ', coalesce(module, '—'), region, coalesce(printf('%.1f', CAST(planned AS DOUBLE)), '—'), coalesce(printf('%.1f', CAST(actual AS DOUBLE)), '—'), status), chr(10) ORDER BY id), 'Maǵlıwmat joq.') AS text
  FROM (SELECT * FROM plans WHERE region = '3' AND module = 'BUILDING' ORDER BY id LIMIT 50)""")
def question_context(spark, sf_dir):
    return assistant.question_text(assistant.question_rows(tables.plans(spark, sf_dir), region="3", module="BUILDING"))


@query(OBSERVATIONS, layer_sql(YEAR), sql=" SELECT indicator_id, arg_min(name, rank) AS leader, arg_max(name, rank) AS laggard, count(*) FILTER (WHERE yoy > 0) AS growing, count(*) FILTER (WHERE yoy < 0) AS declining FROM layer WHERE value IS NOT NULL GROUP BY 1")
def insight_bar(spark, sf_dir):
    return questions.insight(tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), YEAR).drop("mean_yoy")


@query(OBSERVATIONS, layer_sql(YEAR), sql=f" SELECT concat_ws(' | ', indicator_id, name, {_amount('value')}, {_pct('yoy')}) AS line, indicator_id, district_id FROM layer WHERE value IS NOT NULL")
def answer_lines(spark, sf_dir):
    return questions.context(tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), YEAR)


# --- catalogue ------------------------------------------------------------------------------


@query(OBSERVATIONS, SEGS, sql=""" SELECT (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM (SELECT DISTINCT year FROM obs)) AS years,
  (SELECT string_agg(module || ':' || indicator_id || ':' || latest, ',' ORDER BY sort) FROM (SELECT module, sort, indicator_id, max(year) AS latest FROM segs JOIN obs ON id = indicator_id GROUP BY ALL)) AS modules,
  (SELECT string_agg(name, ',' ORDER BY name) FROM districts) AS districts, 'c:5' AS categories, (SELECT count(*) FROM obs) AS observations, 5 AS indicators""")
def meta(spark, sf_dir):
    cats = spark.createDataFrame([("c", "C")], "id string, name string")
    row = catalog.meta(segments(spark), tables.observations(spark, sf_dir), cats, tables.districts(spark, sf_dir))
    return row.select(
        F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), _flat("modules", "module", "indicator_id", "latest_year").alias("modules"),
        _flat("districts", "name").alias("districts"), _flat("categories", "id", "indicators").alias("categories"), "observations", "indicators",
    )


MODULE_NAMES = list(MODULES)
MODULE_ROWS = "mods AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{v[0]}', '{v[2]}')" for m, v in MODULES.items()) + ") t(module, module_name, color))"
BRIEFS = f"briefs AS (SELECT p_partkey AS id, CASE WHEN p_size % 9 < {len(MODULE_NAMES)} THEN {MODULE_NAMES}[p_size % 9 + 1] ELSE 'other' END AS module FROM part)"


def _in_modules(spark, sf_dir):
    k = (F.col("p_size") % 9).cast("int")
    module = F.when(k < len(MODULE_NAMES), F.get(F.array(*map(F.lit, MODULE_NAMES)), k)).otherwise("other")
    return tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("unit"), F.col("p_type").alias("category_id"), module.alias("module"), F.lit(True).alias("has_districts"))


@query(MODULE_ROWS, BRIEFS, sql=" SELECT id, b.module, module_name, color FROM briefs b LEFT JOIN mods m ON m.module = b.module")
def indicator_brief(spark, sf_dir):
    return catalog.brief(_in_modules(spark, sf_dir)).select("id", "module", "module_name", "color")


@query(INDICATORS, sql=" SELECT id FROM inds WHERE contains(translate(strip_accents(lower(name)), '''', ''), 'gear')")
def indicator_found(spark, sf_dir):
    return catalog.found(tables.indicators(spark, sf_dir), "GEÁ'R").select("id")


DISTRICT_LIST = "dims AS (SELECT * FROM (VALUES " + ", ".join(f"('{d[0]}', '{d[1]}', {i})" for i, d in enumerate(DISTRICTS)) + ") t(id, name, nr))"


@query(DISTRICT_LIST, MODULE_ROWS, BRIEFS, sql=f""" SELECT 'district' AS list, d.id, d.name, (SELECT count(*) FROM customer WHERE c_nationkey % {len(DISTRICTS)} = nr) AS n FROM dims d
  UNION ALL SELECT 'module', m.module, m.module_name, (SELECT count(*) FROM briefs b WHERE b.module = m.module) FROM mods m""")
def reference_lists(spark, sf_dir):
    # districts with how many customers they have, modules with how many indicators
    ids = F.get(F.array(*[F.lit(d[0]) for d in DISTRICTS]), (F.col("c_nationkey") % len(DISTRICTS)).cast("int"))
    held = tables.read(spark, sf_dir, "customer").groupBy(ids.alias("district_id")).agg(F.count("*").alias("n"))
    places = reference.districts(spark).join(held, "district_id", "left").select(F.lit("district").alias("list"), F.col("district_id").alias("id"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    own = _in_modules(spark, sf_dir).groupBy(F.col("module").alias("id")).agg(F.count("*").alias("n"))
    return places.unionByName(reference.modules(spark).join(own, "id", "left").select(F.lit("module").alias("list"), "id", "name", F.coalesce("n", F.lit(0)).alias("n")))


@query(INDICATORS, PRIM, sql=" SELECT string_agg(module || ' | ' || name || ' | ' || unit, chr(10) ORDER BY module) AS text FROM prim")
def module_catalogue(spark, sf_dir):
    return reference.catalogue_text(catalog.primary_indicators(tables.indicators(spark, sf_dir), tables.part_observations(spark, sf_dir)))


@query(OBSERVATIONS, sql=f""" SELECT o.indicator_id, o.district_id, sum(value) AS value, b.period, CAST(b.period_no AS VARCHAR) AS period_no FROM obs o JOIN
  (SELECT * FROM (SELECT indicator_id, period, period_no, row_number() OVER (PARTITION BY indicator_id ORDER BY {RANK} DESC, coalesce(period_no, 0) DESC) AS n FROM obs WHERE year = 2001) WHERE n = 1) b
  ON o.indicator_id = b.indicator_id AND o.period = b.period WHERE o.year = 2001 AND o.district_id IS NOT NULL GROUP BY ALL""")
def values_of_year(spark, sf_dir):
    rows = observations.values_by_district(tables.observations(spark, sf_dir), 2001)
    return rows.withColumn("period_no", F.col("period_no").cast("string")).select("indicator_id", "district_id", "value", "period", "period_no")


@query(OBSERVATIONS, sql=" SELECT indicator_id, district_id, year, period, CAST(period_no AS VARCHAR) AS period_no, value FROM obs WHERE indicator_id = 'BUILDING' AND district_id = '7' AND year BETWEEN 1997 AND 2000")
def scanned_district(spark, sf_dir):
    rows = observations.scan(tables.observations(spark, sf_dir), indicator="BUILDING", district="7", year_from=1997, year_to=2000)
    return rows.withColumn("period_no", F.col("period_no").cast("string"))


@query(OBSERVATIONS, sql=" SELECT indicator_id, year, period, CAST(period_no AS VARCHAR) AS period_no, value FROM obs WHERE district_id IS NULL")
def scanned_national(spark, sf_dir):
    rows = observations.scan(tables.observations(spark, sf_dir), level="national", year_from=0)
    return rows.select("indicator_id", "year", "period", F.col("period_no").cast("string").alias("period_no"), "value")


@query(OBSERVATIONS, sql=" SELECT coalesce(max(year), 0) AS latest_year FROM obs")
def latest_year_of_all(spark, sf_dir):
    return observations.latest_year(tables.observations(spark, sf_dir))


# --- sheets ----------------------------------------------------------------------------------

PLACES = [(d[0], d[1]) for d in DISTRICTS[:12]]
FACTS = f"""facts AS (SELECT r_name AS title, d.id AS district_id, d.name AS label, d.nr, CAST(year(o_orderdate) AS INT) + 7 AS year, CAST(count(*) AS DOUBLE) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN (VALUES {', '.join(f"('{i}', '{n}', {k})" for k, (i, n) in enumerate(PLACES))}) d(id, name, nr) ON d.nr = n_nationkey % 12 GROUP BY ALL)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by region (a sheet each), district and year, seven years later."""
    o = tables.read(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") + 7).alias("year"))
    c = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = tables.read(spark, sf_dir, "nation").join(tables.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("title"))
    places = spark.createDataFrame([(k, i, name) for k, (i, name) in enumerate(PLACES)], "nr int, district_id string, label string")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(places, F.col("c_nationkey") % 12 == F.col("nr"))
    return rows.groupBy("title", "district_id", "label", "nr", "year").agg(F.count("*").cast("double").alias("value"))


def _cell(rows: DataFrame, row, col, said) -> DataFrame:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        F.concat(F.lit("f#"), "title").alias("sheet"), F.lit("02_Sanaat").alias("category"), F.col("title").alias("source"), column(row).cast("int").alias("row"), column(col).cast("int").alias("col"), column(said).cast("string").alias("text")
    )


def _sheet(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()




def _title() -> Column:
    return F.concat("title", F.lit(" sanaat ónimi kólemi (mln. som)"))


READ = " SELECT title || ' sanaat ónimi kólemi (mln. som)' AS indicator, 'mln. som' AS unit, district_id, year, value FROM facts"
BACK = ("indicator", "unit", "district_id", "year", "value")


@query(FACTS, sql=READ)
def sheets_of_years_across(spark, sf_dir):
    f = cut(_facts(spark, sf_dir))
    at, down = F.col("year") - 2001, F.col("nr") + 3
    cells = _sheet(_cell(f, 0, 0, _title()), _cell(f, 2, at, F.concat(F.col("year").cast("string"), F.lit("-jıl"))), _cell(f, down, 0, F.col("label")), _cell(f, down, at, F.col("value")))
    return grammar.records(cells).select(*BACK)


@query(FACTS, sql=" SELECT title || ' sanaat ónimi kólemi (mln. som) — ' || title || ' sanaat ónimi kólemi (mln. som) — Jámi' AS indicator, 'mln. som' AS unit, district_id, year, value FROM facts")
def sheets_of_years_down(spark, sf_dir):
    f = cut(_facts(spark, sf_dir))
    head, down = (F.col("year") - 2001) * 20, (F.col("year") - 2001) * 20 + F.col("nr") + 1
    cells = _sheet(_cell(f, 0, 0, _title()), _cell(f, 1, 1, "Jámi"), _cell(f, head, 0, F.col("year").cast("string")), _cell(f, down, 0, F.col("label")), _cell(f, down, 1, F.col("value")))
    return grammar.records(cells).select(*BACK)


@query(FACTS, sql=" SELECT '2004-jıl kólemi (mln. som) — Jámi' AS indicator, 'mln. som' AS unit, district_id, 2004 AS year, sum(value) AS value FROM facts WHERE year = 2004 AND (SELECT count(DISTINCT district_id) FROM facts WHERE year = 2004) >= 5 GROUP BY district_id")
def sheets_of_districts_across(spark, sf_dir):
    f = _facts(spark, sf_dir).where("year = 2004").groupBy("district_id", "label", "nr").agg(F.sum("value").alias("value"))
    f = cut(f.withColumn("title", F.lit("2004-jıl kólemi (mln. som)")))
    at = F.col("nr") + 1
    cells = _sheet(_cell(f, 0, 0, F.col("title")), _cell(f, 2, at, F.col("label")), _cell(f, 3, 0, "Jámi"), _cell(f, 3, at, F.col("value")))
    return grammar.records(cells).select(*BACK)


@query(FACTS, sql=""" SELECT title || ' sanaat ónimi kólemi (mln. som) — ' || part AS indicator, 'mln. som' AS unit, CAST(NULL AS VARCHAR) AS district_id, year, sum(value) AS value
  FROM facts, (VALUES ('Barlıǵı', -1), ('Barlıǵı — Jup', 0), ('Barlıǵı — Taq', 1), ('Qalǵan', -1), ('Qalǵan — Taq', 1)) t(part, odd) WHERE odd < 0 OR nr % 2 = odd GROUP BY ALL""")
def sheets_of_parts(spark, sf_dir):
    f = cut(_facts(spark, sf_dir))
    at = F.col("year") - 2001
    sums = lambda odd: f.where(F.lit(odd < 0) | (F.col("nr") % 2 == odd)).groupBy("title", "year").agg(F.sum("value").alias("value"))
    lines = [("Barlıǵı", -1), ("sonnan:", None), ("Jup", 0), ("Taq", 1), ("Qalǵan", -1), ("Shundan", None), ("Taq", 1)]
    parts = [_cell(f, 0, 0, _title()), _cell(f, 2, at, F.concat(F.col("year").cast("string"), F.lit("-jıl")))]
    for i, (label, odd) in enumerate(lines):
        parts.append(_cell(f, 3 + i, 0, label))
        if odd is not None:
            parts.append(_cell(sums(odd), 3 + i, at, F.col("value")))
    return grammar.records(_sheet(*parts)).select(*BACK)


@query(FACTS, sql=" SELECT title || ' sanaat ónimi kólemi (mln. som) — ' || grp AS indicator, 'mln. som' AS unit, district_id, year, value * k AS value FROM facts, (VALUES ('Jámi', 1), ('Sonnan tısqarı', 2)) t(grp, k)")
def sheets_of_groups(spark, sf_dir):
    f = cut(_facts(spark, sf_dir))
    at, down = F.col("year") - 2001, F.col("nr") + 4
    wide = 20  # two tables stand side by side, the second so far to the right
    heading = F.concat(F.col("year").cast("string"), F.lit(" j."))
    first = f.groupBy("title").agg((F.min("year") - 2001).alias("low"))
    cells = [_cell(f, 0, 0, _title()), _cell(first, 2, F.col("low"), "Jámi"), _cell(first, 2, F.col("low") + wide, "Sonnan tısqarı"), _cell(f, down, 0, F.col("label"))]
    for k in (0, 1):
        cells += [_cell(f, 3, at + k * wide, heading), _cell(f, down, at + k * wide, F.col("value") * (k + 1))]
    return grammar.records(_sheet(*cells)).select(*BACK)


@query(FACTS, sql=""" SELECT title || ' sanaat ónimi kólemi (mln. som)' AS indicator, 'mln. som' AS unit, district_id, 2004 AS year, CASE WHEN m = 12 THEN 'year' ELSE 'ytd' END AS period, CASE WHEN m < 12 THEN m END AS period_no, value * m AS value
  FROM facts, (SELECT unnest([1, 2, 6, 12]) AS m) WHERE year = 2004""")
def sheets_of_month_spans(spark, sf_dir):
    f = cut(_facts(spark, sf_dir).where("year = 2004"))
    spans = {1: "Yanvar", 2: "Yanvar-fevral", 6: "Yanvar - iyun", 12: "Yanvar-dekabr"}
    cells = [_cell(f, 0, 0, _title()), _cell(f, 1, 2, "2004-jıl"), _cell(f, F.col("nr") + 4, 0, F.col("label"))]
    for i, (month, said) in enumerate(spans.items()):
        cells += [_cell(f, 3, 1 + i, said), _cell(f, F.col("nr") + 4, 1 + i, F.col("value") * month)]
    return grammar.records(_sheet(*cells)).select(*BACK, "period", "period_no")


def _table(rows: DataFrame, row, col, said) -> DataFrame:
    return _cell(rows.withColumn("title", F.lit("t")), row, col, said).select("sheet", "row", "col", "text")


def _years_of(f: DataFrame) -> DataFrame:
    return f.groupBy("year").agg(F.sum("value").alias("value"))


@query(FACTS, sql=" SELECT year + 8 AS year, 'Eksport' AS indicator, sum(value) AS value FROM facts GROUP BY 1")
def macro_sheet(spark, sf_dir):
    y = cut(_years_of(_facts(spark, sf_dir)).withColumn("year", F.col("year") + 8))
    at = F.col("year") - 2000
    return domain.macro(_sheet(_table(y, 2, at, F.concat(F.col("year").cast("string"), F.lit(" j."))), _table(y, 4, 0, "Eksport, jámi"), _table(y, 4, 1, "mln. AQSH dolları"), _table(y, 4, at, F.col("value")), _table(y, 5, 1, "ósim, %"), _table(y, 5, at, 100)))


@query(FACTS, sql=" SELECT 'QR jámi' AS district_id, year + 14 AS year, sum(value) + 10 AS active, sum(value) AS employed, 10.0::DOUBLE AS unemployed, 5.5::DOUBLE AS rate FROM facts GROUP BY year")
def labour_sheet(spark, sf_dir):
    y = cut(_years_of(_facts(spark, sf_dir)).withColumn("year", F.col("year") + 14))
    at = (F.col("year") - 2016) * 4 + 1
    four = [_table(y, 6, at + i, v) for i, v in enumerate((F.col("value") + 10, F.col("value"), 10, 5.5))]
    return domain.labour_total(_sheet(_table(y, 2, at, F.concat(F.col("year").cast("string"), F.lit("-j."))), _table(y, 6, 0, "Qoraqalpog'iston Respublikasi"), *four))


@query(FACTS, sql=" SELECT 'Bank' AS branch, year + 10 AS year, 2 AS quarter, sum(value) AS value FROM facts GROUP BY year")
def wages_sheet(spark, sf_dir):
    y = cut(_years_of(_facts(spark, sf_dir)).withColumn("year", F.col("year") + 10))
    at = F.col("year") - 2000
    return domain.wages(_sheet(_table(y, 3, at, F.concat(F.col("year").cast("string"), F.lit(" Q2"))), _table(y, 5, 0, "Bank"), _table(y, 5, at, F.col("value"))))


@query(FACTS, sql=" SELECT 'Un' AS branch, year + 10 AS year, sum(value) AS value FROM facts GROUP BY year")
def branches_sheet(spark, sf_dir):
    y = cut(_years_of(_facts(spark, sf_dir)).withColumn("year", F.col("year") + 10))
    at = F.col("year") - 2000
    return domain.branches(_sheet(_table(y, 1, at, F.concat(F.col("year").cast("string"), F.lit("-jıl"))), _table(y, 5, 0, "Un"), _table(y, 5, at, F.col("value")), _table(y, 6, 0, "* esletpe"), _table(y, 6, at, 1)), least=5)


@query(FACTS, sql=" SELECT year, sum(value) AS value FROM facts GROUP BY year")
def passengers_sheet(spark, sf_dir):
    y = cut(_years_of(_facts(spark, sf_dir)))
    at = F.col("year") - 2000
    return domain.passengers(_sheet(_table(y, 3, at, F.concat(F.col("year").cast("string"), F.lit(" j."))), _table(y, 4, 0, "Qaraqalpaqstan Respublikası"), _table(y, 4, at, F.col("value")), _table(y, 5, 0, "Respublikası emes"), _table(y, 5, at, 7)))


@query(FACTS, sql=" SELECT year + 8 AS year, sum(value) AS value FROM facts GROUP BY year")
def enterprises_sheet(spark, sf_dir):
    y = cut(_years_of(_facts(spark, sf_dir)).withColumn("year", F.col("year") + 8))
    at = (F.col("year") - 2009) * 5 + 1
    return domain.enterprises(_sheet(_table(y, 4, at, F.col("year")), _table(y, 7, 0, "Qaraqalpaqstan Respublikasi"), _table(y, 7, at, 3), _table(y, 7, at + 1, F.col("value"))))


# --- files ------------------------------------------------------------------------------------


def _workbooks(spark, sf_dir) -> str:
    """A folder of workbooks: one for each nation with a sheet for each segment; one that is none, one with a sheet that breaks off, and a duplicate."""
    folder = scratch(spark, "workbooks")
    c = tables.read(spark, sf_dir, "customer").join(tables.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.row_number().over(Window.partitionBy("n_name", "c_mktsegment").orderBy("c_custkey")) - 1
    cell = lambda col, text=None, number=None, day=None: F.struct(F.lit(col).alias("col"), F.lit(text).cast("string").alias("text"), F.lit(number).cast("double").alias("number"), F.lit(day).cast("date").alias("date"))
    each = F.array(cell(0, F.col("c_name")), cell(1, number=F.col("c_acctbal")), cell(2, day=F.date_add(F.lit("2010-01-01").cast("date"), F.col("c_custkey").cast("int"))))
    cells = c.withColumn("row", place).select(F.concat("n_name", F.lit("/"), "n_name", F.lit(".xlsx")).alias("file"), F.col("c_mktsegment").alias("sheet"), "row", F.inline(each))
    workbook_source.write_workbooks(cells, folder).count()
    workbook_source.put(f"{folder}/broken/none.xlsx", b"not a workbook")
    workbook_source.put(f"{folder}/broken/half.xlsx", workbook.packed([("fine", {(0, 0): "x"}), ("torn", {(0, 0): "y"})]).replace(b"sheet2.xml", b"sheet9.xml"))
    workbook_source.put(f"{folder}/{DUPLICATES_FOLDER}/copy.xlsx", workbook.packed([("s", {(0, 0): "z"})]))
    workbook_source.put(f"{folder}/broken/~$open.xlsx", b"")
    return folder


BOOKS = """books AS (SELECT n_name || '.xlsx#' || c_mktsegment AS source, n_name AS category, CAST(row_number() OVER (PARTITION BY n_name, c_mktsegment ORDER BY c_custkey) - 1 AS INT) AS row, c_name, CAST(c_acctbal AS DOUBLE) AS b, CAST(year(DATE '2010-01-01' + CAST(c_custkey AS INT)) AS VARCHAR) AS y
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(BOOKS, sql=""" SELECT source, category, row, 0 AS col, c_name AS text, NULL AS bad FROM books UNION ALL SELECT source, category, row, 1, CAST(b AS VARCHAR), NULL FROM books UNION ALL SELECT source, category, row, 2, y, NULL FROM books
  UNION ALL SELECT 'half.xlsx#fine', 'broken', 0, 0, 'x', NULL UNION ALL SELECT 'none.xlsx', 'broken', NULL, NULL, NULL, 'NotAWorkbook' UNION ALL SELECT 'half.xlsx#torn', 'broken', NULL, NULL, NULL, 'no part xl/worksheets/sheet2.xml'""")
def workbook_cells(spark, sf_dir):
    cells, bad = workbook_source.read_workbooks(spark, _workbooks(spark, sf_dir))
    rows = cells.withColumn("bad", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
    return rows.select("source", "category", "row", "col", "text", F.substring_index("bad", ":", 1).alias("bad"))


@query(sql=" SELECT n_name || '.xlsx' AS name FROM nation WHERE contains(lower(n_name), 'ion_1') AND n_nationkey IN (SELECT c_nationkey FROM customer)")
def workbooks_by_keyword(spark, sf_dir):
    cells, _ = workbook_source.read_workbooks(spark, _workbooks(spark, sf_dir), keyword="Ion_1")
    return cells.select(F.substring_index("source", "#", 1).alias("name")).distinct()


@query(sql=" SELECT n_name || '.xlsx' AS name FROM nation WHERE contains(lower(n_name), 'ion_1') AND n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'none.xlsx' WHERE false")
def workbooks_found(spark, sf_dir):
    return files.find_workbooks(spark, _workbooks(spark, sf_dir), "ION_1").select("name")




@query(PANEL, sql=" SELECT district_id, CAST(year AS VARCHAR) AS year, CAST(active AS VARCHAR) AS active FROM panel")
def csv_report(spark, sf_dir):
    path = scratch(spark, "csv")
    files.write_csv(tables.panel(spark, sf_dir).select("district_id", "year", "active"), path)
    return spark.read.option("header", True).csv(path)


@query(PANEL, sql=" SELECT count(*) AS rows, CAST(sum(active) AS BIGINT) AS active FROM panel")
def nested_report(spark, sf_dir):
    rows = files.report(panel=tables.panel(spark, sf_dir).select("district_id", "active"), years=tables.panel(spark, sf_dir).select("year").distinct())
    each = rows.select(F.inline(F.from_json("report", "panel array<struct<district_id:string,active:long>>")["panel"]))
    return each.agg(F.count("*").alias("rows"), F.sum("active").alias("active"))


@query(sql=" SELECT 'be brief' AS system, p_name AS human, p_brand AS gpt FROM part")
def training_file(spark, sf_dir):
    path = scratch(spark, "pairs")
    pairs = tables.read(spark, sf_dir, "part").select(F.col("p_name").alias("human"), F.col("p_brand").alias("gpt"))
    files.write_json(files.sharegpt(pairs, "be brief"), path)
    return files.dialogues(spark, path, lines=True)


@query(sql=" SELECT c_custkey AS id, CAST(c_custkey % 17 AS DOUBLE) + (c_custkey % 7 + 1) AS x1, CAST((c_custkey % 7 + 1) * (c_custkey % 5 + 1) AS DOUBLE) AS area FROM customer")
def path_shapes(spark, sf_dir):
    k = F.col("c_custkey")
    x, y, w, h = (c.cast("string") for c in (k % 17, k % 13, k % 7 + 1, k % 5 + 1))
    far = (k % 17 + k % 7 + 1).cast("string")
    d = F.concat(F.lit("M"), x, F.lit(" "), y, F.lit(" H"), far, F.lit(" L"), far, F.lit(","), (k % 13 + k % 5 + 1).cast("string"), F.lit(" H"), x, F.lit(" Z"))
    rows = tables.read(spark, sf_dir, "customer").select(k.alias("id"), shapes.path_points(d).alias("ring"))
    main = shapes.main_ring(rows, "id")
    return main.join(shapes.bounding_boxes(main, "id"), "id").select("id", "x1", F.abs(shapes.signed_area(F.col("ring"))).alias("area"))


@query(sql=" SELECT c_custkey AS id, round(CAST(c_custkey % 17 AS DOUBLE) + (c_custkey % 7 + 1) / 2.0, 6) AS x, round(CAST(c_custkey % 13 AS DOUBLE) + (c_custkey % 7 + 1) / 2.0, 6) AS y FROM customer")
def label_places(spark, sf_dir):
    k = F.col("c_custkey")
    point = lambda a, b: F.struct((k % 17 + a * (k % 7 + 1)).cast("double").alias("x"), (k % 13 + b * (k % 7 + 1)).cast("double").alias("y"))
    square = F.array(point(0, 0), point(1, 0), point(1, 1), point(0, 1))
    rows = shapes.label_points(tables.read(spark, sf_dir, "customer").select(k.alias("id"), square.alias("ring")), "id")
    return rows.select("id", F.round(F.col("x"), 6).alias("x"), F.round(F.col("y"), 6).alias("y"))


# --- loading ------------------------------------------------------------------------------------


@query(sql=" SELECT p_partkey AS id FROM part WHERE p_brand IN ('Brand#1', 'Brand#3')")
def known_categories(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("category"))
    return load.keep_known(rows, ["Brand#1", "Brand#3"]).select("id")


@query(sql=" SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name || '|' || p_brand || CASE WHEN p_partkey % 3 > 0 THEN '|' || p_type || '|' || (p_partkey % 3) ELSE '' END ELSE p_name || '|' || p_type || '|' || p_size END AS key FROM part")
def record_keys(spark, sf_dir):
    k = F.col("p_partkey")
    rows = tables.read(spark, sf_dir, "part").select(
        k.alias("id"), F.col("p_name").alias("indicator"), F.col("p_brand").alias("unit"), F.col("p_type").alias("source"), F.col("p_size").alias("row"), (k % 3).cast("int").alias("block"), F.when(k % 2 == 0, "d").alias("district_id")
    )
    return rows.select("id", load.record_key().alias("key"))


@query(sql=" SELECT p_partkey, contains(lower(p_name || ' Jumıssızlıq'), 'jumıssız') AND p_partkey % 2 = 0 AS lower FROM part")
def lower_is_better(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.concat("p_name", F.lit(" Jumıssızlıq"))).otherwise(F.col("p_name"))
    return tables.read(spark, sf_dir, "part").select(k, text.contains_any(name, load.LOWER_IS_BETTER).alias("lower"))


@query(sql=""" SELECT p_partkey AS key, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 10 ELSE (SELECT max(p_partkey) * 10 FROM part WHERE p_partkey % 3 = 0) + row_number() OVER (PARTITION BY p_partkey % 3 = 0 ORDER BY p_partkey) END AS id FROM part""")
def upserted_ids(spark, sf_dir):
    new = tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"))
    return load.with_ids(new, new.where("key % 3 = 0").withColumn("id", F.col("key") * 10), "key")


@query(INDICATORS, sql=" SELECT id, CASE WHEN id = 2 AND has_districts THEN 'm3' ELSE module END AS module, id = 2 OR id % 5 = 0 AS lower_is_better FROM inds")
def patched_indicator(spark, sf_dir):
    inds = tables.indicators(spark, sf_dir).withColumn("lower_is_better", F.col("id") % 5 == 0)
    return load.redirected(load.rebound(inds, 2, "m3", ["m3"]), 2, True).select("id", "module", "lower_is_better")


@query(INDICATORS, sql=" SELECT id FROM inds WHERE id IN (SELECT indicator_id FROM pobs WHERE year = 1998)")
def full_refresh(spark, sf_dir):
    kept, _ = load.fully_refreshed(tables.indicators(spark, sf_dir), tables.part_observations(spark, sf_dir).where("year = 1998"))
    return kept.select("id")


@query(sql=" SELECT nr + 1 AS id, ['0','1','10','11','12','13','14','15','16','17','18','19','2','20','21','22','23'][(nr * 5) % 17 + 1] AS district_id, CAST((nr * 17 + 10) % 100 AS INT) AS progress, make_date(2026, 1 + nr % 12, 28) AS deadline FROM (SELECT n_nationkey AS nr FROM nation)")
def seeded_tasks(spark, sf_dir):
    templates = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("title"), F.lit("sanaat").alias("module"))
    return tasks.seeded(spark, tables.districts(spark, sf_dir), templates).select("id", "district_id", "progress", "deadline")


# --- panels, models, reports -------------------------------------------------------------------------


@query(PANEL, sql=" SELECT year, count(DISTINCT district_id) AS n, arg_min(district_id, struct_pack(a := rate, b := district_id)) AS least, arg_min(district_id, struct_pack(a := -rate, b := district_id)) AS largest FROM panel WHERE year <= 1997 GROUP BY 1")
def best_and_worst_years(spark, sf_dir):
    return panel.best_and_worst(panel.full_years(tables.panel(spark, sf_dir), 1997), "district_id", "rate")


@query(PANEL, sql=""" SELECT district_id, year, rate, CAST(a AS INT) AS from_least, CAST(b AS INT) AS from_largest FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY rate, district_id) AS a,
  row_number() OVER (PARTITION BY year ORDER BY rate DESC, district_id) AS b FROM panel) WHERE a <= 3 OR b <= 3""")
def rate_ends(spark, sf_dir):
    return panel.ends_of_year(tables.panel(spark, sf_dir), "district_id", "rate")


@query(PANEL, sql=" SELECT name, max(value) FILTER (WHERE district_id = '1') AS c1, max(value) FILTER (WHERE district_id = '2') AS c2 FROM (SELECT district_id, 'active' AS name, CAST(active AS DOUBLE) AS value FROM panel WHERE year = 1996 UNION ALL SELECT district_id, 'employed', employed FROM panel WHERE year = 1996) GROUP BY 1")
def transposed_panel(spark, sf_dir):
    return panel.transposed(tables.panel(spark, sf_dir).where("year = 1996"), "district_id", ["active", "employed"], [1, 2])


@query(OBSERVATIONS, sql=" SELECT DISTINCT year FROM obs WHERE indicator_id = 'BUILDING' OR district_id IS NULL")
def either_year(spark, sf_dir):
    obs = tables.observations(spark, sf_dir)
    return panel.unioned_years(obs.where("indicator_id = 'BUILDING'"), obs.where("district_id is null"))


@query(PANEL, sql=""" SELECT district_id, year, round(active - (a + b * year), 4) + 0.0::DOUBLE AS rest FROM panel
  JOIN (SELECT district_id, regr_intercept(active, year) AS a, regr_slope(active, year) AS b FROM panel GROUP BY 1) USING (district_id)""")
def trend_rest(spark, sf_dir):
    return models.trend_of(tables.panel(spark, sf_dir), "district_id", "active").select("district_id", "year", (F.round("rest", 4) + 0.0).alias("rest"))


REPORTED = "said AS (SELECT district_id, year, CAST(active % 3 AS INT) AS label, CAST(employed % 3 AS INT) AS predicted FROM panel)"
BY_CLASS = """classes AS (SELECT c AS class, coalesce(CAST(h AS DOUBLE) / nullif(p, 0), 0) AS precision, coalesce(CAST(h AS DOUBLE) / nullif(t, 0), 0) AS recall, coalesce(2.0 * h / nullif(t + p, 0), 0) AS f1, t AS support FROM
  (SELECT c, (SELECT count(*) FROM said WHERE label = c) AS t, (SELECT count(*) FROM said WHERE predicted = c) AS p, (SELECT count(*) FROM said WHERE label = c AND predicted = c) AS h FROM (SELECT unnest([0, 1, 2]) AS c)) WHERE t + p > 0)"""


def _said(spark, sf_dir):
    return tables.panel(spark, sf_dir).select("district_id", "year", (F.col("active") % 3).cast("int").alias("label"), (F.col("employed") % 3).cast("int").alias("predicted"))


@query(PANEL, REPORTED, BY_CLASS, sql=" SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM classes")
def class_report(spark, sf_dir):
    rows = models.classification_report(_said(spark, sf_dir))
    return rows.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(PANEL, REPORTED, BY_CLASS, sql=""" SELECT 'macro' AS average, round(avg(precision), 9) AS precision, round(avg(f1), 9) AS f1, CAST(sum(support) AS BIGINT) AS support FROM classes
  UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT) FROM classes""")
def class_averages(spark, sf_dir):
    rows = models.report_averages(models.classification_report(_said(spark, sf_dir)))
    return rows.select("average", F.round("precision", 9).alias("precision"), F.round("f1", 9).alias("f1"), "support")


@query(PANEL, REPORTED, BY_CLASS, sql=" SELECT round(avg(f1), 9) AS macro_f1 FROM classes")
def macro_f1(spark, sf_dir):
    return models.macro_f1(_said(spark, sf_dir)).select(F.round("macro_f1", 9).alias("macro_f1"))


@query(PANEL, sql=" SELECT district_id, round(avg(rate), 9) AS mean, round(stddev_pop(rate), 9) AS std, count(*) AS n FROM panel GROUP BY 1")
def score_spread(spark, sf_dir):
    rows = models.score_summary(tables.panel(spark, sf_dir), "rate", "district_id")
    return rows.select("district_id", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "n")


@query(PANEL, sql=" SELECT c AS label, count(*) AS n, max(n) - min(n) <= 1 AS even FROM (SELECT CAST(active % 3 AS INT) AS c FROM panel), (SELECT 1 AS n) GROUP BY 1")
def even_folds(spark, sf_dir):
    dealt = models.folds(_said(spark, sf_dir), "label")
    counts = dealt.groupBy("label", "fold").agg(F.count("*").alias("k")).groupBy("label").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.min("k").alias("least"), F.count("*").alias("folds"))
    return counts.select("label", "n", ((F.col("most") - F.col("least") <= 1) & ((F.col("folds") == 5) | (F.col("n") < 5))).alias("even"))


@query(PANEL, sql=" SELECT district_id, CAST(year AS INT) AS year, CAST(active AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS upper, false AS future FROM panel UNION ALL SELECT district_id, CAST(year + 7 AS INT), active * 2.0, active * 3.0, true FROM panel")
def history_and_future(spark, sf_dir):
    rows = tables.panel(spark, sf_dir)
    ahead = rows.select("district_id", (F.col("year") + 7).alias("year"), (F.col("active") * 2.0).alias("yhat"), F.lit(0.0).alias("lower"), (F.col("active") * 3.0).alias("upper"))
    return models.with_future(rows, ahead, "district_id", "active").select("district_id", "year", "value", "upper", "future")


QUARTERS = """q AS (SELECT o_orderpriority AS k, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS pos, quarter(o_orderdate) AS quarter, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY ALL),
fit AS (SELECT k, regr_slope(y, pos) AS b, regr_intercept(y, pos) AS a, max(pos) AS last FROM q GROUP BY 1 HAVING count(*) >= 8),
season AS (SELECT k, quarter, avg(y / (a + b * pos)) AS s FROM q JOIN fit USING (k) GROUP BY ALL)"""


@query(QUARTERS, sql=""" SELECT k AS o_orderpriority, CAST(pos // 4 AS INT) AS year, CAST(pos % 4 + 1 AS INT) AS quarter, round((a + b * pos) * s, 3) AS yhat
  FROM (SELECT *, unnest(range(last + 1, last + 13)) AS pos FROM fit) f JOIN season USING (k) WHERE season.quarter = pos % 4 + 1""")
def quarters_ahead(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    rows = o.groupBy("o_orderpriority", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").alias("n"))
    return models.quarterly_forecast(rows, "o_orderpriority", "n").withColumn("yhat", F.round("yhat", 3))


def _wide(spark, sf_dir):
    q = tables.read(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("year"))
    sums = q.agg(F.count("*").alias("export"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("investment"), F.count_if(F.col("o_orderstatus") == "P").alias("services"))
    return sums.select("*", (F.col("export") * 2).alias("macro"), (F.col("export") + 1).alias("other"))


@query(sql="""WITH macro AS (SELECT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INT) AS year, ln(2.0 * count(*)) AS z FROM orders GROUP BY 1),
line AS (SELECT regr_slope(z, year) AS b, regr_intercept(z, year) AS a, count(*) AS n, avg(year) AS middle, regr_sxx(z, year) AS sxx, sqrt((regr_syy(z, year) - regr_slope(z, year) * regr_sxy(z, year)) / (count(*) - 2)) AS spread, max(year) AS last FROM macro),
steps AS (SELECT *, CAST(last + s AS INT) AS year, 1.645 * spread * sqrt(1 + 1.0 / n + pow(last + s - middle, 2) / sxx) AS width FROM line, (SELECT unnest([1, 2, 3]) AS s))
SELECT i AS indicator, year, m AS model, CASE WHEN m = 'line' THEN round(exp(a + b * year), 3) END AS yhat, CASE WHEN m = 'line' THEN round(exp(a + b * year - width), 3) END AS lower, CASE WHEN m = 'line' THEN round(exp(a + b * year + width), 3) END AS upper
  FROM steps, (VALUES ('export', 'recurrent'), ('investment', 'recurrent'), ('services', 'ensemble'), ('macro', 'line'), ('other', 'changepoints')) t(i, m)""")
def forecasts_of_all(spark, sf_dir):
    # the figures that SQL can give are compared; those of trained models are compared with single fits in the tests
    rows = forecasting.forecast(cut(_wide(spark, sf_dir)), steps=3, drivers=forecasting.DRIVERS | {"macro": ("line", ())})
    figure = lambda c: F.when(F.col("model") == "line", F.round(c, 3)).alias(c)
    return rows.select("indicator", "year", "model", *map(figure, ("yhat", "lower", "upper")))


@query()
def forecast_figures(spark, sf_dir):
    return forecasting.forecast(cut(_wide(spark, sf_dir)), steps=3)


#: Urgent orders of a nation and year as unemployment: rates on both sides of 6 and 9.
URGENT = """urgent AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS district_id, CAST(year(o_orderdate) AS INT) AS year, count(*) AS active,
    CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS DOUBLE) / count(*) * 37.5 AS rate
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
judged AS (SELECT *, CASE WHEN rate < 6 THEN 0 WHEN rate < 9 THEN 1 ELSE 2 END AS label FROM (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY year) AS nth FROM urgent) WHERE nth > 1)"""


def _urgent(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("year"))
    c = tables.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("district_id"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("district_id", "year").agg(F.count("*").alias("active"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("unemployed"))
    return rows.withColumn("employed", F.col("active") - F.col("unemployed")).withColumn("rate", F.col("unemployed").cast("double") / F.col("active") * 37.5)


def _warnings(spark, sf_dir):
    ready = cut(panel.features(_urgent(spark, sf_dir)))
    model = models.boosted_warning(ready, 10, rate=0.5, depth=3, subsample=1.0, colsample=1.0, bins=256)
    return models.warned(model, ready)


@query(URGENT, sql=" SELECT district_id, year, round(rate, 9) AS rate, label, CAST(label AS INT) AS predicted, true AS right, true AS sums_to_one FROM judged")
def boosted_spots(spark, sf_dir):
    # the rate is among the features, so that trees that are grown well judge every row as the rule does
    rows = _warnings(spark, sf_dir).withColumn("sums_to_one", F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) < 1e-9)
    return rows.select("district_id", "year", F.round("rate", 9).alias("rate"), "label", "predicted", "right", "sums_to_one")


@query(URGENT, sql=" SELECT year, count(*) FILTER (WHERE label = 2) AS critical, count(*) AS districts FROM judged GROUP BY year")
def critical_districts(spark, sf_dir):
    return reports.critical_counts(_warnings(spark, sf_dir))


@query(PANEL, FORECASTS, sql=" SELECT district_id, year, round(sum(yhat / m) / sum(1 / m), 6) AS yhat, count(*) AS models FROM (SELECT *, CASE model WHEN 'a' THEN 10.0::DOUBLE ELSE 5.0 END AS m FROM forecasts WHERE model IN ('a', 'b')) GROUP BY ALL")
def weighted_forecasts(spark, sf_dir):
    rows = _forecasts(spark, sf_dir)
    errors = spark.createDataFrame([("a", 10.0), ("b", 5.0)], "model string, mape double")
    out = reports.weighted_forecast({m: rows.where(F.col("model") == m) for m in ("a", "b")}, errors, "district_id", "year")
    return out.withColumn("yhat", F.round("yhat", 6))


@query(PANEL, sql=" SELECT district_id AS indicator, CAST(max(year) AS INT) AS last_year, CAST(arg_max(active, year) AS DOUBLE) AS last_value, CAST(max(year) + 1 AS INT) AS forecast_year, CAST(arg_max(active, year) * 2 AS DOUBLE) AS forecast, CASE WHEN arg_max(active, year) > 0 THEN 100.0::DOUBLE END AS change FROM panel GROUP BY 1")
def forecast_summary(spark, sf_dir):
    history = tables.panel(spark, sf_dir).select(F.col("district_id").alias("indicator"), F.col("year").cast("int").alias("year"), F.col("active").cast("double").alias("value"))
    return models.summary_of(history.select("indicator", (F.col("year") + 1).alias("year"), (F.col("value") * 2).alias("yhat")), history)


@query(PLANS, sql=" SELECT status, count(*) FILTER (WHERE true) AS n FROM plans WHERE status <> 'unknown' GROUP BY 1")
def dashboard_statuses(spark, sf_dir):
    parts = reports.dashboard(tables.plans(spark, sf_dir))
    row = parts["statuses"]
    names = [c for c in row.columns if c in ("completed", "in_progress", "at_risk", "critical")]
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("status"), F.col(c).cast("long").alias("n")) for c in names])))


@query(PLANS, sql=""" SELECT module, round(CAST(sum(actual) AS DOUBLE) / count(actual), 6) AS fact FROM plans WHERE module IS NOT NULL GROUP BY 1""")
def annual_completion(spark, sf_dir):
    rows = reports.annual_report(tables.plans(spark, sf_dir).withColumn("year", F.lit(2026)), 2026)
    return rows.select("module", F.round("fact", 6).alias("fact"))


@query(sql=" SELECT 'good' AS stage, (SELECT count(*) FROM nation) AS n, false AS failed UNION ALL SELECT 'bad', NULL, true")
def isolated_stages(spark, sf_dir):
    nation = tables.read(spark, sf_dir, "nation")
    done, failed = reports.run_isolated({"good": lambda: nation, "bad": lambda: nation.select("no_such_column")})
    rows = [(name, df.count(), False) for name, df in done.items()] + [(name, None, True) for name in failed]
    return spark.createDataFrame(rows, "stage string, n long, failed boolean")


@query(OBSERVATIONS, series_sql(False), MACRO_SQL, sql=""" , x AS (SELECT m.*, b.value AS base, w.value AS whole FROM macro m LEFT JOIN macro b ON b.indicator = m.indicator AND b.year = m.year - 1 LEFT JOIN macro w ON w.indicator = 'JAO' AND w.year = m.year)
SELECT indicator, year, indicator || ' ' || year || '?' AS human, indicator || ' ' || year || ': ' || printf('%.1f', value) || CASE WHEN indicator = 'Eksport' THEN ' mln.$' ELSE ' mlrd.som' END AS gpt FROM x
UNION ALL SELECT indicator, year, indicator || ' ' || year || ' ósim?', printf('%.1f', (value - base) / abs(base) * 100) || '%' FROM x WHERE base IS NOT NULL
UNION ALL SELECT indicator, year, indicator || ' ' || year || ' úlesi?', printf('%.1f', value / whole * 100) || '%' FROM x WHERE indicator <> 'JAO' AND whole IS NOT NULL""")
def training_texts(spark, sf_dir):
    return retrieval.training_pairs(_macro(spark, sf_dir))


# --- texts and numbers ----------------------------------------------------------------------------------


@query(sql=f" SELECT c_custkey, {_amount('v')} AS amount, printf('%+.1f%%', CAST(v AS DOUBLE)) AS signed, printf('%.1f', CAST(v AS DOUBLE)) AS fixed, printf('%.1f', CAST(v AS DOUBLE)) || '%' AS percent FROM (SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) * 37 + 0.25::DECIMAL(3,2) * 2 AS v FROM customer)")
def number_texts(spark, sf_dir):
    v = ((F.col("c_acctbal").cast("long") * 37) + F.lit(0.5).cast("decimal(3,2)")).cast("decimal(20,2)")
    return tables.read(spark, sf_dir, "customer").select(
        "c_custkey", numbers.amount(v).alias("amount"), numbers.signed_percent(v).alias("signed"), numbers.fixed(v).alias("fixed"), numbers.percent_text(v).alias("percent")
    )


@query(sql=f" SELECT c_custkey, CASE WHEN v IS NULL THEN '—' ELSE replace(replace({_amount('v')}, '.', ','), '-', '−') END AS local FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN CAST(trunc(c_acctbal) AS BIGINT) * 37 + 0.5::DECIMAL(3,2) END AS v FROM customer)")
def local_numbers(spark, sf_dir):
    v = F.when(F.col("c_custkey") % 10 != 0, ((F.col("c_acctbal").cast("long") * 37) + F.lit(0.5).cast("decimal(3,2)")).cast("decimal(20,2)"))
    return tables.read(spark, sf_dir, "customer").select("c_custkey", numbers.local_number(v).alias("local"))


@query(sql=""" SELECT c_custkey, CASE WHEN abs(v) >= 1000000 THEN (CASE WHEN v < 0 THEN '-' ELSE '' END) || (abs(v) // 1000000) || ' mln' WHEN abs(v) >= 1000 THEN (CASE WHEN v < 0 THEN '-' ELSE '' END) || (abs(v) // 1000) || ' ming' ELSE CAST(v AS VARCHAR) END AS said
  FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN (c_custkey % 900 + 1) * 1000000 WHEN 1 THEN -(c_custkey % 900 + 1) * 1000 ELSE c_custkey % 1000 END AS v FROM customer)""")
def compact_texts(spark, sf_dir):
    k = F.col("c_custkey")
    v = F.when(k % 3 == 0, (k % 900 + 1) * 1000000).when(k % 3 == 1, -(k % 900 + 1) * 1000).otherwise(k % 1000)
    return tables.read(spark, sf_dir, "customer").select(k, numbers.compact(v).alias("said"))


@query(sql=" SELECT o_orderkey, md5(o_orderpriority || chr(31) || o_custkey || chr(31)) AS key FROM orders")
def request_keys(spark, sf_dir):
    return tables.read(spark, sf_dir, "orders").select("o_orderkey", text.cache_key(F.col("o_orderpriority"), F.col("o_custkey"), F.lit(None)).alias("key"))


@query(sql=" SELECT n_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS name, CASE WHEN n_nationkey % 4 > 0 THEN n_regionkey END AS region FROM nation")
def structured_answers(spark, sf_dir):
    n = tables.read(spark, sf_dir, "nation")
    said = F.when(F.col("n_nationkey") % 4 > 0, F.concat(F.lit("So:\n```"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))), F.lit("``` ok"))).otherwise("no {answer here")
    read = n.select("n_nationkey", text.structured(said, "name string, region long").alias("a"))
    return read.select("n_nationkey", F.col("a.name").alias("name"), F.col("a.region").cast("int").alias("region"))


@query(sql=" SELECT conv_id, turn, CASE " + " ".join(f"WHEN contains(lower(text), '{r}') THEN '{r}'" for r in ("asia", "the", "a")) + " END AS region FROM conversations")
def first_regions(spark, sf_dir):
    return tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", text.first_named(F.col("text"), ["asia", "the", "a"]).alias("region"))


@query(sql=r" SELECT conv_id, turn, left(trim(regexp_replace(regexp_replace(regexp_replace('**' || text || '** `x` [a](b)', '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '[*_`#>|]+', ' ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')), 1000) AS said FROM conversations")
def speakable_texts(spark, sf_dir):
    said = F.concat(F.lit("**"), "text", F.lit("** `x` [a](b)"))
    return tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", text.speakable(said).alias("said"))


@query(sql=" SELECT o_orderkey, make_date(CAST(year(o_orderdate) AS INT), 6, 15) AS day FROM orders")
def year_middles(spark, sf_dir):
    return tables.read(spark, sf_dir, "orders").select("o_orderkey", period.year_middle(F.year("o_orderdate")).alias("day"))


@query(sql=" SELECT n_name AS name, CASE WHEN n_nationkey % 4 IN (0, 1, 2) THEN 'mln.$' ELSE 'mlrd.som' END AS unit FROM nation")
def units_of(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, ("Eksport", "Import", "Saldo", "JAO"))), (F.col("n_nationkey") % 4).cast("int"))
    return tables.read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), retrieval.unit_of(name).alias("unit"))


@query(sql=" SELECT c_custkey, ln(1 + abs(c_acctbal)) AS up, CAST(abs(c_acctbal) AS DOUBLE) AS down FROM customer".replace("ln(1 + abs(c_acctbal))", "round(ln(1 + CAST(abs(c_acctbal) AS DOUBLE)), 9)").replace("CAST(abs(c_acctbal) AS DOUBLE) AS down", "round(CAST(abs(c_acctbal) AS DOUBLE), 6) AS down"))
def log_scale(spark, sf_dir):
    up = numbers.scaled_log(F.abs("c_acctbal"))
    return tables.read(spark, sf_dir, "customer").select("c_custkey", F.round(up, 9).alias("up"), F.round(numbers.unscaled_log(up), 6).alias("down"))


@query(sql=" SELECT p_partkey, regexp_replace(lower(p_name || '|' || p_brand), '[^a-z0-9]+', '-', 'g') AS slug FROM part")
def slug_words(spark, sf_dir):
    whole = text.slug(F.concat_ws("|", "p_name", "p_brand"))
    return tables.read(spark, sf_dir, "part").select("p_partkey", F.regexp_replace(whole, "-[0-9a-f]{8}$", "").alias("slug"))


@query(sql=f" SELECT c_custkey, {_ramp_sql('r', colour.PERFORMANCE_COLOURS)} AS fill FROM (SELECT c_custkey, 0.6 + (c_custkey % 64) / 100.0::DOUBLE AS r FROM customer)")
def performance_scale(spark, sf_dir):
    return tables.read(spark, sf_dir, "customer").select("c_custkey", colour.performance(F.lit(0.6) + (F.col("c_custkey") % 64) / 100.0).alias("fill"))


@query(sql=" SELECT n_nationkey, CASE WHEN r < 0.5 THEN '#f07178' WHEN r > 2 THEN '#6da7ec' END AS ends FROM (SELECT n_nationkey, n_nationkey % 4 - 0.4 AS r FROM nation) WHERE r < 0.5 OR r > 2")
def performance_ends(spark, sf_dir):
    r = F.col("n_nationkey") % 4 - 0.4
    return tables.read(spark, sf_dir, "nation").where((r < 0.5) | (r > 2)).select("n_nationkey", colour.performance(r).alias("ends"))


@query(OBSERVATIONS, layer_sql(YEAR), SEGS, sql=" SELECT district_id, module, share FROM (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY share DESC, module) AS n FROM layer JOIN segs ON id = indicator_id WHERE share IS NOT NULL) WHERE n <= 4")
def top_modules(spark, sf_dir):
    rows = _layer(spark, sf_dir).join(segments(spark).select(F.col("id").alias("indicator_id"), "module"), "indicator_id")
    return map_layer.largest_shares(rows, 4).select("district_id", "module", "share")


@query(OBSERVATIONS, layer_sql(YEAR), sql=" SELECT indicator_id, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM layer GROUP BY 1")
def layer_pages(spark, sf_dir):
    return catalog.page_counts(_layer(spark, sf_dir), 10, "indicator_id")


@query(PLANS, sql=" SELECT id FROM plans WHERE module = 'BUILDING' AND status = 'critical' AND region = '3'")
def filtered_plans(spark, sf_dir):
    return plan_actual.plan_rows(tables.plans(spark, sf_dir), module="BUILDING", status="critical", region="3").select("id")


@query(TASKS, sql=" SELECT id, progress, status FROM tasks WHERE module = '1-URGENT'")
def urgent_tasks(spark, sf_dir):
    return tasks.task_list(tables.tasks(spark, sf_dir), module="1-URGENT").select("id", "progress", "status")


@query(OBSERVATIONS, series_sql(False), sql=" SELECT 'a' AS part, year, value FROM points WHERE indicator_id = 'BUILDING' UNION ALL SELECT 'b', year, value FROM points WHERE indicator_id = 'MACHINERY'")
def combined_forecasts(spark, sf_dir):
    rows = series.national_series(tables.observations(spark, sf_dir))
    return retrieval.combined({"a": rows.where("indicator_id = 'BUILDING'"), "b": rows.where("indicator_id = 'MACHINERY'")})


# --- training pairs, windows, small changes ----------------------------------------------------------

MORE_MACRO = "macro2 AS (SELECT CASE indicator_id WHEN 'BUILDING' THEN 'JAO' WHEN 'MACHINERY' THEN 'Eksport' WHEN 'HOUSEHOLD' THEN 'Import' ELSE 'Sanaat' END AS indicator, year, value FROM points WHERE indicator_id <> 'AUTOMOBILE')"


@query(OBSERVATIONS, series_sql(False), MORE_MACRO, PANEL, sql=""" , l AS (SELECT *, lag(value) OVER (PARTITION BY indicator ORDER BY year) AS before, row_number() OVER (PARTITION BY indicator ORDER BY year DESC) AS back FROM macro2),
e AS (SELECT indicator, min(year) AS a, max(year) AS b, arg_min(value, year) AS va, arg_max(value, year) AS vb, arg_max(year, struct_pack(v := value, y := -year)) AS top, arg_min(year, struct_pack(v := value, y := year)) AS low FROM macro2 GROUP BY 1 HAVING min(year) < max(year))
SELECT 'change' AS kind, indicator || ' ' || a || '–' || b || '?' AS human, printf('%.1f', va) || ' → ' || printf('%.1f', vb) || ' (' || printf('%.1f', vb / va) || ' ese)' AS gpt FROM e
UNION ALL SELECT 'extremes', indicator || ' eń joqarı?', top || ', ' || low FROM e
UNION ALL SELECT 'mean_growth', indicator || ' ortasha ósim?', printf('%.1f', avg((value - before) / abs(before) * 100)) || '%' FROM l WHERE back <= 3 GROUP BY indicator HAVING count(before) > 0
UNION ALL SELECT 'trade', 'Saldo ' || x.year || '?', printf('%.1f', x.value - m.value) || CASE WHEN x.value > m.value THEN ' artıqsha' ELSE ' kemshilik' END FROM macro2 x JOIN macro2 m ON m.indicator = 'Import' AND m.year = x.year WHERE x.indicator = 'Eksport'
UNION ALL SELECT 'largest', year || ' eń úlken?', arg_max(indicator, struct_pack(v := value, i := indicator)) FROM macro2 GROUP BY year
UNION ALL SELECT 'rate', district_id || ' ' || year || ' jumıssızlıq?', printf('%.1f', rate) || '%, ' || active FROM panel
UNION ALL SELECT 'districts', year || ' eń jaqsı rayon?', arg_min(district_id, struct_pack(r := rate, d := district_id)) || ', ' || arg_max(district_id, struct_pack(r := rate, d := district_id)) FROM panel GROUP BY year""")
def generated_pairs(spark, sf_dir):
    names = F.create_map(*[F.lit(x) for pair in (("BUILDING", "JAO"), ("MACHINERY", "Eksport"), ("HOUSEHOLD", "Import"), ("FURNITURE", "Sanaat")) for x in pair])
    rows = series.national_series(tables.observations(spark, sf_dir)).where("indicator_id <> 'AUTOMOBILE'")
    macro = cut(rows.select(F.try_element_at(names, F.col("indicator_id")).alias("indicator"), "year", "value"))
    return retrieval.generated(macro, tables.panel(spark, sf_dir)).where("kind not in ('value', 'growth', 'share')")  # those are training_texts


@query(PANEL, sql=""" SELECT district_id, year, w1 || ',' || w2 AS steps, target FROM (SELECT district_id, year, lag(active, 2) OVER w || ':' || lag(employed, 2) OVER w AS w1, lag(active) OVER w || ':' || lag(employed) OVER w AS w2, unemployed AS target
  FROM panel WINDOW w AS (PARTITION BY district_id ORDER BY year)) WHERE w1 IS NOT NULL""")
def joint_windows(spark, sf_dir):
    rows = panel.joint_windows(tables.panel(spark, sf_dir), "district_id", ["active", "employed"], "unemployed", 2)
    steps = F.array_join(F.transform("window", lambda x: F.concat_ws(":", F.transform(x, lambda v: v.cast("long").cast("string")))), ",")
    return rows.select("district_id", "year", steps.alias("steps"), "target")


@query(TASKS, sql=" SELECT id FROM tasks WHERE id NOT IN (1, 2, 3)")
def deleted_tasks(spark, sf_dir):
    return load.without(tables.tasks(spark, sf_dir), "id", 1, 2, 3).select("id")


@query(TASKS, sql=" SELECT count(*) AS n, (SELECT count(*) FROM nation) AS seeded FROM tasks")
def tasks_or_seeds(spark, sf_dir):
    templates = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("title"), F.lit("sanaat").alias("module"))
    some, none = tables.tasks(spark, sf_dir).select("id", "progress"), tables.tasks(spark, sf_dir).select("id", "progress").where("false")
    seed = lambda df: tasks.seeded_if_empty(df, spark, tables.districts(spark, sf_dir), templates).agg(F.count("*").alias("n"))
    return seed(some).crossJoin(seed(none).withColumnRenamed("n", "seeded"))  # one row each


@query(OBSERVATIONS, sql=" SELECT string_agg(district_id || ' | ' || name, chr(10) ORDER BY district_id) AS text FROM districts")
def district_catalogue(spark, sf_dir):
    return reference.district_text(tables.districts(spark, sf_dir))


ASKED_OF = ["jao 1999", "eksport hám sanaat 2012", "jumıssızlıq 2000", "ishsizlik", "maosh, gdp 2000-jıl", "qalay"]
ASKING = f"""asking AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, coalesce(text, '') || ' ' || CASE WHEN conv_id % 3 = 0 THEN lower(n_name) || ' ' ELSE '' END || {ASKED_OF}[conv_id % 6 + 1] AS prompt
  FROM conversations JOIN nation ON n_nationkey = conv_id % 25 WHERE role = 'user')"""
PAID = "paid AS (SELECT year, quarter, y, row_number() OVER (ORDER BY year DESC, quarter DESC) AS back FROM (SELECT year(o_orderdate) AS year, quarter(o_orderdate) AS quarter, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS y FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL))"
CONTEXTS = rf"""hits AS (SELECT DISTINCT id, indicator FROM asking JOIN topics ON contains(lower(prompt), word)),
each AS (SELECT s.id, coalesce(h.indicator, 'JAO') AS topic, TRY_CAST(regexp_extract_all(prompt, '20[12][0-9]')[-1] AS INT) AS asked FROM asking s LEFT JOIN hits h ON h.id = s.id),
years AS (SELECT DISTINCT id, asked FROM each),
vals AS (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY year DESC) AS back FROM macro),
met AS (SELECT e.id, topic, year, value, back, coalesce(year = asked, false) AS hit, max(CASE WHEN year = asked THEN 1 ELSE 0 END) OVER (PARTITION BY e.id, topic) AS there FROM each e JOIN vals v ON v.indicator = topic),
labour AS (SELECT *, max(year) OVER (PARTITION BY district_id) AS latest FROM panel),
people AS (SELECT e.id, l.* FROM each e LEFT JOIN named n ON n.id = e.id JOIN labour l ON l.district_id = coalesce(n.district_id, '0') AND l.year = coalesce(asked, latest) WHERE topic = 'Jumıssızlıq'),
context AS (
  SELECT id, 'macro' AS section, topic, CASE WHEN there = 1 THEN 'value' ELSE 'series' END AS item, CAST(year AS VARCHAR) AS at_, round(CAST(value AS DOUBLE), 2) AS value FROM met WHERE CASE WHEN there = 1 THEN hit ELSE back <= 4 END
  UNION ALL SELECT id, 'labour', 'Jumıssızlıq', i, district_id || ' ' || CAST(year AS VARCHAR), CASE i WHEN 'active' THEN round(CAST(active AS DOUBLE), 1) WHEN 'employed' THEN round(CAST(employed AS DOUBLE), 1) WHEN 'unemployed' THEN round(CAST(unemployed AS DOUBLE), 1) ELSE round(rate, 2) END
    FROM people, (SELECT unnest(['active', 'employed', 'unemployed', 'rate']) AS i)
  UNION ALL SELECT y.id, 'districts', 'Jumıssızlıq', p.district_id, CAST(p.year AS VARCHAR), round(rate, 2) FROM years y JOIN named n ON n.id = y.id JOIN panel p ON p.year = coalesce(asked, (SELECT max(year) FROM panel))
  UNION ALL SELECT id, 'wages', 'IsHaqı', '1-URGENT', CAST(year AS VARCHAR) || 'Q' || CAST(quarter AS VARCHAR), round(y / 1000, 0) FROM each, paid WHERE topic = 'IsHaqı' AND back <= 4)"""


def _asking(spark, sf_dir):
    c = tables.read(spark, sf_dir, "conversations").where("role = 'user'")
    n = tables.read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    where = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lower("n_name"), F.lit(" "))).otherwise("")
    what = F.get(F.array(*map(F.lit, ASKED_OF)), (F.col("conv_id") % 6).cast("int"))
    rows = c.join(n, F.col("conv_id") % 25 == F.col("n_nationkey"))
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), where, what).alias("prompt"))


def _contexts(spark, sf_dir, asking):
    o = tables.read(spark, sf_dir, "orders")
    wages = o.groupBy(F.col("o_orderpriority").alias("branch"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return retrieval.contexts(asking, _macro(spark, sf_dir), tables.panel(spark, sf_dir), wages, tables.districts(spark, sf_dir), "0", "1-URGENT")


@query(OBSERVATIONS, series_sql(False), MACRO_SQL, PANEL, TOPICS, ASKING, parsed_sql("asking"), PAID, CONTEXTS, sql=" SELECT id, section, topic, item, at_ AS at, value FROM context")
def question_figures(spark, sf_dir):
    return _contexts(spark, sf_dir, _asking(spark, sf_dir))


@query(OBSERVATIONS, series_sql(False), MACRO_SQL, PANEL, TOPICS, ASKING, parsed_sql("asking"), PAID, CONTEXTS, sql=""" , kept AS (
  SELECT *, CASE section WHEN 'macro' THEN 1 WHEN 'labour' THEN 2 WHEN 'districts' THEN 3 ELSE 4 END AS sec, CASE WHEN section = 'districts' THEN row_number() OVER (PARTITION BY id, section ORDER BY value DESC, item) ELSE 0 END AS worst,
    row_number() OVER (PARTITION BY id, section, topic ORDER BY at_ DESC) AS newest FROM context),
lines AS (SELECT id, string_agg('- ' || topic || CASE WHEN section IN ('labour', 'districts') THEN ' ' || item ELSE '' END || ' (' || at_ || '): ' || printf('%.1f', value) || ' ' ||
    CASE WHEN section = 'macro' THEN CASE WHEN topic IN ('Eksport', 'Import', 'Saldo') THEN 'mln.$' ELSE 'mlrd.som' END WHEN section = 'wages' THEN 'mıń som' WHEN section = 'labour' AND item <> 'rate' THEN 'mıń' ELSE '%' END,
    chr(10) ORDER BY sec, topic, worst, at_, item) AS body FROM kept WHERE CASE WHEN section = 'districts' THEN worst <= 3 WHEN item = 'series' THEN newest <= 3 ELSE true END GROUP BY id)
SELECT a.id, '=== Maǵlıwmatlar ===' || chr(10) || coalesce(body, 'Maǵlıwmat tabılmadı.') || chr(10) || chr(10) || '=== Soraw ===' || chr(10) || prompt AS prompt,
  '## Statistika' || chr(10) || coalesce(body, 'Maǵlıwmat tabılmadı.') || chr(10) || chr(10) || '## Juwmaq' || chr(10) || CASE WHEN body IS NULL THEN 'Sorawdı anıqlań.' ELSE 'Sanlar bazadan alındı.' END AS answer FROM asking a LEFT JOIN lines l ON l.id = a.id""")
def template_answers(spark, sf_dir):
    asking = cut(_asking(spark, sf_dir))
    return retrieval.told(asking, _contexts(spark, sf_dir, asking))


@query(OBSERVATIONS, layer_sql(YEAR), sql=f" SELECT 'Answer:' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS prompt FROM (SELECT concat_ws(' | ', indicator_id, name, {_amount('value')}, {_pct('yoy')}) AS line FROM layer WHERE value IS NOT NULL AND indicator_id = 'BUILDING')")
def prompt_of_lines(spark, sf_dir):
    lines = questions.context(tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), YEAR).where("indicator_id = 'BUILDING'")
    return retrieval.prompt_text("Answer:", lines)


# --- as presented --------------------------------------------------------------------------------


@query(OBSERVATIONS, layer_sql(YEAR), sql=" SELECT indicator_id, district_id, round(value, 2) AS value, round(total, 2) AS total, round(share, 2) AS share, round(yoy, 2) AS yoy, round(intensity, 4) AS intensity FROM layer")
def shown_layer(spark, sf_dir):
    return map_layer.shown(_layer(spark, sf_dir)).select("indicator_id", "district_id", "value", "total", "share", "yoy", "intensity")


@query(sql=" SELECT p_name AS human, CASE WHEN p_size % 2 = 0 THEN '<|im_start|>system' || chr(10) || 'be brief<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>user' || chr(10) || p_name || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || p_brand || '<|im_end|>' || chr(10) AS text FROM part")
def chat_texts(spark, sf_dir):
    path = scratch(spark, "pairs")
    pairs = tables.read(spark, sf_dir, "part").select("p_size", F.col("p_name").alias("human"), F.col("p_brand").alias("gpt"))
    even = F.col("p_size") % 2 == 0
    files.write_json(files.sharegpt(pairs.where(even), "be brief").unionByName(files.sharegpt(pairs.where(~even), "")), path)
    return files.chat_text(files.dialogues(spark, path, lines=True)).select("human", "text")


@query(PLANS, sql=""" , done AS (SELECT module, avg(CAST(planned AS DOUBLE)) AS plan, avg(CAST(actual AS DOUBLE)) AS fact FROM plans WHERE module IS NOT NULL GROUP BY 1 HAVING count(planned) > 0 AND count(actual) > 0)
SELECT 2026 AS year, string_agg(concat_ws(' | ', module, printf('%.1f', plan), printf('%.1f', fact), CASE WHEN fact / plan >= 0.95 THEN 'completed' WHEN fact / plan >= 0.8 THEN 'in_progress' WHEN fact / plan >= 0.6 THEN 'at_risk' ELSE 'critical' END), chr(10) ORDER BY module) AS text FROM done
UNION ALL SELECT 2031, '2031-jıl ushın maǵlıwmat joq.'""")
def annual_texts(spark, sf_dir):
    return reports.annual_text(tables.plans(spark, sf_dir).withColumn("year", F.lit(2026)), [2026, 2031])


@query(sql="""WITH long AS (SELECT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS INT) AS year, count(*) AS export, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS investment FROM orders GROUP BY 1),
pair AS (SELECT 'export' AS indicator, year, ln(CAST(export AS DOUBLE)) AS z FROM long UNION ALL SELECT 'investment', year, ln(CAST(investment AS DOUBLE)) FROM long WHERE (SELECT min(investment) FROM long) > 0),
line AS (SELECT indicator, regr_slope(z, year) AS b, regr_intercept(z, year) AS a, max(year) AS last FROM pair GROUP BY 1)
SELECT indicator, CAST(last + s AS INT) AS year, round(exp(a + b * (last + s)), 3) AS yhat FROM line, (SELECT unnest([1, 2]) AS s)""")
def dashboard_forecasts(spark, sf_dir):
    wide = cut(_wide(spark, sf_dir)).select("year", "export", "investment")
    parts = reports.dashboard(tables.plans(spark, sf_dir), wide=wide, steps=2, drivers={"export": ("line", ()), "investment": ("line", ())})
    return parts["forecasts"].select("indicator", "year", F.round("yhat", 3).alias("yhat"))


@query(PLANS, sql=""" SELECT module, region, round(coalesce(fact / nullif(plan, 0), 0) * 100, 6) AS completion FROM (SELECT module, region, avg(CAST(planned AS DOUBLE)) AS plan, avg(CAST(actual AS DOUBLE)) AS fact FROM plans
  WHERE module IS NOT NULL AND region IS NOT NULL GROUP BY ALL HAVING count(planned) > 0 AND count(actual) > 0) WHERE coalesce(fact / nullif(plan, 0), 0) < 0.8 ORDER BY coalesce(fact / nullif(plan, 0), 0), module, region LIMIT 10""")
def dashboard_critical(spark, sf_dir):
    return reports.dashboard(tables.plans(spark, sf_dir))["critical"].select("module", "region", F.round("completion", 6).alias("completion"))


@query(FACTS, sql=" SELECT year + 8 AS year, 'Eksport' AS indicator, sum(value) AS value FROM facts WHERE year % 2 = 0 GROUP BY 1")
def macro_sheet_filled(spark, sf_dir):
    y = cut(_years_of(_facts(spark, sf_dir)).withColumn("year", F.col("year") + 8))
    at = F.col("year") - 2000
    known = F.when(F.col("year") % 2 == 0, F.col("value")).otherwise(0.0)
    return domain.macro_filled(_sheet(_table(y, 2, at, F.concat(F.col("year").cast("string"), F.lit(" j."))), _table(y, 4, 0, "Eksport, jámi"), _table(y, 4, 1, "mln. AQSH dolları"), _table(y, 4, at, 0), _table(y, 5, 1, "mln. AQSH dolları"), _table(y, 5, at, known)))


LABOUR_ROWS = f"names AS (SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{k.replace(chr(39), chr(39) * 2)}{chr(39)}, {chr(39)}{v}{chr(39)})' for i, (k, v) in enumerate(LABOUR_DISTRICTS.items()))}) t(num, said, id))"


@query(FACTS, LABOUR_ROWS, sql=" SELECT id AS district_id, year + 14 AS year, sum(value) + num AS active, sum(value) AS employed, CAST(num AS DOUBLE) AS unemployed, 5.5::DOUBLE AS rate FROM facts, names WHERE num % 3 <> 2 GROUP BY year, id, num")
def labour_by_district(spark, sf_dir):
    y = cut(_years_of(_facts(spark, sf_dir)).withColumn("year", F.col("year") + 14))
    at = (F.col("year") - 2016) * 4 + 1
    parts = [_table(y, 2, at, F.concat(F.col("year").cast("string"), F.lit("-j.")))]
    for i, said in enumerate(LABOUR_DISTRICTS):
        parts.append(_table(y, 6 + i, 0, said))
        figures = (F.col("value") + i, F.col("value"), i, 5.5)
        parts += [_table(y, 6 + i, at + j, v) for j, v in enumerate(figures) if not (i % 3 == 2 and j == 2)]  # every third has a gap
    return domain.labour(_sheet(*parts))


@query()
def feature_shares(spark, sf_dir):
    ready = cut(panel.features(_urgent(spark, sf_dir)))
    model = models.boosted_warning(ready, 6, rate=0.5, depth=3)
    return spark.createDataFrame([(i + 1, n, s) for i, (n, s) in enumerate(models.top_importances(model))], "place int, feature string, share double")


@query()
def weak_spot_list(spark, sf_dir):
    fit = lambda rows: models.boosted_warning(rows, 6, rate=0.5, depth=3)
    return reports.weak_spots(_urgent(spark, sf_dir), fit=fit)


@query()
def quarterly_forecasts(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    rows = o.groupBy("o_orderpriority", F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(F.count("*").alias("n"))
    return changepoints.quarterly_forecast(rows, "o_orderpriority", "n")


@query(URGENT, sql=" SELECT district_id, year, CAST(label AS INT) AS predicted FROM judged")
def reloaded_spots(spark, sf_dir):
    ready = cut(panel.features(_urgent(spark, sf_dir)))
    path = scratch(spark, "model")
    models.save(models.boosted_warning(ready, 10, rate=0.5, depth=3, subsample=1.0, colsample=1.0, bins=256), path)
    return models.warned(boosting.Boosted.load(spark, path), ready).select("district_id", "year", "predicted")


@query(FACTS, sql=" SELECT 'AMERICA kólemi (mln. som) — ' || title AS indicator, 'mln. som' AS unit, year, sum(value) AS value FROM facts GROUP BY ALL")
def uploaded_records(spark, sf_dir):
    # a workbook of one sheet, sent as bytes: regions down, years across
    rows = _facts(spark, sf_dir).groupBy("title", "year").agg(F.sum("value").alias("value")).orderBy("title", "year").collect()
    titles = sorted({r["title"] for r in rows})
    cells = {(0, 0): "AMERICA kólemi (mln. som)"} | {(2, r["year"] - 2000): f"{r['year']}-jıl" for r in rows}
    cells |= {(3 + titles.index(r["title"]), 0): r["title"] for r in rows} | {(3 + titles.index(r["title"]), r["year"] - 2000): r["value"] for r in rows}
    found = grammar.upload(spark, workbook.packed([("s", cells)]), "02_Sanaat", "regions.xlsx", ["02_Sanaat"])
    return found.select("indicator", "unit", "year", "value")


@query(sql=""" SELECT c_mktsegment AS module, n_name AS region, 2000 + c_custkey % 30 AS year, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_acctbal AS DOUBLE) END AS kpi_actual, 'in_progress' AS status, '' AS error FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, 'region is empty; kpi_actual: junk' FROM customer WHERE c_custkey % 7 = 0""")
def bulk_rows(spark, sf_dir):
    path, k = scratch(spark, "bulk"), F.col("c_custkey")
    rows = tables.read(spark, sf_dir, "customer").join(tables.read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    actual = F.when(k % 7 == 0, "junk").when(k % 5 != 0, F.regexp_replace(F.col("c_acctbal").cast("decimal(18,2)").cast("string"), r"\.", ","))
    told = rows.select(F.col("c_mktsegment").alias("module"), F.when(k % 7 != 0, F.col("n_name")).alias("region"), (k % 30 + 2000).cast("string").alias("year"), actual.alias("kpi_actual"))
    told.write.option("header", True).csv(path)
    good, wrong = files.bulk_plans(spark, path)
    none = lambda kind: F.lit(None).cast(kind)
    return good.select("module", "region", "year", "kpi_actual", "status", F.lit("").alias("error")).unionByName(
        wrong.select(none("string").alias("module"), none("string").alias("region"), none("int").alias("year"), none("double").alias("kpi_actual"), none("string").alias("status"), "error"))


HELD = [1998, 1999]


@query(PANEL, sql=f""" , past AS (SELECT district_id, regr_slope(z, year) AS b, regr_intercept(z, year) AS a, count(*) AS n, avg(year) AS middle, regr_sxx(z, year) AS sxx, max(year) AS last,
    sqrt(greatest(0, regr_syy(z, year) - regr_slope(z, year) * regr_sxy(z, year)) / (count(*) - 2)) AS spread
  FROM (SELECT district_id, year, ln(CAST(active AS DOUBLE)) AS z FROM panel WHERE year < {HELD[0]}) GROUP BY 1 HAVING count(*) >= 3),
ahead AS (SELECT p.*, CAST(last + s AS INT) AS year, 1.645 * spread * sqrt(1 + 1.0 / n + pow(last + s - middle, 2) / sxx) AS width FROM past p, (SELECT unnest([1, 2]) AS s)),
met AS (SELECT h.district_id, CAST(active AS DOUBLE) AS actual, exp(a + b * h.year) AS yhat, exp(a + b * h.year - width) AS low, exp(a + b * h.year + width) AS high
  FROM ahead h JOIN panel p ON p.district_id = h.district_id AND p.year = h.year WHERE p.year IN ({HELD[0]}, {HELD[1]}))
SELECT district_id, count(*) AS n, round(avg(abs(actual - yhat)), 6) AS mae, round(avg(abs(actual - yhat) / actual) * 100, 6) AS mape, round(sqrt(avg((actual - yhat) * (actual - yhat))), 6) AS rmse FROM met GROUP BY 1""")
def holdout_measures(spark, sf_dir):
    rows = tables.panel(spark, sf_dir).where(F.col("year") <= HELD[-1])
    found = reports.holdout(rows, "district_id", "active", HELD)
    return found.select("district_id", "n", F.round("mae", 6).alias("mae"), F.round("mape", 6).alias("mape"), F.round("rmse", 6).alias("rmse"))


#: The sides of a right triangle by nation, and the grid point inside that is farthest from the sides.
TRIANGLES = """tri AS (SELECT n_nationkey AS id, CAST(n_nationkey % 5 AS DOUBLE) AS x, CAST(n_nationkey % 3 AS DOUBLE) AS y, CAST(n_nationkey % 4 + 3 AS DOUBLE) AS w, CAST(n_nationkey % 7 + 2 AS DOUBLE) AS h FROM nation),
grid AS (SELECT id, i, x, y, w, h, w * ((i % 49) + 0.5) / 49 AS u, h * (i // 49 + 0.5) / 49 AS v FROM tri, (SELECT unnest(range(2401)) AS i)),
inner_ AS (SELECT *, least(v, u, (w * h - h * u - w * v) / sqrt(w * w + h * h)) AS away FROM grid WHERE h * u + w * v < w * h)"""


@query(TRIANGLES, sql=" SELECT id, round(away, 9) AS away FROM (SELECT id, max(away) AS away FROM inner_ GROUP BY id)")
def label_triangles(spark, sf_dir):
    k = F.col("n_nationkey")
    x, y, w, h = (c.cast("double") for c in (k % 5, k % 3, k % 4 + 3, k % 7 + 2))
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    rows = tables.read(spark, sf_dir, "nation").select(k.alias("id"), F.array(point(x, y), point(x + w, y), point(x, y + h)).alias("ring"))
    return shapes.label_points(rows, "id").select("id", F.round("away", 9).alias("away"))


@query(sql="""WITH boxes AS (SELECT n_nationkey AS id, n_nationkey % 5 AS x, n_nationkey % 3 AS y, n_nationkey % 4 + 3 AS w, n_nationkey % 4 + 3 AS h FROM nation)
SELECT 'export const SHAPES = [' || chr(10) || string_agg('  { id: "' || id || '", labelX: ' || printf('%.1f', x + w / 2.0) || ', labelY: ' || printf('%.1f', y + h / 2.0) || ', bbox: [' || printf('%.1f', CAST(x AS DOUBLE)) || ', ' || printf('%.1f', CAST(y AS DOUBLE)) || ', ' || printf('%.1f', CAST(x + w AS DOUBLE)) || ', ' || printf('%.1f', CAST(y + h AS DOUBLE))
  || '], d: "M' || x || ' ' || y || ' H' || (x + w) || ' V' || (y + h) || ' H' || x || ' Z" },', chr(10) ORDER BY id) || chr(10) || '];' AS text FROM boxes""")
def geometry_of_drawing(spark, sf_dir):
    path, k = scratch(spark, "drawing"), F.col("n_nationkey")
    x, y, w, h = k % 5, k % 3, k % 4 + 3, k % 4 + 3
    text = lambda c: c.cast("string")
    d = F.concat(F.lit("M"), text(x), F.lit(" "), text(y), F.lit(" H"), text(x + w), F.lit(" V"), text(y + h), F.lit(" H"), text(x), F.lit(" Z"))
    drawn = tables.read(spark, sf_dir, "nation").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k.alias("k"), d.alias("d")))), lambda p: F.concat(F.lit('<path d="'), p["d"], F.lit('"/>'))), "\n").alias("paths"))  # a drawing is one file
    drawn.select(F.concat(F.lit('<svg viewBox="0 0 9 9">'), "paths", F.lit("</svg>"))).write.text(path)
    rows = files.svg_paths(spark, path).select(F.col("place").cast("long").alias("id"), "d", shapes.path_points(F.col("d")).alias("ring"))
    labels = shapes.label_points(rows, "id").select("id", F.col("x").alias("label_x"), F.col("y").alias("label_y"))
    return files.geometry_text(rows.select("id", "d").join(labels, "id").join(shapes.bounding_boxes(rows, "id"), "id"))
