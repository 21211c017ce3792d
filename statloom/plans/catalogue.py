"""Name to query, and name to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import INTENT_KEYWORDS, MODULE_KEYWORDS, SEARCH_LETTERS, TOPIC_KEYWORDS
from ..functions import colour, numbers, period, text
from ..lineage import scratch
from ..operators import backtest, catalog, changepoints, charts, load, map_layer, models, observations, panel, plan_actual, profile, questions, recurrent, reference, reports, retrieval, series, shapes, tasks
from . import tables
from .tables import INDICATORS, OBSERVATIONS, PANEL, PLANS, TASKS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(*ctes: str, sql: str | None = None):
    """Registers a query under its function's name, with SQL that may use these table expressions."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = ("WITH " + ",".join(ctes) if ctes else "") + sql
        return f

    return register


YEAR = 2000
RANK = "CASE period WHEN 'year' THEN 3 WHEN 'ytd' THEN 2 WHEN 'quarter' THEN 1 ELSE 0 END"
MONTHS = "['yanvar','fevral','mart','aprel','may','iyun','iyul','avgust','sentyabr','oktyabr','noyabr','dekabr']"
CAPTION = f"""CASE WHEN period = 'ytd' AND period_no > 0 THEN CASE WHEN period_no <= 1 THEN 'yanvar' ELSE 'yanvar–' || {MONTHS}[least(period_no, 12)] END
  WHEN period = 'month' AND period_no > 0 THEN {MONTHS}[least(period_no, 12)]
  WHEN period = 'quarter' AND period_no > 0 THEN least(period_no, 12) || '-sherek' ELSE 'jıl' END"""


def layer_sql(year: int, prefix: str = "") -> str:
    """The map layer of a year as table expressions ending in {prefix}layer."""
    p = prefix
    best = f"SELECT indicator_id, year, period, period_no FROM (SELECT *, row_number() OVER (PARTITION BY indicator_id, year ORDER BY {RANK} DESC, coalesce(period_no, 0) DESC) AS n FROM obs WHERE year IN ({year}, {year - 1})) WHERE n = 1"
    return f"""{p}best AS ({best}),
{p}vals AS (SELECT o.indicator_id, o.year, o.district_id, coalesce(sum(value), 0) AS value FROM obs o JOIN {p}best b
  ON o.indicator_id = b.indicator_id AND o.year = b.year AND o.period = b.period WHERE district_id IS NOT NULL GROUP BY ALL),
{p}head AS (SELECT a.indicator_id, a.period, a.period_no, b.period IS NOT NULL AND EXISTS (SELECT 1 FROM {p}vals v WHERE v.indicator_id = a.indicator_id AND v.year = {year - 1}) AS comparable,
    (SELECT sum(value) FROM {p}vals v WHERE v.indicator_id = a.indicator_id AND v.year = {year}) AS total,
    (SELECT max(value) FROM {p}vals v WHERE v.indicator_id = a.indicator_id AND v.year = {year}) AS top
  FROM {p}best a LEFT JOIN {p}best b ON a.indicator_id = b.indicator_id AND b.year = {year - 1} AND a.period = b.period AND a.period_no IS NOT DISTINCT FROM b.period_no
  WHERE a.year = {year}),
{p}layer AS (SELECT h.indicator_id, d.district_id, d.name, CAST(v.value AS DOUBLE) AS value,
    CAST(v.value AS DOUBLE) / nullif(CAST(h.total AS DOUBLE), 0) * 100 AS share, CAST(v.value AS DOUBLE) / nullif(CAST(h.top AS DOUBLE), 0) AS intensity,
    CASE WHEN h.comparable THEN CAST(v.value - b.value AS DOUBLE) / nullif(CAST(abs(b.value) AS DOUBLE), 0) * 100 END AS yoy,
    CASE WHEN v.value IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY h.indicator_id, v.value IS NULL ORDER BY v.value DESC, d.district_id) AS INT) END AS rank,
    h.period, h.period_no, h.period <> 'year' AS partial, CAST(h.total AS DOUBLE) AS total
  FROM {p}head h CROSS JOIN districts d LEFT JOIN {p}vals v ON v.indicator_id = h.indicator_id AND v.district_id = d.district_id AND v.year = {year}
  LEFT JOIN {p}vals b ON b.indicator_id = h.indicator_id AND b.district_id = d.district_id AND b.year = {year - 1})"""


def series_sql(by_district: bool, where: str = "true", prefix: str = "") -> str:
    """A series as table expressions ending in {prefix}points."""
    p, d = prefix, ", district_id" if by_district else ""
    dd = ", c.district_id" if by_district else ""
    level = "district_id IS NOT NULL" if by_district else "(has_national = 0 OR district_id IS NULL)"
    return f"""{p}has AS (SELECT indicator_id, max(CASE WHEN district_id IS NULL THEN 1 ELSE 0 END) AS has_national FROM obs GROUP BY 1),
{p}rows AS (SELECT o.*, {"false" if by_district else "has_national = 0"} AS aggregated FROM obs o JOIN {p}has USING (indicator_id) WHERE {level} AND {where}),
{p}pbest AS (SELECT * FROM (SELECT indicator_id{d}, year, period AS bp, period_no AS bn, row_number() OVER (PARTITION BY indicator_id{d}, year ORDER BY {RANK} DESC, coalesce(period_no, 0) DESC) AS n FROM {p}rows) WHERE n = 1),
{p}cells AS (SELECT r.indicator_id, r.district_id, r.year, r.period, r.period_no, r.aggregated, sum(value) AS value FROM {p}rows r JOIN {p}pbest b
  ON r.indicator_id = b.indicator_id AND r.year = b.year AND r.period = b.bp AND r.period_no IS NOT DISTINCT FROM b.bn {"AND r.district_id = b.district_id" if by_district else ""} GROUP BY ALL),
{p}points AS (SELECT c.indicator_id{dd}, c.year, CAST(c.year AS VARCHAR) || CASE WHEN c.period <> 'year' THEN '*' ELSE '' END AS label,
    {CAPTION.replace("period", "c.period")} AS caption, c.period <> 'year' AS partial, CAST(sum(c.value) AS DOUBLE) AS value,
    CAST(sum(c.value) FILTER (WHERE b.value IS NOT NULL) - sum(b.value) AS DOUBLE) / nullif(CAST(abs(sum(b.value)) AS DOUBLE), 0) * 100 AS yoy,
    count(DISTINCT coalesce(c.district_id, '')) AS sources, c.aggregated
  FROM {p}cells c LEFT JOIN {p}cells b ON c.indicator_id = b.indicator_id AND c.district_id IS NOT DISTINCT FROM b.district_id AND c.year = b.year + 1
    AND c.period = b.period AND c.period_no IS NOT DISTINCT FROM b.period_no GROUP BY c.indicator_id{dd}, c.year, c.period, c.period_no, c.aggregated)"""


def _layer(spark: SparkSession, sf_dir: str, year: int = YEAR) -> DataFrame:
    return map_layer.map_layer(tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), year)


# --- map layer, series, overview -------------------------------------------------------


@query(OBSERVATIONS, layer_sql(YEAR), sql=" SELECT * FROM layer")
def map_layer_(spark, sf_dir):
    return _layer(spark, sf_dir)


QUERIES["map_layer"], ORACLE_SQL["map_layer"] = QUERIES.pop("map_layer_"), ORACLE_SQL.pop("map_layer_")


@query(OBSERVATIONS, layer_sql(2001), sql=" SELECT * FROM layer")
def map_layer_partial(spark, sf_dir):
    return _layer(spark, sf_dir, 2001)


@query(OBSERVATIONS, series_sql(False), sql=" SELECT * FROM points")
def series_national(spark, sf_dir):
    return series.national_series(tables.observations(spark, sf_dir))


@query(OBSERVATIONS, series_sql(True), sql=" SELECT * FROM points")
def series_district(spark, sf_dir):
    return series.district_series(tables.observations(spark, sf_dir))


@query(OBSERVATIONS, series_sql(False, "year >= 1998"), sql=" SELECT * FROM points WHERE indicator_id <> 'MACHINERY'")
def series_common_yoy(spark, sf_dir):
    obs = tables.observations(spark, sf_dir).where(F.col("indicator_id") != tables.NATIONAL)
    return series.national_series(obs, year_from=1998)


@query(OBSERVATIONS, series_sql(False), sql=" SELECT * FROM points WHERE indicator_id = 'MACHINERY'")
def series_has_national(spark, sf_dir):
    return series.national_series(observations.scan(tables.observations(spark, sf_dir), indicator=tables.NATIONAL))


@query(OBSERVATIONS, sql=f" SELECT indicator_id, year, period, CAST(period_no AS VARCHAR) AS period_no FROM (SELECT *, row_number() OVER (PARTITION BY indicator_id, year ORDER BY {RANK} DESC, coalesce(period_no, 0) DESC) AS n FROM obs) WHERE n = 1")
def best_period(spark, sf_dir):
    best = observations.best_period(tables.observations(spark, sf_dir), "indicator_id", "year")
    return best.withColumn("period_no", F.col("period_no").cast("string"))


TREND = """
SELECT {keys}, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years, count(*) AS n FROM
 (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY year DESC) AS back FROM points) WHERE back <= {n} GROUP BY {keys}"""


def _years(trend: DataFrame, *keys: str) -> DataFrame:
    return trend.select(*keys, F.array_join(F.transform("trend", lambda t: t["year"].cast("string")), ",").alias("years"), F.size("trend").cast("long").alias("n"))


@query(OBSERVATIONS, series_sql(True), sql=TREND.format(keys="indicator_id, district_id", n=4))
def trend_last4(spark, sf_dir):
    keys = ("indicator_id", "district_id")
    return _years(profile.trend(series.district_series(tables.observations(spark, sf_dir)), *keys, n=4), *keys)


SEVERITY = "CASE WHEN yoy IS NULL THEN 'in_progress' WHEN yoy < -5 THEN 'critical' WHEN yoy < 0 THEN 'at_risk' WHEN yoy < 5 THEN 'in_progress' ELSE 'completed' END"


@query(
    OBSERVATIONS, layer_sql(YEAR), series_sql(True, "district_id = '7'"),
    sql=f""" SELECT p.indicator_id, p.district_id, p.year, p.label, p.value, p.yoy, p.value / nullif(l.total, 0) * 100 AS share, l.rank,
      (SELECT count(*) FROM layer x WHERE x.indicator_id = p.indicator_id AND x.value IS NOT NULL) AS of, {SEVERITY.replace("yoy", "p.yoy")} AS status
    FROM points p LEFT JOIN layer l ON l.indicator_id = p.indicator_id AND l.district_id = '7' WHERE p.year = {YEAR}""",
)
def district_profile(spark, sf_dir):
    return profile.district_profile(tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), "7", YEAR).drop("trend")


ENDS = "(SELECT {f}(name, struct_pack(a := value, b := -rank)) FROM layer l WHERE l.indicator_id = p.indicator_id AND value IS NOT NULL)"
LEADER = "(SELECT name FROM layer l WHERE l.indicator_id = {p}.indicator_id AND value IS NOT NULL ORDER BY rank LIMIT 1)"
LAGGARD = "(SELECT name FROM layer l WHERE l.indicator_id = {p}.indicator_id AND value IS NOT NULL ORDER BY rank DESC LIMIT 1)"


@query(OBSERVATIONS, layer_sql(YEAR), series_sql(False), sql=f" SELECT p.*, {LEADER.format(p='p')} AS leader, {LAGGARD.format(p='p')} AS laggard FROM points p WHERE year = {YEAR}")
def overview(spark, sf_dir):
    return profile.overview(tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), YEAR).drop("trend")


@query(OBSERVATIONS, layer_sql(YEAR), sql=f" SELECT indicator_id, {LEADER.format(p='x')} AS leader, {LAGGARD.format(p='x')} AS laggard, count(*) FILTER (WHERE yoy > 0) AS growing, count(*) FILTER (WHERE yoy < 0) AS declining FROM layer x WHERE value IS NOT NULL GROUP BY indicator_id")
def leader_laggard(spark, sf_dir):
    return map_layer.extremes(_layer(spark, sf_dir)).drop("mean_yoy")


@query(OBSERVATIONS, series_sql(False), sql=f" SELECT count(*) FILTER (WHERE yoy > 0) AS growing, count(*) FILTER (WHERE yoy < 0) AS declining FROM points WHERE year = {YEAR}")
def growth_counts(spark, sf_dir):
    points = series.national_series(tables.observations(spark, sf_dir)).where(F.col("year") == YEAR)
    return profile.growth_counts(points).drop("mean_yoy")


@query(OBSERVATIONS, layer_sql(YEAR), sql=" SELECT * FROM layer WHERE rank <= 17")
def ranking_top17(spark, sf_dir):
    return map_layer.top_ranked(_layer(spark, sf_dir))


def _by_growth_sql(order: str, n: int, where: str = "yoy IS NOT NULL") -> str:
    return f" SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY indicator_id ORDER BY yoy {order}, district_id) AS INT) AS place FROM layer WHERE {where}) WHERE place <= {n}"


@query(OBSERVATIONS, layer_sql(YEAR), sql=_by_growth_sql("DESC", 17))
def growth_top17(spark, sf_dir):
    return map_layer.fastest(_layer(spark, sf_dir))


@query(OBSERVATIONS, layer_sql(YEAR), sql=_by_growth_sql("ASC", 4))
def movers_worst4(spark, sf_dir):
    return map_layer.slowest(_layer(spark, sf_dir))


@query(OBSERVATIONS, layer_sql(YEAR), sql=_by_growth_sql("ASC", 6, "yoy < 0"))
def declining_worst(spark, sf_dir):
    return map_layer.declining(_layer(spark, sf_dir))


@query(OBSERVATIONS, layer_sql(YEAR), sql=""" SELECT * EXCLUDE (back), CASE WHEN rank <= 3 THEN 'top' ELSE 'bottom' END AS side FROM
  (SELECT *, row_number() OVER (PARTITION BY indicator_id ORDER BY value ASC, district_id DESC) AS back FROM layer WHERE value IS NOT NULL) WHERE rank <= 3 OR back <= 3""")
def top3_bottom3(spark, sf_dir):
    return map_layer.leaders_and_laggards(_layer(spark, sf_dir))


@query(OBSERVATIONS, layer_sql(YEAR), sql=""" SELECT l.indicator_id, l.district_id, l.value,
  CAST(m.s AS DOUBLE) / m.n AS mean FROM layer l JOIN (SELECT indicator_id, sum(CAST(value AS DECIMAL(24,4))) AS s, count(value) AS n FROM layer GROUP BY 1) m USING (indicator_id)""")
def compare_to_mean(spark, sf_dir):
    return map_layer.to_mean(_layer(spark, sf_dir))


@query(OBSERVATIONS, layer_sql(YEAR), sql=f" SELECT indicator_id, district_id, {SEVERITY} AS status FROM layer")
def severity(spark, sf_dir):
    return _layer(spark, sf_dir).select("indicator_id", "district_id", numbers.severity(F.col("yoy")).alias("status"))


def _flat(rows: DataFrame, key: str) -> DataFrame:
    """Charts as text, to compare nested rows."""
    return rows.select(key, "kind", F.size("points").cast("long").alias("n"), F.array_join(F.transform("points", lambda p: p["label"]), ",").alias("labels"))


@query(OBSERVATIONS, layer_sql(YEAR), sql=" SELECT indicator_id, 'bar' AS kind, count(*) AS n, string_agg(name, ',' ORDER BY rank) AS labels FROM layer WHERE rank <= 17 GROUP BY 1")
def chart_ranking(spark, sf_dir):
    return _flat(charts.ranking(_layer(spark, sf_dir)), "indicator_id")


@query(OBSERVATIONS, layer_sql(YEAR), sql=" SELECT indicator_id, 'diverging' AS kind, count(*) AS n, string_agg(name, ',' ORDER BY place) AS labels FROM (" + _by_growth_sql("DESC", 17) + ") GROUP BY 1")
def chart_growth(spark, sf_dir):
    return _flat(charts.growth(_layer(spark, sf_dir)), "indicator_id")


@query(OBSERVATIONS, series_sql(False), sql=" SELECT indicator_id, 'line' AS kind, count(*) AS n, string_agg(label, ',' ORDER BY year) AS labels FROM points GROUP BY 1 HAVING count(*) >= 2")
def chart_dynamics(spark, sf_dir):
    return _flat(charts.dynamics(series.national_series(tables.observations(spark, sf_dir))), "indicator_id")


@query(OBSERVATIONS, series_sql(False), sql=f" SELECT year, 'diverging' AS kind, count(*) AS n, string_agg(indicator_id, ',' ORDER BY yoy DESC) AS labels FROM points WHERE year = {YEAR} AND yoy IS NOT NULL GROUP BY 1")
def chart_structure(spark, sf_dir):
    cards = series.national_series(tables.observations(spark, sf_dir)).where(F.col("year") == YEAR)
    return _flat(charts.structure(cards), "year")


@query(OBSERVATIONS, layer_sql(YEAR), series_sql(True, "district_id = '7'"), sql=f" SELECT p.district_id, 'donut' AS kind, count(*) AS n, string_agg(p.indicator_id, ',' ORDER BY p.value / l.total DESC) AS labels FROM points p JOIN layer l ON l.indicator_id = p.indicator_id AND l.district_id = '7' WHERE p.year = {YEAR} GROUP BY 1")
def chart_share(spark, sf_dir):
    rows = profile.district_profile(tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), "7", YEAR)
    return _flat(charts.share(rows), "district_id")


@query(OBSERVATIONS, layer_sql(YEAR), sql=" SELECT district_id, 'dumbbell' AS kind, count(*) AS n, string_agg(indicator_id, ',' ORDER BY indicator_id) AS labels FROM layer WHERE district_id = '7' AND value IS NOT NULL GROUP BY 1")
def chart_compare(spark, sf_dir):
    return _flat(charts.compare(_layer(spark, sf_dir), "7"), "district_id")


@query(OBSERVATIONS, sql=" SELECT DISTINCT year FROM obs")
def available_years(spark, sf_dir):
    return observations.available_years(tables.observations(spark, sf_dir))


@query(OBSERVATIONS, sql=" SELECT indicator_id, max(year) AS latest_year FROM obs GROUP BY 1")
def latest_year(spark, sf_dir):
    return observations.latest_year(tables.observations(spark, sf_dir), "indicator_id")


@query(OBSERVATIONS, sql=" SELECT DISTINCT indicator_id, year, period, CAST(period_no AS VARCHAR) AS period_no FROM obs")
def distinct_spans(spark, sf_dir):
    return observations.spans(tables.observations(spark, sf_dir), "indicator_id").withColumn("period_no", F.col("period_no").cast("string"))


@query(OBSERVATIONS, sql=f" SELECT DISTINCT period, CAST(period_no AS VARCHAR) AS period_no, {CAPTION} AS caption, CASE WHEN period <> 'year' THEN ' (' || {CAPTION} || ')' ELSE '' END AS note FROM obs")
def period_label(spark, sf_dir):
    p, no = F.col("period"), F.col("period_no")
    rows = observations.spans(tables.observations(spark, sf_dir)).select(p, no.cast("string").alias("period_no"), period.caption(p, no).alias("caption"), period.period_note(p, no).alias("note"))
    return rows.distinct()


# --- catalogue ---------------------------------------------------------------------------


@query(INDICATORS, sql="""  , n AS (SELECT indicator_id, count(*) AS c FROM pobs GROUP BY 1)
SELECT module, id, name, unit, coalesce(c, 0) AS observations FROM (SELECT *, row_number() OVER (PARTITION BY module ORDER BY has_districts DESC,
  NOT (lower(name || ' ' || unit) LIKE '%osim%' OR lower(name || ' ' || unit) LIKE '%osiw%' OR contains(name || ' ' || unit, '%')) DESC, coalesce(c, 0) DESC, id) AS place
  FROM inds LEFT JOIN n ON id = indicator_id) WHERE place = 1""")
def primary_indicator(spark, sf_dir):
    return catalog.primary_indicators(tables.indicators(spark, sf_dir), tables.part_observations(spark, sf_dir))


@query(INDICATORS, sql=""" SELECT c.id, c.name, count(i.id) AS indicators, CAST(coalesce(sum(n), 0) AS BIGINT) AS observations
FROM (SELECT DISTINCT category_id AS id, lower(category_id) AS name FROM inds UNION ALL SELECT 'NONE', 'none') c LEFT JOIN inds i ON i.category_id = c.id
LEFT JOIN (SELECT indicator_id, count(*) AS n FROM pobs GROUP BY 1) o ON o.indicator_id = i.id GROUP BY 1, 2""")
def summary_categories(spark, sf_dir):
    inds = tables.indicators(spark, sf_dir)
    cats = inds.select(F.col("category_id").alias("id")).distinct().unionByName(spark.range(1).select(F.lit("NONE").alias("id")))
    return catalog.category_counts(cats.withColumn("name", F.lower("id")), inds, tables.part_observations(spark, sf_dir))


@query(INDICATORS, sql=""" SELECT count(*) AS observations, count(DISTINCT district_id) AS districts, min(year) AS first_year, max(year) AS last_year,
  (SELECT count(*) FROM inds) AS indicators, (SELECT count(*) FROM inds WHERE has_districts) AS with_districts FROM pobs""")
def summary_counts(spark, sf_dir):
    return catalog.summary(tables.indicators(spark, sf_dir), tables.part_observations(spark, sf_dir))


@query(INDICATORS, sql=" SELECT * FROM inds WHERE has_districts AND contains(lower(name), 'gear')")
def indicator_search(spark, sf_dir):
    return catalog.search(tables.indicators(spark, sf_dir), F.lower("name"), F.lit("gear"), has_districts=True)


@query(INDICATORS, sql=" SELECT *, (SELECT count(*) FROM inds) AS total FROM inds ORDER BY category_id, name, id LIMIT 20 OFFSET 10")
def indicator_search_page(spark, sf_dir):
    return catalog.page(tables.indicators(spark, sf_dir), "category_id", "name", "id", offset=10, limit=20)


@query(INDICATORS, sql=""" SELECT i.*, (SELECT count(*) FROM pobs WHERE indicator_id = i.id) AS observations, (SELECT count(DISTINCT district_id) FROM pobs WHERE indicator_id = i.id) AS districts,
  (SELECT string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) FROM (SELECT DISTINCT year FROM pobs WHERE indicator_id = i.id)) AS years FROM inds i WHERE id = 1""")
def indicator_detail(spark, sf_dir):
    rows = catalog.indicator_detail(tables.indicators(spark, sf_dir), tables.part_observations(spark, sf_dir), 1)
    return rows.withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), ","))


@query(sql=" SELECT r_regionkey AS id, r_name AS name, count(n_nationkey) AS indicators, 0 AS observations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")
def meta_categories(spark, sf_dir):
    cats = tables.read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    inds = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("category_id"))
    none = inds.where("false").select(F.col("id").alias("indicator_id"))
    return catalog.category_counts(cats, inds, none)


# --- plans and tasks ---------------------------------------------------------------------

MEAN = "CAST(sum({c}) AS DOUBLE) / nullif(count({c}), 0)"
COMPLETION = "CASE WHEN completion >= 95 THEN 'completed' WHEN completion >= 80 THEN 'in_progress' WHEN completion >= 60 THEN 'at_risk' ELSE 'critical' END"


@query(PLANS, sql=f""" SELECT module, rows, plan, fact, critical, coalesce(fact / nullif(plan, 0) * 100, 0) AS percent FROM (SELECT module, count(*) AS rows,
  coalesce({MEAN.format(c="nullif(planned, 0)")}, 0) AS plan, coalesce({MEAN.format(c="nullif(actual, 0)")}, 0) AS fact, count(*) FILTER (WHERE status IN ('critical', 'at_risk')) AS critical FROM plans GROUP BY module)""")
def plan_actual_nozero(spark, sf_dir):
    return plan_actual.summary_by_module(tables.plans(spark, sf_dir), "module")


DONE = f""" done AS (SELECT *, coalesce(fact / nullif(plan, 0) * 100, 0) AS completion FROM (SELECT module, region, {MEAN.format(c="planned")} AS plan, {MEAN.format(c="actual")} AS fact
  FROM plans WHERE module IS NOT NULL AND region IS NOT NULL GROUP BY 1, 2 HAVING count(planned) > 0 AND count(actual) > 0))"""


@query(PLANS, DONE, sql=f" SELECT *, {COMPLETION} AS status FROM done")
def plan_actual_nulls(spark, sf_dir):
    return plan_actual.completion(tables.plans(spark, sf_dir), "module", "region")


@query(PLANS, DONE, sql=f" SELECT *, {COMPLETION} AS status FROM done WHERE completion < 95 ORDER BY completion, module, region LIMIT 10")
def critical_regions(spark, sf_dir):
    return plan_actual.critical(plan_actual.completion(tables.plans(spark, sf_dir), "module", "region"), "module", "region", below=95.0)


@query(PLANS, sql=" SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in plan_actual.STATUSES) + " FROM plans")
def status_pivot(spark, sf_dir):
    return plan_actual.status_counts(tables.plans(spark, sf_dir))


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("deadline", F.col("deadline").cast("string"))


@query(TASKS, sql=" SELECT status, count(*) AS n FROM tasks GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM tasks")
def task_histogram(spark, sf_dir):
    return plan_actual.status_histogram(tables.tasks(spark, sf_dir))


@query(TASKS, sql=" SELECT * REPLACE (CAST(deadline AS VARCHAR) AS deadline) FROM tasks WHERE module = '1-URGENT' AND status = 'completed'")
def task_list(spark, sf_dir):
    return _dated(tasks.task_list(tables.tasks(spark, sf_dir), module="1-URGENT", status="completed"))


PROGRESS = "CASE WHEN progress >= 100 THEN 'completed' WHEN progress >= 60 THEN 'in_progress' WHEN progress >= 30 THEN 'at_risk' ELSE 'critical' END"


@query(TASKS, sql=f" SELECT id, {PROGRESS} AS status FROM tasks")
def task_status(spark, sf_dir):
    return tables.tasks(spark, sf_dir).select("id", numbers.progress_status(F.col("progress")).alias("status"))


@query(TASKS, sql=" SELECT * REPLACE (CAST(deadline AS VARCHAR) AS deadline), CAST(date_diff('day', DATE '2000-07-27', deadline) AS INT) AS days_left, deadline < DATE '2000-07-27' AND status <> 'completed' AS overdue FROM tasks")
def days_left(spark, sf_dir):
    return _dated(tasks.with_days_left(tables.tasks(spark, sf_dir), F.lit("2000-07-27").cast("date")))


@query(TASKS, sql=f""" SELECT id, district, module, coalesce(p, progress) AS progress, CAST(deadline AS VARCHAR) AS deadline, coalesce(s, CASE WHEN p IS NOT NULL THEN {PROGRESS.replace("progress >=", "p >=")} END, status) AS status
  FROM (SELECT *, CASE WHEN id % 3 = 0 THEN CAST(id % 120 AS INT) END AS p, CASE WHEN id % 9 = 0 THEN 'critical' END AS s FROM tasks)""")
def task_edits(spark, sf_dir):
    rows = tables.tasks(spark, sf_dir)
    changes = rows.where("id % 3 = 0").select("id", F.when(F.col("id") % 9 == 0, "critical").alias("status"), (F.col("id") % 120).cast("int").alias("progress"))
    return _dated(tasks.edited(rows, changes))


# --- text and numbers ----------------------------------------------------------------------


@query(sql=" SELECT p_partkey, trim(regexp_replace(list_extract(string_split(p_brand || '; ' || p_type || ' –', ';'), -1), '^[ \\-–—]+|[ \\-–—]+$', '', 'g')) AS unit FROM part")
def short_unit(spark, sf_dir):
    unit = F.concat("p_brand", F.lit("; "), "p_type", F.lit(" –"))
    return tables.read(spark, sf_dir, "part").select("p_partkey", text.short_unit(unit).alias("unit"))


@query(sql=" SELECT p_partkey, NOT (contains(lower(p_type || ' ' || p_brand), 'steel') AND false) AND NOT contains(lower(p_name || CASE WHEN p_size % 4 = 0 THEN ' %' ELSE '' END || ' ' || p_brand), '%') AS volume FROM part")
def is_volume(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_size") % 4 == 0, " %").otherwise(""))
    return tables.read(spark, sf_dir, "part").select("p_partkey", text.is_volume(name, F.col("p_brand")).alias("volume"))


NEEDLES = [("economy", "sanaat"), ("steel", "qurilis"), ("small", "sawda")]


@query(sql=" SELECT p_partkey, CASE WHEN contains(lower(p_type), 'economy') THEN 'sanaat' WHEN contains(lower(p_type), 'steel') THEN 'qurilis' WHEN contains(lower(p_type), 'small') THEN 'sawda' END AS module FROM part")
def core_module(spark, sf_dir):
    return tables.read(spark, sf_dir, "part").select("p_partkey", text.core_module(F.col("p_type"), NEEDLES).alias("module"))


@query(sql=r" SELECT o_orderkey, CAST(list_extract(regexp_extract_all('from 1999 to ' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '\b(20[12]\d)\b', 1), -1) AS INT) AS found FROM orders")
def extract_year(spark, sf_dir):
    said = F.concat(F.lit("from 1999 to "), F.to_date("o_orderdate").cast("string"))
    return tables.read(spark, sf_dir, "orders").select("o_orderkey", text.last_year_in(said).alias("found"))


@query(sql=r" SELECT event_id, CAST('20' || lpad(CAST(event_id % 30 AS VARCHAR), 2, '0') || '-' || CAST((event_id % 4) * 3 + 2 AS VARCHAR) || '-15' AS DATE)::VARCHAR AS middle FROM events")
def quarter_mid_date(spark, sf_dir):
    code = F.format_string("20%02dQ%d", F.col("event_id") % 30, F.col("event_id") % 4 + 1)
    return tables.read(spark, sf_dir, "events").select("event_id", period.quarter_middle(code).cast("string").alias("middle"))


KEYWORDS = {"a": ["the"], "b": ["ed", "er"], "c": ["an"]}


@query(sql=r" SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])the') THEN 'a' WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(ed|er)') THEN 'b' WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])an') THEN 'c' END AS module FROM conversations")
def keyword_modules(spark, sf_dir):
    return tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", text.first_keyword(F.lower("text"), KEYWORDS).alias("module"))


@query(sql=" SELECT conv_id, CAST(count(*) AS INT) AS n_turns, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS text FROM conversations GROUP BY 1")
def conversation_texts(spark, sf_dir):
    return questions.conversation_texts(tables.read(spark, sf_dir, "conversations"))


@query(sql=" SELECT event_id, CASE WHEN value < 3 THEN 0 WHEN value < 6 THEN 1 ELSE 2 END AS label FROM (SELECT event_id, value / 3 AS value FROM events)")
def unemployment_label(spark, sf_dir):
    return tables.read(spark, sf_dir, "events").select("event_id", numbers.unemployment_class(F.col("value") / 3 + 3).alias("label"))


RAMP = [(0.0, (0, 0, 0)), (50.0, (200, 100, 50)), (100.0, (255, 255, 255))]


@query(sql=""" SELECT p_partkey, '#' || lower(printf('%02x%02x%02x', r, g, b)) AS colour FROM (SELECT p_partkey,
  CAST(CASE WHEN x < 50 THEN floor(x / 50 * 200 + 0.5) ELSE floor(200 + (x - 50) / 50 * 55 + 0.5) END AS INT) AS r,
  CAST(CASE WHEN x < 50 THEN floor(x / 50 * 100 + 0.5) ELSE floor(100 + (x - 50) / 50 * 155 + 0.5) END AS INT) AS g,
  CAST(CASE WHEN x < 50 THEN floor(x / 50 * 50 + 0.5) ELSE floor(50 + (x - 50) / 50 * 205 + 0.5) END AS INT) AS b FROM (SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) AS x FROM part))""")
def colour_ramp(spark, sf_dir):
    return tables.read(spark, sf_dir, "part").select("p_partkey", colour.ramp(F.col("p_size") * 2.0, RAMP).alias("colour"))


# --- loading ---------------------------------------------------------------------------------

RECORDS = """
records AS (SELECT l_orderkey * 10 + l_linenumber AS ord, l_partkey % 100 AS indicator_id, CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_suppkey % 30 AS VARCHAR) END AS district_id,
  CAST(year(l_shipdate) AS INT) AS year, CASE WHEN l_linestatus = 'F' THEN 'year' ELSE 'ytd' END AS period, CASE WHEN l_linestatus <> 'F' THEN l_linenumber END AS period_no, l_quantity AS value,
  l_returnflag AS indicator, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_linestatus END AS unit FROM lineitem)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_partkey") % 100).alias("indicator_id"),
        F.when(F.col("l_suppkey") % 4 != 0, (F.col("l_suppkey") % 30).cast("string")).alias("district_id"), F.year("l_shipdate").alias("year"),
        F.when(F.col("l_linestatus") == "F", "year").otherwise("ytd").alias("period"), F.when(F.col("l_linestatus") != "F", F.col("l_linenumber")).alias("period_no"),
        F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("indicator"), F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_linestatus")).alias("unit"),
    )


FIRSTS = "SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY indicator_id, district_id, year, period, period_no ORDER BY ord) AS n FROM records) WHERE n = 1"


@query(RECORDS, sql=f" {FIRSTS}")
def dedup_first(spark, sf_dir):
    return load.first_of_each(_records(spark, sf_dir)).select("ord")


@query(RECORDS, sql=" SELECT ord FROM records WHERE district_id IS NULL OR district_id IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)")
def known_districts(spark, sf_dir):
    return load.known_districts(_records(spark, sf_dir), tables.districts(spark, sf_dir)).select("ord")


@query(RECORDS, sql=" SELECT ord, value FROM records WHERE indicator_id NOT IN (SELECT indicator_id FROM records WHERE indicator_id < 50) UNION ALL SELECT ord, value + 1 FROM records WHERE indicator_id < 50")
def partial_refresh(spark, sf_dir):
    rows = _records(spark, sf_dir)
    new = rows.where("indicator_id < 50").withColumn("value", F.col("value") + 1)
    return load.refreshed(rows, new).select("ord", "value")


@query(sql=" SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def orphans(spark, sf_dir):
    obs = tables.read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("indicator_id"))
    return load.orphans(tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), obs)


@query(RECORDS, sql=""" SELECT indicator_id, arg_min(indicator, ord) AS name, coalesce(arg_min(unit, ord) FILTER (WHERE unit <> ''), '') AS unit, bool_or(district_id IS NOT NULL) AS has_districts FROM records GROUP BY 1""")
def indicator_first_attrs(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumn("category", F.lit("c")).withColumn("source", F.lit("s"))
    return load.indicators_of(rows, "indicator_id").select("indicator_id", "name", "unit", "has_districts")


@query(RECORDS, sql=f""" SELECT count(*) AS added, count(DISTINCT indicator_id) AS indicators, count(DISTINCT indicator) AS categories, (SELECT count(*) FROM records) - count(*) AS skipped FROM
  (SELECT *, row_number() OVER (PARTITION BY indicator_id, district_id, year, period, period_no ORDER BY ord) AS n FROM records
   WHERE district_id IS NULL OR district_id IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)) WHERE n = 1""")
def load_statistics(spark, sf_dir):
    rows = _records(spark, sf_dir).withColumnRenamed("indicator", "category")
    return load.load_statistics(rows, tables.districts(spark, sf_dir), "indicator_id")


#: Records of which some slugs (u0 to u9) have rows of unknown districts alone, and old tables that they meet in part.
LOADED = """
raw AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_suppkey % 30 >= 25 AND l_suppkey % 4 <> 0 THEN 'u' || CAST(l_partkey % 10 AS VARCHAR) ELSE CAST(l_partkey % 100 AS VARCHAR) END AS slug,
  CASE WHEN l_suppkey % 4 <> 0 THEN CAST(l_suppkey % 30 AS VARCHAR) END AS district_id, CAST(year(l_shipdate) AS INT) AS year, CASE WHEN l_linestatus = 'F' THEN 'year' ELSE 'ytd' END AS period,
  CASE WHEN l_linestatus <> 'F' THEN l_linenumber END AS period_no, l_returnflag AS category FROM lineitem),
olds AS (SELECT DISTINCT CAST(p_partkey % 150 AS VARCHAR) AS slug, 1000 + p_partkey % 150 AS id FROM part),
old_obs AS (SELECT 1000 + o_custkey % 150 AS indicator_id FROM orders),
fits AS (SELECT * FROM raw WHERE district_id IS NULL OR district_id IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation)),
firsts AS (SELECT DISTINCT slug, district_id, year, period, period_no FROM fits),
counts AS (SELECT (SELECT count(DISTINCT category) FROM raw) AS categories, (SELECT count(DISTINCT slug) FROM raw) AS indicators, (SELECT count(*) FROM firsts) AS added, (SELECT count(*) FROM raw) - (SELECT count(*) FROM firsts) AS skipped,
  (SELECT count(*) FROM (SELECT slug FROM raw UNION SELECT slug FROM olds)) AS every, (SELECT count(DISTINCT slug) FROM fits) AS held,
  (SELECT count(*) FROM old_obs WHERE indicator_id NOT IN (SELECT id FROM olds WHERE slug IN (SELECT slug FROM raw))) AS stayed)
"""


@query(LOADED, sql=""" SELECT 'full' AS mode, categories, indicators, added, skipped, every - held AS orphans, held AS indicator_rows, added AS observation_rows FROM counts
  UNION ALL SELECT 'part', categories, indicators, added, skipped, 0, every, added + stayed FROM counts UNION ALL SELECT 'none', 0, 0, 0, 0, 0, NULL, NULL""")
def load_metrics(spark, sf_dir):
    lost = (F.col("l_suppkey") % 30 >= 25) & (F.col("l_suppkey") % 4 != 0)
    rows = tables.read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(lost, F.concat(F.lit("u"), (F.col("l_partkey") % 10).cast("string"))).otherwise((F.col("l_partkey") % 100).cast("string")).alias("slug"),
        F.when(F.col("l_suppkey") % 4 != 0, (F.col("l_suppkey") % 30).cast("string")).alias("district_id"), F.year("l_shipdate").alias("year"), F.when(F.col("l_linestatus") == "F", "year").otherwise("ytd").alias("period"),
        F.when(F.col("l_linestatus") != "F", F.col("l_linenumber")).alias("period_no"), F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("indicator"), F.lit("").alias("unit"), F.col("l_returnflag").alias("category"), F.lit("s").alias("source"),
    )
    k = F.col("p_partkey") % 150
    old = tables.read(spark, sf_dir, "part").select(k.cast("string").alias("slug"), (k + 1000).alias("id")).distinct()
    held = tables.read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 150 + 1000).alias("indicator_id"), F.lit("1").alias("district_id"), F.year("o_orderdate").alias("year"), F.lit("year").alias("period"), F.lit(None).cast("int").alias("period_no"), F.col("o_totalprice").alias("value")
    )
    out = []
    for mode, given in (("full", rows), ("part", rows), ("none", rows.where("false"))):
        to = scratch(spark, "load")
        told = load.load(given, tables.districts(spark, sf_dir), old, held, "slug", to, mode == "full")
        written = [spark.read.parquet(f"{to}/{t}").count() for t in ("indicators", "observations")] if mode != "none" else [None, None]
        out.append((mode, *told.values(), *written))
    return spark.createDataFrame(out, "mode string, categories long, indicators long, added long, skipped long, orphans long, indicator_rows long, observation_rows long")


# --- panels, models ------------------------------------------------------------------------


@query(PANEL, sql=" SELECT *, CAST(active - lag(active) OVER w AS DOUBLE) AS active_diff1, CAST(active - lag(active, 2) OVER w AS DOUBLE) AS active_diff2 FROM panel WINDOW w AS (PARTITION BY district_id ORDER BY year)")
def panel_diff(spark, sf_dir):
    rows = panel.differences(tables.panel(spark, sf_dir), "district_id", "active")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("active_diff1", "active_diff2")})


@query(PANEL, sql=""" SELECT * FROM (SELECT *, rate - lag(rate) OVER w AS rate_diff, rate - lag(rate, 2) OVER w AS rate_diff2, active - lag(active) OVER w AS active_diff, employed - lag(employed) OVER w AS employed_diff,
  CAST(employed AS DOUBLE) / nullif(CAST(active AS DOUBLE), 0) AS employed_share, CAST(unemployed AS DOUBLE) / nullif(CAST(active AS DOUBLE), 0) AS unemployed_share,
  CASE WHEN rate < 6 THEN 0 WHEN rate < 9 THEN 1 ELSE 2 END AS label, year - (SELECT min(year) FROM panel) AS year_index FROM panel WINDOW w AS (PARTITION BY district_id ORDER BY year))
  WHERE rate_diff IS NOT NULL AND active_diff IS NOT NULL AND employed_diff IS NOT NULL""")
def panel_features(spark, sf_dir):
    return panel.features(tables.panel(spark, sf_dir))


@query(PANEL, sql=" SELECT * FROM panel WHERE year = (SELECT max(year) FROM panel)")
def latest_weak_spots(spark, sf_dir):
    return panel.latest_worst(tables.panel(spark, sf_dir))


@query(PANEL, sql=" SELECT *, coalesce(0.05 + CAST(active - min(active) OVER w AS DOUBLE) / nullif(CAST(max(active) OVER w - min(active) OVER w AS DOUBLE), 0) * (0.95::DOUBLE - 0.05::DOUBLE), 0.05) AS scaled FROM panel WINDOW w AS (PARTITION BY district_id)")
def minmax_scale(spark, sf_dir):
    return panel.scaled(tables.panel(spark, sf_dir), "district_id", "active", 0.05, 0.95)


@query(PANEL, sql=" SELECT district_id, year, lag(active, 3) OVER w || ',' || lag(active, 2) OVER w || ',' || lag(active) OVER w AS win, active AS target FROM panel WINDOW w AS (PARTITION BY district_id ORDER BY year) QUALIFY lag(active, 3) OVER w IS NOT NULL")
def sliding_windows(spark, sf_dir):
    rows = panel.sliding_windows(tables.panel(spark, sf_dir), "district_id", "active", 3)
    return rows.select("district_id", "year", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("win"), "target")


@query(PANEL, sql=""", g AS (SELECT *, CAST(active AS DOUBLE) / lag(CAST(active AS DOUBLE)) OVER (PARTITION BY district_id ORDER BY year) - 1 AS g,
  row_number() OVER (PARTITION BY district_id ORDER BY year DESC) AS back FROM panel),
e AS (SELECT district_id, max(year) AS y, max(active) FILTER (WHERE back = 1) AS last, (0.0::DOUBLE + max(g) FILTER (WHERE back = 3) + max(g) FILTER (WHERE back = 2) + max(g) FILTER (WHERE back = 1)) / 3 AS r FROM g GROUP BY 1)
SELECT district_id, CAST(y + s AS INT) AS year, round(last * pow(1 + r, s), 6) AS value FROM e, (SELECT unnest(range(1, 4)) AS s)""")
def extrapolate(spark, sf_dir):
    rows = panel.extrapolated(tables.panel(spark, sf_dir), "district_id", "active", 3)
    return rows.withColumn("value", F.round("value", 6))


def _forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.panel(spark, sf_dir)
    models_ = [("a", F.col("active") + 10), ("b", F.col("active") - F.col("unemployed")), ("c", F.col("active") * 2)]
    each = F.array(*[F.struct(F.lit(m).alias("model"), e.cast("double").alias("yhat")) for m, e in models_])
    return rows.select("district_id", "year", F.inline(each))


FORECASTS = """
forecasts AS (SELECT district_id, year, 'a' AS model, CAST(active + 10 AS DOUBLE) AS yhat FROM panel UNION ALL SELECT district_id, year, 'b', CAST(active - unemployed AS DOUBLE) FROM panel
  UNION ALL SELECT district_id, year, 'c', CAST(active * 2 AS DOUBLE) FROM panel)
"""


@query(PANEL, FORECASTS, sql=" SELECT district_id, year, model, error FROM (SELECT f.*, abs(yhat - active) AS error, row_number() OVER (PARTITION BY district_id, year ORDER BY abs(yhat - active), model) AS n FROM forecasts f JOIN panel USING (district_id, year)) WHERE n = 1")
def model_winner(spark, sf_dir):
    truth = tables.panel(spark, sf_dir).select("district_id", "year", F.col("active").alias("actual"))
    return models.winners(_forecasts(spark, sf_dir), truth, "district_id", "year")


@query(PANEL, FORECASTS, sql=""" SELECT district_id, year, round(sum(w * yhat) / sum(w), 6) AS yhat, count(*) AS models FROM (SELECT *, 1 / greatest(CASE model WHEN 'a' THEN 10.0::DOUBLE WHEN 'b' THEN 5.0 ELSE 0.01 END, 0.1) AS w FROM forecasts) GROUP BY 1, 2""")
def inverse_mape_ensemble(spark, sf_dir):
    rows = _forecasts(spark, sf_dir).withColumn("mape", F.when(F.col("model") == "a", 10.0).when(F.col("model") == "b", 5.0).otherwise(0.01))
    return models.ensemble(rows, "district_id", "year").withColumn("yhat", F.round("yhat", 6))


@query(PANEL, FORECASTS, sql=""" SELECT model, count(*) AS n, round(avg(abs(active - yhat)), 6) AS mae, round(sqrt(avg((active - yhat) * (active - yhat))), 6) AS rmse,
  round(avg(abs(active - yhat) / nullif(abs(CAST(active AS DOUBLE)), 0)) * 100, 6) AS mape, round(1 - sum((active - yhat) * (active - yhat)) / nullif(var_pop(active) * count(*), 0), 6) AS r2,
  round(greatest(0, 100 - avg(abs(active - yhat) / nullif(abs(CAST(active AS DOUBLE)), 0)) * 100), 6) AS accuracy, CAST(count(*) FILTER (WHERE active BETWEEN yhat - 5 AND yhat + 5) AS DOUBLE) / count(*) AS coverage
  FROM forecasts JOIN panel USING (district_id, year) GROUP BY 1""")
def forecast_metrics(spark, sf_dir):
    truth = tables.panel(spark, sf_dir).select("district_id", "year", F.col("active").alias("actual"))
    rows = _forecasts(spark, sf_dir).join(truth, ["district_id", "year"]).withColumn("lower", F.col("yhat") - 5).withColumn("upper", F.col("yhat") + 5)
    return models.measures(rows, "model").select("model", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "mape", "r2", "accuracy")], "coverage")


@query(PANEL, sql=" SELECT district_id, year, 'employed' AS name, employed AS value FROM panel UNION ALL SELECT district_id, year, 'unemployed', unemployed FROM panel")
def wide_to_long(spark, sf_dir):
    return panel.long(tables.panel(spark, sf_dir).select("district_id", "year", "employed", "unemployed"), ["district_id", "year"], ["employed", "unemployed"])


@query(OBSERVATIONS, series_sql(False), sql=" SELECT year, max(value) FILTER (WHERE indicator_id = 'BUILDING') AS building, max(value) FILTER (WHERE indicator_id = 'MACHINERY') AS machinery FROM points GROUP BY year")
def long_to_wide(spark, sf_dir):
    rows = series.national_series(tables.observations(spark, sf_dir))
    return panel.wide(rows, "year", "indicator_id", "value", ["BUILDING", "MACHINERY"]).toDF("year", "building", "machinery")


@query(PANEL, FORECASTS, sql=" SELECT district_id, year, model, yhat FROM forecasts WHERE model = 'a' UNION ALL SELECT district_id, year, model, yhat FROM forecasts WHERE model = 'b'")
def union_forecasts(spark, sf_dir):
    rows = _forecasts(spark, sf_dir)
    return reports.all_forecasts({m: rows.where(F.col("model") == m) for m in ("a", "b")}, "district_id", "year")


TRADE = """, ex AS (SELECT year, value FROM points WHERE indicator_id = 'BUILDING'), im AS (SELECT year, value FROM points WHERE indicator_id = 'MACHINERY')"""


@query(OBSERVATIONS, series_sql(False), sql=TRADE + " SELECT year, ex.value AS export, im.value AS import, ex.value - im.value AS balance FROM ex JOIN im USING (year)")
def trade_balance(spark, sf_dir):
    rows = series.national_series(tables.observations(spark, sf_dir))
    return panel.balance(rows.where("indicator_id = 'BUILDING'"), rows.where("indicator_id = 'MACHINERY'"))


@query(OBSERVATIONS, series_sql(False), sql=TRADE + " SELECT year FROM ex JOIN im USING (year)")
def year_intersection(spark, sf_dir):
    rows = series.national_series(tables.observations(spark, sf_dir))
    return panel.common_years(rows.where("indicator_id = 'BUILDING'"), rows.where("indicator_id = 'MACHINERY'"))


# --- geometry -------------------------------------------------------------------------------


def _ring(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))])


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("id"), F.col("c_nationkey").alias("nation"), _ring(k % 17, k % 13, k % 7 + 1, k % 5 + 1).alias("ring"))


@query(sql=" SELECT c_custkey AS id, CAST((c_custkey % 7 + 1) * (c_custkey % 5 + 1) AS DOUBLE) AS area FROM customer")
def polygon_area(spark, sf_dir):
    return _shapes(spark, sf_dir).select("id", shapes.signed_area(F.col("ring")).alias("area"))


@query(sql=""" SELECT c_nationkey AS nation, CAST(min(c_custkey % 17) AS DOUBLE) AS x0, CAST(min(c_custkey % 13) AS DOUBLE) AS y0, CAST(max(c_custkey % 17 + c_custkey % 7 + 1) AS DOUBLE) AS x1,
  CAST(max(c_custkey % 13 + c_custkey % 5 + 1) AS DOUBLE) AS y1 FROM customer GROUP BY 1""")
def bbox_union(spark, sf_dir):
    return shapes.bounding_boxes(_shapes(spark, sf_dir), "nation")


@query(sql=" SELECT c_custkey AS id, 5.5 > c_custkey % 17 AND 5.5 < c_custkey % 17 + c_custkey % 7 + 1 AND 4.5 > c_custkey % 13 AND 4.5 < c_custkey % 13 + c_custkey % 5 + 1 AS inside FROM customer")
def point_in_polygon(spark, sf_dir):
    return _shapes(spark, sf_dir).select("id", shapes.contains(F.col("ring"), F.lit(5.5), F.lit(4.5)).alias("inside"))


# --- without SQL -------------------------------------------------------------------------------


@query()
def slugs(spark, sf_dir):
    return tables.read(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat_ws("|", "p_name", "p_brand")).alias("slug"))


_LETTERS = {**{k: v for k, v in SEARCH_LETTERS.items() if v}, **{k: "" for k, v in SEARCH_LETTERS.items() if not v}}


def form_sql(text: str) -> str:
    """The search form of a text, in SQL."""
    quoted = lambda t: t.replace("'", "''")
    return f"translate(strip_accents(lower({text})), '{quoted(''.join(_LETTERS))}', '{quoted(''.join(_LETTERS.values()))}')"


def question_sql(text: str) -> str:
    """The form of a question, in SQL."""
    return rf"trim(regexp_replace(regexp_replace({form_sql(text)}, '[^\p{{L}}\p{{N}}\p{{M}}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


def first_keyword_sql(text: str, keywords: dict[str, list[str]]) -> str:
    """The first name with a keyword at the start of a word, in SQL."""
    plain = lambda k: " ".join("".join(c if c.isalnum() or c == "_" else " " for c in k).split())
    return "CASE " + " ".join(rf"WHEN regexp_matches({text}, '\b(?:{'|'.join(map(plain, keys))})') THEN '{name}'" for name, keys in keywords.items()) + " END"


def parsed_sql(asked: str) -> str:
    """Table expressions that end in parsed (id, intent, district_id, module), from rows (id, prompt) and districts."""
    return f"""forms AS (SELECT id, {question_sql("coalesce(prompt, '')")} AS q FROM {asked}),
aliases AS (SELECT district_id, {question_sql('name')} AS alias FROM districts),
named AS (SELECT id, arg_min(district_id, struct_pack(a := -n, b := district_id)) AS district_id FROM
  (SELECT forms.id, a.district_id, n FROM forms, (SELECT *, unnest(range(5, length(alias) + 1)) AS n FROM aliases) a WHERE contains(q, left(alias, n))) GROUP BY id),
words AS (SELECT id, q, {first_keyword_sql('q', MODULE_KEYWORDS)} AS module, {first_keyword_sql('q', INTENT_KEYWORDS)} AS intent FROM forms),
parsed AS (SELECT w.id, coalesce(intent, CASE WHEN module IS NOT NULL THEN 'module' WHEN district_id IS NOT NULL THEN 'district' ELSE 'overview' END) AS intent, district_id, module
  FROM words w LEFT JOIN named n ON n.id = w.id)"""


DISTRICT_ROWS = "districts AS (SELECT CAST(n_nationkey AS VARCHAR) AS district_id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region_id FROM nation)"
USER_PROMPTS = "prompts AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, text AS prompt FROM conversations WHERE role = 'user')"


@query(sql=f" SELECT conv_id, turn, {form_sql('text')} AS form FROM conversations")
def search_forms(spark, sf_dir):
    return tables.read(spark, sf_dir, "conversations").select("conv_id", "turn", text.search_form(F.col("text")).alias("form"))


@query()
def changepoint_forecasts(spark, sf_dir):
    return changepoints.yearly_forecast(tables.panel(spark, sf_dir), "district_id", "active", 5)


@query()
def recurrent_forecasts(spark, sf_dir):
    return recurrent.forecast(tables.quarters(spark, sf_dir), "district_id", "active", 5)


@query()
def backtest_grid(spark, sf_dir):
    configurations = (*backtest.CLOSED, backtest.Configuration("changepoints", "changepoints"), *backtest.GRID)
    found = backtest.backtested(tables.quarters(spark, sf_dir), "district_id", "active", configurations, (1998 * 4, 1999 * 4), 2)
    return backtest.scores(found, "district_id")


@query(PANEL, sql=""" , line AS (SELECT district_id, regr_slope(z, year) AS b, regr_intercept(z, year) AS a, count(*) AS n, avg(year) AS middle, regr_sxx(z, year) AS sxx, max(year) AS last,
    sqrt(greatest(0, regr_syy(z, year) - regr_slope(z, year) * regr_sxy(z, year)) / (count(*) - 2)) AS spread
  FROM (SELECT district_id, year, ln(CAST(active AS DOUBLE)) AS z FROM panel) GROUP BY 1 HAVING count(*) >= 3),
ahead AS (SELECT *, CAST(last + s AS INT) AS year, 1.645 * spread * sqrt(1 + 1.0 / n + pow(last + s - middle, 2) / sxx) AS width FROM line, (SELECT unnest([1, 2, 3, 4, 5]) AS s))
SELECT district_id, year, round(exp(a + b * year), 6) AS yhat, round(exp(a + b * year - width), 6) AS lower, round(exp(a + b * year + width), 6) AS upper FROM ahead""")
def trend_forecasts(spark, sf_dir):
    rows = models.trend_forecast(tables.panel(spark, sf_dir), "district_id", "active", 5)
    return rows.withColumns({c: F.round(c, 6) for c in ("yhat", "lower", "upper")})


@query(DISTRICT_ROWS, USER_PROMPTS, parsed_sql("prompts"), sql=" SELECT id, intent, district_id, module FROM parsed")
def question_intents(spark, sf_dir):
    asked = tables.read(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("prompt"))
    return questions.parsed(asked, tables.districts(spark, sf_dir))


# --- colours, retrieval, reference ----------------------------------------------------------


def _ramp_sql(x: str, stops) -> str:
    """The colour of x between stops, in SQL."""
    cases = [f"WHEN {x} <= {stops[0][0]} THEN '#%02x%02x%02x'" % stops[0][1]]
    for (p, low), (q, high) in zip(stops, stops[1:], strict=False):
        parts = ", ".join(f"CAST(floor({i} + ({x} - {p}) / ({q - p!r}::DOUBLE) * {j - i} + 0.5) AS INT)" for i, j in zip(low, high, strict=True))
        cases.append(f"WHEN {x} < {q} THEN printf('#%02x%02x%02x', {parts})")
    return "CASE " + " ".join(cases) + " ELSE '#%02x%02x%02x' END" % stops[-1][1]


@query(OBSERVATIONS, layer_sql(YEAR), sql=f" SELECT indicator_id, district_id, CASE WHEN intensity IS NULL THEN '#1b2338' ELSE {_ramp_sql('s', colour.VOLUME_COLOURS)} END AS fill, CASE WHEN yoy IS NULL THEN '#5a6588' ELSE {_ramp_sql('g', colour.PERFORMANCE_COLOURS)} END AS edge FROM (SELECT *, sqrt(greatest(0.0, least(1.0, intensity))) AS s, 1 + greatest(-20.0, least(20.0, yoy)) / 20 * 0.18 AS g FROM layer)")
def map_colours(spark, sf_dir):
    return _layer(spark, sf_dir).select("indicator_id", "district_id", colour.volume(F.col("intensity")).alias("fill"), colour.growth(F.col("yoy")).alias("edge"))


def _macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.when(F.col("indicator_id") == "BUILDING", "JAO").when(F.col("indicator_id") == "MACHINERY", "Eksport").otherwise("Sanaat")
    rows = series.national_series(tables.observations(spark, sf_dir)).where("indicator_id in ('BUILDING', 'MACHINERY', 'FURNITURE')")
    return rows.select(names.alias("indicator"), "year", "value")


MACRO = "macro AS (SELECT CASE indicator_id WHEN 'BUILDING' THEN 'JAO' WHEN 'MACHINERY' THEN 'Eksport' ELSE 'Sanaat' END AS indicator, year, value FROM points WHERE indicator_id IN ('BUILDING', 'MACHINERY', 'FURNITURE'))"


TOPICS = "topics AS (SELECT * FROM (VALUES " + ", ".join("('" + k.replace("'", "''") + f"', '{t}')" for k, t in TOPIC_KEYWORDS.items()) + ") t(word, indicator))"
PROMPTS = ["gdp 1999, 2000?", "sanoat va eksport", "salem", "Eksport 2012-jıl, 2019?"]


@query(OBSERVATIONS, series_sql(False), MACRO, TOPICS, sql=f""" , said AS (SELECT conv_id || '-' || turn AS id, text FROM conversations UNION ALL SELECT 'p' || i, p FROM (SELECT unnest({PROMPTS}) AS p, unnest(range(4)) AS i)),
hits AS (SELECT DISTINCT id, indicator FROM said JOIN topics ON contains(lower(text), word)),
asked AS (SELECT s.id, coalesce(h.indicator, 'JAO') AS indicator, CAST(regexp_extract_all(text, '\\b20[12][0-9]\\b')[-1] AS INT) AS y FROM said s LEFT JOIN hits h USING (id))
SELECT id, indicator, year, value FROM asked JOIN (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY year DESC) AS back FROM macro) USING (indicator) WHERE CASE WHEN y IS NOT NULL THEN year = y ELSE back <= 4 END""")
def retrieved_figures(spark, sf_dir):
    turns = tables.read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("prompt"))
    more = spark.createDataFrame([(f"p{i}", p) for i, p in enumerate(PROMPTS)], "id string, prompt string")
    return retrieval.figures(turns.unionByName(more), _macro(spark, sf_dir))


@query(OBSERVATIONS, series_sql(False), MACRO, sql=""" , x AS (SELECT m.*, b.value AS base, w.value AS whole FROM macro m LEFT JOIN macro b ON b.indicator = m.indicator AND b.year = m.year - 1 LEFT JOIN macro w ON w.indicator = 'JAO' AND w.year = m.year)
SELECT indicator, year, count(*) + count(base) + count(CASE WHEN indicator <> 'JAO' THEN whole END) AS n FROM x GROUP BY 1, 2""")
def training_pairs(spark, sf_dir):
    return retrieval.training_pairs(_macro(spark, sf_dir)).groupBy("indicator", "year").agg(F.count("*").alias("n"))


@query(INDICATORS, sql=" SELECT id FROM inds WHERE module NOT IN ('m1', 'm3')")
def without_legacy(spark, sf_dir):
    legacy = spark.createDataFrame([("m1",), ("m3",)], "id string")
    return reference.without_legacy(tables.indicators(spark, sf_dir), legacy, "module").select("id")


@query(sql=" SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'new ' || n_name ELSE n_name END AS name FROM nation UNION ALL SELECT 1000, 'added'")
def seeded_dimension(spark, sf_dir):
    old = tables.read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    fixed = old.where("id % 2 = 0").withColumn("name", F.concat(F.lit("new "), "name")).unionByName(spark.createDataFrame([(1000, "added")], "id int, name string"))
    return reference.seeded(old, fixed, "id")


@query(sql=" SELECT c_custkey, CASE WHEN abs(v) >= 1000000 THEN 'mln' WHEN abs(v) >= 1000 THEN 'ming' ELSE '' END AS size, greatest(0, least(100, v)) AS clamped FROM (SELECT c_custkey, c_acctbal AS v FROM customer)")
def compact_numbers(spark, sf_dir):
    v = F.col("c_acctbal")
    rows = tables.read(spark, sf_dir, "customer").select("c_custkey", numbers.compact(v).alias("t"), numbers.clamp(v, 0.0, 100.0).alias("clamped"))
    return rows.select("c_custkey", F.regexp_extract("t", r"(ming|mln)?$", 1).alias("size"), "clamped")


@query(PANEL, sql=" SELECT district_id, min_by(year, -abs(active) * 100000 + year) AS peak FROM panel GROUP BY 1")
def peak_year(spark, sf_dir):
    return panel.peak(tables.panel(spark, sf_dir), "district_id", "year", "active")


@query(PANEL, sql=" SELECT district_id, year, active FROM panel WHERE active > 80 AND active < 200 AND district_id IN (SELECT district_id FROM panel WHERE active > 80 AND active < 200 GROUP BY 1 HAVING count(*) >= 3)")
def enough_values(spark, sf_dir):
    return panel.enough(tables.panel(spark, sf_dir).select("district_id", "year", "active"), "district_id", "active", 3, 80, 200)


ORIGINS = (1995, 1996, 1997)
#: Forecasts of the closed-form configurations from each origin, and what came in the two years after.
BACKTESTS = f"""backtests AS (SELECT f.district_id, configuration, origin, CAST(p.year AS INT) AS year, CAST(p.active AS DOUBLE) AS actual,
    CASE configuration WHEN 'last' THEN last WHEN 'drift' THEN last + (last - first) / (last_year - first_year) * (p.year - last_year) ELSE a + b * p.year END AS yhat
  FROM (SELECT district_id, origin, arg_max(v, year) AS last, max(year) AS last_year, arg_min(v, year) AS first, min(year) AS first_year, regr_slope(v, year) AS b, regr_intercept(v, year) AS a
    FROM (SELECT district_id, CAST(o AS INT) AS origin, year, CAST(active AS DOUBLE) AS v FROM panel, (SELECT unnest({list(ORIGINS)}) AS o) WHERE year <= o) GROUP BY ALL HAVING count(*) >= 2) f
  JOIN panel p ON p.district_id = f.district_id AND p.year > origin AND p.year <= origin + 2, (SELECT unnest(['last', 'drift', 'line']) AS configuration))"""


@query(PANEL, BACKTESTS, sql=" SELECT district_id, configuration, origin, year, actual, round(yhat, 6) + 0.0::DOUBLE AS yhat FROM backtests")
def backtests(spark, sf_dir):
    rows = backtest.backtested(tables.panel(spark, sf_dir), "district_id", "active", origins=ORIGINS, horizon=2)
    return rows.withColumn("yhat", F.round("yhat", 6) + 0.0)


@query(PANEL, BACKTESTS, sql=""" SELECT district_id, arg_min(configuration, struct_pack(a := mape, b := configuration)) AS configuration, round(min(mape), 6) AS mape FROM
  (SELECT district_id, configuration, round(avg(abs(actual - yhat) / abs(actual)) * 100, 9) AS mape FROM backtests GROUP BY 1, 2) GROUP BY 1""")
def best_configuration(spark, sf_dir):
    return backtest.chosen(tables.panel(spark, sf_dir), "district_id", "active", origins=ORIGINS, horizon=2).withColumn("mape", F.round("mape", 6))


@query(PLANS, sql=" SELECT id FROM plans WHERE module = 'BUILDING' AND status = 'critical'")
def plan_rows(spark, sf_dir):
    return plan_actual.plan_rows(tables.plans(spark, sf_dir), module="BUILDING", status="critical").select("id")


@query(OBSERVATIONS, layer_sql(YEAR), sql=" SELECT indicator_id, count(*) AS lines, string_agg(name, ',' ORDER BY name) AS names FROM layer WHERE value IS NOT NULL GROUP BY 1")
def answer_context(spark, sf_dir):
    lines = questions.context(tables.observations(spark, sf_dir), tables.districts(spark, sf_dir), YEAR)
    name = F.split("line", r" \| ")[1]
    return lines.groupBy("indicator_id").agg(F.count("*").alias("lines"), F.array_join(F.sort_array(F.collect_list(name)), ",").alias("names"))


# --- small things --------------------------------------------------------------------------------


@query(PANEL, sql=" SELECT district_id, round(quantile_cont(active, 0.05), 9) AS low, round(quantile_cont(active, 0.95), 9) AS high, round(avg(ln(1 + active)), 9) AS mean_log FROM panel GROUP BY 1")
def percentile_bounds(spark, sf_dir):
    rows = panel.bounds(tables.panel(spark, sf_dir), "district_id", "active")
    return rows.select("district_id", *[F.round(c, 9).alias(c) for c in ("low", "high", "mean_log")])


@query(PANEL, sql=" SELECT district_id, year, year IN (1999, 2000) AS test FROM panel")
def train_test_split(spark, sf_dir):
    train, test = panel.split_by_years(tables.panel(spark, sf_dir), [1999, 2000])
    return train.select("district_id", "year", F.lit(False).alias("test")).unionByName(test.select("district_id", "year", F.lit(True).alias("test")))


@query(PANEL, sql=" SELECT district_id, 1995 AS year, max(active) FILTER (WHERE year = 1995) AS a, max(employed) FILTER (WHERE year = 1995) AS b FROM panel GROUP BY 1 HAVING a IS NOT NULL UNION ALL SELECT district_id, 1998, max(active) FILTER (WHERE year = 1998), max(employed) FILTER (WHERE year = 1998) AS b FROM panel GROUP BY 1 HAVING max(active) FILTER (WHERE year = 1998) IS NOT NULL")
def year_chunks(spark, sf_dir):
    years = (1995, 1998)
    rows = tables.panel(spark, sf_dir).groupBy("district_id").agg(*[F.max(F.when(F.col("year") == y, F.col(c))).alias(f"{c}{y}") for y in years for c in ("active", "employed")])
    return panel.chunks_to_rows(rows, "district_id", {y: [f"active{y}", f"employed{y}"] for y in years}, ["a", "b"])


@query(sql=" SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders")
def short_dates(spark, sf_dir):
    return tables.read(spark, sf_dir, "orders").select("o_orderkey", numbers.short_date(F.col("o_orderdate")).alias("day"))


@query(OBSERVATIONS, layer_sql(YEAR), sql=" SELECT indicator_id, string_agg(name, ',' ORDER BY rank) AS highlights FROM layer WHERE rank <= 5 GROUP BY 1")
def highlights(spark, sf_dir):
    return map_layer.highlights(_layer(spark, sf_dir)).withColumn("highlights", F.array_join("highlights", ","))


@query(INDICATORS, sql=" SELECT category_id, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM inds GROUP BY 1")
def page_counts(spark, sf_dir):
    return catalog.page_counts(tables.indicators(spark, sf_dir), 50, "category_id")


@query(sql=" SELECT event_type, date_trunc('hour', ts)::VARCHAR AS began, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from ..streaming.uploads import event_counts

    rows = event_counts(tables.read(spark, sf_dir, "events"))
    return rows.select("event_type", F.col("window.start").cast("string").alias("began"), "n")
