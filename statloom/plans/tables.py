"""The driver's tables as observations, indicators, districts, plans, tasks and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
#: Market segments that also have national rows, from this year on.
NATIONAL, NATIONAL_FROM = "MACHINERY", 1997


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as districts; their region as category."""
    return read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("district_id"), F.col("n_name").alias("name"), F.col("n_name").alias("name_ru"), F.col("n_regionkey").cast("string").alias("region_id")
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = read(spark, sf_dir, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.col("o_totalprice").cast(MONEY).alias("value")
    )
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    # One aggregation to months; all periods are made from these few rows.
    return rows.groupBy(F.col("c_mktsegment").alias("indicator_id"), F.col("c_nationkey").cast("string").alias("district_id"), "year", "month").agg(F.sum("value").cast(MONEY).alias("value"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by segment, nation and period.

    Full years, and for the year that ends early year-to-date rows of 3 months and of all
    its months; quarters of 2000; national rows of one segment.
    """
    months = _orders(spark, sf_dir).withColumn("last", F.max("month").over(Window.partitionBy("year")))
    no = F.lit(None).cast("int")
    spans = F.array(
        F.when(F.col("last") == 12, F.struct(F.lit("year").alias("period"), no.alias("period_no"))),
        F.when((F.col("last") < 12) & (F.col("month") <= 3), F.struct(F.lit("ytd").alias("period"), F.lit(3).alias("period_no"))),
        F.when(F.col("last") < 12, F.struct(F.lit("ytd").alias("period"), F.col("last").alias("period_no"))),
        F.when(F.col("year") == 2000, F.struct(F.lit("quarter").alias("period"), F.ceil(F.col("month") / 3).cast("int").alias("period_no"))),
    )
    spanned = months.select("indicator_id", "district_id", "year", "value", F.inline(F.filter(spans, lambda s: s.isNotNull())))
    keys = ["year", "period", "period_no"]
    by_district = spanned.groupBy("indicator_id", "district_id", *keys).agg(F.sum("value").cast(MONEY).alias("value"))
    nation = by_district.where((F.col("indicator_id") == NATIONAL) & (F.col("year") >= NATIONAL_FROM)).groupBy("indicator_id", *keys).agg(F.sum("value").cast(MONEY).alias("value"))
    return by_district.unionByName(nation.withColumn("district_id", F.lit(None).cast("string")))


OBSERVATIONS = """
months AS (
  SELECT c_mktsegment AS indicator_id, CAST(c_nationkey AS VARCHAR) AS district_id, CAST(year(o_orderdate) AS INT) AS year,
    CAST(month(o_orderdate) AS INT) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
lasts AS (SELECT year, max(month) AS last FROM months GROUP BY year),
spanned AS (
  SELECT m.*, 'year' AS period, CAST(NULL AS INT) AS period_no FROM months m JOIN lasts USING (year) WHERE last = 12
  UNION ALL SELECT m.*, 'ytd', 3 FROM months m JOIN lasts USING (year) WHERE last < 12 AND month <= 3
  UNION ALL SELECT m.*, 'ytd', last FROM months m JOIN lasts USING (year) WHERE last < 12
  UNION ALL SELECT m.*, 'quarter', CAST(ceil(month / 3.0) AS INT) FROM months m WHERE year = 2000),
by_district AS (
  SELECT indicator_id, district_id, year, period, period_no, CAST(sum(value) AS DECIMAL(18,2)) AS value FROM spanned GROUP BY ALL),
obs AS (
  SELECT * FROM by_district
  UNION ALL SELECT indicator_id, NULL, year, period, period_no, CAST(sum(value) AS DECIMAL(18,2))
  FROM by_district WHERE indicator_id = 'MACHINERY' AND year >= 1997 GROUP BY ALL),
districts AS (SELECT CAST(n_nationkey AS VARCHAR) AS district_id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region_id FROM nation)
"""


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as indicators: id, name, unit, category, module, whether with districts."""
    size, key = F.col("p_size"), F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        key.alias("id"), F.col("p_name").alias("name"), F.concat("p_brand", F.when(size % 4 == 0, " %").otherwise("")).alias("unit"), F.col("p_type").alias("category_id"),
        F.concat(F.lit("m"), (size % 7).cast("string")).alias("module"), (key % 3 != 0).alias("has_districts"),
    )


def part_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines sold by indicator, supplier nation and year."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("indicator_id"), "l_suppkey", F.year("l_shipdate").alias("year"), F.col("l_quantity").cast(MONEY).alias("value"))
    nations = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("district_id"))
    rows = lines.join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("indicator_id", "district_id", "year").agg(F.sum("value").cast(MONEY).alias("value"))


INDICATORS = """
inds AS (
  SELECT p_partkey AS id, p_name AS name, p_brand || CASE WHEN p_size % 4 = 0 THEN ' %' ELSE '' END AS unit, p_type AS category_id,
    'm' || CAST(p_size % 7 AS VARCHAR) AS module, p_partkey % 3 <> 0 AS has_districts FROM part),
pobs AS (
  SELECT l_partkey AS indicator_id, CAST(s_nationkey AS VARCHAR) AS district_id, CAST(year(l_shipdate) AS INT) AS year,
    CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
"""


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan (balance of customers) and actual (theirs less 500), some zero, some null, by segment and nation."""
    c = read(spark, sf_dir, "customer")
    planned = F.col("c_acctbal").cast(MONEY)
    return c.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 50 != 0, F.col("c_mktsegment")).alias("module"),
        F.col("c_nationkey").cast("string").alias("region"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit(0).cast(MONEY)).when(F.col("c_custkey") % 11 != 0, planned).alias("planned"),
        F.when(F.col("c_custkey") % 13 == 0, F.lit(0).cast(MONEY)).when(F.col("c_custkey") % 17 != 0, (planned - 500).cast(MONEY)).alias("actual"),
        F.get(F.array(*map(F.lit, ("completed", "in_progress", "at_risk", "critical", "unknown"))), (F.col("c_custkey") % 5).cast("int")).alias("status"),
    )


PLANS = """
plans AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 50 <> 0 THEN c_mktsegment END AS module, CAST(c_nationkey AS VARCHAR) AS region,
    CASE WHEN c_custkey % 7 = 0 THEN CAST(0 AS DECIMAL(18,2)) WHEN c_custkey % 11 <> 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS planned,
    CASE WHEN c_custkey % 13 = 0 THEN CAST(0 AS DECIMAL(18,2)) WHEN c_custkey % 17 <> 0 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) - 500 AS DECIMAL(18,2)) END AS actual,
    ['completed', 'in_progress', 'at_risk', 'critical', 'unknown'][c_custkey % 5 + 1] AS status
  FROM customer)
"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks."""
    o = read(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("district"), F.col("o_orderpriority").alias("module"), (F.col("o_orderkey") % 101).cast("int").alias("progress"),
        F.to_date("o_orderdate").alias("deadline"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "in_progress").otherwise("at_risk").alias("status"),
    )


TASKS = """
tasks AS (
  SELECT o_orderkey AS id, o_custkey AS district, o_orderpriority AS module, CAST(o_orderkey % 101 AS INT) AS progress, CAST(o_orderdate AS DATE) AS deadline,
    CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'in_progress' ELSE 'at_risk' END AS status FROM orders)
"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each nation and year as labour: active all, employed the settled ones."""
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("year"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("district_id"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("district_id", "year").agg(
        F.count("*").alias("active"), F.count_if(F.col("o_orderstatus") != "P").alias("employed"), F.count_if(F.col("o_orderstatus") == "P").alias("unemployed")
    )
    return rows.withColumn("rate", F.col("unemployed").cast("double") / F.col("active") * 10)


PANEL = """
panel AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS district_id, CAST(year(o_orderdate) AS INT) AS year, count(*) AS active,
    count(*) FILTER (WHERE o_orderstatus <> 'P') AS employed, count(*) FILTER (WHERE o_orderstatus = 'P') AS unemployed,
    CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) / count(*) * 10 AS rate
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
"""


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each nation and quarter; quarters are numbered on, as ``year``: series long enough to learn from."""
    o = read(spark, sf_dir, "orders").select("o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).alias("year"))
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("district_id"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("district_id", "year").agg(F.count("*").alias("active"))
