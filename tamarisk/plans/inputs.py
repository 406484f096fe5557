"""The driver's tables read as hazard data, once as DataFrames and once as SQL common table expressions.

Suppliers stand for districts, nations for provinces, regions for countries; line items for daily readings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.operators.raster import Grid

#: Fine population grid, and the coarse daily grid over the same ground.
FINE, COARSE = Grid(0.0, 20.0, 1.0, 1.0, 20, 40), Grid(0.0, 20.0, 4.0, 4.0, 5, 10)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def districts(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    found = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return found.select(F.col("r_name").alias("adm0_en"), F.col("n_name").alias("adm1_en"), F.col("n_nationkey").alias("adm1_pcode"), F.col("s_name").alias("adm2_en"), F.col("s_suppkey").alias("adm2_pcode"))


def population(spark: SparkSession, d: str) -> DataFrame:
    """Population by district: adm1_en, adm1_pcode, adm2_en, adm2_pcode, pop."""
    total = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("adm2_pcode")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("pop"))
    return districts(spark, d).join(total, "adm2_pcode", "left").select("adm1_en", "adm1_pcode", "adm2_en", "adm2_pcode", "pop")


def exposure(spark: SparkSession, d: str) -> DataFrame:
    """Exposed population by district and year: adm columns, stat, date, pop_exposed; null where a reading has no tax."""
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("adm2_pcode"), F.col("l_shipdate").cast("date").alias("day"), "l_extendedprice", "l_discount", "l_tax")
    exposed = F.sum(F.when(F.col("l_tax") != 0, F.col("l_extendedprice").cast("decimal(18,2)") * F.col("l_discount").cast("decimal(6,2)")))
    yearly = l.groupBy("adm2_pcode", F.trunc("day", "year").alias("date")).agg(exposed.cast("double").alias("pop_exposed"))
    return districts(spark, d).join(yearly, "adm2_pcode").select("adm0_en", "adm1_en", "adm1_pcode", "adm2_en", "adm2_pcode", F.lit("sum").alias("stat"), "date", "pop_exposed")


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily flood fraction on the coarse grid: date, row, col, value; null for some readings of three cells.

    A reading is at most a share of 1 that depends on cell and year, so yearly maxima differ. All are multiples of
    1/128, whose sums with bilinear weights are exact.
    """
    at = (F.col("l_partkey") % 50).cast("int")
    l = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.floor(at / 10).cast("int").alias("row"), (at % 10).alias("col"), at.alias("at"), "l_orderkey", F.round(F.col("l_discount") * 100).cast("int").alias("tenths"))
    most = (F.col("col") + 2 * F.col("row") + F.year("date")) % 12 + 1
    unknown = (F.col("l_orderkey") % 101 == 0) & (F.col("at") % 17 == 3)
    return l.select("date", "row", "col", F.when(~unknown, F.col("tenths") * most / 128.0).alias("value"))


def people(spark: SparkSession, d: str) -> DataFrame:
    """Population on the fine grid: row, col, pop; cells without parts are absent."""
    at = (F.col("p_partkey") % 800).cast("int")
    return table(spark, d, "part").groupBy(F.floor(at / 40).cast("int").alias("row"), (at % 40).alias("col")).agg(F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("double").alias("pop"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box for each nation."""
    n = table(spark, d, "nation")
    i, j = F.col("n_nationkey") % 5, F.floor(F.col("n_nationkey") / 5)
    return n.select("n_nationkey", F.col("n_name").alias("adm1_en"), (i * 8 + 0.25).cast("double").alias("xmin"), (i * 8 + 7.6).cast("double").alias("xmax"), (20 - (j * 4 + 3.3)).cast("double").alias("ymin"), (20 - (j * 4 + 0.5)).cast("double").alias("ymax"))


def rain(spark: SparkSession, d: str) -> DataFrame:
    """Dekadal rain as text columns with a row of tags, as the files have it."""
    l = table(spark, d, "lineitem")
    text = l.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_suppkey").cast("string").alias("adm2_pcode"), F.col("l_quantity").cast("string").alias("r1h"), F.when(F.col("l_tax") == 0, "none").otherwise(F.col("l_extendedprice").cast("string")).alias("r1h_avg"), F.col("l_discount").cast("string").alias("r1q"))
    tags = l.sparkSession.createDataFrame([("#date", "#adm2+code", "#indicator+rfh+num", "#indicator+rfh_avg+num", "#indicator+rfq+pct")], text.schema)
    return text.unionByName(tags)


def phases(spark: SparkSession, d: str) -> DataFrame:
    """Food-insecurity phase rows: country, level1, from, phase, validity_period, number, total_country_population."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    found = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return found.select(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("level_1"), F.col("o_orderdate").cast("date").alias("from"), F.col("o_orderpriority").alias("phase"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("validity_period"), F.col("o_totalprice").cast("string").alias("number"), F.col("c_acctbal").cast("string").alias("total_country_population"))


CTES = {
    "adm": "adm AS (SELECT r_name AS adm0_en, n_name AS adm1_en, n_nationkey AS adm1_pcode, s_name AS adm2_en, s_suppkey AS adm2_pcode FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "pops": "pops AS (SELECT adm1_en, adm1_pcode, adm2_en, adm2_pcode, pop FROM adm LEFT JOIN (SELECT l_suppkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS pop FROM lineitem GROUP BY 1) ON l_suppkey = adm2_pcode)",
    "expo": "expo AS (SELECT adm0_en, adm1_en, adm1_pcode, adm2_en, adm2_pcode, 'sum' AS stat, date, pop_exposed FROM adm JOIN (SELECT l_suppkey, CAST(date_trunc('year', CAST(l_shipdate AS DATE)) AS DATE) AS date, CAST(sum(CASE WHEN l_tax <> 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(6,2)) END) AS DOUBLE) AS pop_exposed FROM lineitem GROUP BY 1, 2) ON l_suppkey = adm2_pcode)",
    "daily": """daily AS (SELECT date, "row", col, CASE WHEN l_orderkey % 101 <> 0 OR cell % 17 <> 3 THEN CAST(tenths * ((col + 2 * "row" + year(date)) % 12 + 1) AS DOUBLE) / 128 END AS value
  FROM (SELECT CAST(l_shipdate AS DATE) AS date, l_partkey % 50 AS cell, CAST((l_partkey % 50) // 10 AS INTEGER) AS "row", CAST(l_partkey % 10 AS INTEGER) AS col, l_orderkey, CAST(round(l_discount * 100) AS INTEGER) AS tenths FROM lineitem))""",
    "people": 'people AS (SELECT CAST((p_partkey % 800) // 40 AS INTEGER) AS "row", CAST(p_partkey % 40 AS INTEGER) AS col, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS pop FROM part GROUP BY 1, 2)',
    "boxes": "boxes AS (SELECT n_nationkey, n_name AS adm1_en, CAST(n_nationkey % 5 * 8 + 0.25 AS DOUBLE) AS xmin, CAST(n_nationkey % 5 * 8 + 7.6 AS DOUBLE) AS xmax, CAST(20 - (n_nationkey // 5 * 4 + 3.3) AS DOUBLE) AS ymin, CAST(20 - (n_nationkey // 5 * 4 + 0.5) AS DOUBLE) AS ymax FROM nation)",
    "rain": "rain AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, l_suppkey AS adm2_pcode, CAST(l_quantity AS DOUBLE) AS r1h, CASE WHEN l_tax <> 0 THEN l_extendedprice END AS r1h_avg, l_discount AS r1q FROM lineitem)",
    "phases": "phases AS (SELECT n_name AS country, c_mktsegment AS level_1, CAST(o_orderdate AS DATE) AS \"from\", o_orderpriority AS phase, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS validity_period, o_totalprice AS number, c_acctbal AS total_country_population FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
}


def ctes(*names: str) -> str:
    return ", ".join(CTES[n] for n in names)
