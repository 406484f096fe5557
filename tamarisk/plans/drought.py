"""Rainy seasons: provincial medians of dekadal rain and vegetation, seasons, ranks and return periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.functions import dates, stats, text
from tamarisk.operators import ordered, relational
from tamarisk.plans import inputs
from tamarisk.plans.inputs import ctes

# Seasons shown apart from the long-term average, and years of the rain and vegetation records.
HIGHLIGHTED = ("2015/2016", "2022/2023", "2023/2024")
RAIN_YEARS, NDVI_YEARS = 45, 23
#: Districts up to which their table, of some 100 bytes a row, is broadcast.
BROADCAST_ROWS = 1 << 20

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def put(f):
        QUERIES[f"q_{f.__name__}"], ORACLE[f"q_{f.__name__}"] = f, sql
        return f

    return put


def province_medians(readings: DataFrame, dims: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Median of each measure (new name: text column) by province and date; what is no number counts as unknown."""
    few = dims.count() <= BROADCAST_ROWS
    joined = relational.join_suffixed(readings, F.broadcast(dims) if few else dims, ["adm2_pcode"], "_shp")
    numbers = joined.withColumns({c: stats.as_number(F.col(c)) for c in measures.values()})
    return ordered.medians(numbers, ["adm1_pcode", "adm1_pt", "date"], {n: F.col(c) for n, c in measures.items()})


def in_season(df: DataFrame, dekads: tuple[str, ...] = ("21",)) -> DataFrame:
    """Rows of the season's months and these dekads, with the months' places in the season."""
    kept = df.where(F.col("dekad_start").isin(*dekads) & F.col("month_name").isin(*dates.SEASON_MONTHS))
    return kept.withColumn("month_name_ord", dates.ordinal(F.col("month_name"), dates.SEASON_MONTHS))


def highlighted(df: DataFrame, value: str, average: str, seasons: tuple[str, ...] = HIGHLIGHTED) -> DataFrame:
    """Adds the season, or Long Term Average for all but a few, and the value to show for it."""
    own = F.coalesce(F.col("season").isin(*seasons), F.lit(False))
    return df.withColumns({"highlighted_ssn": F.when(own, F.col("season")).otherwise("Long Term Average"), "ssn_values": F.when(own, F.col(value)).otherwise(F.col(average))})


def month_dekad(df: DataFrame) -> DataFrame:
    label = F.concat_ws(" ", F.substring("month_name", 1, 3), F.col("dekad_start"))
    return df.withColumns({"mon_dekad": label, "mon_dekad_ord": dates.ordinal(label, dates.MONTH_DEKADS)})


def season_totals(df: DataFrame, by: list[str], total: Column) -> DataFrame:
    """One figure a season, without its last month."""
    return df.where(F.col("month_name") != "March").groupBy(*by, "season").agg(total.alias("adm1_ssn_avg"))


def national_ranks(totals: DataFrame) -> DataFrame:
    """Median over provinces by season, and its rank among the seasons."""
    national = ordered.medians(totals, ["season"], {"moz_ssn_avg": F.col("adm1_ssn_avg")})
    return ordered.ranked(national, [], "moz_ssn_avg")


def return_periods(df: DataFrame, by: list[str], value: str, years: int) -> DataFrame:
    """Rank, mean, sd, normal probability and the two return-period labels of a value within `by`."""
    w = Window.partitionBy(*by)
    x = F.col(value)
    out = df.withColumns({"rank": stats.rank_mean_ties(x, [F.col(c) for c in by]), "mean": stats.mean_strict_over(x, w), "sd": stats.sd_strict_over(x, w)})
    out = out.withColumn("prob", stats.normal_cdf(x, F.col("mean"), F.col("sd")))
    by_prob = F.when(F.col("prob") == 0, text.paste(F.lit("1 in "), F.lit("Inf"), F.lit(" yr"))).otherwise(text.return_period(stats.round_even(stats.ratio(F.lit(1.0), F.col("prob")))))
    return out.withColumns({"rp": by_prob, "rp_rank": text.return_period(stats.round_even(F.lit(float(years)) / F.col("rank")))})


def label_points(df: DataFrame, day: str) -> DataFrame:
    """Rows of one date, written yyyy-MM-dd, to label on a chart."""
    return df.where(F.col("date") == day)


# ---- queries -----------------------------------------------------------------------------------------------------


def _dims(spark: SparkSession, d: str) -> DataFrame:
    return inputs.districts(spark, d).select(F.col("adm2_pcode").cast("string").alias("adm2_pcode"), F.col("adm1_pcode"), F.col("adm1_en").alias("adm1_pt"))


_RAIN = {"adm1_tot_med": "r1h", "adm1_avg_med": "r1h_avg", "adm1_anom_med": "r1q"}
_NDVI = {"adm1_val_med": "r1h_avg", "adm1_lta_med": "r1h"}


def _rain(spark: SparkSession, d: str) -> DataFrame:
    readings = relational.drop_tag_rows(inputs.rain(spark, d), "date")
    return dates.season_columns(province_medians(readings, _dims(spark, d), _RAIN))


def _ndvi(spark: SparkSession, d: str) -> DataFrame:
    readings = relational.drop_tag_rows(inputs.rain(spark, d), "date")
    return month_dekad(in_season(dates.season_columns(province_medians(readings, _dims(spark, d), _NDVI)), dates.DEKADS))


_MED = f"""WITH {ctes('adm', 'rain')}, med AS (
  SELECT adm1_pcode, adm1_en AS adm1_pt, date, median(r1h) AS adm1_tot_med, median(r1h_avg) AS adm1_avg_med, median(r1q) AS adm1_anom_med FROM rain LEFT JOIN adm USING (adm2_pcode) GROUP BY 1, 2, 3
), parts AS (SELECT *, substr(date, 9, 2) AS dekad_start, CAST(substr(date, 6, 2) AS INTEGER) AS month, CAST(substr(date, 1, 4) AS INTEGER) AS yr FROM med
), bucket AS (SELECT *, monthname(make_date(yr, month, 1)) AS month_name, CASE WHEN month >= 10 THEN yr || '/' || (yr + 1) WHEN month <= 3 THEN (yr - 1) || '/' || yr END AS season FROM parts
), season AS (SELECT *, CASE month_name WHEN 'October' THEN 1 WHEN 'November' THEN 2 WHEN 'December' THEN 3 WHEN 'January' THEN 4 WHEN 'February' THEN 5 ELSE 6 END AS month_name_ord FROM bucket WHERE dekad_start = '21' AND (month >= 10 OR month <= 3)
), veg AS (SELECT adm1_pcode, adm1_pt, date, adm1_avg_med AS adm1_val_med, adm1_tot_med AS adm1_lta_med, season, month_name, dekad_start, yr, substr(month_name, 1, 3) || ' ' || dekad_start AS mon_dekad FROM bucket WHERE dekad_start IN ('01', '11', '21') AND (month >= 10 OR month <= 3))"""


@query(f"{_MED} SELECT adm1_pcode, adm1_pt, date, round(adm1_tot_med, 6) AS adm1_tot_med, round(adm1_avg_med, 6) AS adm1_avg_med, round(adm1_anom_med, 6) AS adm1_anom_med FROM med")
def rain_adm1_median(spark: SparkSession, d: str) -> DataFrame:
    return _rain(spark, d).select("adm1_pcode", "adm1_pt", "date", *[F.round(c, 6).alias(c) for c in _RAIN])


@query(f"{_MED} SELECT adm1_pcode, date, dekad_start, month, month_name, substr(month_name, 1, 3) AS month_abb, yr, season FROM bucket")
def season_bucket(spark: SparkSession, d: str) -> DataFrame:
    return _rain(spark, d).select("adm1_pcode", "date", "dekad_start", "month", "month_name", "month_abb", "yr", "season")


@query(f"{_MED} SELECT adm1_pcode, date, month_name, CAST(month_name_ord AS INTEGER) AS month_name_ord, season FROM season")
def season_filter(spark: SparkSession, d: str) -> DataFrame:
    return in_season(_rain(spark, d)).select("adm1_pcode", "date", "month_name", "month_name_ord", "season")


@query(f"""{_MED} SELECT adm1_pcode, date, season, CASE WHEN season IN ('1996/1997', '1998/1999') THEN season ELSE 'Long Term Average' END AS highlighted_ssn,
  round(CASE WHEN season IN ('1996/1997', '1998/1999') THEN adm1_tot_med ELSE adm1_avg_med END, 6) AS ssn_values FROM season""")
def highlight(spark: SparkSession, d: str) -> DataFrame:
    shown = highlighted(in_season(_rain(spark, d)), "adm1_tot_med", "adm1_avg_med", ("1996/1997", "1998/1999"))
    return shown.select("adm1_pcode", "date", "season", "highlighted_ssn", F.round("ssn_values", 6).alias("ssn_values"))


@query(f"{_MED} SELECT adm1_pt, date, round(adm1_anom_med, 6) AS adm1_anom_med FROM season WHERE date = '1998-02-21'")
def label_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return label_points(in_season(_rain(spark, d)), "1998-02-21").select("adm1_pt", "date", F.round("adm1_anom_med", 6).alias("adm1_anom_med"))


@query(f"""{_MED}, t AS (SELECT adm1_pt, season, coalesce(sum(adm1_tot_med), 0) AS x FROM season WHERE month_name <> 'March' GROUP BY 1, 2), n AS (SELECT season, median(x) AS m FROM t GROUP BY 1)
SELECT season, round(m, 6) AS moz_ssn_avg, CAST(rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS DOUBLE) AS rank FROM n""")
def nat_rank(spark: SparkSession, d: str) -> DataFrame:
    totals = season_totals(in_season(_rain(spark, d)), ["adm1_pt"], stats.sum_known(F.col("adm1_tot_med")))
    return national_ranks(totals).withColumn("moz_ssn_avg", F.round("moz_ssn_avg", 6))


def _cdf_sql(x: str, mean: str, sd: str) -> str:
    def horner(c: tuple[float, ...]) -> str:
        out = repr(c[0])
        for k in c[1:]:
            out = f"({out} * z + {k!r})"
        return out

    z = f"abs(({x} - {mean}) / nullif({sd}, 0))"
    tail = f"(SELECT CASE WHEN z > 37 THEN 0.0 WHEN z < 7.07106781186547 THEN exp(-z * z / 2) * {horner(stats.NORMAL_N)} / {horner(stats.NORMAL_D)} ELSE exp(-z * z / 2) / (z + 1.0 / (z + 2.0 / (z + 3.0 / (z + 4.0 / (z + 0.65))))) / 2.506628274631 END FROM (SELECT CAST({z} AS DOUBLE) AS z))"
    return f"CASE WHEN {sd} = 0 THEN CASE WHEN {x} < {mean} THEN 0.0 ELSE 1.0 END WHEN {x} > {mean} THEN 1 - {tail} ELSE {tail} END"


def _periods_sql(source: str, by: str, x: str, years: int, more: str) -> str:
    return f""", w AS (SELECT *, CASE WHEN {x} IS NOT NULL THEN CAST(rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 AS DOUBLE) END AS rank,
  CASE WHEN count({x}) OVER (PARTITION BY {by}) = count(*) OVER (PARTITION BY {by}) THEN avg({x}) OVER (PARTITION BY {by}) END AS mean, CASE WHEN count({x}) OVER (PARTITION BY {by}) = count(*) OVER (PARTITION BY {by}) THEN stddev_samp({x}) OVER (PARTITION BY {by}) END AS sd FROM {source}
), p AS (SELECT *, {_cdf_sql(x, 'mean', 'sd')} AS prob FROM w)
SELECT {more}, round({x}, 6) AS value, rank, round(mean, 6) AS mean, round(sd, 6) AS sd, round(prob, 9) AS prob,
  '1 in  ' || CASE WHEN prob = 0 THEN 'Inf' ELSE coalesce(CAST(CAST(round_even(1.0 / prob, 0) AS BIGINT) AS VARCHAR), 'NA') END || '  yr' AS rp,
  '1 in  ' || coalesce(CAST(CAST(round_even({years}.0 / rank, 0) AS BIGINT) AS VARCHAR), 'NA') || '  yr' AS rp_rank FROM p"""


def _periods(df: DataFrame, by: list[str], value: str, years: int, more: list[str]) -> DataFrame:
    out = return_periods(df, by, value, years)
    return out.select(*more, F.round(value, 6).alias("value"), "rank", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("prob", 9).alias("prob"), "rp", "rp_rank")


@query(f"{_MED}, t AS (SELECT adm1_pt, season, coalesce(sum(adm1_tot_med), 0) AS x FROM season WHERE month_name <> 'March' GROUP BY 1, 2)" + _periods_sql("t", "adm1_pt", "x", RAIN_YEARS, "adm1_pt, season"))
def adm1_rank_prob_rp(spark: SparkSession, d: str) -> DataFrame:
    totals = season_totals(in_season(_rain(spark, d)), ["adm1_pt"], stats.sum_known(F.col("adm1_tot_med")))
    return _periods(totals, ["adm1_pt"], "adm1_ssn_avg", RAIN_YEARS, ["adm1_pt", "season"])


@query(f"{_MED}, t AS (SELECT adm1_pt, season, avg(adm1_lta_med) AS x FROM veg WHERE month_name <> 'March' GROUP BY 1, 2)" + _periods_sql("t", "adm1_pt", "x", NDVI_YEARS, "adm1_pt, season"))
def ndvi_rank(spark: SparkSession, d: str) -> DataFrame:
    means = season_totals(_ndvi(spark, d), ["adm1_pt"], F.avg("adm1_lta_med"))
    return _periods(means, ["adm1_pt"], "adm1_ssn_avg", NDVI_YEARS, ["adm1_pt", "season"])


@query(f"{_MED}, t AS (SELECT adm1_pt, mon_dekad, yr, adm1_lta_med AS x FROM veg WHERE mon_dekad = 'Feb 21')" + _periods_sql("t", "adm1_pt, mon_dekad", "x", NDVI_YEARS, "adm1_pt, mon_dekad, yr"))
def dekad_rank(spark: SparkSession, d: str) -> DataFrame:
    one = _ndvi(spark, d).where(F.col("mon_dekad") == "Feb 21")
    return _periods(one, ["adm1_pt", "mon_dekad"], "adm1_lta_med", NDVI_YEARS, ["adm1_pt", "mon_dekad", "yr"])


_LABELS = ", ".join(f"('{label}', {i})" for i, label in enumerate(dates.MONTH_DEKADS, 1))


@query(f"{_MED}, l AS (SELECT * FROM (VALUES {_LABELS}) t(mon_dekad, ord)) SELECT DISTINCT mon_dekad, CAST(ord AS INTEGER) AS mon_dekad_ord FROM veg JOIN l USING (mon_dekad) WHERE (ord - 1) % 3 = 0")
def dekad_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every third of the season's month-and-dekad labels that occur, as an axis shows them."""
    return _ndvi(spark, d).select("mon_dekad", "mon_dekad_ord").distinct().where((F.col("mon_dekad_ord") - 1) % 3 == 0)
