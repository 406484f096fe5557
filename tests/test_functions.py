import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tamarisk.functions import dates, stats, text


def one(df):
    return df.first()[0]


def column(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_sum_of_nothing_is_zero(spark):
    assert one(column(spark, [None]).agg(stats.sum_known(F.col("x")))) == 0


def test_mean_and_max_of_unknown_are_unknown(spark):
    frame = column(spark, [1.0, None])
    assert tuple(frame.agg(stats.mean_strict(F.col("x")), stats.max_strict(F.col("x"))).first()) == (None, None)


def test_median_takes_the_middle_of_two(spark):
    assert one(column(spark, [1.0, 2.0, 4.0, 10.0, None]).agg(F.median("x"))) == 3


def test_rank_shares_ties_and_leaves_null_out(spark):
    ranked = column(spark, [10.0, 20.0, 20.0, 30.0, None]).select("x", stats.rank_mean_ties(F.col("x"), [F.lit(1)]).alias("r"))
    assert sorted((r.x or 99, r.r) for r in ranked.collect()) == [(10, 1), (20, 2.5), (20, 2.5), (30, 4), (99, None)]


def test_halves_round_to_even(spark):
    rows = column(spark, [45 / 2, 45 / 10, 45 / 18, 23 / 2]).select("x", stats.round_even(F.col("x")).alias("r")).collect()
    assert [r.r for r in rows] == [22, 4, 2, 12]


@pytest.mark.parametrize("x", [-8.0, -3.0, -1.0, 0.0, 0.5, 1.96, 4.0, 7.5])
def test_normal_cdf(spark, x):
    got = one(column(spark, [x]).select(stats.normal_cdf(F.col("x"), F.lit(0.0), F.lit(1.0))))
    assert got == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-7, abs=1e-15)


def test_normal_cdf_edges(spark):
    frame = column(spark, [1.0])
    cdf = lambda mean, sd: one(frame.select(stats.normal_cdf(F.col("x"), F.lit(mean), F.lit(sd).cast("double"))))
    assert (cdf(2.0, 0.0), cdf(1.0, 0.0), cdf(1.0, None)) == (0, 1, None)


def test_figures(spark):
    frame = column(spark, [12345.0, 0.01234, 0.0])
    assert [r[0] for r in frame.select(text.three_figures(F.col("x"))).collect()] == ["12,300", "0.0123", "0"]
    assert one(column(spark, [0.1234]).select(text.percent(F.col("x")))) == "12%"
    assert one(column(spark, [5.0]).select(text.return_period(F.col("x")))) == "1 in  5  yr"


def test_bad_numbers_and_ratios(spark):
    frame = spark.createDataFrame([("1.5",), ("x",), ("NaN",)], "x string")
    assert [r[0] for r in frame.select(stats.as_number(F.col("x"))).collect()] == [1.5, None, None]
    assert one(column(spark, [1.0]).select(stats.ratio(F.col("x"), F.lit(0.0)))) is None


def test_t_quantile(spark):
    rows = column(spark, [0, 3, 10, 100], "int").select(stats.t_quantile_975(F.col("x"))).collect()
    assert rows[0][0] is None and [r[0] for r in rows[1:]] == pytest.approx([3.182446, 2.228139, 1.983972], abs=1e-5)


def test_seasons(spark):
    frame = spark.createDataFrame([("2015-10-21",), ("2016-03-21",), ("2016-07-21",)], "date string")
    assert [r.season for r in dates.season_columns(frame).collect()] == ["2015/2016", "2015/2016", None]
    days = spark.createDataFrame([(date(2020, 4, 3),), (date(2020, 11, 30),), (date(2020, 7, 1),)], "date date")
    rows = dates.layer_lookup(days).collect()
    assert [r.fs_seas for r in rows] == ["MAM_2020", "OND_2020", "other_2020"]
    assert (rows[0].fs_mo, rows[0].fs_yr, rows[0].yr_int) == (date(2020, 4, 1), date(2020, 1, 1), 2020)


def test_day_indices(spark):
    assert [r[0] for r in column(spark, [0, 365], "int").select(dates.from_index(F.col("x"))).collect()] == [date(1998, 1, 12), date(1999, 1, 12)]
    assert len(dates.MONTH_DEKADS) == 18 and dates.MONTH_DEKADS[0] == "Oct 01"


def test_day_sequences(spark):
    frame = spark.createDataFrame([(date(2020, 2, 27), date(2020, 3, 1))], "lo date, hi date")
    assert [str(x) for x in one(frame.select(dates.day_sequence(F.col("lo"), F.col("hi"))))] == ["2020-02-27", "2020-02-28", "2020-02-29", "2020-03-01"]


def test_recoding_and_titles(spark):
    frame = spark.createDataFrame([("Swaziland",), ("Zambia",), (None,)], "x string")
    assert [r[0] for r in frame.select(text.recode(F.col("x"), {"Swaziland": "Eswatini"})).collect()] == ["Eswatini", "Zambia", None]
    assert one(spark.createDataFrame([("first projection",)], "x string").select(text.title_case(F.col("x")))) == "First Projection"
