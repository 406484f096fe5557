"""Aggregates, ranks and numeric functions whose null, tie and rounding rules differ from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

# Coefficients of the rational approximation to the normal integral (Hart 1968, West 2005).
NORMAL_N = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_D = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

# 0.975 quantiles of Student's t for 1 to 30 degrees of freedom.
T_975 = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139,
    2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963,
    2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
)
Z_975 = 1.959963984540054


def clean(x: Column) -> Column:
    """NaN as null, so that aggregates leave it out."""
    return F.when(~F.isnan(x.cast("double")), x)


def as_number(x: Column) -> Column:
    """Text as a double; what is no number becomes null."""
    return clean(x.try_cast("double"))


def sum_known(x: Column) -> Column:
    """Sum of the known values; 0 where there are none."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def _whole(x: Column) -> tuple[Column, Column]:
    """A finite double as m * 2^k: m a long below 2^57, and k."""
    size = F.abs(x)
    k = F.when(size > 0, F.floor(F.log2(size)).cast("int") - 54).otherwise(0)
    half = F.floor(k / 2).cast("int")
    # powers of two are exact, and in two steps none is beyond a double's range
    return (x * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - k)).cast("long"), k


def sum_exactly(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Sums of doubles by group that are the same bits whatever order rows come in: keys and the named sums.

    Each value is a whole number times a power of two. These are added as decimals, by powers 32 apart, without
    rounding; the few totals of a group are then added from the largest power down. Null where none is known; values that are not finite add up as Spark adds them.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), x.cast("double").alias("x")) for i, x in enumerate(sums.values())])
    each = df.select(*keys, F.explode(pairs).alias("__p")).select(*keys, F.col("__p.i").alias("__i"), F.col("__p.x").alias("__x"))
    x = F.col("__x")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    m, k = _whole(x)
    each = each.withColumns({"__m": F.when(finite, m), "__k": F.when(finite, k)})
    limb = F.floor(F.col("__k") / 32).cast("int")
    amount = F.col("__m").cast("decimal(18,0)") * F.expr("shiftleft(1L, pmod(__k, 32))").cast("decimal(10,0)")
    parts = each.groupBy(*keys, "__i", limb.alias("__limb")).agg(F.sum(amount).alias("__s"), F.sum(F.when(~finite, x)).alias("__odd"))
    own = lambda i, c: F.when(F.col("__i") == i, c)

    def total(i: int) -> Column:
        held = F.sort_array(F.collect_list(own(i, F.when(F.col("__s").isNotNull(), F.struct("__limb", "__s")))), asc=False)
        added = F.aggregate(held, F.lit(0.0), lambda acc, p: acc + p["__s"].cast("double") * F.pow(F.lit(2.0), p["__limb"] * 16) * F.pow(F.lit(2.0), p["__limb"] * 16))
        odd = F.sum(own(i, F.col("__odd")))
        return F.when(odd.isNotNull(), odd).when(F.size(held) > 0, added)

    return parts.groupBy(*keys).agg(*[total(i).alias(name) for i, name in enumerate(sums)])


def all_known(value: Column, x: Column) -> Column:
    """An aggregate, but null as soon as one value of x is null."""
    return F.when(F.count(x) == F.count(F.lit(1)), value)


def mean_strict(x: Column) -> Column:
    return all_known(F.avg(x), x)


def max_strict(x: Column) -> Column:
    return all_known(F.max(x), x)


def rank_mean_ties(order: Column, by: list[Column]) -> Column:
    """Ascending rank within `by`, ties given the mean of their places; null for null."""
    rank = F.rank().over(Window.partitionBy(*by).orderBy(order.asc_nulls_last()))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, order))
    return F.when(order.isNotNull(), rank + (ties - 1) / 2)


def mean_strict_over(x: Column, w: WindowSpec) -> Column:
    return F.when(F.count(x).over(w) == F.count(F.lit(1)).over(w), F.avg(x).over(w))


def sd_strict_over(x: Column, w: WindowSpec) -> Column:
    """Sample standard deviation; null for one row, or where a value is null."""
    return F.when(F.count(x).over(w) == F.count(F.lit(1)).over(w), F.stddev_samp(x).over(w))


def _horner(coefficients: tuple[float, ...], z: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * z + F.lit(c)
    return out


def normal_cdf(x: Column, mean: Column, sd: Column) -> Column:
    """P(X <= x) of a normal variable; a step at the mean for sd 0, null for a null argument."""
    z = F.abs((x - mean) / F.when(sd != 0, sd))
    bell = F.exp(-z * z / 2)
    near = bell * _horner(NORMAL_N, z) / _horner(NORMAL_D, z)
    far = bell / (z + F.lit(1.0) / (z + F.lit(2.0) / (z + F.lit(3.0) / (z + F.lit(4.0) / (z + F.lit(0.65)))))) / F.lit(2.506628274631)
    tail = F.when(z > 37, 0.0).when(z < 7.07106781186547, near).otherwise(far)
    return F.when(sd == 0, F.when(x < mean, 0.0).otherwise(1.0)).otherwise(F.when(x > mean, 1 - tail).otherwise(tail))


def round_even(x: Column) -> Column:
    """To the nearest integer, halves to the even one."""
    return F.bround(x, 0)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a, b)


def significant(x: Column, digits: int = 3) -> Column:
    """x rounded to so many significant digits."""
    places = F.lit(digits - 1) - F.floor(F.log10(F.abs(F.when(x != 0, x)))).cast("int")
    scale = F.pow(F.lit(10.0), places)
    return F.coalesce(F.round(x * scale) / scale, x)


def t_quantile_975(df: Column) -> Column:
    """0.975 quantile of Student's t: a table up to 30 degrees of freedom, an expansion beyond."""
    z = F.lit(Z_975)
    g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    beyond = z + g[0] / df + g[1] / df**2 + g[2] / df**3
    return F.when(df < 1, None).when(df <= len(T_975), F.element_at(F.array(*map(F.lit, T_975)), F.greatest(F.lit(1), F.least(F.lit(len(T_975)), df)).cast("int"))).otherwise(beyond)


def pseudo_log(x: Column) -> Column:
    """asinh(x / 2): a log scale that passes through 0."""
    return F.asinh(x / 2)
