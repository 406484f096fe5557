"""Flood exposure: joins and roll-ups by district and province, grids, zonal sums, and the tables and bands shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.functions import dates, stats, text
from tamarisk.operators import dissolve as union
from tamarisk.operators import raster, relational, zonal
from tamarisk.operators.raster import Grid
from tamarisk.plans import inputs
from tamarisk.plans.inputs import COARSE, FINE, ctes
from tamarisk.sources.grids import axes

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f"q_{f.__name__}"] = f
        if sql is not None:
            ORACLE[f"q_{f.__name__}"] = sql
        return f

    return put


def r6(x: Column | str) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


# ---- the analysis ------------------------------------------------------------------------------------------------


def district_stats(pops: DataFrame, exposed: DataFrame) -> DataFrame:
    """Exposure joined to population on all they share, with the part exposed."""
    joined = relational.natural_left_join(pops.withColumnRenamed("pop", "total_pop_wp"), exposed)
    joined = joined.withColumnRenamed("pop_exposed", "pop_exposed_wp")
    return joined.withColumn("pct_exposed", stats.ratio(F.col("pop_exposed_wp"), F.col("total_pop_wp")))


def province_stats(district: DataFrame) -> DataFrame:
    """Sums by province and date; the part exposed is made anew from them."""
    keys = [*relational.matching(district, "^adm[01]"), "date"]
    out = district.groupBy(*keys).agg(stats.sum_known(F.col("total_pop_wp")).alias("total_pop_wp"), stats.sum_known(F.col("pop_exposed_wp")).alias("pop_exposed_wp"))
    return out.withColumn("pct_exposed", stats.ratio(F.col("pop_exposed_wp"), F.col("total_pop_wp")))


def mean_over_years(frame: DataFrame, pattern: str = "adm") -> DataFrame:
    """Mean exposure of each zone over the years, null if a year's is; its one population; and their ratio.

    A zone's population is the same in every year, up to the order of its sum, so the largest stands for it.
    """
    keys = relational.matching(frame, pattern)
    out = frame.groupBy(*keys).agg(stats.mean_strict(F.col("pop_exposed_wp")).alias("mean_exposed"), F.max("total_pop_wp").alias("total_pop"))
    return out.withColumn("pct_exposed", stats.ratio(F.col("mean_exposed"), F.col("total_pop")))


_STATS = f"""WITH {ctes('adm', 'pops', 'expo')}, d2 AS (
  SELECT p.adm1_en, p.adm1_pcode, p.adm2_en, p.adm2_pcode, p.pop AS total_pop_wp, e.adm0_en, e.stat, e.date, e.pop_exposed AS pop_exposed_wp, e.pop_exposed / nullif(p.pop, 0) AS pct_exposed
  FROM pops p LEFT JOIN expo e ON p.adm1_en IS NOT DISTINCT FROM e.adm1_en AND p.adm1_pcode IS NOT DISTINCT FROM e.adm1_pcode AND p.adm2_en IS NOT DISTINCT FROM e.adm2_en AND p.adm2_pcode IS NOT DISTINCT FROM e.adm2_pcode
), d1 AS (
  SELECT *, pop_exposed_wp / nullif(total_pop_wp, 0) AS pct_exposed FROM (
    SELECT adm1_en, adm1_pcode, adm0_en, date, coalesce(sum(total_pop_wp), 0) AS total_pop_wp, coalesce(sum(pop_exposed_wp), 0) AS pop_exposed_wp FROM d2 GROUP BY ALL)
)"""


def _d2(spark: SparkSession, d: str) -> DataFrame:
    return district_stats(inputs.population(spark, d), inputs.exposure(spark, d))


def _mean_sql(source: str, keys: str) -> str:
    return f"""{_STATS} SELECT {keys}, round(mean_exposed, 4) AS mean_exposed, round(total_pop, 4) AS total_pop, round(mean_exposed / nullif(total_pop, 0), 6) AS pct_exposed FROM (
  SELECT {keys}, CASE WHEN count(pop_exposed_wp) = count(*) THEN avg(pop_exposed_wp) END AS mean_exposed, max(total_pop_wp) AS total_pop FROM {source} GROUP BY {keys})"""


def _rounded_mean(df: DataFrame) -> DataFrame:
    return df.withColumns({"mean_exposed": F.round("mean_exposed", 4), "total_pop": F.round("total_pop", 4), "pct_exposed": r6("pct_exposed")})


@query(_mean_sql("d1", "adm1_en, adm1_pcode, adm0_en"))
def flood_adm1_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_mean(mean_over_years(province_stats(_d2(spark, d))))


@query(_mean_sql("d2", "adm1_en, adm1_pcode, adm2_en, adm2_pcode, adm0_en"))
def flood_adm2_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_mean(mean_over_years(_d2(spark, d)))


@query(f"{_STATS} SELECT adm1_en, adm1_pcode, adm2_en, adm2_pcode, round(total_pop_wp, 4) AS total_pop_wp, adm0_en, stat, date, round(pop_exposed_wp, 4) AS pop_exposed_wp, round(pct_exposed, 6) AS pct_exposed FROM d2")
def adm2_stats_join(spark: SparkSession, d: str) -> DataFrame:
    return _d2(spark, d).withColumns({"total_pop_wp": F.round("total_pop_wp", 4), "pop_exposed_wp": F.round("pop_exposed_wp", 4), "pct_exposed": r6("pct_exposed")})


@query(f"{_STATS} SELECT adm1_en, adm1_pcode, adm0_en, date, round(total_pop_wp, 4) AS total_pop_wp, round(pop_exposed_wp, 4) AS pop_exposed_wp, round(pct_exposed, 6) AS pct_exposed FROM d1")
def adm1_rollup(spark: SparkSession, d: str) -> DataFrame:
    return province_stats(_d2(spark, d)).withColumns({"total_pop_wp": F.round("total_pop_wp", 4), "pop_exposed_wp": F.round("pop_exposed_wp", 4), "pct_exposed": r6("pct_exposed")})


@query("SELECT adm0_en, adm1_en, CAST(NULL AS VARCHAR) AS adm2_en FROM (SELECT r_name AS adm0_en, n_name AS adm1_en FROM nation JOIN region ON n_regionkey = r_regionkey) UNION ALL SELECT NULL, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def bind_rows(spark: SparkSession, d: str) -> DataFrame:
    n, r, s = (inputs.table(spark, d, t) for t in ("nation", "region", "supplier"))
    upper = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("adm0_en"), F.col("n_name").alias("adm1_en"))
    lower = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("adm1_en"), F.col("s_name").alias("adm2_en"))
    return relational.bind_rows(upper, lower)


# ---- reshaping ---------------------------------------------------------------------------------------------------

_WIDE = f"WITH {ctes('adm', 'expo')}, wide AS (SELECT adm2_pcode, CAST(max(pop_exposed) FILTER (WHERE year(date) = 1996) AS DOUBLE) AS \"sum.1996-01-01\", CAST(max(pop_exposed) FILTER (WHERE year(date) = 1997) AS DOUBLE) AS \"sum.1997-01-01\" FROM expo GROUP BY 1)"


def _wide(spark: SparkSession, d: str) -> DataFrame:
    e = inputs.exposure(spark, d)
    return e.groupBy("adm2_pcode").agg(*[F.max(F.when(F.year("date") == y, F.col("pop_exposed"))).alias(f"sum.{y}-01-01") for y in (1996, 1997)])


@query(f"{_WIDE} SELECT adm2_pcode, name, round(value, 4) AS value FROM wide UNPIVOT INCLUDE NULLS (value FOR name IN (\"sum.1996-01-01\", \"sum.1997-01-01\"))")
def unpivot_keep_nulls(spark: SparkSession, d: str) -> DataFrame:
    wide = _wide(spark, d).toDF("adm2_pcode", "a", "b")
    return relational.longer(wide, ["a", "b"]).withColumns({"name": F.when(F.col("name") == "a", "sum.1996-01-01").otherwise("sum.1997-01-01"), "value": F.round("value", 4)})


@query(f"WITH {ctes('adm', 'expo')} SELECT adm2_pcode, date, round(max(pop_exposed), 4) AS \"sum\" FROM expo GROUP BY 1, 2")
def pivot_wider(spark: SparkSession, d: str) -> DataFrame:
    e = inputs.exposure(spark, d).select("adm2_pcode", "date", "stat", "pop_exposed")
    return relational.wider(e, "stat", "pop_exposed", ["sum"]).withColumn("sum", F.round("sum", 4))


@query(f"""WITH {ctes('adm', 'expo')}, n AS (SELECT adm2_pcode, CASE WHEN adm2_pcode % 7 = 0 THEN 'sum' ELSE 'sum.' || CAST(date AS VARCHAR) END AS name, pop_exposed FROM expo)
SELECT adm2_pcode, string_split(name, '.')[1] AS stat, TRY_CAST(string_split(name, '.')[2] AS DATE) AS date, round(pop_exposed, 4) AS pop_exposed FROM n""")
def separate(spark: SparkSession, d: str) -> DataFrame:
    e = inputs.exposure(spark, d)
    named = e.select("adm2_pcode", F.when(F.col("adm2_pcode") % 7 == 0, "sum").otherwise(F.concat(F.lit("sum."), F.col("date").cast("string"))).alias("name"), F.round("pop_exposed", 4).alias("pop_exposed"))
    return relational.separate(named, "name", ["stat", "date"]).withColumn("date", dates.as_date(F.col("date")))


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 0 THEN NULL ELSE r_name END AS part, n_name || '_' || coalesce(CASE WHEN n_regionkey = 0 THEN NULL ELSE r_name END, 'NA') AS admin_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def unite(spark: SparkSession, d: str) -> DataFrame:
    n, r = inputs.table(spark, d, "nation"), inputs.table(spark, d, "region")
    named = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", F.when(F.col("n_regionkey") != 0, F.col("r_name")).alias("part"))
    return relational.unite(named, "admin_id", ["n_name", "part"])


# ---- dates and grids ---------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT d AS fs_name, CAST(date_trunc('month', d) AS DATE) AS fs_mo, CAST(date_trunc('year', d) AS DATE) AS fs_yr, CAST(year(d) AS INTEGER) AS yr_int,
  CASE WHEN month(d) IN (3, 4, 5) THEN 'MAM' WHEN month(d) IN (10, 11, 12) THEN 'OND' ELSE 'other' END || '_' || year(d) AS fs_seas FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem)""")
def floodscan_lookup(spark: SparkSession, d: str) -> DataFrame:
    return dates.layer_lookup(inputs.daily(spark, d).select("date").distinct())


@query("""SELECT time_index, DATE '1998-01-12' + CAST(time_index AS INTEGER) AS date FROM (SELECT DISTINCT CAST(date_diff('day', DATE '1998-01-12', CAST(l_shipdate AS DATE)) AS INTEGER) AS time_index FROM lineitem)
WHERE DATE '1998-01-12' + CAST(time_index AS INTEGER) BETWEEN DATE '1998-02-01' AND DATE '1999-01-31'""")
def time_index_dates(spark: SparkSession, d: str) -> DataFrame:
    index = inputs.daily(spark, d).select(dates.to_index(F.col("date")).alias("time_index")).distinct()
    lo, hi = F.lit("1998-02-01").cast("date"), F.lit("1999-01-31").cast("date")
    return index.withColumn("date", dates.from_index(F.col("time_index"))).where(F.col("date").between(lo, hi))


@query(f"""WITH {ctes('daily', 'boxes')}, b AS (SELECT min(xmin) AS x0, min(ymin) + 4 AS y0, max(xmax) - 16 AS x1, max(ymax) AS y1 FROM boxes), p AS (SELECT date, CAST((col + 0.5) * 4 AS DOUBLE) AS lon, CAST(20 - ("row" + 0.5) * 4 AS DOUBLE) AS lat, value FROM daily)
SELECT lon, lat, count(*) AS n, round(sum(value), 4) AS total FROM p, b WHERE lon BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY 1, 2""")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    zones = inputs.boxes(spark, d)
    b = zones.agg(F.min("xmin"), F.min("ymin") + 4, F.max("xmax") - 16, F.max("ymax")).first()  # one row
    points = inputs.daily(spark, d).select("date", COARSE.x(F.col("col")).alias("lon"), COARSE.y(F.col("row")).alias("lat"), "value")
    return raster.within(points, tuple(b)).groupBy("lon", "lat").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_LAYERS = f"""WITH {ctes('daily', 'people', 'boxes')}, yearly AS (
  SELECT year(date) AS y, "row", col, CASE WHEN count(value) = count(*) THEN max(value) END AS value FROM daily GROUP BY 1, 2, 3
), layers AS (SELECT CAST(y AS INTEGER) AS year, f.date, "row", col, value FROM yearly JOIN (SELECT year(date) AS y, min(date) AS date FROM daily GROUP BY 1) f USING (y))"""


def _layers(spark: SparkSession, d: str) -> DataFrame:
    return raster.layer_max(inputs.daily(spark, d)).select("date", "row", "col", "value")


@query(f'{_LAYERS} SELECT year, date, "row", col, value FROM layers')
def layer_year_max(spark: SparkSession, d: str) -> DataFrame:
    return raster.layer_max(inputs.daily(spark, d))


@query(f"""WITH {ctes('people')}, t AS (SELECT "row", col, pop FROM people WHERE col < 24 UNION ALL SELECT "row", col, pop / 2 FROM people WHERE col >= 16) SELECT "row", col, round(avg(pop), 4) AS pop FROM t GROUP BY 1, 2""")
def mosaic_mean(spark: SparkSession, d: str) -> DataFrame:
    p = inputs.people(spark, d)
    return raster.mosaic(p.where("col < 24"), p.where("col >= 16").withColumn("pop", F.col("pop") / 2), value="pop").withColumn("pop", F.round("pop", 4))


@query(f"""WITH {ctes('people')} SELECT "row" - 3 AS "row", col - 5 AS col, round(100 + (col - 5 + 0.5) * (50.0 / 20), 6) AS lon, round(60 - ("row" - 3 + 0.5) * (30.0 / 12), 6) AS lat, round(pop, 4) AS pop FROM people WHERE col BETWEEN 5 AND 24 AND "row" BETWEEN 3 AND 14""")
def crop_setext(spark: SparkSession, d: str) -> DataFrame:
    cells, grid = raster.crop(inputs.people(spark, d), FINE, (5.2, 24.9, 5.1, 17.4))
    grid = raster.set_extent(grid, (100.0, 150.0, 30.0, 60.0))
    return cells.select("row", "col", F.round(grid.x(F.col("col")), 6).alias("lon"), F.round(grid.y(F.col("row")), 6).alias("lat"), F.round("pop", 4).alias("pop"))


_FINE_CELLS = 'cells AS (SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM range(20) a(r), range(40) b(c))'
_BILINEAR = f"""{_LAYERS}, {_FINE_CELLS}, pts AS (
  SELECT "row", col, floor((col + 0.5) / 4.0 - 0.5) AS i, floor(("row" + 0.5) / 4.0 - 0.5) AS j, (col + 0.5) / 4.0 - 0.5 - floor((col + 0.5) / 4.0 - 0.5) AS wx, ("row" + 0.5) / 4.0 - 0.5 - floor(("row" + 0.5) / 4.0 - 0.5) AS wy FROM cells
), need AS (
  SELECT "row", col, least(4, greatest(0, j + b)) AS sj, least(9, greatest(0, i + a)) AS si, sum((CASE WHEN a = 0 THEN 1 - wx ELSE wx END) * (CASE WHEN b = 0 THEN 1 - wy ELSE wy END)) AS w FROM pts, range(2) x(a), range(2) y(b) GROUP BY ALL
), counted AS (SELECT *, count(*) OVER (PARTITION BY "row", col) AS n FROM need WHERE w > 0
), fine AS (
  SELECT l.date, c."row", c.col, CASE WHEN count(l.value) = max(n) THEN sum(w * l.value) END AS value FROM counted c JOIN layers l ON l."row" = c.sj AND l.col = c.si GROUP BY ALL
)"""


@query(f'{_BILINEAR} SELECT date, "row", col, value FROM fine')
def resample_bilinear(spark: SparkSession, d: str) -> DataFrame:
    return raster.resample_bilinear(_layers(spark, d), COARSE, FINE)


@query(f'{_LAYERS}, {_FINE_CELLS} SELECT l.date, c."row", c.col, l.value FROM cells c JOIN layers l ON l."row" = c."row" // 4 AND l.col = c.col // 4')
def resample_near(spark: SparkSession, d: str) -> DataFrame:
    return raster.resample_near(_layers(spark, d), COARSE, FINE)


@query(f'WITH {ctes("people")} SELECT CAST("row" // 4 AS INTEGER) AS "row", CAST(col // 4 AS INTEGER) AS col, round(sum(pop), 4) AS pop FROM people GROUP BY 1, 2')
def resample_sum(spark: SparkSession, d: str) -> DataFrame:
    return raster.resample_sum(inputs.people(spark, d), FINE, COARSE, "pop").withColumn("pop", F.round("pop", 4))


@query(f"""{_BILINEAR} SELECT f.date, f."row", f.col, CAST(CASE WHEN f.value IS NULL THEN NULL WHEN f.value >= 0.4 THEN 1 ELSE 0 END AS DOUBLE) AS flag, CASE WHEN f.value IS NOT NULL THEN f.value END * p.pop AS value
FROM fine f JOIN people p ON f."row" = p."row" AND f.col = p.col""")
def threshold_mask_multiply(spark: SparkSession, d: str) -> DataFrame:
    fine = raster.resample_bilinear(_layers(spark, d), COARSE, FINE)
    flagged = fine.withColumn("flag", raster.at_least(F.col("value"), 0.4))
    kept = flagged.withColumn("value", raster.masked(F.col("value"), F.col("flag")))
    return raster.multiply(kept, inputs.people(spark, d), "value", "pop").select("date", "row", "col", "flag", "value")


# ---- zonal sums --------------------------------------------------------------------------------------------------

_COVER = """cover AS (
  SELECT n_nationkey, adm1_en, r AS "row", c AS col, (least(xmax, c + 1) - greatest(xmin, c)) * (least(ymax, 20 - r) - greatest(ymin, 19 - r)) AS w FROM boxes, range(20) a(r), range(40) b(c)
  WHERE least(xmax, c + 1) > greatest(xmin, c) AND least(ymax, 20 - r) > greatest(ymin, 19 - r)
)"""
_ZONAL = f"""WITH {ctes('people', 'boxes')}, {_COVER} SELECT n_nationkey, adm1_en, round(coalesce(sum(w * pop), 0), 4) AS "sum" FROM cover JOIN people ON cover."row" = people."row" AND cover.col = people.col GROUP BY 1, 2"""


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    return zonal.box_coverage(inputs.boxes(spark, d), FINE)


@query(_ZONAL)
def zonal_sum_box(spark: SparkSession, d: str) -> DataFrame:
    return zonal.zonal_sum(_coverage(spark, d), inputs.people(spark, d), ["n_nationkey", "adm1_en"], "pop").withColumn("sum", F.round("sum", 4))


@query(_ZONAL)
def zonal_sum_polygon(spark: SparkSession, d: str) -> DataFrame:
    """The same zones as polygons."""
    zones = inputs.boxes(spark, d).select("n_nationkey", "adm1_en", zonal.box_rings(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("rings"))
    return zonal.zonal_sum(zonal.polygon_coverage(zones, FINE), inputs.people(spark, d), ["n_nationkey", "adm1_en"], "pop").withColumn("sum", F.round("sum", 4))


@query("""WITH s AS (SELECT n_nationkey AS k, n_regionkey AS r, n_nationkey % 5 AS i, n_nationkey // 5 AS j FROM nation)
SELECT r_name AS adm0_en, CAST(area AS DOUBLE) AS area, CAST(4 * area - 2 * coalesce(shared, 0) AS DOUBLE) AS perimeter FROM (SELECT r, count(*) AS area FROM s GROUP BY 1)
LEFT JOIN (SELECT a.r, count(*) AS shared FROM s a JOIN s b ON a.r = b.r AND a.k < b.k AND abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY 1) USING (r) JOIN region ON r_regionkey = r""")
def dissolve(spark: SparkSession, d: str) -> DataFrame:
    """Nations as unit squares, dissolved to regions; area and border of the union from its chained rings."""
    n, r = inputs.table(spark, d, "nation"), inputs.table(spark, d, "region")
    i, j = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double")
    squares = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("adm0_en"), zonal.box_rings(i, j, i + 1, j + 1).alias("rings"))
    united = union.dissolve(squares, ["adm0_en"])
    edge = united.select("adm0_en", F.explode("rings").alias("r")).select("adm0_en", "r", F.posexplode("r").alias("i", "p")).select("adm0_en", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.get("r", (F.col("i") + 1) % F.size("r")).alias("q"))
    return edge.groupBy("adm0_en").agg(F.abs(F.sum(F.col("x1") * F.col("q.y") - F.col("q.x") * F.col("y1")) / 2).alias("area"), F.sum(F.hypot(F.col("q.x") - F.col("x1"), F.col("q.y") - F.col("y1"))).alias("perimeter"))


def _two_triangles_and_an_island(spark: SparkSession, d: str) -> DataFrame:
    """For each nation a square of 3.5 with a square hole of 2 and an island of 1 in it, and a right triangle apart; rings either way round."""
    n = inputs.table(spark, d, "nation")
    x = (F.col("n_nationkey") % 5).cast("double") * 8
    y = F.floor(F.col("n_nationkey") / 5).cast("double") * 4
    square = lambda x, y, size: zonal.ring_of((x, y), (x + size, y), (x + size, y + size), (x, y + size))
    triangle = zonal.ring_of((x + 4.25, y + 0.25), (x + 4.25, y + 3.25), (x + 7.25, y + 0.25))
    rings = F.array(square(x + 1.0, y + 1.25, 2.0), triangle, F.reverse(square(x + 0.25, y + 0.25, 3.5)), square(x + 1.5, y + 1.75, 1.0))
    return n.select(F.col("n_name").alias("adm1_en"), rings.alias("rings"))


@query(f"""WITH {ctes('people')}, z AS (SELECT n_name AS adm1_en, CAST(n_nationkey % 5 * 8 AS DOUBLE) AS x, CAST(n_nationkey // 5 * 4 AS DOUBLE) AS y FROM nation
), c AS (SELECT adm1_en, p."row", p.col, p.pop, p.col - x AS a, 19 - p."row" - y AS b FROM z, people p
), boxed AS (SELECT *, 
    greatest(0, least(a + 1, 3.75) - greatest(a, 0.25)) * greatest(0, least(b + 1, 3.75) - greatest(b, 0.25)) - greatest(0, least(a + 1, 3) - greatest(a, 1)) * greatest(0, least(b + 1, 3.25) - greatest(b, 1.25))
    + greatest(0, least(a + 1, 2.5) - greatest(a, 1.5)) * greatest(0, least(b + 1, 2.75) - greatest(b, 1.75)) AS squares,
    greatest(a, 4.25) AS l, least(a + 1, 7.25) AS r, greatest(b, 0.25) AS lo, least(b + 1, 3.25) AS hi FROM c
), half AS (
  -- below the line u + v = 7.5: from a corner's triangle those beyond the other corners go
  SELECT *, CASE WHEN r > l AND hi > lo THEN (power(greatest(0, 7.5 - l - lo), 2) - power(greatest(0, 7.5 - r - lo), 2) - power(greatest(0, 7.5 - l - hi), 2) + power(greatest(0, 7.5 - r - hi), 2)) / 2 ELSE 0 END AS tri FROM boxed
)
SELECT adm1_en, sum((squares + tri) * pop) AS "sum", round(sum(squares + tri), 6) AS cells FROM half WHERE squares + tri > 0 GROUP BY 1""")
def zonal_sum_parts(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of several parts: an island in a lake, a triangle beside; SQL goes by boxes and a half-plane."""
    cover = zonal.polygon_coverage(_two_triangles_and_an_island(spark, d), FINE)
    cells = inputs.people(spark, d).select("row", "col", F.col("pop").alias("value"))
    area = zonal.zonal_sum(cover, cells.withColumn("value", F.lit(1.0)), ["adm1_en"], to="cells")
    return zonal.zonal_sum(cover, cells, ["adm1_en"]).join(area, "adm1_en").select("adm1_en", "sum", F.round("cells", 6).alias("cells"))


@query("""SELECT r_name AS adm0_en, count(*) AS parts, CAST(sum(24 * power(1 + n_nationkey % 3, 2)) AS DOUBLE) AS area, CAST(sum(20 * (1 + n_nationkey % 3)) AS DOUBLE) AS perimeter
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def dissolve_unlike(spark: SparkSession, d: str) -> DataFrame:
    """For each nation a square with two half as wide beside it, whose common corner lies on its border; dissolved to regions."""
    n, r = inputs.table(spark, d, "nation"), inputs.table(spark, d, "region")
    x, size = F.col("n_nationkey").cast("double") * 100, (1 + F.col("n_nationkey") % 3).cast("double") * 2
    box = lambda dx, dy, side: zonal.box_rings(x + size * dx, size * dy, x + size * (dx + side), size * (dy + side))
    each = F.explode(F.array(box(0, 0, 2), box(2, 0, 1), box(2, 1, 1)))
    corners = union.chained(union.outline(n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("adm0_en"), each.alias("rings")), ["adm0_en"]), ["adm0_en"])
    own = Window.partitionBy("adm0_en", "ring").orderBy("place")
    first = [F.first(c).over(own) for c in ("x", "y")]
    edge = corners.select("adm0_en", "ring", "x", "y", *[F.coalesce(F.lead(c).over(own), f).alias(f"{c}2") for c, f in zip(("x", "y"), first)])
    area, length = F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2, F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y")))
    return edge.groupBy("adm0_en").agg(F.count_distinct("ring").alias("parts"), area.alias("area"), length.alias("perimeter"))


@query(f"""{_STATS}, m AS (SELECT adm1_en, sum(pop_exposed_wp) AS exposed FROM d2 GROUP BY 1)
SELECT adm1_en, CAST(1 AS INTEGER) AS n_rings, CAST((xmax - xmin) * (ymax - ymin) AS DOUBLE) AS area, round(exposed, 3) AS exposed FROM (SELECT adm1_en, xmin, xmax, ymin, ymax FROM (WITH {ctes('boxes')} SELECT * FROM boxes)) LEFT JOIN m USING (adm1_en)""")
def geometry_with_stats(spark: SparkSession, d: str) -> DataFrame:
    """Zones' shapes beside their figures, as maps need them; a zone without figures keeps its shape."""
    shapes = inputs.boxes(spark, d).select("adm1_en", zonal.box_rings(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]).alias("geom"))
    totals = _d2(spark, d).groupBy("adm1_en").agg(F.sum("pop_exposed_wp").alias("exposed"))
    corner = lambda i: F.col("geom")[0][i]
    area = (corner(2)["x"] - corner(0)["x"]) * (corner(2)["y"] - corner(0)["y"])
    return relational.natural_left_join(shapes, totals).select("adm1_en", F.size("geom").alias("n_rings"), area.alias("area"), F.round("exposed", 3).alias("exposed"))


@query("SELECT n_nationkey AS adm1_pcode, n_name AS adm1_en, n_regionkey AS adm1_en_2, n_nationkey + 1 AS shape_area FROM nation")
def snake_case(spark: SparkSession, d: str) -> DataFrame:
    """Names as boundary files have them, in snake case and distinct."""
    n = inputs.table(spark, d, "nation")
    return relational.snake_names(n.select(F.col("n_nationkey").alias("ADM1_PCode"), F.col("n_name").alias("ADM1 EN"), F.col("n_regionkey").alias("ADM1-EN"), (F.col("n_nationkey") + 1).alias("ShapeArea")))


@query("""SELECT o_orderpriority, CAST(day AS DATE) AS day FROM (SELECT o_orderpriority, unnest(generate_series(min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE)), INTERVAL 1 DAY)) AS day FROM orders GROUP BY 1)
WHERE (o_orderpriority, CAST(day AS DATE)) NOT IN (SELECT o_orderpriority, CAST(o_orderdate AS DATE) FROM orders)""")
def days_without_rows(spark: SparkSession, d: str) -> DataFrame:
    """Days from each priority's first order to its last, that have none."""
    o = inputs.table(spark, d, "orders").select("o_orderpriority", F.col("o_orderdate").cast("date").alias("day"))
    days = o.groupBy("o_orderpriority").agg(F.explode(dates.day_sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(o, ["o_orderpriority", "day"], "left_anti")


def fine_layers(layers: DataFrame, flood_grid: Grid, people_grid: Grid) -> DataFrame:
    """Flood layers cropped to the population's extent, stretched over it and brought to its cells."""
    cropped, grid = raster.crop(layers, flood_grid, people_grid.extent)
    return raster.resample_bilinear(cropped, raster.set_extent(grid, people_grid.extent), people_grid)


def zonal_exposure(daily: DataFrame, people: DataFrame, coverage: DataFrame, zone: list[str], flood_grid: Grid, people_grid: Grid, mode: str = "asrun", threshold: float = 0.005, zones: DataFrame | None = None) -> DataFrame:
    """Exposed population by zone and year: zone columns, stat, date, pop_exposed.

    `asrun`: flood fraction times population, whatever the threshold; `binary`: population of cells that reach
    it; `fraction_floor`: fraction times population of those cells. With `zones`, those without cells have rows too.
    """
    layers = raster.layer_max(daily).select("date", "row", "col", "value")
    fine = fine_layers(layers, flood_grid, people_grid)
    flag = raster.at_least(F.col("value"), threshold)
    value = {"asrun": raster.masked(F.col("value"), flag), "binary": flag, "fraction_floor": flag * F.col("value")}[mode]
    exposed = raster.multiply(fine.withColumn("value", value), people, "value", "pop")
    return zonal.zonal_sum(coverage, exposed, zone, to="pop_exposed", zones=zones).withColumn("stat", F.lit("sum"))


def zonal_pop_exposure(points: DataFrame, tiles: list[DataFrame], people_grid: Grid, zones: DataFrame, zone: list[str], box: tuple[float, float, float, float], mode: str = "asrun", threshold: float = 0.005, edges: bool = False) -> DataFrame:
    """The exposure analysis from flood readings at (date, lon, lat) to zones, which are boxes.

    Readings in the box around the zones (xmin, ymin, xmax, ymax) make a grid by their axes, as run with the outer
    centres for edges; population tiles on one grid are put together; then as zonal_exposure.
    """
    near = raster.within(points, box)
    grid = axes(near, edges)
    daily = raster.on_grid(near, grid).select("date", "row", "col", "value")
    people = raster.mosaic(*tiles, value="pop")
    return zonal_exposure(daily, people, zonal.box_coverage(zones, people_grid), zone, grid, people_grid, mode, threshold, zones)


def threshold_sweep(daily: DataFrame, people: DataFrame, coverage: DataFrame, zone: list[str], thresholds: list[float], flood_grid: Grid, people_grid: Grid) -> DataFrame:
    """Population of cells that reach each threshold, by zone and year, all in one pass."""
    layers = raster.layer_max(daily).select("date", "row", "col", "value")
    fine = fine_layers(layers, flood_grid, people_grid).withColumn("thresh", F.explode(F.array(*map(F.lit, thresholds))))
    exposed = raster.multiply(fine.withColumn("value", raster.at_least(F.col("value"), F.col("thresh"))), people, "value", "pop")
    return zonal.zonal_sum(coverage, exposed, zone, to="pop_exposed").withColumn("stat", F.lit("sum"))


def _exposure_sql(value: str) -> str:
    return f"""{_BILINEAR}, {_COVER} SELECT adm1_en, date, 'sum' AS stat, round(coalesce(sum(w * ({value}) * pop), 0), 4) AS pop_exposed
FROM fine f JOIN people p ON f."row" = p."row" AND f.col = p.col JOIN cover c ON c."row" = f."row" AND c.col = f.col GROUP BY 1, 2"""


def _exposed(spark: SparkSession, d: str, mode: str, threshold: float) -> DataFrame:
    found = zonal_exposure(inputs.daily(spark, d), inputs.people(spark, d), _coverage(spark, d), ["adm1_en"], COARSE, FINE, mode, threshold)
    return found.withColumn("pop_exposed", F.round("pop_exposed", 4)).select("adm1_en", "date", "stat", "pop_exposed")


@query(_exposure_sql("f.value"))
def zonal_exposure_asrun(spark: SparkSession, d: str) -> DataFrame:
    return _exposed(spark, d, "asrun", 0.2)


@query(_exposure_sql("CASE WHEN f.value >= 0.7 THEN 1.0 WHEN f.value IS NOT NULL THEN 0.0 END"))
def zonal_exposure_binary(spark: SparkSession, d: str) -> DataFrame:
    return _exposed(spark, d, "binary", 0.7)


@query(_exposure_sql("CASE WHEN f.value >= 0.7 THEN f.value WHEN f.value IS NOT NULL THEN 0.0 END"))
def zonal_exposure_fraction_floor(spark: SparkSession, d: str) -> DataFrame:
    return _exposed(spark, d, "fraction_floor", 0.7)


@query(f"""{_BILINEAR}, {_COVER}, t AS (SELECT unnest([CAST(0.2 AS DOUBLE), 0.6, 0.9]) AS thresh) SELECT adm1_en, date, thresh, 'sum' AS stat, round(coalesce(sum(w * (CASE WHEN f.value >= thresh THEN 1.0 WHEN f.value IS NOT NULL THEN 0.0 END) * pop), 0), 4) AS pop_exposed
FROM fine f JOIN people p ON f."row" = p."row" AND f.col = p.col JOIN cover c ON c."row" = f."row" AND c.col = f.col, t GROUP BY 1, 2, 3""")
def threshold_sweep_query(spark: SparkSession, d: str) -> DataFrame:
    found = threshold_sweep(inputs.daily(spark, d), inputs.people(spark, d), _coverage(spark, d), ["adm1_en"], [0.2, 0.6, 0.9], COARSE, FINE)
    return found.withColumn("pop_exposed", F.round("pop_exposed", 4)).select("adm1_en", "date", "thresh", "stat", "pop_exposed")


QUERIES["q_threshold_sweep"], ORACLE["q_threshold_sweep"] = QUERIES.pop("q_threshold_sweep_query"), ORACLE.pop("q_threshold_sweep_query")


def flood_exposure_window(daily: DataFrame, people: DataFrame, zones: DataFrame, zone: list[str], lo: str, hi: str, flood_grid: Grid, people_grid: Grid, resample: str = "population", binary: bool = True, fixed: bool = False) -> DataFrame:
    """Daily exposure in a window of dates: zone columns, date, sum.

    Population is cropped to the floods' extent. resample="population" brings it to the flood grid by sums,
    "floodscan" floods to the population grid by nearest cells. `binary` counts whole cells with any flood; on the
    floodscan path it has no effect unless `fixed`.
    """
    window = daily.where(F.col("date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    people, cropped = raster.crop(people, people_grid, flood_grid.extent)
    if resample == "population":
        grid = flood_grid
        flood = window.withColumn("value", raster.presence(F.col("value"))) if binary else window
        exposed = raster.multiply(flood, raster.resample_sum(people, cropped, flood_grid, "pop"), "value", "pop")
    else:
        grid = cropped
        flood = window.withColumn("value", raster.presence(F.col("value"))) if binary and fixed else window
        exposed = raster.multiply(raster.resample_near(flood, flood_grid, cropped), people, "value", "pop")
    return zonal.zonal_sum(zonal.box_coverage(zones, grid), exposed, zone, empty=0.0)


def _one_a_day(spark: SparkSession, d: str) -> DataFrame:
    return inputs.daily(spark, d).groupBy("date", "row", "col").agg(F.max("value").alias("value"))


_DAY = 'WITH {}, one AS (SELECT date, "row", col, max(value) AS value FROM daily WHERE date BETWEEN DATE \'1998-03-01\' AND DATE \'1998-03-31\' GROUP BY 1, 2, 3)'.format(ctes("daily", "people", "boxes"))


@query(f"""{_DAY}, pop4 AS (SELECT "row" // 4 AS "row", col // 4 AS col, sum(pop) AS pop FROM people GROUP BY 1, 2), cover AS (
  SELECT adm1_en, r AS "row", c AS col, (least(xmax, c * 4 + 4) - greatest(xmin, c * 4)) * (least(ymax, 20 - r * 4) - greatest(ymin, 16 - r * 4)) / 16 AS w FROM boxes, range(5) a(r), range(10) b(c)
  WHERE least(xmax, c * 4 + 4) > greatest(xmin, c * 4) AND least(ymax, 20 - r * 4) > greatest(ymin, 16 - r * 4))
SELECT adm1_en, date, round(coalesce(sum(w * (CASE WHEN value <> 0 THEN 1.0 END) * pop), 0), 4) AS "sum" FROM one o JOIN pop4 p ON o."row" = p."row" AND o.col = p.col JOIN cover c ON c."row" = o."row" AND c.col = o.col GROUP BY 1, 2""")
def flood_exposure_window_population(spark: SparkSession, d: str) -> DataFrame:
    found = flood_exposure_window(_one_a_day(spark, d), inputs.people(spark, d), inputs.boxes(spark, d), ["adm1_en"], "1998-03-01", "1998-03-31", COARSE, FINE)
    return found.withColumn("sum", F.round("sum", 4))


@query(f"""{_DAY}, {_COVER} SELECT adm1_en, date, coalesce(sum(w * value * pop), 0) AS "sum" FROM people p JOIN one o ON o."row" = p."row" // 4 AND o.col = p.col // 4 JOIN cover c ON c."row" = p."row" AND c.col = p.col GROUP BY 1, 2""")
def flood_exposure_window_floodscan(spark: SparkSession, d: str) -> DataFrame:
    return flood_exposure_window(_one_a_day(spark, d), inputs.people(spark, d), inputs.boxes(spark, d), ["adm1_en"], "1998-03-01", "1998-03-31", COARSE, FINE, "floodscan")


# Readings at the centres of COARSE inside this box make, as run, a grid with the outer centres for edges: x 2 to 38 by
# 3.6, y 14 to 6 by 8/3. Population is looked at on columns 5 to 30 and rows 4 to 16 of FINE, x 5 to 31, y 16 to 3.
_BOX = (0.25, 4.7, 39.6, 15.5)
_STUDY = (5.2, 30.9, 3.1, 16.4)


def _points(spark: SparkSession, d: str) -> DataFrame:
    return inputs.daily(spark, d).select("date", COARSE.x(F.col("col")).alias("lon"), COARSE.y(F.col("row")).alias("lat"), "value")


def _zones_and_one_apart(spark: SparkSession, d: str) -> DataFrame:
    """The boxes, the last one moved off the grid."""
    off = F.when(F.col("n_nationkey") == 24, 100.0).otherwise(0.0)
    return inputs.boxes(spark, d).withColumns({"xmin": F.col("xmin") + off, "xmax": F.col("xmax") + off})


@query(f"""WITH {ctes('daily', 'people', 'boxes')}, near AS (SELECT date, "row" - 1 AS "row", col, value FROM daily WHERE "row" BETWEEN 1 AND 3
), yearly AS (SELECT year(date) AS y, "row", col, CASE WHEN count(value) = count(*) THEN max(value) END AS value FROM near GROUP BY 1, 2, 3
), layers AS (SELECT f.date, "row", col - 1 AS col, value FROM yearly JOIN (SELECT year(date) AS y, min(date) AS date FROM near GROUP BY 1) f USING (y) WHERE col BETWEEN 1 AND 7
), pts AS (SELECT r, c, (c + CAST(0.5 AS DOUBLE)) / (CAST(26 AS DOUBLE) / 7) - 0.5 AS fx, (r + CAST(0.5 AS DOUBLE)) / (CAST(13 AS DOUBLE) / 3) - 0.5 AS fy FROM range(13) a(r), range(26) b(c)
), need AS (SELECT r, c, least(2, greatest(0, floor(fy) + b)) AS sj, least(6, greatest(0, floor(fx) + a)) AS si, sum((CASE WHEN a = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END) * (CASE WHEN b = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END)) AS w FROM pts, range(2) x(a), range(2) y(b) GROUP BY ALL
), counted AS (SELECT *, count(*) OVER (PARTITION BY r, c) AS n FROM need WHERE w > 0
), fine AS (SELECT l.date, r, c, CASE WHEN count(l.value) = max(n) THEN sum(w * l.value) END AS value FROM counted JOIN layers l ON l."row" = sj AND l.col = si GROUP BY ALL
), tiles AS (SELECT "row" - 4 AS r, col - 5 AS c, avg(pop) AS pop FROM (SELECT "row", col, pop FROM people WHERE col < 24 UNION ALL SELECT "row", col, pop / 2 FROM people WHERE col >= 16) WHERE col BETWEEN 5 AND 30 AND "row" BETWEEN 4 AND 16 GROUP BY 1, 2
), zones AS (SELECT adm1_en, xmin + CASE WHEN n_nationkey = 24 THEN 100 ELSE 0 END AS xmin, xmax + CASE WHEN n_nationkey = 24 THEN 100 ELSE 0 END AS xmax, ymin, ymax FROM boxes
), cover AS (SELECT adm1_en, r, c, (least(xmax, c + 6) - greatest(xmin, c + 5)) * (least(ymax, 16 - r) - greatest(ymin, 15 - r)) AS w FROM zones, range(13) a(r), range(26) b(c) WHERE least(xmax, c + 6) > greatest(xmin, c + 5) AND least(ymax, 16 - r) > greatest(ymin, 15 - r)
), exposed AS (SELECT f.date, f.r, f.c, f.value * t.pop AS value FROM fine f JOIN tiles t USING (r, c)
), met AS (SELECT adm1_en, date, coalesce(sum(w * value), 0) AS x FROM cover JOIN exposed USING (r, c) GROUP BY 1, 2)
SELECT z.adm1_en, d.date, 'sum' AS stat, round(coalesce(x, 0), 4) AS pop_exposed FROM (SELECT DISTINCT adm1_en FROM zones) z CROSS JOIN (SELECT DISTINCT date FROM met) d LEFT JOIN met m ON m.adm1_en = z.adm1_en AND m.date = d.date
WHERE m.adm1_en IS NOT NULL OR z.adm1_en NOT IN (SELECT adm1_en FROM met)""")
def zonal_pop_exposure_points(spark: SparkSession, d: str) -> DataFrame:
    """From readings at places to zones: box, axes, mosaic, crop, extent, resampling, zonal sums; one zone lies off the grid."""
    p = inputs.people(spark, d)
    people, grid = raster.crop(p, FINE, _STUDY)
    parts = people.where(F.col("col") < 19), people.where(F.col("col") >= 11).withColumn("pop", F.col("pop") / 2)
    found = zonal_pop_exposure(_points(spark, d), list(parts), grid, _zones_and_one_apart(spark, d), ["adm1_en"], _BOX)
    return found.withColumn("pop_exposed", F.round("pop_exposed", 4)).select("adm1_en", "date", "stat", "pop_exposed")


@query(f"""WITH {ctes('daily', 'people', 'boxes')}, one AS (SELECT date, "row" - 1 AS j, col AS i, max(value) AS value FROM daily WHERE "row" BETWEEN 1 AND 3 AND date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31' GROUP BY 1, 2, 3
), part AS (SELECT j, i, pop * (least(col + 1, 2 + 3.6 * (i + 1)) - greatest(col, 2 + 3.6 * i)) * (least(20 - "row", 14 - j * CAST(8 AS DOUBLE) / 3) - greatest(19 - "row", 14 - (j + 1) * CAST(8 AS DOUBLE) / 3)) AS pop FROM people, range(3) a(j), range(10) b(i)
  WHERE col BETWEEN 2 AND 37 AND "row" BETWEEN 6 AND 13 AND least(col + 1, 2 + 3.6 * (i + 1)) > greatest(col, 2 + 3.6 * i) AND least(20 - "row", 14 - j * CAST(8 AS DOUBLE) / 3) > greatest(19 - "row", 14 - (j + 1) * CAST(8 AS DOUBLE) / 3)
), people2 AS (SELECT j, i, sum(pop) AS pop FROM part GROUP BY 1, 2
), cover AS (SELECT adm1_en, j, i, (least(xmax, 2 + 3.6 * (i + 1)) - greatest(xmin, 2 + 3.6 * i)) * (least(ymax, 14 - j * CAST(8 AS DOUBLE) / 3) - greatest(ymin, 14 - (j + 1) * CAST(8 AS DOUBLE) / 3)) / 9.6 AS w FROM boxes, range(3) a(j), range(10) b(i)
  WHERE least(xmax, 2 + 3.6 * (i + 1)) > greatest(xmin, 2 + 3.6 * i) AND least(ymax, 14 - j * CAST(8 AS DOUBLE) / 3) > greatest(ymin, 14 - (j + 1) * CAST(8 AS DOUBLE) / 3))
SELECT adm1_en, date, coalesce(sum(w * value * pop), 0) AS "sum" FROM one JOIN people2 USING (j, i) JOIN cover USING (j, i) GROUP BY 1, 2""")
def flood_exposure_window_points(spark: SparkSession, d: str) -> DataFrame:
    """The window analysis on the grid of the readings' own axes; population is cropped to it and shared out over its cells."""
    near = raster.within(_points(spark, d), _BOX)
    grid = axes(near)
    daily = raster.on_grid(near, grid).groupBy("date", "row", "col").agg(F.max("value").alias("value"))
    return flood_exposure_window(daily, inputs.people(spark, d), inputs.boxes(spark, d), ["adm1_en"], "1998-03-01", "1998-03-31", grid, FINE, binary=False)  # not rounded: many sums lie halfway


# ---- bands and tables --------------------------------------------------------------------------------------------


def bands(frame: DataFrame, value: str = "pop_exposed_wp") -> DataFrame:
    """Mean, deviation and mean -+ 1.96 deviations of each zone over its years; `se` is 1.96 deviations."""
    w = Window.partitionBy(*relational.matching(frame, "adm"))
    out = frame.withColumns({"mean_exposed": stats.mean_strict_over(F.col(value), w), "sd_exposed": stats.sd_strict_over(F.col(value), w)})
    out = out.withColumn("se", 1.96 * F.col("sd_exposed"))
    return out.withColumns({"lower_ci": F.col("mean_exposed") - F.col("se"), "upper_ci": F.col("mean_exposed") + F.col("se")})


@query(f"""{_STATS}, w AS (SELECT *, CASE WHEN count(pop_exposed_wp) OVER z = count(*) OVER z THEN avg(pop_exposed_wp) OVER z END AS mean_exposed, CASE WHEN count(pop_exposed_wp) OVER z = count(*) OVER z THEN stddev_samp(pop_exposed_wp) OVER z END AS sd_exposed
  FROM d2 WINDOW z AS (PARTITION BY adm0_en, adm1_en, adm1_pcode, adm2_en, adm2_pcode))
SELECT adm1_en, adm2_en, date, round(mean_exposed, 3) AS mean_exposed, round(1.96 * sd_exposed, 3) AS se, round(mean_exposed - 1.96 * sd_exposed, 3) AS lower_ci, round(mean_exposed + 1.96 * sd_exposed, 3) AS upper_ci FROM w WHERE adm0_en = 'ASIA'""")
def ci_band(spark: SparkSession, d: str) -> DataFrame:
    found = bands(_d2(spark, d)).where(F.col("adm0_en") == "ASIA")
    return found.select("adm1_en", "adm2_en", "date", *[F.round(c, 3).alias(c) for c in ("mean_exposed", "se", "lower_ci", "upper_ci")])


@query(f"""{_STATS}, g AS (SELECT adm1_en, adm2_en, avg(pop_exposed_wp) AS m, stddev_samp(pop_exposed_wp) AS s, count(pop_exposed_wp) AS n FROM d2 GROUP BY 1, 2)
SELECT adm1_en, adm2_en, round(m, 3) AS mean, CAST(n AS BIGINT) AS n, round(m - t * s / sqrt(n), 3) AS lower, round(m + t * s / sqrt(n), 3) AS upper FROM g LEFT JOIN (VALUES {', '.join(f'({i}, {t})' for i, t in enumerate(stats.T_975, 1))}) q(df, t) ON df = n - 1""")
def mean_cl_normal(spark: SparkSession, d: str) -> DataFrame:
    """Mean and its 95 % confidence limits by Student's t for each zone."""
    g = _d2(spark, d).groupBy("adm1_en", "adm2_en").agg(F.avg("pop_exposed_wp").alias("m"), F.stddev_samp("pop_exposed_wp").alias("s"), F.count("pop_exposed_wp").alias("n"))
    half = stats.t_quantile_975(F.col("n") - 1) * F.col("s") / F.sqrt("n")
    return g.select("adm1_en", "adm2_en", F.round("m", 3).alias("mean"), "n", F.round(F.col("m") - half, 3).alias("lower"), F.round(F.col("m") + half, 3).alias("upper"))


def shown_table(means: DataFrame, region: str, district: str | None = None, before: list[Column] | None = None) -> DataFrame:
    """A means table as shown: labels, three figures, whole percent. `before`: columns to put in front."""
    names = [*(before or []), F.col(region).alias("Region"), *([F.col(district).alias("District")] if district else [])]
    return means.select(*names, text.three_figures(F.col("mean_exposed")).alias("Average population exposed"), text.three_figures(F.col("total_pop")).alias("Total population"), text.percent(F.col("pct_exposed")).alias("Percent population exposed"))


def country_tables(means: DataFrame, country: str, region: str, district: str | None = None) -> DataFrame:
    """A table for each country, rows grouped by region: shown_table with `country`, `row_group` on a group's first row, and `place`, the row's number in its table.

    The tables lie side by side under one key; `write_tables` gives each its own folder.
    """
    order = [F.col(region), *([F.col(district)] if district else [])]
    first = F.row_number().over(Window.partitionBy(country, region).orderBy(*order)) == 1
    place = F.row_number().over(Window.partitionBy(country).orderBy(*order))
    marked = means.withColumns({"__group": F.when(first, F.col(region)), "__place": place})
    shown = shown_table(marked, region, district, [F.col(country).alias("country"), F.col("__group").alias("row_group"), F.col("__place").alias("place")])
    return shown


def write_tables(tables: DataFrame, path: str, by: str = "country") -> None:
    """One folder of rows for each key, as splitting a frame by key gives one frame each."""
    tables.repartition(by).sortWithinPartitions(by, "place").write.mode("overwrite").partitionBy(by).parquet(path)


def _figures_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN abs({x}) >= 100 THEN format('{{:,.0f}}', round({x} * pow(10.0, 2 - floor(log10(abs({x}))))) / pow(10.0, 2 - floor(log10(abs({x}))))) ELSE format('{{:,.2f}}', {x}) END"


_MEANS1 = f"{_STATS}, m AS (SELECT adm0_en, adm1_en, CASE WHEN count(pop_exposed_wp) = count(*) THEN avg(pop_exposed_wp) END AS me, max(total_pop_wp) AS tp FROM d1 GROUP BY 1, 2)"


@query(f"""{_MEANS1} SELECT adm1_en AS "Region", {_figures_sql('me')} AS "Average population exposed", {_figures_sql('tp')} AS "Total population", format('{{:,.0f}}', round(me / tp * 100)) || '%' AS "Percent population exposed" FROM m WHERE me >= 100""")
def format_table(spark: SparkSession, d: str) -> DataFrame:
    means = province_stats(_d2(spark, d)).groupBy("adm0_en", "adm1_en").agg(stats.mean_strict(F.col("pop_exposed_wp")).alias("mean_exposed"), F.max("total_pop_wp").alias("total_pop"))
    return shown_table(means.where("mean_exposed >= 100").withColumn("pct_exposed", stats.ratio(F.col("mean_exposed"), F.col("total_pop"))), "adm1_en")


def ramp(x: Column, *by: Column) -> Column:
    """Place of a value within its column's range, 0 to 1; the range is that of each table where there are several."""
    w = Window.partitionBy(*by)
    return stats.ratio(x - F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w))


@query(f"{_MEANS1} SELECT adm0_en, adm1_en, round((me - min(me) OVER z) / nullif(max(me) OVER z - min(me) OVER z, 0), 6) AS ramp FROM m WINDOW z AS (PARTITION BY adm0_en)")
def color_ramp(spark: SparkSession, d: str) -> DataFrame:
    means = province_stats(_d2(spark, d)).groupBy("adm0_en", "adm1_en").agg(stats.mean_strict(F.col("pop_exposed_wp")).alias("m"))
    return means.select("adm0_en", "adm1_en", r6(ramp(F.col("m"), F.col("adm0_en"))).alias("ramp"))


@query(f"""{_STATS} SELECT adm2_pcode, date, round(asinh(pop_exposed_wp / 2), 6) AS pseudo_log, format('{{:,.0f}}', round(pop_exposed_wp / 1000)) || 'k' AS label, format('{{:,.0f}}', round(pct_exposed * 100)) || '%' AS pct FROM d2""")
def pseudo_log(spark: SparkSession, d: str) -> DataFrame:
    return _d2(spark, d).select("adm2_pcode", "date", r6(stats.pseudo_log(F.col("pop_exposed_wp"))).alias("pseudo_log"), text.in_thousands(F.col("pop_exposed_wp")).alias("label"), text.percent(F.col("pct_exposed")).alias("pct"))


_MEANS2 = f"{_STATS}, m AS (SELECT adm0_en, adm1_en, adm2_en, CASE WHEN count(pop_exposed_wp) = count(*) THEN avg(pop_exposed_wp) END AS me, max(total_pop_wp) AS tp FROM d2 GROUP BY 1, 2, 3)"


@query(f"""{_MEANS2}, k AS (SELECT *, row_number() OVER (PARTITION BY adm0_en, adm1_en ORDER BY adm2_en) AS n, row_number() OVER (PARTITION BY adm0_en ORDER BY adm1_en, adm2_en) AS place FROM m WHERE me >= 100)
SELECT adm0_en AS country, CASE WHEN n = 1 THEN adm1_en END AS row_group, CAST(place AS INTEGER) AS place, adm1_en AS "Region", adm2_en AS "District", {_figures_sql('me')} AS "Average population exposed", {_figures_sql('tp')} AS "Total population", format('{{:,.0f}}', round(me / tp * 100)) || '%' AS "Percent population exposed" FROM k""")
def country_tables_query(spark: SparkSession, d: str) -> DataFrame:
    means = _d2(spark, d).groupBy("adm0_en", "adm1_en", "adm2_en").agg(stats.mean_strict(F.col("pop_exposed_wp")).alias("mean_exposed"), F.max("total_pop_wp").alias("total_pop")).where("mean_exposed >= 100")
    return country_tables(means.withColumn("pct_exposed", stats.ratio(F.col("mean_exposed"), F.col("total_pop"))), "adm0_en", "adm1_en", "adm2_en")


QUERIES["q_country_tables"], ORACLE["q_country_tables"] = QUERIES.pop("q_country_tables_query"), ORACLE.pop("q_country_tables_query")
