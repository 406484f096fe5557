"""Grids kept as Parquet: daily layers partitioned by year, and single-layer tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.dates import from_index
from tamarisk.functions.stats import clean
from tamarisk.operators.raster import Grid, grid_of_axes


def read_layers(spark: SparkSession, path: str, band: str, lo: str | None = None, hi: str | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(date, lon, lat, value) of one band. Year partitions, dates and the box are filtered in the scan."""
    cube = spark.read.parquet(path)
    if "date" not in cube.columns:
        cube = cube.withColumn("date", from_index(F.col("time_index")))
    if lo is not None:
        cube = cube.where(F.col("date") >= F.lit(lo).cast("date"))
        cube = cube.where(F.col("year") >= int(lo[:4])) if "year" in cube.columns else cube
    if hi is not None:
        cube = cube.where(F.col("date") <= F.lit(hi).cast("date"))
        cube = cube.where(F.col("year") <= int(hi[:4])) if "year" in cube.columns else cube
    if box is not None:
        cube = cube.where(F.col("lat").between(box[1], box[3]) & F.col("lon").between(box[0], box[2]))
    return cube.select("date", "lon", "lat", clean(F.col(band)).alias("value"))


def write_layers(df: DataFrame, path: str, tile: float = 10.0) -> None:
    """Layers partitioned by year and sorted by place, so that dates and boxes prune files and row groups.

    A task writes one year of one tile of `tile` degrees.
    """
    tiles = [F.floor(F.col(c) / tile) for c in ("lat", "lon")]
    df.withColumn("year", F.year("date")).repartition("year", *tiles).sortWithinPartitions("year", "lat", "lon", "date").write.mode("overwrite").partitionBy("year").parquet(path)


def axes(cube: DataFrame, edges: bool = False) -> Grid:
    """The grid of a table's lon and lat values; `edges` as for grid_of_axes."""
    r = cube.agg(F.min("lon"), F.max("lon"), F.count_distinct("lon"), F.min("lat"), F.max("lat"), F.count_distinct("lat")).first()
    return grid_of_axes((r[0], r[1], r[2]), (r[3], r[4], r[5]), edges)


def read_tile(spark: SparkSession, path: str, value: str, to: str = "value") -> DataFrame:
    """(row, col, value) of a tile on the common grid."""
    return spark.read.parquet(path).select("row", "col", clean(F.col(value)).alias(to))
