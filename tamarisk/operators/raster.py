"""Grids as long tables (row, col, value, with a date where there are layers) and their algebra as joins and sums.

Rows count from the top and columns from the left, from 0. A Grid says where the cells lie; it is a few numbers
on the driver, and cells never are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarisk.functions.stats import max_strict, sum_exactly


@dataclass(frozen=True)
class Grid:
    """Left and upper edge, cell size, rows and columns."""

    x0: float
    y0: float
    dx: float
    dy: float
    nrow: int
    ncol: int
    crs: str = "EPSG:4326"

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """xmin, xmax, ymin, ymax."""
        return self.x0, self.x0 + self.ncol * self.dx, self.y0 - self.nrow * self.dy, self.y0

    def x(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + 0.5) * self.dx

    def y(self, row: Column) -> Column:
        return F.lit(self.y0) - (row + 0.5) * self.dy

    def column(self, x: Column) -> Column:
        return F.floor((x - self.x0) / self.dx).cast("int")

    def line(self, y: Column) -> Column:
        return F.floor((F.lit(self.y0) - y) / self.dy).cast("int")

    def cells(self, spark: SparkSession) -> DataFrame:
        """All (row, col)."""
        n = spark.range(self.nrow * self.ncol)
        return n.select((F.col("id") / self.ncol).cast("int").alias("row"), (F.col("id") % self.ncol).cast("int").alias("col"))


def grid_of_axes(xs: tuple[float, float, int], ys: tuple[float, float, int], edges: bool = False) -> Grid:
    """A grid from each axis's least and greatest cell centre and count.

    As run, the centres are taken for the edges, which makes the grid a cell too small in all; `edges` puts the
    edges half a cell further out, where they belong.
    """
    (x_lo, x_hi, nx), (y_lo, y_hi, ny) = xs, ys
    if not edges:
        return Grid(x_lo, y_hi, (x_hi - x_lo) / nx, (y_hi - y_lo) / ny, ny, nx)
    dx, dy = (x_hi - x_lo) / max(1, nx - 1), (y_hi - y_lo) / max(1, ny - 1)
    return Grid(x_lo - dx / 2, y_hi + dy / 2, dx, dy, ny, nx)


def on_grid(points: DataFrame, grid: Grid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points as cells (row, col), null outside the grid.

    The last edge counts as inside, so that a grid whose edges are the outer centres of its axes holds the same array
    as one with true edges: there are as many cells as centres, in the same order.
    """
    place = lambda x, size, n: F.when((x >= 0) & (x <= n * size), F.least(F.lit(n - 1), F.floor(x / size).cast("int")))
    return points.withColumns({"row": place(F.lit(grid.y0) - F.col(lat), grid.dy, grid.nrow), "col": place(F.col(lon) - grid.x0, grid.dx, grid.ncol)})


def within(points: DataFrame, box: tuple[float, float, float, float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points in a box (xmin, ymin, xmax, ymax), edges included; the comparison reaches the scan."""
    return points.where(F.col(lat).between(box[1], box[3]) & F.col(lon).between(box[0], box[2]))


def same_cells(a: Grid, b: Grid) -> None:
    if (a.dx, a.dy) != (b.dx, b.dy):
        raise ValueError("the grids differ in cell size")


def mosaic(*tiles: DataFrame, value: str = "value") -> DataFrame:
    """One grid of several on common rows and columns; where tiles overlap, the mean of known values."""
    rows = tiles[0].select("row", "col", value)
    for t in tiles[1:]:
        rows = rows.unionByName(t.select("row", "col", value))
    return rows.groupBy("row", "col").agg(F.avg(value).alias(value))


def crop(cells: DataFrame, grid: Grid, extent: tuple[float, float, float, float]) -> tuple[DataFrame, Grid]:
    """Cells that meet the extent (xmin, xmax, ymin, ymax), edges rounded to the grid's own, numbered anew."""
    lo, hi = max(0, round((extent[0] - grid.x0) / grid.dx)), min(grid.ncol, round((extent[1] - grid.x0) / grid.dx))
    top, bottom = max(0, round((grid.y0 - extent[3]) / grid.dy)), min(grid.nrow, round((grid.y0 - extent[2]) / grid.dy))
    kept = cells.where(F.col("col").between(lo, hi - 1) & F.col("row").between(top, bottom - 1))
    kept = kept.withColumns({"row": F.col("row") - top, "col": F.col("col") - lo})
    return kept, replace(grid, x0=grid.x0 + lo * grid.dx, y0=grid.y0 - top * grid.dy, nrow=bottom - top, ncol=hi - lo)


def set_extent(grid: Grid, extent: tuple[float, float, float, float]) -> Grid:
    """The same cells stretched over another extent."""
    return replace(grid, x0=extent[0], y0=extent[3], dx=(extent[1] - extent[0]) / grid.ncol, dy=(extent[3] - extent[2]) / grid.nrow)


def layer_max(daily: DataFrame, value: str = "value", day: str = "date") -> DataFrame:
    """Largest value of each cell and year, null if any day's is; named by the cell-year's first day in the table.

    The day is the first of the whole year, so all cells of a layer share it.
    """
    yearly = daily.groupBy(F.year(day).alias("year"), "row", "col").agg(max_strict(F.col(value)).alias(value), F.min(day).alias("__first"))
    first = yearly.groupBy("year").agg(F.min("__first").alias(day))
    return yearly.drop("__first").join(first, "year").select("year", day, "row", "col", value)


def _layers(df: DataFrame, value: str) -> list[str]:
    return [c for c in df.columns if c not in ("row", "col", value)]


def _corners(index: Column, n: int) -> Column:
    """(block, side) along one axis for which a source cell is a corner; blocks -1 and n - 1 lie beyond the outer centres."""
    near = F.array(F.struct(index.alias("block"), F.lit(0).alias("side")), F.struct((index - 1).alias("block"), F.lit(1).alias("side")))
    first = F.when(index == 0, F.array(F.struct(F.lit(-1).alias("block"), F.lit(0).alias("side")))).otherwise(F.filter(near, lambda x: F.lit(False)))
    last = F.when(index == n - 1, F.array(F.struct(F.lit(n - 1).alias("block"), F.lit(1).alias("side")))).otherwise(F.filter(near, lambda x: F.lit(False)))
    return F.concat(near, first, last)


def resample_bilinear(cells: DataFrame, source: Grid, target: Grid, value: str = "value", propagate: bool = True) -> DataFrame:
    """Values at the target's cell centres from the four source centres around, clamped at the edges.

    With `propagate` a target cell is null where any of those that count is null or absent; else the others' weights
    are scaled up. Four source centres are one block: each source cell goes once to each of its four blocks, and the
    target cells of a block then share its row, so the shuffle grows with the source and not with the target. The
    four terms are added in one order, whatever order rows come in.
    """
    fx = (target.x(F.col("col")) - source.x0) / source.dx - 0.5
    fy = (F.lit(source.y0) - target.y(F.col("row"))) / source.dy - 0.5
    clamp = lambda x, n: F.greatest(F.lit(-1), F.least(F.lit(n - 1), F.floor(x).cast("int")))
    at = target.cells(cells.sparkSession).select(F.col("row").alias("r"), F.col("col").alias("c"), clamp(fy, source.nrow).alias("__y"), clamp(fx, source.ncol).alias("__x"), (fx - F.floor(fx)).alias("wx"), (fy - F.floor(fy)).alias("wy"))
    layers = _layers(cells, value)
    spread = cells.withColumn("__i", F.explode(_corners(F.col("col"), source.ncol))).withColumn("__j", F.explode(_corners(F.col("row"), source.nrow)))
    corners = [(y, x) for y in (0, 1) for x in (0, 1)]
    pick = [F.max(F.when((F.col("__j.side") == y) & (F.col("__i.side") == x), F.struct(F.col(value).alias("v")))).alias(f"__v{y}{x}") for y, x in corners]
    blocks = spread.groupBy(*layers, F.col("__j.block").alias("__y"), F.col("__i.block").alias("__x")).agg(*pick)
    weights = {(y, x): (F.col("wy") if y else 1 - F.col("wy")) * (F.col("wx") if x else 1 - F.col("wx")) for y, x in corners}
    term = lambda k, none: F.when(weights[k] > 0, F.coalesce(none, F.lit(0.0))).otherwise(0.0)
    known = lambda k: F.col(f"__v{k[0]}{k[1]}.v")
    total = reduce(lambda a, b: a + b, [term(k, weights[k] * known(k)) for k in corners])
    if propagate:
        whole = reduce(lambda a, b: a & b, [(weights[k] <= 0) | known(k).isNotNull() for k in corners])
        out = F.when(whole, total)
    else:
        held = reduce(lambda a, b: a + b, [term(k, F.when(known(k).isNotNull(), weights[k])) for k in corners])
        out = total / F.when(held > 0, held)
    there = reduce(lambda a, b: a | b, [(weights[k] > 0) & F.col(f"__v{k[0]}{k[1]}").isNotNull() for k in corners])
    met = blocks.join(at, ["__y", "__x"]).where(there)
    return met.select(*layers, F.col("r").alias("row"), F.col("c").alias("col"), out.alias(value))


def resample_near(cells: DataFrame, source: Grid, target: Grid, value: str = "value") -> DataFrame:
    """Each target cell takes the source cell its centre lies in."""
    at = target.cells(cells.sparkSession).select(F.col("row").alias("r"), F.col("col").alias("c"), source.line(target.y(F.col("row"))).alias("row"), source.column(target.x(F.col("col"))).alias("col"))
    return cells.join(at, ["row", "col"]).select(*_layers(cells, value), F.col("r").alias("row"), F.col("c").alias("col"), value)


def resample_sum(cells: DataFrame, source: Grid, target: Grid, value: str = "value") -> DataFrame:
    """Each source value is shared out over target cells by area; null values count for nothing. Sums don't hang on the order of rows."""

    def shares(index: Column, a0: float, da: float, b0: float, db: float, n: int, sign: int) -> Column:
        """(cell, share) along one axis, where positions grow with the index."""
        lo = (F.lit(a0) + index * da - b0) / db if sign > 0 else (F.lit(b0) - (F.lit(a0) - index * da)) / db
        hi = lo + da / db
        whole = F.sequence(F.greatest(F.lit(0), F.floor(lo).cast("int")), F.greatest(F.lit(0), F.least(F.lit(n - 1), (F.ceil(hi) - 1).cast("int"))))
        return F.transform(whole, lambda k: F.struct(k.alias("at"), ((F.least(hi, k + 1) - F.greatest(lo, k)) / (da / db)).alias("share")))

    xs = shares(F.col("col"), source.x0, source.dx, target.x0, target.dx, target.ncol, 1)
    ys = shares(F.col("row"), source.y0, source.dy, target.y0, target.dy, target.nrow, -1)
    layers = _layers(cells, value)
    parts = cells.where(F.col(value).isNotNull()).withColumn("__x", F.explode(xs)).withColumn("__y", F.explode(ys)).where("__x.share > 0 and __y.share > 0")
    shared = parts.select(*layers, F.col("__y.at").alias("row"), F.col("__x.at").alias("col"), (F.col(value) * F.col("__x.share") * F.col("__y.share")).alias("__share"))
    return sum_exactly(shared, [*layers, "row", "col"], {value: F.col("__share")})


def at_least(value: Column, threshold: Column | float) -> Column:
    """1 where the value reaches the threshold, else 0; null stays null."""
    return F.when(value.isNotNull(), F.when(value >= threshold, 1.0).otherwise(0.0))


def presence(value: Column) -> Column:
    """1 for every known value but 0, which becomes null."""
    return F.when(value != 0, 1.0)


def masked(value: Column, mask: Column) -> Column:
    """The value where the mask is known."""
    return F.when(mask.isNotNull(), value)


def multiply(a: DataFrame, b: DataFrame, a_value: str, b_value: str, to: str = "value") -> DataFrame:
    """Products of cells that both grids have, null where either is."""
    return a.join(b.select("row", "col", F.col(b_value).alias("__b")), ["row", "col"]).select(*_layers(a, a_value), "row", "col", (F.col(a_value) * F.col("__b")).alias(to))


def bounds(points: DataFrame, x: str, y: str) -> DataFrame:
    return points.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def index_range(lo: float, hi: float, start: float, size: float, n: int) -> tuple[int, int]:
    """Cells that an interval meets."""
    return max(0, math.floor((lo - start) / size)), min(n - 1, math.ceil((hi - start) / size) - 1)
