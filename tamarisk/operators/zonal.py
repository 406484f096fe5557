"""Zonal sums: cells meet zones by an equi-join on row and column, weighted with the part of the cell inside.

Zones are boxes, whose coverage is plain column arithmetic, or polygons. A polygon is its edges, cut at the rows of
the grid and then at its columns: each piece says how much of its own cell lies to its right, and how far all cells
further right are turned inside or outside by it. Sums over cells and a running sum along each row give the coverage,
so that work grows with edges and covered cells, and neither a polygon nor a cell's edges are ever in one place. Boxes
are exploded over their cells, so no range join is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.functions.stats import sum_exactly
from tamarisk.operators.raster import Grid
from tamarisk.operators.staging import settled

#: Rings of a shape, in any order and either way round: outlines, holes in them, islands in those.
RINGS = "array<array<struct<x:double,y:double>>>"


def _cells(zones: DataFrame, grid: Grid, x0: Column, x1: Column, y0: Column, y1: Column) -> DataFrame:
    """Zones times the cells of their boxes."""
    col = F.sequence(F.greatest(F.lit(0), grid.column(x0)), F.least(F.lit(grid.ncol - 1), F.ceil((x1 - grid.x0) / grid.dx).cast("int") - 1))
    row = F.sequence(F.greatest(F.lit(0), grid.line(y1)), F.least(F.lit(grid.nrow - 1), F.ceil((F.lit(grid.y0) - y0) / grid.dy).cast("int") - 1))
    meets = (x1 > grid.x0) & (x0 < grid.extent[1]) & (y1 > grid.extent[2]) & (y0 < grid.y0)
    return zones.where(meets).withColumn("row", F.explode(row)).withColumn("col", F.explode(col))


def box_coverage(zones: DataFrame, grid: Grid, xmin: str = "xmin", ymin: str = "ymin", xmax: str = "xmax", ymax: str = "ymax") -> DataFrame:
    """Zones by cell, with `coverage`, the part of the cell inside the box."""
    x0, x1, y0, y1 = (F.col(c) for c in (xmin, xmax, ymin, ymax))
    left, top = F.lit(grid.x0) + F.col("col") * grid.dx, F.lit(grid.y0) - F.col("row") * grid.dy
    w = F.least(x1, left + grid.dx) - F.greatest(x0, left)
    h = F.least(y1, top) - F.greatest(y0, top - grid.dy)
    return _cells(zones, grid, x0, x1, y0, y1).withColumn("coverage", w * h / (grid.dx * grid.dy)).where("coverage > 0")


def signed_area(ring: np.ndarray) -> float:
    """Area of a ring (n, 2), positive where it runs anticlockwise."""
    if len(ring) < 3:
        return 0.0
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _crossings(ring: np.ndarray, y: float) -> np.ndarray:
    """Where a ring meets a horizontal line that none of its vertices is on."""
    a, b = ring, np.roll(ring, -1, axis=0)
    over = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[over], b[over]
    return np.sort(a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0]))


def _inner_point(ring: np.ndarray, others: list[np.ndarray]) -> tuple[float, float]:
    """A point inside a ring on a line that meets no vertex of any ring."""
    lo, hi = ring[:, 1].min(), ring[:, 1].max()
    ys = np.unique(np.concatenate([ring[:, 1], *(r[(r[:, 1] >= lo) & (r[:, 1] <= hi), 1] for r in others)]))
    at = int(np.argmax(np.diff(ys)))
    y = (ys[at] + ys[at + 1]) / 2
    xs = _crossings(ring, y)
    widest = int(np.argmax(xs[1::2] - xs[::2]))
    return (xs[2 * widest] + xs[2 * widest + 1]) / 2, y


def turned(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Rings with the inside to their left: those within an even number of larger ones run anticlockwise, others clockwise.

    Which way round they came does not matter. Rings may touch, but not cross; those without area are left out.
    """
    areas = [signed_area(r) for r in rings]
    kept = sorted((i for i, a in enumerate(areas) if a), key=lambda i: (-abs(areas[i]), i))
    found, boxes = [], []
    for place, i in enumerate(kept):
        ring = rings[i]
        low, high = ring.min(axis=0), ring.max(axis=0)
        around = [k for k in range(place) if (boxes[k][0] <= low).all() and (boxes[k][1] >= high).all()]
        depth = 0
        if around:
            x, y = _inner_point(ring, [rings[kept[k]] for k in around])
            depth = sum(int((_crossings(rings[kept[k]], y) > x).sum()) % 2 for k in around)
        boxes.append((low, high))
        found.append(ring if (areas[i] > 0) == (depth % 2 == 0) else ring[::-1])
    return found


def edges(zones: DataFrame, rings: str = "rings") -> DataFrame:
    """Zones without their rings times the edges (x1, y1, x2, y2) of these, the inside to the left."""
    keep = [f for f in zones.schema.fields if f.name != rings]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shape = batch.column(rings)[i]
                if not shape.is_valid:
                    continue
                points = [r for r in (shape.values[k].values for k in range(len(shape.values))) if r is not None and len(r)]
                own = turned([np.stack([np.asarray(p.field("x")), np.asarray(p.field("y"))], axis=1) for p in points])
                if not own:
                    continue
                a, b = np.concatenate(own), np.concatenate([np.roll(r, -1, axis=0) for r in own])
                for begin in range(0, len(a), 50_000):
                    some, to = a[begin : begin + 50_000], b[begin : begin + 50_000]
                    row = pa.array(np.full(len(some), i))
                    yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name).take(row) for f in keep} | {"x1": some[:, 0], "y1": some[:, 1], "x2": to[:, 0], "y2": to[:, 1]})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in keep]
    return zones.where(F.size(rings) > 0).mapInArrow(work, ", ".join([*kinds, "x1 double, y1 double, x2 double, y2 double"]))


def polygon_coverage(zones: DataFrame, grid: Grid, rings: str = "rings") -> DataFrame:
    """As box_coverage for polygons; `rings` is dropped after use. Rows that agree in all other columns are one zone."""
    zone = [c for c in zones.columns if c != rings]
    e = edges(zones, rings)
    # in cells from the grid's upper left corner, downwards
    u = lambda x: (F.col(x) - grid.x0) / grid.dx
    v = lambda y: (F.lit(grid.y0) - F.col(y)) / grid.dy
    e = e.select(*zone, u("x1").alias("u1"), v("y1").alias("v1"), u("x2").alias("u2"), v("y2").alias("v2")).where("v1 <> v2")
    # an edge that runs down has the inside to its right
    e = e.withColumn("__way", F.when(F.col("v2") > F.col("v1"), 1.0).otherwise(-1.0))
    down = F.col("__way") > 0
    e = e.select(*zone, "__way", *[F.when(down, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("ua", "u1", "u2"), ("va", "v1", "v2"), ("ub", "u2", "u1"), ("vb", "v2", "v1"))])
    first_row, last_row = F.greatest(F.lit(0), F.floor("va")).cast("int"), F.least(F.lit(grid.nrow - 1), F.ceil("vb") - 1).cast("int")
    strips = e.where((F.col("vb") > 0) & (F.col("va") < grid.nrow)).withColumn("row", F.explode(F.sequence(first_row, last_row)))
    # u at a height, exact at both ends
    at = lambda y: F.when(y <= F.col("va"), F.col("ua")).when(y >= F.col("vb"), F.col("ub")).otherwise(F.col("ua") + (y - F.col("va")) / (F.col("vb") - F.col("va")) * (F.col("ub") - F.col("ua")))
    y0, y1 = F.greatest(F.col("va"), F.col("row").cast("double")), F.least(F.col("vb"), F.col("row") + F.lit(1.0))
    strips = strips.select(*zone, "row", (F.col("__way") * (y1 - y0)).alias("h"), F.least(at(y0), at(y1)).alias("lo"), F.greatest(at(y0), at(y1)).alias("hi"))
    # pieces right of the grid change nothing; what is left of it turns the whole row
    strips = strips.where(F.col("lo") < grid.ncol)
    first_col = F.greatest(F.lit(-1), F.floor("lo")).cast("int")
    last_col = F.greatest(first_col, F.least(F.lit(grid.ncol - 1), F.ceil("hi") - 1)).cast("int")
    pieces = strips.withColumn("col", F.explode(F.sequence(first_col, last_col)))
    a = F.when(F.col("col") < 0, F.col("lo")).otherwise(F.greatest(F.col("lo"), F.col("col").cast("double")))
    b = F.greatest(a, F.least(F.col("hi"), F.col("col") + F.lit(1.0)))
    height = F.when(F.col("hi") > F.col("lo"), F.col("h") * (b - a) / (F.col("hi") - F.col("lo"))).otherwise(F.col("h"))
    inner = F.when(F.col("col") < 0, 0.0).otherwise(height * (F.col("col") + 1 - (a + b) / 2))
    met = sum_exactly(pieces.select(*zone, "row", "col", inner.alias("__in"), height.alias("__turn")), [*zone, "row", "col"], {"__in": F.col("__in"), "__turn": F.col("__turn")})
    along = Window.partitionBy(*zone, "row").orderBy("col")
    before = F.coalesce(F.sum("__turn").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    swept = met.select(*zone, "row", "col", (before + F.col("__in")).alias("__own"), F.sum("__turn").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("__after"), F.lead("col", 1, grid.ncol).over(along).alias("__next"))
    # between pieces the turns so far are the coverage: that part of the row's height is inside; a whole row but for rounding is whole
    inside = F.when(F.abs(F.col("__after") - F.round("__after")) < LEAST_COVER, F.round("__after")).otherwise(F.col("__after"))
    own = F.when(F.col("col") >= 0, F.array(F.struct(F.col("col").alias("col"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__own"))).alias("coverage"))))
    run = F.when((inside > 0) & (F.col("__next") > F.col("col") + 1), F.transform(F.sequence(F.col("col") + 1, F.col("__next") - 1), lambda c: F.struct(c.alias("col"), F.least(F.lit(1.0), inside).alias("coverage"))))
    none = F.array().cast("array<struct<col:int,coverage:double>>")
    cells = swept.withColumn("__cell", F.explode(F.concat(F.coalesce(own, none), F.coalesce(run, none))))
    return cells.select(*zone, "row", F.col("__cell.col").alias("col"), F.col("__cell.coverage").alias("coverage")).where(F.col("coverage") > LEAST_COVER)


#: Coverage up to which a cell counts as only touched; far above what rounding leaves of nothing.
LEAST_COVER = 1e-12


def zonal_sum(coverage: DataFrame, cells: DataFrame, zone: list[str], value: str = "value", to: str = "sum", empty: float | None = 0.0, zones: DataFrame | None = None) -> DataFrame:
    """Coverage-weighted sum of known values for each zone and layer; `empty` where a zone that meets cells has none known.

    With `zones`, a zone that meets no cell has a row with `empty` in each layer too. Sums are exact before they are
    rounded once, so they don't hang on how rows lie in partitions.
    """
    layers = [c for c in cells.columns if c not in ("row", "col", value)]
    joined = coverage.select(*zone, "row", "col", "coverage").join(cells, ["row", "col"])
    met = sum_exactly(joined, [*zone, *layers], {to: F.col("coverage") * F.col(value)})
    met = met.withColumn(to, F.coalesce(to, F.lit(empty)))
    if zones is None:
        return met
    met = settled(met)
    same = [F.col(f"z.{c}").eqNullSafe(F.col(f"m.{c}")) for c in zone]
    bare = zones.select(*zone).distinct().alias("z").join(met.select(*zone).distinct().alias("m"), same, "left_anti")
    if layers:
        bare = bare.crossJoin(met.select(*layers).distinct())  # each pair is a row of the result
    return met.unionByName(bare.withColumn(to, F.lit(empty).cast("double")))


def box_rings(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A box as a polygon."""
    return F.array(ring_of((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax)))


def ring_of(*points: tuple[Column, Column]) -> Column:
    """A ring of corners."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])
