"""Unions of neighbouring polygons: inner borders cancel, and what is left is chained into rings by pointer jumping.

Neighbours need not share vertices: an edge is first cut where a vertex of another lies on it, by a join on buckets
of ground. Rings are then found among the edges that are left without holding any of them in one task: each edge knows
the next one, and knows twice as far in each round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.operators.staging import settled
from tamarisk.operators.zonal import edges

ENDS = ["x1", "y1", "x2", "y2"]


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def noded(segments: DataFrame, by: list[str], tolerance: float = 0.0) -> DataFrame:
    """Segments (by, x1, y1, x2, y2) cut where another's end lies on them, within `tolerance`.

    Both sides meet in buckets of ground about as large as an edge is long on average, which an edge has one of for
    each such length; so the join grows with the edges.
    """
    numbered = settled(segments.withColumn("__id", F.monotonically_increasing_id()))
    size = numbered.agg(F.avg(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), F.count("*")).first()
    if not size[1] or not size[0]:
        return segments
    cell = float(size[0])
    at = lambda c: F.floor(c / cell)
    spread = lambda a, b: F.explode(F.sequence(at(F.least(a, b) - tolerance), at(F.greatest(a, b) + tolerance)))
    columns = numbered.withColumn("__bx", spread(F.col("x1"), F.col("x2")))
    # of a long slanted edge only the buckets near it, column by column
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = lambda x: F.when(dx == 0, F.col("y1")).otherwise(F.col("y1") + (F.least(F.greatest(x, F.least("x1", "x2")), F.greatest("x1", "x2")) - F.col("x1")) / dx * dy)
    ya, yb = along(F.col("__bx") * cell - tolerance), along((F.col("__bx") + 1) * cell + tolerance)
    slack = cell * 1e-6 + tolerance
    lo = F.when(dx == 0, F.least("y1", "y2")).otherwise(F.least(ya, yb)) - slack
    hi = F.when(dx == 0, F.greatest("y1", "y2")).otherwise(F.greatest(ya, yb)) + slack
    buckets = columns.withColumn("__by", F.explode(F.sequence(at(lo), at(hi))))
    ends = segments.select(*by, F.col("x1").alias("px"), F.col("y1").alias("py")).distinct()
    ends = ends.withColumns({"__bx": at(F.col("px")), "__by": at(F.col("py"))})
    px, py = F.col("px") - F.col("x1"), F.col("py") - F.col("y1")
    length2 = dx * dx + dy * dy
    place = (px * dx + py * dy) / length2
    off = px * dy - py * dx
    on = (place > 0) & (place < 1) & (off * off <= F.lit(tolerance * tolerance) * length2)
    not_end = ~((F.col("px") == F.col("x1")) & (F.col("py") == F.col("y1"))) & ~((F.col("px") == F.col("x2")) & (F.col("py") == F.col("y2")))
    met = buckets.alias("b").join(ends.alias("e"), _same("b", "e", [*by, "__bx", "__by"])).select(*[F.col(f"b.{c}") for c in [*by, "__id", *ENDS]], "px", "py")
    cuts = met.where(on & not_end).select(*by, "__id", place.alias("__t"), "px", "py").distinct()
    points = numbered.select(*by, "__id", F.lit(0.0).alias("__t"), F.col("x1").alias("px"), F.col("y1").alias("py"))
    points = points.union(numbered.select(*by, "__id", F.lit(1.0), "x2", "y2")).union(cuts)
    own = Window.partitionBy("__id").orderBy("__t")
    pieces = points.select(*by, "__t", F.col("px").alias("x1"), F.col("py").alias("y1"), F.lead("px").over(own).alias("x2"), F.lead("py").over(own).alias("y2"))
    return pieces.where("x2 is not null and (x1 <> x2 or y1 <> y2)").select(*by, *ENDS)


def outline(zones: DataFrame, by: list[str], rings: str = "rings", tolerance: float = 0.0) -> DataFrame:
    """Edges (by, x1, y1, x2, y2) of each group's union, its inside to the left: those that no neighbour runs back along.

    Zones may touch and share borders with other vertices, but not overlap.
    """
    pieces = noded(edges(zones.select(*by, rings), rings), by, tolerance)
    forward = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") <= F.col("y2")))
    low = lambda a, b: F.when(forward, F.col(a)).otherwise(F.col(b))
    turned = pieces.select(*by, low("x1", "x2").alias("xa"), low("y1", "y2").alias("ya"), low("x2", "x1").alias("xb"), low("y2", "y1").alias("yb"), F.when(forward, 1).otherwise(-1).alias("way"))
    left = turned.groupBy(*by, "xa", "ya", "xb", "yb").agg(F.sum("way").alias("way")).where("way <> 0")
    back = F.col("way") < 0
    pick = lambda a, b: F.when(back, F.col(a)).otherwise(F.col(b))
    return left.select(*by, pick("xb", "xa").alias("x1"), pick("yb", "ya").alias("y1"), pick("xa", "xb").alias("x2"), pick("ya", "yb").alias("y2"))


def _successors(borders: DataFrame, by: list[str]) -> DataFrame:
    """(id, next) of borders (by, id, x1 ... y2): where several leave a point, the first one clockwise from where the edge came."""
    a, b = borders.alias("a"), borders.alias("b")
    meets = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by], (F.col("a.x2") == F.col("b.x1")) & (F.col("a.y2") == F.col("b.y1")))
    came = F.atan2(F.col("a.y1") - F.col("a.y2"), F.col("a.x1") - F.col("a.x2"))
    goes = F.atan2(F.col("b.y2") - F.col("b.y1"), F.col("b.x2") - F.col("b.x1"))
    turn = came - goes
    turn = F.when(turn <= 0, turn + 2 * 3.141592653589793).otherwise(turn)
    return a.join(b, meets).groupBy(F.col("a.id").alias("id")).agg(F.min_by(F.col("b.id"), F.struct(turn, F.col("b.id"))).alias("next"))


def chained(borders: DataFrame, by: list[str]) -> DataFrame:
    """Corners of the rings that borders (by, x1, y1, x2, y2) make: by, ring, place (from 0), x, y.

    Two runs of pointer jumping: the first names each ring by its smallest edge, the second counts edges from there.
    Each has as many rounds as the longest ring's length has binary digits.
    """
    borders = settled(borders.withColumn("id", F.monotonically_increasing_id()))
    succ = settled(_successors(borders, by))
    state = settled(succ.select("id", F.col("next").alias("to"), F.least("id", "next").alias("ring")))
    while True:
        ahead = state.select(F.col("id").alias("to"), F.col("to").alias("__to"), F.col("ring").alias("__ring"))
        jumped = state.join(ahead, "to").select("id", F.col("__to").alias("to"), F.least("ring", "__ring").alias("ring"), (F.col("__ring") < F.col("ring")).alias("__less"))
        jumped = settled(jumped)
        state = jumped.select("id", "to", "ring")
        # a round that lowers nothing may still be followed by one that does, unless all rings agree along their edges
        if not jumped.where("__less").take(1):
            agree = state.join(succ, "id").join(state.select(F.col("id").alias("next"), F.col("ring").alias("__ring")), "next").where("ring <> __ring")
            if not agree.take(1):
                break
    ring = state.select("id", "ring")
    # steps to the ring's last edge, the one before its smallest
    steps = succ.join(ring, "id").select("id", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"), F.when(F.col("next") != F.col("ring"), 1).otherwise(0).cast("long").alias("left"))
    steps = settled(steps)
    while steps.where("to is not null").take(1):
        ahead = steps.select(F.col("id").alias("to"), F.col("to").alias("__to"), F.col("left").alias("__left"))
        steps = settled(steps.join(ahead, "to", "left").select("id", "ring", F.col("__to").alias("to"), (F.col("left") + F.coalesce("__left", F.lit(0))).alias("left")))
    longest = steps.groupBy("ring").agg(F.max("left").alias("__most"))
    placed = steps.join(longest, "ring").select("id", "ring", (F.col("__most") - F.col("left")).alias("place"))
    return borders.join(placed, "id").select(*by, "ring", "place", F.col("x1").alias("x"), F.col("y1").alias("y"))


def dissolve(zones: DataFrame, by: list[str], rings: str = "rings", tolerance: float = 0.0) -> DataFrame:
    """Union of each group's polygons: (by, rings), outlines anticlockwise and holes clockwise.

    Borders are cut, cancelled and chained by many tasks (see `outline` and `chained`, whose long tables hold regions of any
    size); only the row that holds a region holds it whole.
    """
    corners = chained(outline(zones, by, rings, tolerance), by)
    each = corners.groupBy(*by, "ring").agg(F.sort_array(F.collect_list(F.struct("place", "x", "y"))).alias("p"))
    each = each.select(*by, "ring", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("r"))
    return each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ring", "r"))).alias("p")).select(*by, F.transform("p", lambda p: p["r"]).alias(rings))
