import pytest
from pyspark.sql import functions as F

from tamarisk.functions import stats
from tamarisk.operators import dissolve, ordered, raster, relational, zonal
from tamarisk.operators.raster import Grid
from tamarisk.plans import flood, food


def cells(spark, rows):
    return spark.createDataFrame(rows, "row int, col int, value double")


def values(df):
    return {(r.row, r.col): r.value for r in df.collect()}


def test_natural_join_matches_null_keys(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([(None, 3)], "k string, y int")
    assert sorted(map(tuple, relational.natural_left_join(left, right).collect()), key=str) == [("a", 1, None), (None, 2, 3)]
    with pytest.raises(ValueError):
        relational.natural_left_join(left.select("x"), right.select("y"))


def test_suffix_goes_to_clashing_right_columns(spark):
    left, right = (spark.createDataFrame([("a", z)], "k string, z int") for z in (1, 2))
    assert relational.join_suffixed(left, right, ["k"], "_shp").columns == ["k", "z", "z_shp"]


def test_outer_merge(spark):
    x = spark.createDataFrame([("a", 1), ("b", 2)], "id string, z int")
    y = spark.createDataFrame([("b", "q", 3), ("c", "r", 4)], "fixed string, id string, w int")
    out = relational.merge_outer(x, y, "id", "fixed")
    assert out.columns == ["id", "z", "id_y", "w"]
    assert sorted(map(tuple, out.collect())) == [("a", 1, None, None), ("b", 2, "q", 3), ("c", None, "r", 4)]


def test_reshaping(spark):
    wide = spark.createDataFrame([("k", 1.0, None)], "adm string, x double, y double")
    assert relational.longer(wide, ["x", "y"]).count() == 2
    split = relational.separate(spark.createDataFrame([("sum.1998-01-12",), ("sum",)], "name string"), "name", ["stat", "date"])
    assert [tuple(r) for r in split.collect()] == [("sum", "1998-01-12"), ("sum", None)]
    named = relational.unite(spark.createDataFrame([("Zambia", None)], "a string, b string"), "id", ["a", "b"])
    assert named.first().id == "Zambia_NA"
    twice = spark.createDataFrame([("k", "sum", 1.0), ("k", "sum", 2.0)], "k string, stat string, v double")
    with pytest.raises(Exception, match="more than one value"):
        relational.wider(twice, "stat", "v", ["sum"]).collect()


def test_row_sums(spark):
    frame = spark.createDataFrame([(None, None, None), (1, None, 2), (5, None, None)], "a int, b int, c int")
    rows = frame.select(relational.row_sum(["a", "b", "c"]), relational.row_sum(["b", "c"])).collect()
    assert [tuple(r) for r in rows] == [(None, None), (3, 2), (5, None)]


def test_names():
    assert [relational.snake(n) for n in ("Total country population", "ADM1_PT", "Level 1", "fooBar")] == ["total_country_population", "adm1_pt", "level_1", "foo_bar"]


def test_layer_max(spark):
    rows = [("2000-01-02", 0, 0, 0.1), ("2000-01-03", 0, 0, 0.3), ("2000-01-02", 0, 1, 0.1), ("2000-01-03", 0, 1, None)]
    daily = spark.createDataFrame(rows, "date string, row int, col int, value double").withColumn("date", F.col("date").cast("date"))
    out = raster.layer_max(daily)
    assert {(r.col, r.value, str(r.date)) for r in out.collect()} == {(0, 0.3, "2000-01-02"), (1, None, "2000-01-02")}


def test_mosaic_means_overlaps(spark):
    assert values(raster.mosaic(cells(spark, [(0, 0, 10.0), (0, 1, 10.0)]), cells(spark, [(0, 0, 20.0)]))) == {(0, 0): 15, (0, 1): 10}


def test_resampling(spark):
    two, four = Grid(0, 1, 2, 1, 1, 2), Grid(0, 1, 1, 1, 1, 4)
    assert values(raster.resample_bilinear(cells(spark, [(0, 0, 0.0), (0, 1, 4.0)]), two, four)) == {(0, 0): 0, (0, 1): 1, (0, 2): 3, (0, 3): 4}
    assert values(raster.resample_near(cells(spark, [(0, 0, 0.0), (0, 1, 4.0)]), two, four)) == {(0, 0): 0, (0, 1): 0, (0, 2): 4, (0, 3): 4}
    assert values(raster.resample_sum(cells(spark, [(0, i, i + 1.0) for i in range(4)]), four, two)) == {(0, 0): 3, (0, 1): 7}
    assert values(raster.resample_bilinear(cells(spark, [(0, 0, 5.0)]), two, four, propagate=False))[(0, 2)] == 5
    assert values(raster.resample_bilinear(cells(spark, [(0, 0, 5.0)]), two, four)) == {(0, 0): 5, (0, 1): None, (0, 2): None}


def test_constant_grid_stays_constant(spark):
    source, target = Grid(0, 6, 2, 2, 3, 4), Grid(0.5, 5.5, 0.7, 0.7, 6, 9)
    out = raster.resample_bilinear(cells(spark, [(r, c, 7.0) for r in range(3) for c in range(4)]), source, target)
    assert all(v == pytest.approx(7) for v in values(out).values()) and out.count() == 54


def test_crop_and_extent():
    grid = raster.set_extent(Grid(0, 10, 1, 1, 10, 10), (0, 20, 0, 5))
    assert (grid.dx, grid.dy) == (2, 0.5)
    assert raster.grid_of_axes((0.5, 3.5, 4), (0.5, 1.5, 2), edges=True).extent == (0, 4, 0, 2)
    assert raster.grid_of_axes((0.5, 3.5, 4), (0.5, 1.5, 2)).extent == (0.5, 3.5, 0.5, 1.5)


def test_zonal_sums(spark):
    grid = Grid(0, 1, 1, 1, 1, 2)
    zone = spark.createDataFrame([("z", 0.5, 0.0, 2.0, 1.0)], "zone string, xmin double, ymin double, xmax double, ymax double")
    found = zonal.zonal_sum(zonal.box_coverage(zone, grid), cells(spark, [(0, 0, 1.0), (0, 1, 2.0)]), ["zone"])
    assert [tuple(r) for r in found.collect()] == [("z", 2.5)]


def covered(spark, shapes, grid):
    """{(zone, row, col): coverage} of {zone: rings}."""
    zones = spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in shapes.items()], f"k string, rings {zonal.RINGS}")
    return {(r.k, r.row, r.col): r.coverage for r in zonal.polygon_coverage(zones, grid).collect()}


def square(x, y, side, back=False):
    ring = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    return ring[::-1] if back else ring


def clipped(ring, x0, y0, x1, y1):
    """Signed area of a ring inside a box, by cutting it at each side in turn."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for i, b in enumerate(ring):
            a = ring[i - 1]
            a_in, b_in = (a[axis] - bound) * keep >= 0, (b[axis] - bound) * keep >= 0
            if a_in != b_in:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if b_in:
                out.append(b)
        ring = out
    return sum(ring[i - 1][0] * p[1] - p[0] * ring[i - 1][1] for i, p in enumerate(ring)) / 2


def test_polygon_coverage(spark):
    grid = Grid(0, 2, 1, 1, 2, 2)
    got = covered(spark, {"triangle": [[(0, 0), (2, 0), (0, 2)]], "holed": [square(0, 0, 2), square(0.5, 0.5, 1)], "none": [], "flat": [[(0, 0), (1, 1)]], "empty ring": [[], square(0, 0, 1)]}, grid)
    assert {k[1:]: v for k, v in got.items() if k[0] == "triangle"} == pytest.approx({(1, 0): 1, (1, 1): 0.5, (0, 0): 0.5})
    assert {k[1:]: v for k, v in got.items() if k[0] == "holed"} == pytest.approx({(r, c): 0.75 for r in (0, 1) for c in (0, 1)})
    assert {k[0] for k in got} == {"triangle", "holed", "empty ring"}


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_shapes_of_several_parts(spark, order):
    """Outlines apart, holes, islands in lakes and lakes on those, in any order and either way round."""
    grid = Grid(0, 12, 1, 1, 12, 12)
    parts = {"apart": [square(0.5, 0.5, 4), square(7, 7, 2)], "island": [square(0.5, 0.5, 10), square(1.5, 1.5, 8), square(3, 3, 4), square(4.25, 4.25, 1)], "touching": [square(1, 1, 2), square(3, 3, 2), square(3, 1, 1)]}
    turn = lambda rings: [r[::-1] if (order + i) % 2 else r for i, r in enumerate(rings[order % len(rings) :] + rings[: order % len(rings)])]
    got = covered(spark, {k: turn(v) for k, v in parts.items()}, grid)
    areas = {k: sum(v for key, v in got.items() if key[0] == k) for k in parts}
    assert areas == pytest.approx({"apart": 20, "island": 100 - 64 + 16 - 1, "touching": 9})


def test_covered_cells_are_those_of_clipping_each(spark):
    """Stars with holes, in part beyond the grid, against each ring clipped to each cell."""
    import math
    import random

    random.seed(5)
    grid = Grid(0, 6, 1, 1.5, 4, 7)
    shapes = {}
    for k in range(40):
        n = random.randint(3, 9)
        angles = sorted(random.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [(3.3 + random.uniform(0.5, 4) * math.cos(t), 3 + random.uniform(0.5, 3.5) * math.sin(t)) for t in angles]
        hole = [(3.3 + 0.3 * math.cos(t), 3 + 0.3 * math.sin(t)) for t in angles]
        shapes[str(k)] = random.choice([[ring], [[(1.0, 1.5), (5.0, 1.5), (5.0, 4.5), (1.0, 4.5)], hole], [[(1.0, 1.0), (6.0, 1.0), (6.0, 5.0), (1.0, 5.0)]], [[(-3.0, -2.0), (9.0, -2.0), (9.0, 9.0), (-3.0, 8.0)]]])
    got = covered(spark, shapes, grid)
    for k, rings in shapes.items():
        for r in range(4):
            for c in range(7):
                areas = [abs(clipped(ring, c, 6 - (r + 1) * 1.5, c + 1, 6 - r * 1.5)) / 1.5 for ring in rings]
                assert got.get((k, r, c), 0) == pytest.approx(areas[0] - sum(areas[1:]), abs=1e-9)


def test_coverage_of_a_hundred_thousand_edges(spark):
    """A comb's area, and its row that teeth cross; work grows with edges, not with edges times rows."""
    import math

    n = 100_000
    ring = [(50 + (40 + math.sin(40 * t)) * math.cos(t), 50 + (40 + math.sin(40 * t)) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]
    true = abs(sum(ring[i - 1][0] * p[1] - p[0] * ring[i - 1][1] for i, p in enumerate(ring))) / 2
    got = covered(spark, {"a": [ring]}, Grid(0, 100, 0.25, 0.25, 400, 400))
    assert sum(got.values()) / 16 == pytest.approx(true, rel=1e-9) and max(got.values()) == 1 and min(got.values()) > 0


def test_sums_do_not_hang_on_partitions(spark):
    import random
    from fractions import Fraction

    rng = random.Random(9)
    rows = [(i % 3, rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-30, 30) if i % 50 else None) for i in range(3000)]
    rows += [(4, 1e308), (4, -1e308), (4, 5e-324), (5, None), (6, float("inf")), (6, 1.0), (7, 0.0), (7, -0.0), (8, 0.1), (8, 0.2), (8, -0.3)]
    seen = set()
    for parts in (1, 2, 3, 7, 16):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k int, x double").repartition(parts)
        out = stats.sum_exactly(df, ["k"], {"s": F.col("x"), "t": F.col("x") / 4}).collect()
        seen.add(tuple(sorted((r.k, str(r.s), str(r.t)) for r in out)))
    assert len(seen) == 1
    got = {r.k: r.s for r in out}
    for k in (0, 1, 2, 8):
        assert got[k] == pytest.approx(float(sum(Fraction(x) for i, x in rows if i == k and x is not None)), rel=1e-15)
    assert got[4] == 5e-324 and got[5] is None and got[6] == float("inf") and got[7] == 0


@pytest.mark.parametrize("large", [1 << 20, 5])
def test_ranks_and_medians(spark, monkeypatch, large):
    """Also where all groups count as too large for one sort, so that parts begin from the counts before them."""
    import random
    import statistics

    monkeypatch.setattr(ordered, "SORTED", large)
    rng = random.Random(10)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(0, 9) / 4, rng.random() * 100]), float(i)) for i in range(900)] + [("c", None, 1.0), ("d", 2.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    got = {r.k: (r.mx, r.my) for r in ordered.medians(df, ["k"], {"mx": F.col("x"), "my": F.col("y")}).collect()}
    own = lambda k, i: [r[i] for r in rows if r[0] == k and r[i] is not None]
    assert got == {k: tuple(statistics.median(own(k, i)) if own(k, i) else None for i in (1, 2)) for k in {r[0] for r in rows}}
    for keys in ([], ["k"]):
        out = ordered.ranked(df, keys, "x").collect()
        assert len(out) == len(rows)
        for r in rng.sample(out, 60):
            among = own(r.k, 1) if keys else [x for _, x, _ in rows if x is not None]
            assert r.rank == (None if r.x is None else sum(x < r.x for x in among) + (sum(x == r.x for x in among) + 1) / 2)


def test_large_groups_have_no_single_window(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SORTED", 100)
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("double").alias("x"))
    out = ordered.ranked(df, [], "x")
    plan = str(out._jdf.queryExecution().executedPlan())
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    # values go by part; only the parts' totals, one row each, are in one task
    assert len(windows) == 2 and sum("windowspecdefinition(__part" in w and "sum(n" in w for w in windows) == 1 and sum("sum(__n" in w for w in windows) == 1
    assert sorted(r["rank"] for r in out.collect()) == [float(i) for i in range(1, 5001)]


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Whatever the number of shuffle partitions (4 here); half of all rows have one value, and a group has none."""
    import statistics

    monkeypatch.setattr(ordered, "ROWS", 100, raising=False)
    df = spark.range(5000).select((F.col("id") % 40).alias("k"), F.when(F.col("id") % 40 != 7, F.when(F.col("id") % 80 < 40, 3.0).otherwise(F.col("id") / 2)).alias("x"))
    out = ordered.medians(df, ["k"], {"m": F.col("x")})
    assert out.rdd.getNumPartitions() >= 50
    own = lambda k: [3.0 if i % 80 < 40 else i / 2 for i in range(k, 5000, 40)]
    assert {r.k: r.m for r in out.collect()} == {k: None if k == 7 else statistics.median(own(k)) for k in range(40)}


def test_tasks_that_deal_rows_read_small_files(spark, monkeypatch):
    """A task that deals rows out holds what it reads; rows pack well here, so one split of the files would hold them all."""
    written = []
    kept = ordered.settled
    monkeypatch.setattr(ordered, "ROWS", 4000)
    monkeypatch.setattr(ordered, "settled", lambda *a, **more: written.append(kept(*a, **more)) or written[-1])
    out = ordered.medians(spark.range(0, 20_000, 1, 1).select(F.lit("k").alias("k"), F.lit(1.5).alias("x")), ["k"], {"m": F.col("x")})
    assert [tuple(r) for r in out.collect()] == [("k", 1.5)]
    assert written[0].count() == 20_000 and max(r["count"] for r in written[0].groupBy(F.input_file_name()).count().collect()) <= 1000


def test_full_outer_join_with_a_hot_key(spark, monkeypatch):
    """Half of all rows on one key, with and without partners; parts meet once."""
    left = [("" if i % 2 else f"k{i % 7}", i) for i in range(200)] + [(None, 900), ("only left", 901)]
    for rights in ([("k0", 1), ("k1", 2), ("k1", 3), ("zz", 4), (None, 5)], [("", 1), ("", 2), ("zz", 4)], [("", i) for i in range(25)], []):
        frames = spark.createDataFrame(left, "k string, v int").repartition(4), spark.createDataFrame(rights, "key string, v int")
        found = []
        for hot in (1 << 17, 10):
            monkeypatch.setattr(relational, "HOT", hot)
            out = relational.merge_outer(*frames, "k", "key")
            assert out.columns == ["k", "v", "v_y"]
            found.append(sorted(map(str, out.collect())))
        assert found[0] == found[1]


def rings_of(df):
    return {r.k: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in df.collect()}


def area(ring):
    return sum(ring[i - 1][0] * p[1] - p[0] * ring[i - 1][1] for i, p in enumerate(ring)) / 2


def test_dissolve(spark):
    shapes = [("a", [square(0, 0, 1)]), ("a", [square(1, 0, 1, back=True)]), ("b", [square(5, 0, 1)])]
    # squares of unlike size side by side; squares that meet in a corner; a frame of four boxes around a hole
    shapes += [("unlike", [square(0, 0, 4)]), ("unlike", [square(4, 0, 2)]), ("unlike", [square(4, 2, 1)]), ("unlike", [square(4, 3, 1)]), ("corner", [square(0, 0, 1)]), ("corner", [square(1, 1, 1)])]
    shapes += [("frame", [[(0, 0), (3, 0), (3, 1), (0, 1)]]), ("frame", [[(0, 2), (3, 2), (3, 3), (0, 3)]]), ("frame", [square(0, 1, 1)]), ("frame", [square(2, 1, 1)])]
    shapes += [("parts", [square(0, 0, 1), square(9, 9, 1)]), ("parts", [square(1, 0, 1)])]
    rows = [(k, [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in shapes]
    got = rings_of(dissolve.dissolve(spark.createDataFrame(rows, f"k string, rings {zonal.RINGS}").repartition(3), ["k"]))
    areas = {k: sorted(area(r) for r in rings) for k, rings in got.items()}
    assert areas == {"a": [2], "b": [1], "unlike": [22], "corner": [1, 1], "frame": [-1, 9], "parts": [1, 2]}
    perimeter = lambda rings: sum(abs(r[i][0] - r[i - 1][0]) + abs(r[i][1] - r[i - 1][1]) for r in rings for i in range(len(r)))
    assert perimeter(got["unlike"]) == 20 and perimeter(got["a"]) == 6


def test_a_long_border_is_chained(spark):
    """A ring of thousands of edges in one order, by rounds that double how far each edge sees."""
    import math

    n = 5000
    points = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    borders = spark.createDataFrame([("a", *points[i], *points[(i + 1) % n]) for i in range(n)], "k string, x1 double, y1 double, x2 double, y2 double").repartition(4)
    out = sorted(dissolve.chained(borders, ["k"]).collect(), key=lambda r: r.place)
    assert [r.place for r in out] == list(range(n)) and len({r.ring for r in out}) == 1
    at = points.index((out[0].x, out[0].y))
    assert [(r.x, r.y) for r in out] == points[at:] + points[:at]


def test_exposure_modes(spark):
    daily = spark.createDataFrame([("2000-01-01", r, c, v) for r in range(5) for c, v in enumerate([0.1, 0.1, 0.1, 0.5, 0.5, 0.5, 0.5, None, None, None])], "date string, row int, col int, value double").withColumn("date", F.col("date").cast("date"))
    people = spark.createDataFrame([(0, 1, 100.0), (0, 20, 100.0), (0, 36, 100.0)], "row int, col int, pop double")
    zones = spark.createDataFrame([(n, x, 19.0, x + 1, 20.0) for n, x in (("low", 1.0), ("high", 20.0), ("none", 36.0))], "zone string, xmin double, ymin double, xmax double, ymax double")
    cover = zonal.box_coverage(zones, flood.FINE)
    got = {m: {r.zone: r.pop_exposed for r in flood.zonal_exposure(daily, people, cover, ["zone"], flood.COARSE, flood.FINE, m, t).collect()} for m, t in (("asrun", 0.2), ("binary", 0.2), ("fraction_floor", 0.005))}
    assert got["asrun"] == got["fraction_floor"] == pytest.approx({"low": 10, "high": 50, "none": 0})
    assert got["binary"] == {"low": 0, "high": 100, "none": 0}


def test_phase_maps(spark):
    joined = spark.createDataFrame([("x", "3+", "current", "5"), ("y", None, None, None)], "admin_id string, phase string, validity_period string, number string")
    assert [r.admin_id for r in food.phase_map(joined, "3+", "current").collect()] == ["x"]
    assert food.phase_map(joined, "3+", "current", keep_unmatched=True).count() == 2


def test_phase_five_menu(spark):
    long = spark.createDataFrame([("phase5_num_t", 1.0)], "labels string, vals double")
    assert (food.shown_measure(long, "Phase 5").count(), food.shown_measure(long, "Phase 5", strict=False).count()) == (0, 1)


def test_key_repair(spark):
    phases = spark.createDataFrame([("Zambia_Muchiga",), ("Foo_Bar",), ("Zambia_Lusaka",)], "admin_id string")
    areas = spark.createDataFrame([("Zambia_Lusaka",), ("Zambia_Lusaka",)], "admin_id string")
    assert {r.admin_id: r.admin_fixed for r in food.repaired(phases, areas).collect()} == {"Zambia_Muchiga": "Zambia_Northern", "Foo_Bar": "", "Zambia_Lusaka": "Zambia_Lusaka"}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_readings_fall_on_both_sides(spark, sf):
    """The queries' floods vary: thresholds part them, flags have two values, and exposure modes differ, at each size."""
    from tamarisk.plans import inputs

    d = f"/root/testdata/{sf}"
    layers = raster.layer_max(inputs.daily(spark, d)).select("date", "row", "col", "value")
    fine = raster.resample_bilinear(layers, inputs.COARSE, inputs.FINE)
    row = fine.agg(*[F.sum(F.when(F.col("value") >= t, 1).otherwise(0)).alias(f"over{t}".replace(".", "")) for t in (0.2, 0.4, 0.6, 0.7, 0.9)], F.count("value").alias("n"), F.count_distinct("value").alias("k")).first()
    assert all(0 < row[i] < row["n"] for i in range(5)) and row["k"] > 100
    got = {m: {tuple(r[:2]): r.pop_exposed for r in flood._exposed(spark, d, m, 0.7).collect()} for m in ("asrun", "binary", "fraction_floor")}
    assert len({tuple(sorted(v.items())) for v in got.values()}) == 3


def test_bilinear_does_not_hang_on_row_order(spark):
    import random

    random.seed(2)
    source, target = Grid(0, 6, 2, 2, 3, 4), Grid(0.5, 5.5, 0.7, 0.7, 6, 9)
    rows = [(r, c, random.random()) for r in range(3) for c in range(4)]
    seen = set()
    for _ in range(3):
        random.shuffle(rows)
        seen.add(tuple(sorted(values(raster.resample_bilinear(cells(spark, rows).repartition(5), source, target)).items())))
    assert len(seen) == 1


def test_axes_as_run_hold_the_same_array(spark):
    from tamarisk.sources.grids import axes

    points = spark.createDataFrame([(x, y, float(x * 10 + y)) for x in (2.0, 6.0, 10.0) for y in (1.0, 3.0)], "lon double, lat double, value double")
    run, true = axes(points), axes(points, edges=True)
    assert (run.extent, true.extent) == ((2, 10, 1, 3), (0, 12, 0, 4))
    assert values(raster.on_grid(points, run)) == values(raster.on_grid(points, true)) and (raster.on_grid(points, run).where("row is null").count()) == 0


def test_zone_without_cells_has_a_row_in_each_layer(spark):
    grid = Grid(0, 1, 1, 1, 1, 2)
    zones = spark.createDataFrame([("z", 0.0, 0.0, 2.0, 1.0), ("far", 7.0, 0.0, 8.0, 1.0)], "zone string, xmin double, ymin double, xmax double, ymax double")
    layers = spark.createDataFrame([(d, 0, c, 1.0) for d in ("a", "b") for c in range(2)], "date string, row int, col int, value double")
    found = zonal.zonal_sum(zonal.box_coverage(zones, grid), layers, ["zone"], zones=zones)
    assert sorted(map(tuple, found.select("zone", "date", "sum").collect())) == [("far", "a", 0), ("far", "b", 0), ("z", "a", 2), ("z", "b", 2)]


def test_tables_by_country(spark, tmp_path):
    means = spark.createDataFrame([("A", "r1", "d1", 120.0, 400.0, 0.3), ("A", "r1", "d2", 130.0, 400.0, 0.3), ("B", "r2", "d3", 140.0, 400.0, 0.35)], "adm0_en string, adm1_en string, adm2_en string, mean_exposed double, total_pop double, pct_exposed double")
    tables = flood.country_tables(means, "adm0_en", "adm1_en", "adm2_en")
    assert sorted((r.country, r.place, r.row_group) for r in tables.collect()) == [("A", 1, "r1"), ("A", 2, None), ("B", 1, "r2")]
    flood.write_tables(tables.toDF(*[c.replace(" ", "_") for c in tables.columns]), f"file://{tmp_path}/tables")
    assert sorted(p.name for p in (tmp_path / "tables").glob("country=*")) == ["country=A", "country=B"]


def test_renamed_country_meets_its_phases(spark):
    areas = spark.createDataFrame([("Swaziland", "Hhohho"), ("Zambia", "Lusaka")], "COUNTRY string, Admin string")
    assert {r.admin_id for r in food.area_keys(areas, "COUNTRY", "Admin").collect()} == {"Eswatini_Hhohho", "Zambia_Lusaka"}
    assert areas.select(food.phase_title("3+", F.lit("first projection"))).first()[0] == "Acute Food Insecurity IPC Phase 3+ (First Projection)"


def test_geometry_keeps_its_rings_beside_stats(spark):
    zones = spark.createDataFrame([("A", [[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]]), ("B", [])], f"adm1_en string, rings {zonal.RINGS}")
    stats = spark.createDataFrame([("A", 2.0)], "adm1_en string, mean_exposed double")
    rows = {r.adm1_en: (len(r.rings), r.mean_exposed) for r in relational.natural_left_join(zones, stats).collect()}
    assert rows == {"A": (1, 2.0), "B": (0, None)}
