import datetime
import inspect
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.operators.raster import Grid
from tamarisk.sources import grids, shapes, store, tables
from tamarisk.sources import netcdf as netcdfs
from tamarisk.sources import tiff as tiffs


def test_csv_with_tags(spark, tmp_path):
    path = tmp_path / "rain.csv"
    path.write_text("date,ADM2 PCODE,r1h\n#date,#adm2,#ind\n2020-01-01,MZ01,NA\n2020-01-11,,3.5\n")
    rows = tables.read_csv(spark, str(path), tags="date").collect()
    assert sorted((r.date, r.adm2_pcode, r.r1h) for r in rows) == [("2020-01-01", "MZ01", None), ("2020-01-11", None, "3.5")]
    path.write_text("iso2\nNA\nMW\n")
    assert tables.read_csv(spark, str(path), null=None).where("iso2 = 'NA'").count() == 1


def test_shapefile(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    body = struct.pack("<i4d2i1i", 5, 0, 0, 1, 1, 1, len(ring), 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    field = b"ADM1_EN".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(b"\x03" + b"\0" * 3 + struct.pack("<IHH", 1, 32 + 32 + 1, 11) + b"\0" * 20 + field + b"\r" + b" " + b"Gaza".ljust(10))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for suffix in ("shp", "dbf"):
            z.write(tmp_path / f"a.{suffix}", f"inside/a.{suffix}")
    assert [r.adm1_en for path in ("z.zip", "z.zip/a.shp") for r in shapes.read_shapes(spark, str(tmp_path / path)).collect()] == ["Gaza"] * 2
    levels = shapes.read_levels(spark, str(tmp_path), {"x": ("a", "a"), "y": ("a",)})
    assert (sorted(levels), levels["adm0"].count(), levels["adm1"].count()) == (["adm0", "adm1"], 2, 1)
    row = shapes.read_shapes(spark, str(tmp_path / "a.shp"), r"^adm\d_").first()
    assert row.adm1_en == "Gaza" and [(p.x, p.y) for p in row.rings[0]] == ring[:-1]


def test_layers_prune_by_year(spark, tmp_path):
    days = spark.createDataFrame([("1999-12-31", 0.5, 0.5, 0.1), ("2000-01-01", 0.5, 0.5, float("nan"))], "date string, lon double, lat double, SFED_AREA double").withColumn("date", F.col("date").cast("date"))
    grids.write_layers(days, str(tmp_path / "cube"))
    found = grids.read_layers(spark, str(tmp_path / "cube"), "SFED_AREA", "2000-01-01", "2000-12-31")
    assert [r.value for r in found.collect()] == [None]
    assert "PartitionFilters: [isnotnull(year" in found._jdf.queryExecution().toString()


def test_store_keeps_results(spark, tmp_path):
    s, runs = store.Store(spark, f"file://{tmp_path}/store"), []

    @s.node
    def numbers():
        runs.append("numbers")
        return spark.range(3)

    @s.node
    def total(numbers):
        runs.append("total")
        return numbers.agg(F.sum("id").alias("s"))

    assert s.make("total").first().s == 3 and s.make("total").first().s == 3
    assert runs == ["numbers", "total"] and s.metadata("total")["depends"] == ["numbers"]


def test_store_sees_changed_inputs(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/numbers")
    s, runs = store.Store(spark, f"file://{tmp_path}/store", {"numbers": f"file://{tmp_path}/numbers"}), []

    @s.node
    def total(numbers):
        runs.append("total")
        return numbers.agg(F.sum("id").alias("s"))

    assert [s.make("total").first().s, s.make("total").first().s] == [3, 3] and runs == ["total"]
    spark.range(5).write.mode("overwrite").parquet(f"file://{tmp_path}/numbers")
    assert s.make("total").first().s == 10 and runs == ["total", "total"]


def test_a_new_year_costs_a_year(spark, tmp_path):
    days, at = f"file://{tmp_path}/days", f"file://{tmp_path}/store"
    write = lambda rows, mode="overwrite": spark.createDataFrame(rows, "year int, v double").write.mode(mode).partitionBy("year").parquet(days)
    write([(2000, 1.0), (2000, 5.0), (2001, 2.0)])
    runs = spark.sparkContext.accumulator(0)

    def counted(v):
        runs.add(1)
        return v

    s = store.Store(spark, at, {"days": days})

    @s.node(by="year")
    def most(days):
        return days.withColumn("v", F.udf(counted, "double")("v")).groupBy("year").agg(F.max("v").alias("most"))

    def made():
        before = runs.value
        rows = sorted((r.year, r.most) for r in s.make("most").collect())
        return rows, runs.value - before

    assert made() == ([(2000, 5.0), (2001, 2.0)], 3)
    assert made() == ([(2000, 5.0), (2001, 2.0)], 0)
    write([(2002, 7.0)], "append")
    assert made() == ([(2000, 5.0), (2001, 2.0), (2002, 7.0)], 1)
    write([(2001, 9.0)], "append")
    assert made() == ([(2000, 5.0), (2001, 9.0), (2002, 7.0)], 2)
    s._drop(f"{days}/year=2000")
    assert made() == ([(2001, 9.0), (2002, 7.0)], 0)
    assert s.metadata("most")["bytes"] > 0


def test_store_keeps_errors_and_warnings(spark, tmp_path):
    import warnings

    s, fail = store.Store(spark, f"file://{tmp_path}/store"), [True]

    @s.node
    def odd():
        warnings.warn("a few rows look odd")
        if fail[0]:
            raise ValueError("no rows")
        return spark.range(3)

    with pytest.raises(ValueError):
        s.make("odd")
    assert s.metadata("odd")["error"] == "ValueError: no rows"
    fail[0] = False
    assert s.make("odd").count() == 3
    assert (s.metadata("odd")["error"], s.metadata("odd")["warnings"]) == (None, ["a few rows look odd"]) and s.metadata("odd")["bytes"] > 0


def test_store_sees_functions_of_other_modules():
    from tamarisk.operators import raster
    from tamarisk.plans import flood

    found = "".join(store._sources(flood.zonal_exposure))
    assert "def layer_max(" in found and "def sum_exactly(" in found and inspect.getsource(raster.resample_bilinear) in found


def test_paths_need_a_root(monkeypatch):
    monkeypatch.delenv("TAMARISK_DATA_DIR", raising=False)
    assert tables.data_path("a", "b.csv", root="/data/") == "/data/a/b.csv"
    with pytest.raises(ValueError):
        tables.data_path("a")


def tiff(path, cells, order="<", kind=3, tile=None, rows=None, compression=1, predictor=1, no_data=None, big=False, apart=False):
    """A TIFF file of cells (rows, columns, bands), written by the format's description."""
    nrow, ncol, bands = cells.shape
    height, width = tile or (rows or nrow, ncol)
    blocks = []
    for b in range(bands if apart else 1):
        for i in range(0, nrow, height):
            for j in range(0, ncol, width):
                block = cells[i : i + height, j : j + width, b : b + 1] if apart else cells[i : i + height, j : j + width]
                if tile:
                    block = np.pad(block, [(0, height - block.shape[0]), (0, width - block.shape[1]), (0, 0)])
                block = block.astype(order + cells.dtype.str[1:])
                if predictor == 2:
                    block = np.concatenate([block[:, :1], np.diff(block.astype(cells.dtype), axis=1)], axis=1).astype(block.dtype)
                raw = block.tobytes()
                if predictor == 3:
                    size, deep = cells.dtype.itemsize, block.shape[2]
                    planes = np.frombuffer(block.astype(">" + cells.dtype.str[1:]).tobytes(), np.uint8).reshape(len(block), -1, size).transpose(0, 2, 1).reshape(len(block), -1, deep)
                    raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
                blocks.append(lzw(raw) if compression == 5 else zlib.compress(raw) if compression != 1 else raw)
    at, out = 16, b""
    places = []
    for raw in blocks:
        places.append(at + len(out))
        out += raw
    sizes = [len(b) for b in blocks]
    text = b"" if no_data is None else f"{no_data}\0".encode()
    entries = [(256, "I", [ncol]), (257, "I", [nrow]), (258, "H", [cells.dtype.itemsize * 8] * bands), (259, "H", [compression]), (277, "H", [bands]), (284, "H", [2 if apart else 1]), (317, "H", [predictor]), (339, "H", [kind] * bands), (33550, "d", [0.5, 0.25, 0.0]), (33922, "d", [0.0, 0.0, 0.0, 10.0, 20.0, 0.0])]
    entries += [(322, "H", [width]), (323, "H", [height]), (324, "I", places), (325, "I", sizes)] if tile else [(273, "I", places), (278, "H", [height]), (279, "I", sizes)]
    entries += [(42113, "s", text)] if text else []
    codes, wide = {"H": 3, "I": 4, "d": 12, "s": 2}, 8 if big else 4
    body, extra, begin = b"", b"", 16 + len(out)
    extra_at = begin + (8 if big else 2) + len(entries) * (20 if big else 12) + wide
    for tag, code, values in sorted(entries):
        data = values if code == "s" else struct.pack(f"{order}{len(values)}{code}", *values)
        body += struct.pack(order + "HH" + ("Q" if big else "I"), tag, codes[code], len(values))
        if len(data) <= wide:
            body += data.ljust(wide, b"\0")
        else:
            body += struct.pack(order + ("Q" if big else "I"), extra_at + len(extra))
            extra += data
    mark = b"II" if order == "<" else b"MM"
    head = mark + (struct.pack(order + "HHHQ", 43, 8, 0, begin) if big else struct.pack(order + "HI", 42, begin)).ljust(14, b"\0")
    path.write_bytes(head + out + struct.pack(order + ("Q" if big else "H"), len(entries)) + body + b"\0" * wide + extra)


def lzw(data):
    table, codes, w, width = {bytes([i]): i for i in range(256)}, [(256, 9)], b"", 9
    n = 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if w + c in table:
            w += c
            continue
        codes.append((table[w], width))
        table[w + c] = n
        n += 1
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
        if n == 4094:
            codes.append((256, width))
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        w = c
    if w:
        codes.append((table[w], width))
        n += 1
        width = 12 if n >= 2048 else 11 if n >= 1024 else 10 if n >= 512 else 9
    bits = "".join(f"{c:0{k}b}" for c, k in [*codes, (257, width)])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize(
    "how",
    [
        {"rows": 4}, {"rows": 5, "order": ">", "compression": 8}, {"tile": (16, 16), "compression": 8, "predictor": 3}, {"tile": (16, 32), "big": True, "order": ">"},
        {"rows": 8, "compression": 5}, {"tile": (16, 16), "compression": 32946, "apart": True}, {"rows": 3, "dtype": "i2", "kind": 2, "predictor": 2, "compression": 8}, {"tile": (16, 16), "dtype": "u1", "kind": 1, "predictor": 2},
    ],
)
def test_tiff(spark, tmp_path, how):
    how = dict(how)
    dtype = how.pop("dtype", "f4")
    rng = np.random.default_rng(1)
    cells = (rng.integers(0, 100, (37, 45, 2)) * (1 if dtype != "f4" else 0.25)).astype(dtype)
    tiff(tmp_path / "a.tif", cells, no_data=7, **how)
    for band in (1, 2):
        found, grid = tiffs.read_tiff(spark, str(tmp_path / "a.tif"), band=band)
        assert grid == Grid(10.0, 20.0, 0.5, 0.25, 37, 45)
        got = {(r.row, r.col): r.value for r in found.collect()}
        assert got == {(i, j): None if cells[i, j, band - 1] == 7 else float(cells[i, j, band - 1]) for i in range(37) for j in range(45)}


def test_tiff_reads_only_what_a_box_meets(spark, tmp_path):
    cells = np.arange(64 * 64, dtype="f4").reshape(64, 64, 1)
    tiff(tmp_path / "a.tif", cells, tile=(16, 16), compression=8)
    path = f"file://{tmp_path}/a.tif"
    whole, grid = tiffs.read_tiff(spark, path)
    some, _ = tiffs.read_tiff(spark, path, box=(grid.x0 + 5 * 0.5, 20 - 20 * 0.25, grid.x0 + 20 * 0.5, 20 - 2 * 0.25))
    assert (whole.rdd.getNumPartitions(), some.rdd.getNumPartitions()) == (16, 4)
    assert {(r.row, r.col): r.value for r in some.collect()} == {(i, j): float(cells[i, j, 0]) for i in range(2, 20) for j in range(5, 20)}
    assert spark.read.format("tiff").load(path).where("row = 63 and col = 0").rdd.getNumPartitions() == 1
    assert spark.read.format("tiff").load(path).where("band = 2").count() == 0


def netcdf(path, values, version=1, record=True, fill=-9.0, other=True):
    """A classic NetCDF file with time, lat and lon, a packed variable over them and a second record variable beside it."""
    wide = ">q" if version == 5 else ">i"
    place = ">q" if version > 1 else ">i"
    name = lambda s: struct.pack(wide, len(s)) + s.encode().ljust(-(-len(s) // 4) * 4, b"\0")
    double = lambda n, x: name(n) + struct.pack(">i", 6) + struct.pack(wide, 1) + struct.pack(">d", x)
    nt, ny, nx = values.shape
    dims = [("time", 0 if record else nt), ("lat", ny), ("lon", nx)]
    packed = np.where(np.isnan(values), -9, (values - 1) / 0.5).astype(">i2")
    parts = {"lat": ([1], 6, (np.arange(ny)[::-1] + 0.5).astype(">f8"), b""), "lon": ([2], 5, (np.arange(nx) + 30).astype(">f4"), b""), "time": ([0], 4, (np.arange(nt) * 2).astype(">i4"), b"")}
    parts["flood"] = ([0, 1, 2], 3, packed, struct.pack(">i", 12) + struct.pack(wide, 3) + name("_FillValue") + struct.pack(">i", 3) + struct.pack(wide, 1) + struct.pack(">h2x", -9) + double("scale_factor", 0.5) + double("add_offset", 1.0))
    if other:
        parts["odd"] = ([0], 1, np.arange(nt).astype(">i1"), b"")
    none = struct.pack(">i", 0) + struct.pack(wide, 0)
    per = lambda d, a: a.nbytes // nt if record and d[0] == 0 else a.nbytes
    pad = lambda n: -(-n // 4) * 4

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(wide, nt if record else 0) + struct.pack(">i", 10) + struct.pack(wide, 3) + b"".join(name(n) + struct.pack(wide, k) for n, k in dims)
        out += none + struct.pack(">i", 11) + struct.pack(wide, len(parts))
        for n, (d, kind, a, attributes) in parts.items():
            out += name(n) + struct.pack(wide, len(d)) + b"".join(struct.pack(wide, x) for x in d) + (attributes or none) + struct.pack(">i", kind) + struct.pack(wide, pad(per(d, a))) + struct.pack(place, begins[n])
        return out

    at, begins = len(header(dict.fromkeys(parts, 0))), {}
    fixed = [n for n, (d, *_) in parts.items() if not (record and d[0] == 0)]
    for n in [*fixed, *(n for n in parts if n not in fixed)]:
        begins[n] = at
        at += pad(per(parts[n][0], parts[n][2]))
    out = header(begins) + b"".join(parts[n][2].tobytes().ljust(pad(parts[n][2].nbytes), b"\0") for n in fixed)
    if record:
        for t in range(nt):
            out += b"".join(parts[n][2][t : t + 1].tobytes().ljust(pad(per(parts[n][0], parts[n][2])), b"\0") for n in parts if n not in fixed)
    path.write_bytes(out)


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("record", [True, False])
def test_netcdf(spark, tmp_path, version, record):
    values = np.random.default_rng(2).integers(0, 9, (5, 3, 7)) * 0.5 + 1
    values[2, 1, 3] = np.nan
    netcdf(tmp_path / "a.nc", values, version, record)
    found = netcdfs.read_netcdf(spark, f"file://{tmp_path}/a.nc", "flood").collect()
    start = datetime.date(1998, 1, 12)
    got = {((r.date - start).days, r.lat, r.lon): r.value for r in found}
    assert got == {(2 * t, 2.5 - y, 30.0 + x): None if np.isnan(values[t, y, x]) else values[t, y, x] for t in range(5) for y in range(3) for x in range(7)}
    odd = spark.read.format("netcdf").option("variable", "odd").load(str(tmp_path / "a.nc"))
    assert [(r.time, r.value) for r in odd.orderBy("time").collect()] == [(2.0 * t, float(t)) for t in range(5)]


def test_netcdf_reads_only_the_days_and_box(spark, tmp_path, monkeypatch):
    values = np.random.default_rng(3).integers(0, 9, (20, 4, 6)) * 0.5 + 1
    netcdf(tmp_path / "a.nc", values, 2)
    reader = netcdfs.NetcdfReader(str(tmp_path / "a.nc"), "flood")
    monkeypatch.setattr(netcdfs, "RUN", 4 * 4 * 6 * 2)
    assert len(reader.partitions()) == 5
    monkeypatch.undo()
    some = netcdfs.read_netcdf(spark, str(tmp_path / "a.nc"), "flood", box=(31.0, 0.0, 32.5, 1.6), days=(4, 9))
    assert sorted((r.lat, r.lon, r.value) for r in some.collect()) == sorted((3.5 - y, 30.0 + x, values[t, y, x]) for t in (2, 3, 4) for y in (2, 3) for x in (1, 2))
    assert netcdfs.read_netcdf(spark, str(tmp_path / "a.nc"), "flood", days=(100, 200)).count() == 0
    (tmp_path / "b.nc").write_bytes(b"\x89HDF" + b"\0" * 100)
    with pytest.raises(ValueError):
        netcdfs.Header(str(tmp_path / "b.nc"))


def test_shapefile_with_several_parts(spark, tmp_path):
    """Two outlines, clockwise as such files have them, and a hole: areas add up once read and laid on a grid."""
    from tamarisk.operators import zonal

    box = lambda x, y, side: [(x, y), (x, y + side), (x + side, y + side), (x + side, y), (x, y)]
    parts = [box(0.5, 0.5, 4.0), box(1.0, 1.0, 1.0)[::-1], box(7.0, 7.0, 2.0)]
    points = [p for part in parts for p in part]
    body = struct.pack("<i4d2i3i", 5, 0, 0, 9, 9, 3, len(points), 0, 5, 10) + b"".join(struct.pack("<2d", *p) for p in points)
    (tmp_path / "a.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(body) // 2) + body)
    field = b"ADM1_EN".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([10, 0]) + b"\0" * 14
    (tmp_path / "a.dbf").write_bytes(b"\x03" + b"\0" * 3 + struct.pack("<IHH", 1, 32 + 32 + 1, 11) + b"\0" * 20 + field + b"\r" + b" " + b"Lamu".ljust(10))
    found = shapes.read_shapes(spark, f"file://{tmp_path}/a.shp")
    assert sum(r.coverage for r in zonal.polygon_coverage(found, Grid(0, 10, 1, 1, 10, 10)).collect()) == pytest.approx(16 - 1 + 4)
