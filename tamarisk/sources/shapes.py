"""Shapefiles as a Spark data source: polygons and their attributes, one task a file."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tamarisk.operators.relational import matching, snake_names
from tamarisk.sources.files import opened


def rings_of(shp: bytes) -> Iterator[list[list[dict]]]:
    """Polygons of a .shp file, each a list of rings without the repeated last point; none for null shapes.

    Rings come as the file has them: outlines of several parts, and holes, which operators tell apart by how they nest.
    """
    at = 100
    while at + 8 <= len(shp):
        (words,) = struct.unpack(">i", shp[at + 4 : at + 8])
        body = shp[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        (kind,) = struct.unpack("<i", body[:4])
        if kind not in (5, 15, 25):
            yield []
            continue
        n_parts, n_points = struct.unpack("<ii", body[36:44])
        parts = [*struct.unpack(f"<{n_parts}i", body[44 : 44 + 4 * n_parts]), n_points]
        flat = struct.unpack(f"<{2 * n_points}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points])
        points = [{"x": flat[2 * i], "y": flat[2 * i + 1]} for i in range(n_points)]
        yield [points[a : b - 1] for a, b in zip(parts, parts[1:])]


def fields_of(dbf: bytes) -> list[tuple[str, int]]:
    """Names and widths of a .dbf file's fields."""
    found, at = [], 32
    while dbf[at] != 0x0D:
        found.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    return found


def records_of(dbf: bytes, encoding: str = "utf-8") -> Iterator[list[str | None]]:
    """Rows of a .dbf file as text, blank as null."""
    count, start, width = struct.unpack("<IHH", dbf[4:12])
    fields = fields_of(dbf)
    for i in range(count):
        at = start + i * width + 1
        row = []
        for _, size in fields:
            row.append(dbf[at : at + size].decode(encoding, "replace").strip() or None)
            at += size
        yield row


def part_of(path: str, suffix: str) -> bytes:
    """One file of a shapefile: beside it, or inside a zip archive (`a.zip`, or `a.zip/layer` where it holds several)."""
    if ".zip" not in path:
        with opened(f"{path.removesuffix('.shp')}.{suffix}") as f:
            return f.read()
    archive, _, layer = path.partition(".zip")
    layer = layer.strip("/").removesuffix(".shp")
    with opened(f"{archive}.zip") as f, zipfile.ZipFile(f) as z:
        names = [n for n in z.namelist() if n.lower().endswith(f".{suffix}") and (not layer or n.rsplit("/", 1)[-1][: -len(suffix) - 1] == layer)]
        if len(names) != 1:
            raise ValueError(f"{path} holds {len(names)} layers; name one of them")
        return z.read(names[0])


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ShapeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.encoding = options["path"].split(","), options.get("encoding", "utf-8")

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        for rings, row in zip(rings_of(part_of(partition.path, "shp")), records_of(part_of(partition.path, "dbf"), self.encoding)):
            yield (*row, rings)


class ShapeSource(DataSource):
    """spark.read.format("shapes").load(path): paths or URIs that every executor can open, comma-joined."""

    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> str:
        names = [f"`{name}` string" for name, _ in fields_of(part_of(self.options["path"].split(",")[0], "dbf"))]
        return ", ".join([*names, "rings array<array<struct<x:double,y:double>>>"])

    def reader(self, schema: StructType) -> ShapeReader:
        return ShapeReader(self.options)


def read_shapes(spark: SparkSession, path: str, names: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """A shapefile in snake-case names; `names`: a pattern for the attributes to keep."""
    spark.dataSource.register(ShapeSource)
    found = snake_names(spark.read.format("shapes").option("encoding", encoding).load(path))
    return found.select(*[c for c in matching(found, names) if c != "rings"], "rings") if names else found


def read_levels(spark: SparkSession, folder: str, layers: dict[str, tuple[str, ...]], pattern: str = r"^adm\d_") -> dict[str, DataFrame]:
    """Boundaries by level, all countries in one table each; columns that a country lacks are null."""
    from tamarisk.operators.relational import bind_rows

    levels = range(max(map(len, layers.values())))
    return {f"adm{i}": bind_rows(*[read_shapes(spark, f"{folder}/{names[i]}.shp", pattern) for names in layers.values() if i < len(names)]) for i in levels}
