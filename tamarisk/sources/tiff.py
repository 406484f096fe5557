"""TIFF grids as a Spark data source: (band, row, col, value), one partition a strip or tile.

Conditions on band, row and col reach the reader, so that a box costs the strips or tiles that it meets. Classic and
BigTIFF files of either byte order, with numbers of 8 to 64 bits, uncompressed, deflated or LZW, with or without
differencing.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tamarisk.operators.raster import Grid, index_range
from tamarisk.sources.files import bounds_of, opened, part

# Numbers of the format's tags and bytes of its field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZES, SAMPLE_KIND, PIXEL_SCALE, TIEPOINT, NO_DATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


def tags_of(path: str) -> tuple[str, dict[int, tuple | bytes]]:
    """Byte order (< or >) and tags of a file's first image."""
    with opened(path) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        magic = struct.unpack(order + "H", head[2:4])[0] if order else 0
        if magic not in (42, 43):
            raise ValueError(f"{path} is no TIFF file")
        big = magic == 43
        (at,) = struct.unpack(order + ("Q" if big else "I"), head[8:16] if big else head[4:8])
        width, count = ("Q", 20) if big else ("H", 12)
        (n,) = struct.unpack(order + width, f.read_at(struct.calcsize(width), at))
        body = f.read_at(n * count, at + struct.calcsize(width))
        found: dict[int, tuple | bytes] = {}
        for i in range(n):
            entry = body[i * count : (i + 1) * count]
            tag, kind = struct.unpack(order + "HH", entry[:4])
            (size,) = struct.unpack(order + ("Q" if big else "I"), entry[4:12] if big else entry[4:8])
            if kind not in FIELD:
                continue
            code = FIELD[kind]
            total = size * struct.calcsize("=" + code.replace("s", "B"))
            inline = entry[12:] if big else entry[8:]
            raw = inline[:total]
            if total > len(inline):
                (place,) = struct.unpack(order + ("Q" if big else "I"), inline)
                raw = f.read_at(total, place)
            found[tag] = raw if code == "s" else struct.unpack(f"{order}{size * len(code)}{code[0]}", raw)
    return order, found


def unpacked(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, most significant bit first."""
    table: list[bytes] = []
    out, held, bits, width, last = [], 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            bits -= width
            code = held >> bits
            held &= (1 << bits) - 1
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            if last:
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


class Layout:
    """How a file's numbers lie: blocks of `height` rows and `width` columns, one plane for all bands or one for each."""

    def __init__(self, path: str):
        self.order, tags = tags_of(path)
        one = lambda tag, default: tags.get(tag, (default,))[0]
        self.ncol, self.nrow, self.bands = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
        self.compression, self.predictor, self.apart = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANES, 1) == 2
        kind, bits = one(SAMPLE_KIND, 1), one(BITS, 1)
        if self.compression not in (1, 5, 8, 32946) or bits not in (8, 16, 32, 64) or kind not in (1, 2, 3) or self.predictor not in (1, 2, 3):
            raise ValueError(f"{path} has compression {self.compression}, {bits} bits of kind {kind}, predictor {self.predictor}")
        self.dtype = f"{'uif'[kind - 1]}{bits // 8}"
        tiled = TILE_AT in tags
        self.width, self.height = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (self.ncol, min(self.nrow, one(STRIP_ROWS, self.nrow)))
        self.tiled = tiled
        self.at, self.sizes = tags[TILE_AT if tiled else STRIP_AT], tags[TILE_SIZES if tiled else STRIP_SIZES]
        text = tags.get(NO_DATA, b"").split(b"\0")[0].strip()
        self.no_data = float(text) if text else None
        self.scale, self.tie = tags.get(PIXEL_SCALE), tags.get(TIEPOINT)

    def grid(self) -> Grid:
        if not self.scale or not self.tie:
            raise ValueError("the file does not say where its cells lie")
        dx, dy = self.scale[:2]
        return Grid(self.tie[3] - self.tie[0] * dx, self.tie[4] + self.tie[1] * dy, dx, dy, self.nrow, self.ncol)

    def blocks(self, band: tuple[float, float], row: tuple[float, float], col: tuple[float, float]) -> Iterator[tuple[int, int, int, int]]:
        """(index, first band or -1 for all, first row, first column) of blocks that meet ranges of bands (from 1), rows and columns."""
        across, down = -(-self.ncol // self.width), -(-self.nrow // self.height)
        for plane in range(self.bands if self.apart else 1):
            if band[0] > (plane + 1 if self.apart else self.bands) or band[1] < (plane + 1 if self.apart else 1):
                continue
            for i in range(down):
                if row[0] > i * self.height + self.height - 1 or row[1] < i * self.height:
                    continue
                for j in range(across):
                    if col[0] <= j * self.width + self.width - 1 and col[1] >= j * self.width:
                        yield (plane * down + i) * across + j, plane if self.apart else -1, i * self.height, j * self.width

    def numbers(self, raw: bytes, first_row: int) -> np.ndarray:
        """A block's numbers: (rows, columns, bands of its plane)."""
        data = raw if self.compression == 1 else unpacked(raw) if self.compression == 5 else zlib.decompress(raw)
        rows = self.height if self.tiled else min(self.height, self.nrow - first_row)
        deep = 1 if self.apart else self.bands
        if self.predictor == 3:  # bytes of each row by significance, differenced
            size = int(self.dtype[1:])
            flat = np.frombuffer(data, np.uint8)[: rows * self.width * deep * size].reshape(rows, self.width * size, deep).cumsum(axis=1, dtype=np.uint8)
            cells = flat.reshape(rows, size, self.width * deep).transpose(0, 2, 1)
            return np.ascontiguousarray(cells).view(f">{self.dtype}").reshape(rows, self.width, deep)
        cells = np.frombuffer(data, self.order + self.dtype)[: rows * self.width * deep].reshape(rows, self.width, deep)
        return cells.cumsum(axis=1, dtype=self.dtype) if self.predictor == 2 else cells


class _Block(InputPartition):
    def __init__(self, index: int, plane: int, row: int, col: int):
        self.index, self.plane, self.row, self.col = index, plane, row, col


class TiffReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.layout = path, Layout(path)
        self.bounds: dict[str, tuple[float, float]] = {}

    def pushFilters(self, filters: list) -> Iterator:
        self.bounds = bounds_of(filters)
        yield from filters  # blocks are pruned by them; within a block Spark applies them

    def partitions(self) -> list[_Block]:
        every = float("-inf"), float("inf")
        return [_Block(*b) for b in self.layout.blocks(*(self.bounds.get(c, every) for c in ("band", "row", "col")))]

    def read(self, partition: _Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # which is what Spark asks for where there is no partition
            return
        own = self.layout
        size = own.sizes[partition.index]
        if not size:  # a block that was never written
            return
        cells = own.numbers(part(self.path, own.at[partition.index], size), partition.row)
        rows, cols = min(cells.shape[0], own.nrow - partition.row), min(cells.shape[1], own.ncol - partition.col)
        row, col = (x.ravel() for x in np.meshgrid(partition.row + np.arange(rows), partition.col + np.arange(cols), indexing="ij"))
        for b in range(cells.shape[2]):
            value = cells[:rows, :cols, b].ravel().astype(np.float64)
            known = ~np.isnan(value) if own.no_data is None else ~np.isnan(value) & (value != own.no_data)
            band = np.full(len(row), (b if partition.plane < 0 else partition.plane) + 1, np.int32)
            whole = pa.RecordBatch.from_pydict({"band": band, "row": row.astype(np.int32), "col": col.astype(np.int32), "value": pa.array(value, mask=~known)})
            for begin in range(0, whole.num_rows, 100_000):
                yield whole.slice(begin, 100_000)


class TiffSource(DataSource):
    """spark.read.format("tiff").load(path): a path or URI that driver and executors can open."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return "band int, row int, col int, value double"

    def reader(self, schema: StructType) -> TiffReader:
        return TiffReader(self.options["path"])


def read_tiff(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, band: int = 1, to: str = "value") -> tuple[DataFrame, Grid]:
    """(row, col, value) of one band, and the file's grid; no-data is null. `box`: xmin, ymin, xmax, ymax of the cells wanted, which keep their numbers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    grid = Layout(path).grid()
    cells = spark.read.format("tiff").load(path).where(F.col("band") == band)
    if box is not None:
        (left, right), (top, bottom) = index_range(box[0], box[2], grid.x0, grid.dx, grid.ncol), index_range(grid.y0 - box[3], grid.y0 - box[1], 0.0, grid.dy, grid.nrow)
        cells = cells.where((F.col("row") >= top) & (F.col("row") <= bottom) & (F.col("col") >= left) & (F.col("col") <= right))
    return cells.select("row", "col", F.col("value").alias(to)), grid
