"""Classic NetCDF variables as a Spark data source: one column for each dimension and the value, one partition a run of slabs.

A slab is what lies at one index of the first dimension: a day's grid, or a row of one. Conditions on the
dimensions' columns reach the reader: a range of times picks slabs, and ranges of the others the part of a slab that
is read. Versions 1, 2 and 5 of the format; files kept in HDF5 are another format and are not read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tamarisk.functions.dates import from_index
from tamarisk.sources.files import bounds_of, opened

# The format's types as numpy has them, and the marks of its lists.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: Bytes of a partition at about.
RUN = 32 << 20


class Variable:
    def __init__(self, dims: list[int], attributes: dict, dtype: str, begin: int, record: bool):
        self.dims, self.attributes, self.dtype, self.begin, self.record = dims, attributes, np.dtype(dtype), begin, record


class Header:
    """Dimensions, and variables with where their numbers lie."""

    def __init__(self, path: str):
        self.path = path
        size = 1 << 16
        while True:
            with opened(path) as f:
                self.data = f.read_at(min(size, f.size()), 0)
                whole = f.size() <= size
            try:
                self._parse()
                return
            except (struct.error, IndexError):
                if whole:
                    raise ValueError(f"{path} ends within its header") from None
                size *= 8

    def _number(self, wide: bool = False) -> int:
        code = ">q" if wide else ">i"
        (n,) = struct.unpack(code, self.data[self.at : self.at + struct.calcsize(code)])
        self.at += struct.calcsize(code)
        return n

    def _name(self) -> str:
        n = self._number(self.five)
        if self.at + n > len(self.data):
            raise IndexError
        text = self.data[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return text

    def _attributes(self) -> dict:
        self._number()
        found = {}
        for _ in range(self._number(self.five)):
            name, kind, n = self._name(), self._number(), self._number(self.five)
            size = np.dtype(TYPES[kind]).itemsize * n
            if self.at + size > len(self.data):
                raise IndexError
            raw = self.data[self.at : self.at + size]
            found[name] = raw.decode("utf-8", "replace") if kind == 2 else np.frombuffer(raw, TYPES[kind]).tolist()
            self.at += -(-size // 4) * 4
        return found

    def _parse(self) -> None:
        version = self.data[3] if self.data[:3] == b"CDF" else 0
        if version not in (1, 2, 5):
            raise ValueError(f"{self.path} is no classic NetCDF file")
        self.five, self.at = version == 5, 4
        self.records = self._number(self.five)
        self._number()
        self.dims = [(self._name(), self._number(self.five)) for _ in range(self._number(self.five))]
        self.attributes = self._attributes()
        self._number()
        self.variables: dict[str, Variable] = {}
        sizes = {}
        for _ in range(self._number(self.five)):
            name = self._name()
            dims = [self._number(self.five) for _ in range(self._number(self.five))]
            attributes, kind = self._attributes(), self._number()
            sizes[name] = self._number(self.five)
            record = bool(dims) and self.dims[dims[0]][1] == 0
            self.variables[name] = Variable(dims, attributes, TYPES[kind], self._number(version > 1), record)
        recorded = [n for n, v in self.variables.items() if v.record]
        own = lambda v: math.prod(self.length(d) for d in v.dims[1:]) * v.dtype.itemsize
        # a file's only record variable is not padded
        self.record_size = own(self.variables[recorded[0]]) if len(recorded) == 1 else sum(-(-own(self.variables[n]) // 4) * 4 for n in recorded)
        if self.records < 0:  # a stream whose end was not written back
            with opened(self.path) as f:
                self.records = (f.size() - min(self.variables[n].begin for n in recorded)) // max(1, self.record_size) if recorded else 0

    def length(self, dim: int) -> int:
        return self.dims[dim][1] or self.records

    def slabs(self, name: str) -> tuple[int, int]:
        """Bytes from one slab of a variable to the next, and of one."""
        v = self.variables[name]
        size = math.prod(self.length(d) for d in v.dims[1:]) * v.dtype.itemsize
        return (self.record_size if v.record else size), size

    def read(self, name: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Slabs lo to hi of a variable."""
        v = self.variables[name]
        shape = [self.length(d) for d in v.dims]
        if not shape:
            with opened(self.path) as f:
                return np.frombuffer(f.read_at(v.dtype.itemsize, v.begin), v.dtype)
        step, size = self.slabs(name)
        hi = shape[0] if hi is None else hi
        with opened(self.path) as f:
            if step == size:
                raw = f.read_at((hi - lo) * size, v.begin + lo * step)
            else:
                raw = b"".join(f.read_at(size, v.begin + i * step) for i in range(lo, hi))
        return np.frombuffer(raw, v.dtype).reshape([hi - lo, *shape[1:]])

    def axis(self, dim: int) -> np.ndarray:
        """A dimension's coordinates, or its indexes where there are none."""
        name = self.dims[dim][0]
        v = self.variables.get(name)
        return self.read(name).astype(np.float64) if v is not None and v.dims == [dim] else np.arange(self.length(dim), dtype=np.float64)


class _Run(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class NetcdfReader(DataSourceReader):
    def __init__(self, path: str, variable: str):
        self.header, self.variable = Header(path), variable
        own = self.header.variables[variable]
        self.names = [self.header.dims[d][0] for d in own.dims]
        self.axes = [self.header.axis(d) for d in own.dims]
        self.bounds: dict[str, tuple[float, float]] = {}

    def pushFilters(self, filters: list) -> Iterator:
        self.bounds = bounds_of(filters)
        yield from filters

    def _kept(self, i: int) -> np.ndarray:
        lo, hi = self.bounds.get(self.names[i], (-math.inf, math.inf))
        return np.flatnonzero((self.axes[i] >= lo) & (self.axes[i] <= hi))

    def partitions(self) -> list[_Run]:
        kept = self._kept(0)
        many = max(1, RUN // max(1, self.header.slabs(self.variable)[1]))
        runs = np.split(kept, np.flatnonzero(np.diff(kept) != 1) + 1) if len(kept) else []
        return [_Run(int(r[a]), int(r[min(a + many, len(r)) - 1]) + 1) for r in runs for a in range(0, len(r), many)]

    def read(self, partition: _Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # which is what Spark asks for where there is no partition
            return
        header, own = self.header, self.header.variables[self.variable]
        inner = [self._kept(i) for i in range(1, len(self.axes))]
        missing = [x for a in ("_FillValue", "missing_value") for x in own.attributes.get(a, []) if not isinstance(x, str)]
        scale, offset = own.attributes.get("scale_factor", [1.0])[0], own.attributes.get("add_offset", [0.0])[0]
        for i in range(partition.lo, partition.hi):
            slab = header.read(self.variable, i, i + 1)[0]
            if inner:
                slab = slab[np.ix_(*inner)]
            flat = np.asarray(slab).ravel()
            value = flat.astype(np.float64)
            known = ~np.isnan(value) & ~np.isin(flat, missing)
            if (scale, offset) != (1.0, 0.0):
                value = value * scale + offset
            at = np.meshgrid(*[self.axes[d + 1][k] for d, k in enumerate(inner)], indexing="ij") if inner else []
            columns = {self.names[0]: np.full(len(value), self.axes[0][i])} | {n: x.ravel() for n, x in zip(self.names[1:], at)}
            whole = pa.RecordBatch.from_pydict(columns | {"value": pa.array(value, mask=~known)})
            for begin in range(0, whole.num_rows, 100_000):
                yield whole.slice(begin, 100_000)


class NetcdfSource(DataSource):
    """spark.read.format("netcdf").option("variable", name).load(path): a path or URI that driver and executors can open."""

    @classmethod
    def name(cls) -> str:
        return "netcdf"

    def schema(self) -> str:
        reader = NetcdfReader(self.options["path"], self.options["variable"])
        return ", ".join([*(f"`{n}` double" for n in reader.names), "value double"])

    def reader(self, schema: StructType) -> NetcdfReader:
        return NetcdfReader(self.options["path"], self.options["variable"])


def read_netcdf(spark: SparkSession, path: str, variable: str, box: tuple[float, float, float, float] | None = None, days: tuple[int, int] | None = None, time: str = "time", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(date, lon, lat, value) of a daily variable whose time counts days from the first layer. `days`: first and last index wanted; `box`: xmin, ymin, xmax, ymax."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetcdfSource)
    found = spark.read.format("netcdf").option("variable", variable).load(path)
    if days is not None:
        found = found.where((F.col(time) >= days[0]) & (F.col(time) <= days[1]))
    if box is not None:
        found = found.where((F.col(lon) >= box[0]) & (F.col(lon) <= box[2]) & (F.col(lat) >= box[1]) & (F.col(lat) <= box[3]))
    return found.select(from_index(F.col(time).cast("int")).alias("date"), F.col(lon).alias("lon"), F.col(lat).alias("lat"), "value")
