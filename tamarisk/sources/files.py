"""Random access to files by path or URI, on the driver and in tasks alike."""

from __future__ import annotations

from typing import BinaryIO

from pyarrow import fs


def opened(path: str) -> BinaryIO:
    """A seekable file: a local path, or a URI of any store that Arrow knows (file, hdfs, s3 ...)."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def part(path: str, begin: int, size: int) -> bytes:
    with opened(path) as f:
        return f.read_at(size, begin)


def bounds_of(filters: list) -> dict[str, tuple[float, float]]:
    """Least and greatest value of each column that pushed filters let through; the filters themselves still hold afterwards."""
    found: dict[str, tuple[float, float]] = {}
    for f in filters:
        if len(getattr(f, "attribute", ())) != 1 or isinstance(getattr(f, "value", None), (bool, str, type(None))):
            continue
        kind, value = type(f).__name__, f.value
        try:
            value = float(value)
        except (TypeError, ValueError):
            continue
        lo, hi = found.get(f.attribute[0], (float("-inf"), float("inf")))
        if kind in ("EqualTo", "EqualNullSafe", "GreaterThan", "GreaterThanOrEqual"):
            lo = max(lo, value)
        if kind in ("EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual"):
            hi = min(hi, value)
        found[f.attribute[0]] = lo, hi
    return found
