"""A store of named results: computed once, and again only when their definition or inputs change."""

from __future__ import annotations

import hashlib
import inspect
import json
import re
import time
import types
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _sources(f: Callable, seen: set | None = None) -> list[str]:
    """Source of a function and of the functions of its package that it names, also as `module.name`, one after another."""
    seen = set() if seen is None else seen
    if f in seen:
        return []
    seen.add(f)
    try:
        found = [inspect.getsource(f)]
    except (OSError, TypeError):
        return []
    named = {**getattr(f, "__globals__", {}), **inspect.getclosurevars(f).nonlocals}
    names = f.__code__.co_names + f.__code__.co_freevars
    called = [named.get(n) for n in names]
    called += [getattr(m, n, None) for m in called if isinstance(m, types.ModuleType) for n in names]
    root = f.__module__.split(".")[0]
    for g in called:
        if inspect.isfunction(g) and g.__module__.split(".")[0] == root:
            found += _sources(g, seen)
    return found


class Store:
    """Results as Parquet below a folder that Spark can reach, each with a row of metadata beside it."""

    def __init__(self, spark: SparkSession, folder: str, inputs: dict[str, str] | None = None):
        """`inputs`: folders or files by the names that results take them by; they are read as Parquet."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.inputs = dict(inputs or {})
        self.nodes: dict[str, tuple[Callable[..., DataFrame], list[str]]] = {}
        self.by: dict[str, str] = {}

    def node(self, f: Callable[..., DataFrame] | None = None, *, by: str | None = None) -> Callable:
        """Registers f under its name; its parameters name the results it takes.

        `by`: a column that f's first input is partitioned by in folders and that f keeps, each value's rows coming
        from that value's rows only. The result is kept by it too, and only values whose files changed are made again.
        """
        if f is None:
            return lambda g: self.node(g, by=by)
        self.nodes[f.__name__] = (f, list(inspect.signature(f).parameters))
        if by is not None:
            self.by[f.__name__] = by
        return f

    def digest(self, name: str) -> str:
        """Of the source of a result, of the functions of its package that it calls, and of all it comes from; of an input, its files' names, sizes and times."""
        if name in self.inputs:
            return hashlib.sha256("|".join(sorted(self._files(self.inputs[name]))).encode()).hexdigest()
        f, needs = self.nodes[name]
        return hashlib.sha256("|".join([*_sources(f), *map(self.digest, needs)]).encode()).hexdigest()

    def _files(self, path: str) -> list[str]:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        system = there.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found, files = [], system.listFiles(there, True)
        while files.hasNext():
            one = files.next()
            found.append(f"{one.getPath()} {one.getLen()} {one.getModificationTime()}")
        return found

    def _exists(self, path: str) -> bool:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there)

    def metadata(self, name: str) -> dict | None:
        path = f"{self.folder}/meta/{name}"
        return json.loads(self.spark.read.text(path).first()[0]) if self._exists(f"{path}/_SUCCESS") else None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/objects/{name}")

    def _parts(self, name: str) -> dict[str, str]:
        """For each value of the column that an input is partitioned by, a digest of its files."""
        f, needs = self.nodes[name]
        own: dict[str, list[str]] = {}
        for line in self._files(self.inputs[needs[0]]):
            if m := re.search(rf"/{re.escape(self.by[name])}=([^/]+)/", line):
                own.setdefault(m[1], []).append(line)
        return {v: hashlib.sha256("|".join(sorted(lines)).encode()).hexdigest() for v, lines in own.items()}

    def _drop(self, path: str) -> None:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)

    def make(self, name: str) -> DataFrame:
        """The named result; what it needs first. Kept ones with the same digest are read.

        Metadata hold name, digest, what it depends on, time, seconds, bytes, warnings, and the error of a run that failed, which is raised.
        """
        if name in self.inputs:
            return self.spark.read.parquet(self.inputs[name])
        f, needs = self.nodes[name]
        inputs = [self.make(n) for n in needs]
        digest, known = self.digest(name), self.metadata(name)
        if known and known["digest"] == digest and not known.get("error"):
            return self.read(name)
        began, path = time.time(), f"{self.folder}/objects/{name}"
        row = {"name": name, "digest": digest, "depends": needs, "time": began, "error": None, "warnings": []}
        try:
            with warnings.catch_warnings(record=True) as heard:
                warnings.simplefilter("always")
                if name in self.by:
                    row["parts"], row["source"] = self._parts(name), hashlib.sha256("|".join([*_sources(f), *map(self.digest, needs[1:])]).encode()).hexdigest()
                    self._renew(name, inputs, row, known)
                else:
                    f(*inputs).write.mode("overwrite").parquet(path)
            row["warnings"] = [str(w.message) for w in heard if not issubclass(w.category, (DeprecationWarning, ResourceWarning))]
            row["bytes"] = sum(int(line.rsplit(" ", 2)[1]) for line in self._files(path))
        except Exception as e:
            row["error"] = f"{type(e).__name__}: {e}"
            raise
        finally:
            row["seconds"] = round(time.time() - began, 3)
            self.spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/meta/{name}")
        return self.read(name)

    def _renew(self, name: str, inputs: list[DataFrame], row: dict, known: dict | None) -> None:
        """Makes the values again whose files changed (all, where the code or another input did), and drops those that went."""
        f, by, path = self.nodes[name][0], self.by[name], f"{self.folder}/objects/{name}"
        old = known.get("parts", {}) if known and not known.get("error") and known.get("source") == row["source"] else None
        changed = sorted(v for v, d in row["parts"].items() if old is None or old.get(v) != d)
        some = inputs[0].where(F.col(by).cast("string").isin(changed))
        write = f(some, *inputs[1:]).write.mode("overwrite").partitionBy(by)
        if old is None:
            write.option("partitionOverwriteMode", "static").parquet(path)
            return
        for gone in {*old, *changed} - ({*row["parts"]} - {*changed}):
            self._drop(f"{path}/{by}={gone}")  # also of a changed value, which may have no rows now
        if changed:
            write.option("partitionOverwriteMode", "dynamic").parquet(path)
