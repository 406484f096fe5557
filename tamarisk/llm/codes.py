"""Vector code compression: product codes from Lloyd rounds with Elkan's bounds.

Vectors become integers and are cut into equal parts; each part position has a codebook of its own. Between rounds a
table holds, for each vector and part, its entry, an upper bound of the distance to it and one lower bound for each
entry. When entries move, bounds are shifted by how far. An entry is passed over only where a bound or the triangle
inequality says that it is strictly farther than the present one; all others are measured in integers, so that ties
go to the lower index whatever rounding did. Lower bounds are kept as 255ths of the largest of their part, rounded
down: a byte each.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm._common import bound_batches, drop_staged, stage

#: Components become floor(SCALE x); entries of a codebook, parts of a vector and rounds.
SCALE, ENTRIES, PARTS, ROUNDS = 1024, 256, 4, 4
#: Distances measured at once, times components.
STEP = 1 << 21
#: Relative slack that covers what double precision rounds off.
SLACK = 1e-9
#: Components up to which squared distances and sums stay exact in 64 bits; beyond, Python's integers are used.
LARGEST = 1 << 24


class Bounds:
    """One part position of a batch: entry, upper bound of the distance to it, and lower bounds of those to all."""

    def __init__(self, at: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.at, self.upper, self.lower = at, upper, lower
        self.measured = 0


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    return ((x - c) ** 2).sum(axis=1)


def measured_all(x: np.ndarray, entries: np.ndarray) -> Bounds:
    """Bounds from the distances to all entries."""
    top = max((int(abs(v).max()) for v in (x, entries) if v.size), default=0)
    if x.dtype == np.int64 and 4 * x.shape[1] * top * top < 1 << 53:  # every sum below is a whole number that doubles hold
        a, c = x.astype(np.float64), entries.astype(np.float64)
        found = ((a**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None, :] - 2 * a @ c.T).astype(np.int64)
    else:
        found = np.empty((len(x), len(entries)), x.dtype)
        for j in range(len(entries)):
            found[:, j] = squared(x, entries[j])
    at = found.argmin(axis=1) if len(x) else np.zeros(0, np.int64)  # the lowest index of equals
    roots = np.sqrt(found.astype(np.float64))
    out = Bounds(at, roots[np.arange(len(x)), at] * (1 + SLACK), roots * (1 - SLACK))
    out.measured = found.size
    return out


def moved(bounds: Bounds, x: np.ndarray, entries: np.ndarray, shift: np.ndarray, between: np.ndarray) -> Bounds:
    """Bounds after the entries moved by `shift` (rounded up); `between`: distances of entries (rounded down)."""
    n = len(x)
    upper = (bounds.upper + shift[bounds.at]) * (1 + SLACK)
    lower = np.maximum((bounds.lower - shift[None, :]) * (1 - SLACK) - SLACK, 0)
    at = bounds.at.copy()
    half = between / 2
    nearest_other = np.where(np.eye(len(entries), dtype=bool), np.inf, half).min(axis=1) if len(entries) else np.zeros(0)
    open_ = np.flatnonzero(upper >= nearest_other[at])  # for the others, every entry is strictly farther
    out = Bounds(at, upper, lower)
    best = np.zeros(n, x.dtype)
    best[open_] = squared(x[open_], entries[at[open_]])
    roots = np.sqrt(best[open_].astype(np.float64))
    upper[open_] = roots * (1 + SLACK)
    lower[open_, at[open_]] = roots * (1 - SLACK)
    out.measured = len(open_)
    old = bounds.at
    step = max(1, STEP // max(1, x.shape[1] * len(entries)))
    for begin in range(0, len(open_), step):
        some = open_[begin : begin + step]
        try_ = (lower[some] <= upper[some, None]) & (half[old[some]] <= upper[some, None])
        try_[np.arange(len(some)), old[some]] = False
        i, j = np.nonzero(try_)
        if not len(i):
            continue
        i = some[i]
        d = squared(x[i], entries[j])
        lower[i, j] = np.sqrt(d.astype(np.float64)) * (1 - SLACK)
        out.measured += len(i)
        # the least distance of each row, then the lowest index with it; rows come in order, and so do entries
        heads = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        least = np.minimum.reduceat(d, heads)
        rows = i[heads]
        first = np.minimum.reduceat(np.where(d == np.repeat(least, np.diff([*heads, len(i)])), j, len(entries)), heads)
        better = (least < best[rows]) | ((least == best[rows]) & (first < at[rows]))
        rows, least, first = rows[better], least[better], first[better]
        best[rows], at[rows] = least, first
        upper[rows] = np.sqrt(least.astype(np.float64)) * (1 + SLACK)
    return out


def _pack(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as bytes and their unit, never above what they were."""
    unit = lower.max(axis=1, initial=0) / 255
    return np.floor(lower / np.where(unit > 0, unit, 1)[:, None] * (1 - SLACK)).astype(np.uint8), unit


def _ints(column: pa.Array, dtype: str, dims: int) -> np.ndarray:
    """Rows of packed components; object arrays of Python's integers where 64 bits are not enough."""
    if dtype == "object":
        return np.array([[int(x) for x in row.split(",")] if row else [] for row in column.to_pylist()], object).reshape(len(column), dims)
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype)
    return raw.reshape(len(column), dims).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


STATE = "at binary, upper binary, lower binary, unit binary"


def _assigned(table: DataFrame, dtype: str, width: int, entries: np.ndarray, last: np.ndarray | None, final: bool) -> DataFrame:
    """The table with entries and bounds for these codebooks, given those of the last round; if final, with the error."""
    kept = [f for f in table.schema.fields if f.name in ("vec", "label", "x")]
    parts, n_entries = entries.shape[:2]
    gap = lambda a, b: np.sqrt((((a - b) ** 2).sum(axis=-1)).astype(np.float64))
    between = [np.array([gap(e, entries[p]) for e in entries[p]]).reshape(n_entries, n_entries) * (1 - SLACK) for p in range(parts)]
    shift = None if last is None else [gap(entries[p], last[p]) * (1 + SLACK) for p in range(parts)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _ints(batch.column("x"), dtype, parts * width)
            n = len(x)
            at = np.zeros((n, parts), np.uint8)
            upper, unit, lower = np.zeros((n, parts)), np.zeros((n, parts)), np.zeros((n, parts, n_entries), np.uint8)
            error = np.zeros(n, x.dtype)
            if last is not None:
                was_at, was_upper, was_unit, was_lower = (np.frombuffer(b"".join(batch.column(c).to_pylist()), k) for c, k in (("at", np.uint8), ("upper", np.float64), ("unit", np.float64), ("lower", np.uint8)))
                was_at, was_upper, was_unit, was_lower = was_at.reshape(n, parts), was_upper.reshape(n, parts), was_unit.reshape(n, parts), was_lower.reshape(n, parts, n_entries)
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                if last is None:
                    found = measured_all(own, entries[p])
                else:
                    was = Bounds(was_at[:, p].astype(np.int64), was_upper[:, p], was_lower[:, p] * was_unit[:, p, None])
                    found = moved(was, own, entries[p], shift[p], between[p])
                at[:, p] = found.at
                if final:
                    error += squared(own, entries[p][found.at])
                else:
                    upper[:, p] = found.upper
                    lower[:, p], unit[:, p] = _pack(found.lower)
            out = {c.name: batch.column(c.name) for c in kept if not (final and c.name == "x")} | {"at": _binary(at)}
            out |= {"error": pa.array(error.tolist(), pa.int64())} if final else {"upper": _binary(upper), "lower": _binary(lower), "unit": _binary(unit)}
            yield pa.RecordBatch.from_pydict(out)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in kept if not (final and f.name == "x")]
    return table.mapInArrow(work, ", ".join([*fields, "at binary, error long" if final else STATE]))


def _sums(state: DataFrame, dtype: str, parts: int, n_entries: int, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry): how many parts it has, and their componentwise sums; formed in each task, then by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.int64 if dtype != "object" else object
        sums, counts = np.zeros((parts, n_entries, width), exact), np.zeros((parts, n_entries), np.int64)
        for batch in batches:
            x = _ints(batch.column("x"), dtype, parts * width)
            at = np.frombuffer(b"".join(batch.column("at").to_pylist()), np.uint8).reshape(len(x), parts)
            for p in range(parts):
                np.add.at(sums[p], at[:, p], x[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(at[:, p], minlength=n_entries)
        p, j = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_pydict({"p": pa.array(p, pa.int32()), "j": pa.array(j, pa.int32()), "n": pa.array(counts[p, j]), "sums": pa.array([[str(v) for v in row] for row in sums[p, j]], pa.list_(pa.string()))})

    found = state.select("x", "at").mapInArrow(work, "p int, j int, n long, sums array<string>")
    each = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    rows = found.groupBy("p", "j").agg(F.sum("n").alias("n"), *each).collect()  # parts x entries rows
    return {(r["p"], r["j"]): (r["n"], [int(r[f"s{i}"]) for i in range(width)]) for r in rows}


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """For each vector: `key, code, error, label_error, codebooks_sha256`.

    Rows whose vector is null or holds null or non-finite components are left out. Components become floor(1024 x);
    each part's codebook begins with that part of the `entries` smallest keys (all, if fewer; equal keys in the order of
    their vectors, null keys last). `rounds` times each part goes to its nearest entry (ties: lower index), and entries
    become componentwise floors of their parts' means; unused ones stay. Then parts are assigned once more. `code` has
    two hex digits for each part, `error` sums squared distances, `label_error` sums those over equal labels (nulls
    are one label).

    All vectors have one length, that of the kept row first by key and vector; others are left out. Where it does not
    divide by `parts`, zeros fill the last part. Empty vectors have distance 0 to all. Repeated rows come out alike, an
    empty table gives no rows, and other columns are not read. Components of 2^24 or more are calculated with Python's integers; an
    error beyond 64 bits is refused.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index is a byte")
    spark = vectors.sparkSession
    bound_batches(spark)
    v = F.col("v")
    rows = vectors.select(F.col(key).alias("vec"), F.col(vector).alias("v"), F.col(label).alias("label")).where(v.isNotNull())
    rows = rows.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))))
    by_key = [F.col("vec").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*by_key).select("vec", "v").limit(1).collect()
    dims = len(first[0]["v"]) if first else 0
    rows = rows.where(F.size("v") == dims)
    width = -(-dims // parts)
    largest = rows.agg(F.max(F.greatest(F.abs(F.array_max("v").cast("double")), F.abs(F.array_min("v").cast("double"))))).first()[0] or 0.0
    top = largest * SCALE + 1
    dtype = "<i2" if top < 1 << 15 else "<i4" if top < LARGEST else "object"
    beginning = [[int(np.floor(np.float64(x) * SCALE)) for x in r["v"]] + [0] * (parts * width - dims) for r in rows.orderBy(*by_key).limit(entries).select("v").collect()]
    n_entries = len(beginning)
    exact = object if dtype == "object" else np.int64
    books = np.array(beginning, exact).reshape(n_entries, parts, width).transpose(1, 0, 2)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.asarray(batch.column("v").flatten(), np.float64).reshape(batch.num_rows, dims)
            floors = np.floor(found * SCALE)
            if dtype == "object":
                x = pa.array([",".join([*(str(int(a)) for a in row), *["0"] * (parts * width - dims)]) for row in floors], pa.string())
            else:
                x = _binary(np.pad(floors.astype(dtype), ((0, 0), (0, parts * width - dims))))
            yield pa.RecordBatch.from_pydict({"vec": batch.column("vec"), "label": batch.column("label"), "x": x})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    table = rows.mapInArrow(packed, f"vec {kinds['vec']}, label {kinds['label']}, x {'string' if dtype == 'object' else 'binary'}")
    last, held = None, table
    for _ in range(rounds):
        state = stage(_assigned(held, dtype, width, books, last, False), "bounds")
        sums = _sums(state, dtype, parts, n_entries, width) if n_entries else {}
        last, books = books, books.copy()
        for (p, j), (n, total) in sums.items():
            books[p, j] = [t // n for t in total]
        if held is not table:
            drop_staged(held)  # the table of the round before is not read again
        held = state
    found = stage(_assigned(held, dtype, width, books, last, True), "codes")
    if held is not table:
        drop_staged(held)
    digest = sha256(",".join(str(int(c)) for c in books.reshape(-1)).encode()).hexdigest()
    # summed by label in each task first; labels come back by a join that adaptive execution may split
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = found.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("vec").alias(key), F.lower(F.hex("at")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
