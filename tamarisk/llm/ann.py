"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, and greedy search over it.

Every distinct direction is a node. Cells of a few random hyperplane trees give each node its first neighbours; a
crowded cell is parted by further hyperplanes about its own mean. Rounds of NN-descent then join each node's
neighbours and reverse neighbours with one another, and a node keeps the nearest it meets, until hardly any
neighbour changes. Pairs that were compared before are not compared again: neighbours are flagged as new for one
round, and a node around which none is new is left out. Reverse lists are cut within each task and again after the
shuffle, so that a hub sends and gets a bounded list. Queries walk the graph greedily with a beam, from their own node
and from the nearest of some entry nodes all over the graph, in case parts of it are not joined: each step joins the
beam's unopened nodes to their neighbour lists, which lie bucketed by node with the neighbours' vectors, so a step
moves queries and not the graph.

How wide the beam must be is measured: for a bounded sample of the queries the true neighbours come from one scan
over all nodes, and the beam is doubled until the walk finds them often enough. Where WIDEST is not enough, the queries
are held against all nodes in blocks, which is exact. Nearness on the way is the squared
distance of unit vectors in single precision, from differences or about a common centre, so that tight groups keep
their order; in the end all that rounding could have put among the nearest is compared in double precision.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.llm._common import bound_batches, by_group, mix, shared_dir, stage

#: Neighbours of a node and reverse ones besides; trees, nodes of a cell on average.
NEIGHBOURS, REVERSE, TREES, CELL = 24, 24, 8, 800
#: Rounds of NN-descent go on until fewer than this share of all neighbours is new.
SETTLED = 0.02
#: Width of the first beam; queries that its width is fitted on, and the share of their true neighbours to be found.
BEAM, SAMPLE, TARGET = 256, 256, 0.97
#: Width of the last beam tried; entry nodes, and how many of them each query starts from.
WIDEST, ENTRIES, STARTS = 4096, 1024, 8
#: Edges that a task holds before it cuts reverse lists and sends them, and queries that one scan over all nodes serves.
HELD, SCANNED = 1 << 18, 4096
#: Nodes of a bucket in which the edges around them meet.
BUCKET = 8192
#: Distance of unit vectors that rounding to single precision may hide, with room.
ROUNDING = 1e-6
#: Below any nearness, which is the squared distance of unit vectors, negated.
FARTHEST = -5.0
#: Pairs that one numpy step compares, and rows of lists merged at once.
BLOCK, MERGED = 1 << 20, 5_000
SEED = 11


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors without null or non-finite parts, not zero, and of the most frequent dimension (the smaller of ties)."""
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    found = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(F.coalesce(ok, F.lit(False)))
    first = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found.where(F.size("v") == (first["d"] if first else 0))


def _matrix(column: pa.Array, kind=np.float32) -> np.ndarray:
    """Rows of equally long packed numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _packed(rows) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which changes no digit, so that squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = _scaled(np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1))
        yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "u": _packed((v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32))})


def _nearness(u: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Of rows begin to end with all rows, taken about the rows' mean so that small distances keep their digits."""
    x = u - u.mean(axis=0, dtype=np.float64).astype(np.float32)
    squares = np.einsum("ij,ij->i", x, x)
    return np.minimum(2 * (x[begin:end] @ x.T) - squares[begin:end, None] - squares, 0)


def _edges_of(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lists, sims, fresh = (found.column(c).to_pylist() for c in ("others", "sims", "fresh"))
    lens = np.array([len(b) // 8 for b in lists], int)
    return np.repeat(np.asarray(found.column("id")), lens), np.frombuffer(b"".join(lists), np.int64), np.frombuffer(b"".join(sims), np.float32), np.frombuffer(b"".join(fresh), np.uint8)


def _best(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each id the k nearest others, each once, nearest first; fresh where any of its edges is."""
    order = np.lexsort((-fresh.astype(np.int8), -sims, others, ids))
    ids, others, sims, fresh = ids[order], others[order], sims[order], fresh[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (others[1:] != others[:-1])
    ids, others, sims, fresh = ids[new], others[new], sims[new], np.maximum.reduceat(fresh, np.flatnonzero(new)) if len(ids) else fresh
    order = np.lexsort((others, -sims, ids))
    ids, others, sims, fresh = ids[order], others[order], sims[order], fresh[order]
    place = np.arange(len(ids)) - np.searchsorted(ids, ids)
    return tuple(x[place < k] for x in (ids, others, sims, fresh))


def _lists(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    """Edges that are sorted by id, as one row for each id."""
    edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, int)
    ends = np.concatenate([edges[1:], [len(ids)]])
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(edges, ends)], pa.binary())
    return pa.RecordBatch.from_pydict({"id": pa.array(ids[edges]), "others": cut(others), "sims": cut(sims.astype(np.float32)), "fresh": cut(fresh.astype(np.uint8))})


_LISTS = "id long, others binary, sims binary, fresh binary"
_OPENED = "id long, other long, fresh boolean"
#: Files of a graph up to which the lists of one id come from few enough tasks to be merged at once.
DIRECT = 128


def _handed_on(ids: np.ndarray, others: np.ndarray, sims: np.ndarray, fresh: np.ndarray, opened: str | None) -> Iterator[pa.RecordBatch]:
    """Edges that are sorted by id, as lists; or `opened`, as edges of "all" ids or of those with a "fresh" edge.

    They are opened where they are merged, as each further Python function in a stage is a worker more for each core.
    """
    if opened is None:
        yield _lists(ids, others, sims, fresh)
        return
    if opened == "fresh":
        keep = np.isin(ids, ids[fresh > 0])
        ids, others, fresh = ids[keep], others[keep], fresh[keep]
    for a in range(0, len(ids), 50_000):
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids[a : a + 50_000]), "other": pa.array(others[a : a + 50_000]), "fresh": pa.array(fresh[a : a + 50_000] > 0)})


def merged(lists: DataFrame) -> DataFrame:
    """One list for each id: the nearest NEIGHBOURS of all its lists."""
    return by_group(lists, ["id"], lambda found: iter([_lists(*_best(*_edges_of(found), NEIGHBOURS))]), _LISTS, MERGED)


def _sums(cells: DataFrame, key: list[str], dim: int) -> DataFrame:
    """(key, n, mean): rows and mean vector of each cell, first summed up within each batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(k)) for k in key]) if key else np.zeros((1, batch.num_rows), np.int64)
            order = np.lexsort(keys)
            begins = np.flatnonzero(np.concatenate([[True], (keys[:, order][:, 1:] != keys[:, order][:, :-1]).any(axis=0)]))
            sums = np.add.reduceat(_matrix(batch.column("u"))[order].astype(np.float64), begins, axis=0)
            counts = np.diff(np.concatenate([begins, [batch.num_rows]]))
            yield pa.RecordBatch.from_pydict({k: pa.array(keys[i, order][begins]) for i, k in enumerate(key)} | {"n": pa.array(counts), "total": pa.array(list(sums), pa.list_(pa.float64()))})

    head = "".join(f"{k} long, " for k in key)
    sums = cells.select(*key, "u").mapInArrow(work, f"{head}n long, total array<double>")
    means = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(dim)]
    return sums.groupBy(*key).agg(F.sum("n").alias("n"), *means).select(*key, "n", F.array(*[F.col(f"t{i}") / F.col("n") for i in range(dim)]).alias("mean"))


def _parted(cells: DataFrame, dim: int, seed: int) -> DataFrame:
    """Crowded cells (cell, n, mean, id, u) parted by the signs of random directions, seen from the cell's own mean."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = np.random.default_rng(seed).normal(size=(dim, 62)).astype(np.float32)
        for batch in batches:
            cell, n = np.asarray(batch.column("cell")), np.asarray(batch.column("n"))
            away = _matrix(batch.column("u")) - np.asarray(batch.column("mean").flatten()).reshape(batch.num_rows, -1).astype(np.float32)
            bits = (away @ directions > 0) & (np.arange(62) < np.ceil(np.log2(np.maximum(n / CELL, 1)))[:, None])
            code = bits @ (np.int64(1) << np.arange(62, dtype=np.int64))
            new = mix(cell.astype(np.uint64) * np.uint64(3) + mix(code.astype(np.uint64) + np.uint64(seed)))
            yield pa.RecordBatch.from_pydict({"cell": pa.array((new >> np.uint64(1)).astype(np.int64)), "id": batch.column("id"), "u": batch.column("u")})

    return cells.select("cell", "n", "mean", "id", "u").mapInArrow(work, "cell long, id long, u binary")


def _cells(nodes: DataFrame, n: int, dim: int) -> DataFrame:
    """(cell, part, id, u) for each tree: the signs of some random directions, seen from the mean, name the cell.

    A cell far above the average is parted about its own mean, again and again while that makes cells smaller.
    What cannot be parted so (equal in single precision) is dealt into parts at random.
    """
    levels = max(0, int(np.ceil(np.log2(max(1, n / CELL)))))
    codes = np.random.default_rng(SEED).normal(size=(TREES, dim, levels)).astype(np.float32)
    mean = np.array(_sums(nodes, [], dim).first()["mean"], float)  # one row

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = _matrix(batch.column("u")) - mean.astype(np.float32)
            for t in range(TREES if levels else 1):
                cell = ((u @ codes[t] > 0) @ (np.int64(1) << np.arange(levels, dtype=np.int64))).astype(np.int64) * TREES + t if levels else np.zeros(len(u), np.int64)
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cell), "id": batch.column("id"), "u": batch.column("u")})

    most = 3 * CELL
    left = stage(nodes.mapInArrow(signs, "cell long, id long, u binary"), "cells")
    done = []
    before = None
    for again in range(1, 64):
        sized = stage(_sums(left, ["cell"], dim), "sizes")
        crowded, largest = sized.where(F.col("n") > most).agg(F.count("*"), F.max("n")).first()
        if not crowded or largest == before:
            break
        met = left.join(sized, "cell")
        done.append(stage(met.where(F.col("n") <= most).select("cell", "id", "u"), "done"))
        left = stage(_parted(met.where(F.col("n") > most), dim, SEED + again), "left")
        before = largest
    sized = left.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("parts"))
    dealt = F.pmod(F.xxhash64("id", "cell"), F.col("parts"))
    out = left.join(sized, "cell").select("cell", dealt.alias("part"), "id", "u")
    for d in done:
        out = out.unionByName(d.select("cell", F.lit(0).cast("long").alias("part"), "id", "u"))
    return out


def _compared(found: pa.Table) -> Iterator[pa.RecordBatch]:
    """Each node's nearest within its cell; the cell is compared in blocks."""
    cell, part = np.asarray(found.column("cell")), np.asarray(found.column("part"))
    ids, u = np.asarray(found.column("id")), _matrix(found.column("u").combine_chunks() if isinstance(found.column("u"), pa.ChunkedArray) else found.column("u"))
    edges = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]), [True]]))
    for a, b in zip(edges[:-1], edges[1:]):
        m = b - a
        k = min(NEIGHBOURS, m - 1)
        if k < 1:
            continue
        step = max(1, BLOCK // m)
        for begin in range(a, b, step):
            end = min(b, begin + step)
            sims = _nearness(u[a:b], begin - a, end - a)
            sims[np.arange(end - begin), np.arange(begin - a, end - a)] = -np.inf
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids[begin:end]), "others": _packed(ids[a:b][near]), "sims": _packed(np.take_along_axis(sims, near, 1)), "fresh": pa.array([b"\x01" * k] * (end - begin), pa.binary())})


def _around(graph: DataFrame, opened: str | None = None, n: int = 0) -> DataFrame:
    """Each of n nodes' neighbours and its nearest reverse neighbours: (id, others, sims, fresh), or edges as merged() opens them.

    Edges go to buckets of nodes, packed: a task sends one row to each bucket for HELD edges, and not one for each node
    that it met, of which more tasks would meet each more often. A bucket's tasks' reverse lists are cut once more there.
    """
    buckets = max(int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))

    def packed(ahead: tuple[np.ndarray, ...], back: tuple[np.ndarray, ...] | None) -> pa.RecordBatch:
        ids, others, sims, fresh = ahead
        back = _best(*(back or (others, ids, sims, fresh)), REVERSE)
        edges = [np.concatenate(x) for x in zip(ahead, back)] + [np.repeat(np.array([0, 1], np.uint8), [len(ids), len(back[0])])]
        bucket = (mix(edges[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, edges = bucket[order], [x[order] for x in edges]
        begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
        ends = np.concatenate([begins[1:], [len(bucket)]])
        return pa.RecordBatch.from_arrays([pa.array(bucket[begins]), *(pa.array([x[a:b].tobytes() for a, b in zip(begins, ends)], pa.binary()) for x in edges)], names=["bucket", "ids", "others", "sims", "fresh", "back"])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def dealt() -> pa.RecordBatch:
            return packed(tuple(np.concatenate(x) for x in zip(*held)), None)

        for batch in batches:
            held.append(_edges_of(pa.Table.from_batches([batch])))
            size += len(held[-1][0])
            if size > HELD:
                yield dealt()
                held, size = [], 0
        if held:
            yield dealt()

    def opened_up(found: pa.Table) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        kinds = {"ids": np.int64, "others": np.int64, "sims": np.float32, "fresh": np.uint8, "back": np.uint8}
        *edges, back = (np.frombuffer(b"".join(found.column(c).to_pylist()), kind) for c, kind in kinds.items())
        return tuple(x[back == 0] for x in edges), tuple(x[back > 0] for x in edges)

    def around(found: pa.Table) -> Iterator[pa.RecordBatch]:
        ahead, back = opened_up(found)
        yield from _handed_on(*_best(*map(np.concatenate, zip(ahead, _best(*back, REVERSE))), NEIGHBOURS + REVERSE), opened)

    schema = "bucket long, ids binary, others binary, sims binary, fresh binary, back binary"
    sent = graph.mapInArrow(turned, schema)
    if len(graph.inputFiles()) > DIRECT:  # a hub has a list from each task: these are cut once more on the way
        some = sent.withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(32)).cast("long"))
        sent = by_group(some, ["bucket", "deal"], lambda found: iter([packed(*opened_up(found))]), schema)
    return by_group(sent, ["bucket"], around, _LISTS if opened is None else _OPENED)


def _descended(graph: DataFrame, nodes: DataFrame, n: int = 0) -> DataFrame:
    """One round: around each node, its neighbours are compared with those that are new, and each keeps the nearest it meets."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = [np.frombuffer(b, np.float32) for b in batch.column("sims").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "least": pa.array([float(s.min()) if len(s) >= NEIGHBOURS else FARTHEST for s in sims])})

    bars = graph.mapInArrow(last, "id long, least double")
    known = nodes.join(bars, "id").select(F.col("id").alias("other"), "u", "least")
    met = _around(graph, "fresh", n).join(known, "other").select("id", "other", "u", "least", "fresh")

    def f(found: pa.Table) -> Iterator[pa.RecordBatch]:
        at, others, bars, fresh = (np.asarray(found.column(c)) for c in ("id", "other", "least", "fresh"))
        u = _matrix(found.column("u").combine_chunks() if isinstance(found.column("u"), pa.ChunkedArray) else found.column("u"))
        edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        ids, near, sims = [], [], []
        for a, b in zip(edges[:-1], edges[1:]):
            s = _nearness(u[a:b], 0, b - a)
            np.fill_diagonal(s, -np.inf)
            i, j = np.nonzero((s > bars[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]))
            ids.append(others[a:b][i])
            near.append(others[a:b][j])
            sims.append(s[i, j])
        ids, near, sims = map(np.concatenate, (ids, near, sims))
        yield _lists(*_best(ids, near, sims, np.ones(len(ids), np.uint8), NEIGHBOURS))

    return merged(graph.unionByName(by_group(met, ["id"], f, _LISTS, 4000)))


def _flagged(old: DataFrame, new: DataFrame) -> DataFrame:
    """`new` with neighbours fresh that the node did not have before, and how many (n_fresh)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            had, has = ([np.frombuffer(b or b"", np.int64) for b in batch.column(c).to_pylist()] for c in ("had", "others"))
            fresh = [~np.isin(y, x) for x, y in zip(had, has)]
            columns = {c: batch.column(c) for c in ("id", "others", "sims")}
            yield pa.RecordBatch.from_pydict(columns | {"fresh": _packed([f.astype(np.uint8) for f in fresh]), "n_fresh": pa.array([int(f.sum()) for f in fresh], pa.int64()), "n": pa.array([len(f) for f in fresh], pa.int64())})

    both = new.join(old.select("id", F.col("others").alias("had")), "id", "left")
    return both.select("id", "others", "sims", "had").mapInArrow(work, f"{_LISTS}, n_fresh long, n long")


def build(nodes: DataFrame, n: int, dim: int) -> DataFrame:
    """The neighbour graph (id, others, sims, fresh) of nodes (id, u). Nearness only grows from round to round, so the rounds end."""
    graph = stage(merged(by_group(_cells(nodes, n, dim), ["cell", "part"], _compared, _LISTS)), "graph")
    share = 1.0 if n > CELL else 0.0
    while share > SETTLED:
        better = stage(_flagged(graph, _descended(graph, nodes, n)), "graph")
        fresh, every = better.agg(F.sum("n_fresh"), F.sum("n")).first()
        share = (fresh or 0) / max(1, every or 0)
        graph = better.select("id", "others", "sims", "fresh")
    return graph


_STATE = "query long, u binary, others binary, sims binary, opened binary, next array<long>, bar double"


def _walk(found: pa.Table, beam: int) -> Iterator[pa.RecordBatch]:
    """Beams after a step: each query's beam and what it met, the `beam` nearest kept, and the next nodes to open."""
    query = np.asarray(found.column("query"))
    edges = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1], [True]]))
    columns = {c: found.column(c).to_pylist() for c in ("u", "others", "sims", "opened")}
    out: dict[str, list] = {c: [] for c in ("query", "u", "others", "sims", "opened", "next", "bar")}
    for a, b in zip(edges[:-1], edges[1:]):
        others = np.frombuffer(b"".join(columns["others"][a:b]), np.int64)
        sims = np.frombuffer(b"".join(columns["sims"][a:b]), np.float32)
        opened = np.frombuffer(b"".join(columns["opened"][a:b]), np.int8)
        order = np.lexsort((-opened, others))
        others, sims, opened = others[order], sims[order], opened[order]
        new = np.concatenate([[True], others[1:] != others[:-1]])
        others, sims, opened = others[new], sims[new], opened[new]
        order = np.lexsort((others, -sims))[:beam]
        others, sims, opened = others[order], sims[order], opened[order].copy()
        ahead = np.flatnonzero(opened == 0)[: max(32, beam // 2)]
        opened[ahead] = 1
        out["query"].append(int(query[a]))
        out["u"].append(next(x for x in columns["u"][a:b] if x is not None))
        out["others"].append(others.tobytes())
        out["sims"].append(sims.tobytes())
        out["opened"].append(opened.tobytes())
        out["next"].append(others[ahead].tolist())
        out["bar"].append(float(sims[-1]) if len(sims) >= beam else FARTHEST)
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.float64())
    yield pa.RecordBatch.from_pydict({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds)})


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a query meets at an opened node, as far as it is nearer than the beam's end."""
    for batch in batches:
        rows = []
        for q, bar, u, others, near in zip(*(batch.column(c).to_pylist() for c in ("query", "bar", "qu", "others", "near"))):
            v = np.frombuffer(u, np.float32)
            away = np.frombuffer(near, np.float32).reshape(-1, len(v)) - v
            sims = -np.einsum("ij,ij->i", away, away)
            keep = sims > bar
            if keep.any():
                rows.append((q, np.frombuffer(others, np.int64)[keep].tobytes(), sims[keep].tobytes(), bytes(int(keep.sum()))))
        if rows:
            q, o, s, done = zip(*rows)
            yield pa.RecordBatch.from_pydict({"query": pa.array(q, pa.int64()), "others": pa.array(o, pa.binary()), "sims": pa.array(s, pa.binary()), "opened": pa.array(done, pa.binary())})


def _with_vectors(graph: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, others, near): each node's neighbours and reverse neighbours, with their vectors packed in the same order."""
    met = _around(graph, "all", n).join(nodes.select(F.col("id").alias("other"), "u"), "other")

    def f(found: pa.Table) -> Iterator[pa.RecordBatch]:
        at, others, u = np.asarray(found.column("id")), np.asarray(found.column("other")), found.column("u").to_pylist()
        edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        yield pa.RecordBatch.from_pydict({"node": pa.array(at[edges[:-1]]), "others": pa.array([others[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()), "near": pa.array([b"".join(u[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())})

    return by_group(met.select("id", "other", "u"), ["id"], f, "node long, others binary, near binary", 2000)


def search(around: DataFrame, queries: DataFrame, beam: int) -> DataFrame:
    """(query, others, sims): the nodes in each query's beam, nearest first, once no node in it is left to open.

    `around` holds nodes with their neighbours' vectors; queries (query, node, u, starts) begin at their own node and at
    those of `starts`, which are opened first and met again as neighbours. Every step opens nodes that were not opened
    before, so the walk ends.
    """

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_pylist()
            yield pa.RecordBatch.from_pydict({"query": batch.column("query"), "u": batch.column("u"), "others": pa.array([np.int64(i).tobytes() for i in ids], pa.binary()), "sims": pa.array([np.float32(0).tobytes()] * len(ids), pa.binary()), "opened": pa.array([b"\x01"] * len(ids), pa.binary()), "next": pa.array([[i, *(x for x in more if x != i)] for i, more in zip(ids, batch.column("starts").to_pylist())], pa.list_(pa.int64())), "bar": pa.array([FARTHEST] * len(ids))})

    state = stage(queries.select("query", "node", "u", "starts").mapInArrow(begun, _STATE), "beams")
    while state.where(F.size("next") > 0).take(1):
        ahead = state.select("query", F.col("u").alias("qu"), "bar", F.explode("next").alias("node"))
        met = ahead.join(around, "node").select("query", "bar", "qu", "others", "near").mapInArrow(_met, "query long, others binary, sims binary, opened binary")
        both = state.select("query", "u", "others", "sims", "opened").unionByName(met.withColumn("u", F.lit(None).cast("binary")))
        state = stage(by_group(both, ["query"], lambda found: _walk(found, beam), _STATE, 2000), "beams")
    return state.select("query", "others", "sims")


def true_distances(nodes: DataFrame, sample: DataFrame, k: int) -> dict[int, np.ndarray]:
    """For queries (query, node, u), SAMPLE at most: ascending distances of the k nearest other nodes, by a scan over all nodes."""
    rows = sample.collect()
    ids, own = [r["query"] for r in rows], np.array([r["node"] for r in rows])
    at = np.stack([np.frombuffer(r["u"], np.float32) for r in rows]).astype(np.float64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(at), k), np.inf)
        for batch in batches:
            x = _matrix(batch.column("u")).astype(np.float64)
            d = np.maximum(0, (at * at).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * (at @ x.T))
            d[own[:, None] == np.asarray(batch.column("id"))] = np.inf
            best = np.sort(np.hstack([best, d]), axis=1)[:, :k]
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.repeat(np.arange(len(at), dtype=np.int32), k)), "d": pa.array(best.ravel())})

    place = F.row_number().over(Window.partitionBy("i").orderBy("d"))
    found = nodes.select("id", "u").mapInArrow(work, "i int, d double").where(F.col("d") < float("inf")).withColumn("at", place).where(F.col("at") <= k).collect()
    out: dict[int, list[float]] = {q: [] for q in ids}
    for r in found:
        out[ids[r["i"]]].append(r["d"] ** 0.5)
    return {q: np.sort(v) for q, v in out.items()}


def recall(found: DataFrame, truth: dict[int, np.ndarray]) -> float:
    """The share of the true nearest nodes' distances that beams (query, others, sims) of the sampled queries reach."""
    hits = n = 0
    for r in found.collect():
        true = truth[r["query"]]
        own = np.sqrt(-np.frombuffer(r["sims"], np.float32).astype(np.float64))[1 : len(true) + 1]  # the first is the query's own node
        hits += int((own <= true[: len(own)] * (1 + 1e-6) + ROUNDING).sum())
        n += len(true)
    return hits / max(1, n)


def with_starts(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Queries with `starts`, the nearest STARTS of ENTRIES nodes that lie all over the graph (by hash of their ids)."""
    rows = nodes.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).collect()
    ids, at = np.array([r["id"] for r in rows], np.int64), np.stack([np.frombuffer(r["u"], np.float32) for r in rows]) if rows else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.argsort(-(_matrix(batch.column("u")) @ at.T), axis=1, kind="stable")[:, :STARTS]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(ids[near]), pa.list_(pa.int64()))], names=[*batch.schema.names, "starts"])

    return queries.select("query", "node", "u").mapInArrow(work, "query long, node long, u binary, starts array<long>")


def scanned(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, node) as found_nodes, exactly: all nodes that may be among the k nearest of queries (query, node, u), SCANNED queries at a time.

    Each task keeps for each query of the block the k + 1 nearest it meets, and all that rounding may hide behind them.
    """
    dealt = stage(queries.select("query", "u").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(max(1, -(-queries.count() // (SCANNED // 2)))))), "dealt")
    out = None
    for block in [r["block"] for r in dealt.select("block").distinct().collect()]:
        rows = dealt.where(F.col("block") == block).collect()
        ids, at = np.array([r["query"] for r in rows]), np.stack([np.frombuffer(r["u"], np.float32) for r in rows]).astype(np.float64)

        def work(batches: Iterator[pa.RecordBatch], ids=ids, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("u")).astype(np.float64)
                d = np.sqrt(np.maximum(0, (at * at).sum(axis=1)[:, None] + (x * x).sum(axis=1) - 2 * (at @ x.T)))
                bar = np.sort(d, axis=1)[:, min(k, d.shape[1] - 1)]
                q, n = np.nonzero(d <= bar[:, None] + 2 * ROUNDING)
                yield pa.RecordBatch.from_pydict({"query": pa.array(ids[q]), "node": pa.array(np.asarray(batch.column("id"))[n]), "d": pa.array(d[q, n])})

        met = stage(nodes.select("id", "u").mapInArrow(work, "query long, node long, d double"), "met")
        near = met.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy("d"))).where(F.col("at") <= k + 1).groupBy("query").agg(F.max("d").alias("bar"))
        some = met.join(near, "query").where(F.col("d") <= F.col("bar") + 2 * ROUNDING).select("query", "node")
        out = some if out is None else out.union(some)
    return out if out is not None else queries.select("query", "node")


def found_nodes(around: DataFrame, nodes: DataFrame, queries: DataFrame, n: int, k: int) -> DataFrame:
    """(query, node): for queries (query, node) all nodes that may be among the k nearest found, by a beam as wide as a sample needs."""
    own = stage(with_starts(queries.join(nodes.select(F.col("id").alias("node"), "u"), "node"), nodes), "own")
    sample = stage(own.orderBy(F.xxhash64("query"), "query").limit(SAMPLE), "sample")
    truth = true_distances(nodes, sample, k) if sample.take(1) else {}
    beam = max(BEAM, 4 * k)
    walked = search(around, sample, beam)
    while truth and recall(walked, truth) < TARGET and beam < n:
        beam *= 2
        if beam > max(WIDEST, 4 * k):
            return scanned(nodes, own, k)
        walked = search(around, sample, beam)
    rest = own.join(F.broadcast(sample.select("query")), "query", "left_anti")  # the sample has been walked
    if rest.take(1):
        walked = walked.unionByName(search(around, rest, beam))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for others, sims in zip(batch.column("others").to_pylist(), batch.column("sims").to_pylist()):
                d = np.sqrt(-np.frombuffer(sims, np.float32).astype(np.float64))
                # k nodes besides the query's own one hold the k nearest rows, up to rounding
                lists.append(np.frombuffer(others, np.int64)[d <= d[min(k, len(d) - 1)] + ROUNDING])
            lens = np.array([len(x) for x in lists], int)
            yield pa.RecordBatch.from_pydict({"query": pa.array(np.repeat(np.asarray(batch.column("query")), lens)), "node": pa.array(np.concatenate(lists))})

    return walked.mapInArrow(ends, "query long, node long")


def nearest(vectors: DataFrame, is_query: F.Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows found, by cosine in double precision.

    Ties go to the smaller id. Null vectors, zero ones, those with null or non-finite parts, those of another
    dimension than the most frequent one and rows without id take no part, as queries or as candidates. Rows with
    equal vectors are one node of the graph, and each gives candidates of its own; a query meets every row but its
    own. Of rows that repeat an id, the first by vector stands for all. With fewer candidates than k, all found
    come; an empty table gives no rows. `is_query` is a condition on the key. Other columns are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = stage(usable(vectors, key, vector).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    first = rows.take(1)
    if not first:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(first[0]["v"])
    members = stage(rows.join(rows.groupBy("v").agg(F.min("id").alias("node")), "v").select("id", "node"), "members")
    nodes = stage(rows.join(members.where("id = node").select("id"), "id", "left_semi").mapInArrow(_unit, "id long, u binary"), "nodes")
    n = nodes.count()
    graph = build(nodes, n, dim)
    queries = stage(members.withColumn(key, F.col("id")).where(is_query).select(F.col("id").alias("query"), "node"), "queries")
    name = f"tamarisk_ann_{uuid.uuid4().hex}"
    try:
        if graph.take(1):
            parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
            lists = _with_vectors(graph, nodes, n).write.bucketBy(parts, "node").sortBy("node").format("parquet")
            lists.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)  # files go to the shared folder, not to a warehouse
            found = stage(found_nodes(spark.table(name), nodes, queries, n, k), "found")
        else:
            found = queries
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    # of a node's members no more than k and the query itself can be among the k nearest
    some = members.withColumn("at", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where(F.col("at") <= k + 1).select("node", "id")
    some = some.join(rows, "id").select("node", "id", "v")
    pairs = found.join(some, "node").where("id <> query").join(rows.select(F.col("id").alias("query"), F.col("v").alias("qv")), "query")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = _scaled(np.asarray(batch.column("qv").flatten()).reshape(batch.num_rows, -1))
            b = _scaled(np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1))
            value = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            yield pa.RecordBatch.from_pydict({"query_id": batch.column("query"), "vec_id": batch.column("id"), "score": pa.array(value)})

    ranked = pairs.select("query", "id", "qv", "v").mapInArrow(scored, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ranked.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
