"""MinHash near-duplicates with HyperMinHash sketches.

A document's distinct 5-word shingles are hashed into buckets; each bucket's register keeps the leading-zero count
and a few mantissa bits of its smallest hash. Empty buckets borrow from the first filled one in an order of their
own, so short texts have full sketches too. Bands of registers group candidates; the sketches' collision-corrected
Jaccard estimate drops those far below the threshold, and full shingle sets confirm the others.

Texts with one shingle set are one node. A first round links each node to one node of its bands only, the next
ones look at bands that still hold several components, so that a large group of copies costs rows in proportion
to its size and not to its square; no link between different components is left untested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.llm._common import bound_batches, by_group, mix, rolling, slices, split_words, stage

#: Words of a shingle; links need 100 * intersection >= THRESHOLD * union.
SHINGLE, THRESHOLD = 5, 75
#: A pair at the threshold is missed with probability (1 - .75 ** ROWS) ** BANDS, about 4e-6.
BANDS, ROWS = 64, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Standard errors below the threshold at which an estimate rules a pair out.
MARGIN = 6
#: Rounds in which an empty bucket tries one other bucket, before all filled ones are ranked for it.
PROBES = 24
#: Nodes of one band up to which all pairs of different components are compared; larger bands go by rare shingles.
PAIRWISE = 8
#: Shingles of all sets that one test holds, on either side; 1 MB.
CHUNK = 1 << 17

_PROBE = (mix(np.arange(PROBES * REGISTERS, dtype=np.uint64) + np.uint64(99)) % np.uint64(REGISTERS)).astype(np.int64).reshape(PROBES, REGISTERS)
_RANK = mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(12345)).reshape(REGISTERS, REGISTERS)
_FULL = np.uint64((1 << 64) - 1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted."""
    words = split_words(texts, lower=True)
    hashes, first = words.hashes(), words.first
    fives = rolling(hashes, SHINGLE)
    found = []
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= SHINGLE:
            found.append(np.unique(fives[a : b - SHINGLE + 1]))
        elif b > a:
            found.append(mix(rolling(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def sketch(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a non-empty set."""
    bucket = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    least = np.full(REGISTERS, _FULL)
    np.minimum.at(least, bucket, mix(shingles))
    filled = least != _FULL
    source = np.where(filled, np.arange(REGISTERS), -1)
    empty = np.flatnonzero(~filled)
    for t in range(PROBES):
        if not len(empty):
            break
        tried = _PROBE[t, empty]
        hit = filled[tried]
        source[empty[hit]] = tried[hit]
        empty = empty[~hit]
    if len(empty):
        held = np.flatnonzero(filled)
        source[empty] = held[np.argmin(_RANK[empty][:, held], axis=1)]
    fraction, exponent = np.frexp(least[source].astype(np.float64))
    return (np.minimum(63, 64 - exponent) << MANTISSA | np.clip(((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.int64), 0, (1 << MANTISSA) - 1)).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    rows = registers.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return key


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate: the share of equal registers, less what different minima that share a register add."""
    chance = 2.0 ** -(MANTISSA + 1)
    return (float(np.mean(a == b)) - chance) / (1 - chance)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, h, n_shingles, k1, k2, bands): text hash, set size, 128 bits of the set, and band keys."""
    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"))
            sums = [(mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets]
            keys = [band_keys(sketch(s)).view(np.int64) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "h": batch.column("h"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "k1": _long(np.array([a for a, _ in sums], np.uint64)),
                    "k2": _long(np.array([b for _, b in sums], np.uint64)),
                    "bands": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys))),
                }
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).mapInArrow(work, f"doc_id {kind}, h long, n_shingles long, k1 long, k2 long, bands array<long>")


def with_texts(some: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of `some` (node, ...) with the text of the node's document."""
    named = some.join(nodes.select("node", "rep", "h"), "node").alias("n")
    return named.join(texts.alias("t"), F.col("n.rep").eqNullSafe(F.col("t.key")) & (F.col("n.h") == F.col("t.h"))).select(*[F.col(f"n.{c}") for c in some.columns], "t.text")


def confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose shingle sets overlap enough, as (a, b).

    `nodes` names a document for each node by key and text hash, and its text is fetched from `texts`. A text that
    many are held against goes once to each of the parts that these are dealt into, and parts hold CHUNK shingles.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    held = stage(with_texts(ends, nodes, texts), "held")
    sizes = nodes.select(F.col("node").alias("a"), "n_shingles")
    parts = stage(pairs.join(sizes, "a").groupBy("b").agg(F.ceil(F.sum("n_shingles") / CHUNK).alias("parts")), "parts")
    asking = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    left = asking.join(held.select(F.col("node").alias("a"), "text"), "a").select("b", "part", "a", "text")
    right = parts.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(held.select(F.col("node").alias("b"), "text"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    return by_group(left.unionByName(right), ["b", "part"], _confirmed, "a long, b long", 100)


def _confirmed(found: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of each part, the nodes whose sets overlap enough with that of the row without `a`."""
    least = THRESHOLD / 100 - MARGIN * (THRESHOLD / 100 * (1 - THRESHOLD / 100) / REGISTERS) ** 0.5
    b, part, one = np.asarray(found.column("b")), np.asarray(found.column("part")), found.column("a").combine_chunks()
    a, is_hub = one.fill_null(0).to_numpy(), one.is_null().to_numpy(zero_copy_only=False)
    texts = found.column("text").combine_chunks()
    edges = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (part[1:] != part[:-1]), [True]]))
    keep = np.zeros(len(b), bool)
    for begin, end in zip(edges[:-1], edges[1:]):
        hubs = begin + np.flatnonzero(is_hub[begin:end])
        if not len(hubs):
            continue
        hub = shingle_sets(texts.slice(hubs[0], 1))[0]
        sketched = sketch(hub)
        at = begin
        for batch in slices(iter([pa.RecordBatch.from_pydict({"text": texts.slice(begin, end - begin)})])):
            for own in shingle_sets(batch.column("text")):
                if not is_hub[at] and len(own) and estimate(sketch(own), sketched) >= least:
                    both = len(np.intersect1d(own, hub, assume_unique=True))
                    keep[at] = 100 * both >= THRESHOLD * (len(own) + len(hub) - both)
                at += 1
    yield pa.RecordBatch.from_pydict({"a": pa.array(a[keep]), "b": pa.array(b[keep])})


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes of edges (a, b); alternating large and small stars."""
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = stage(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = stage(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "small")
        before, now = now, state(edges)
        if now == before:
            break
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def crowd_links(crowd: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of crowded nodes (node, component) as all links between them would.

    Exact prefix, length and position filters name the (node, other component) pairs that need a test: shingles are
    ordered by how few of these nodes have them; two sets that overlap enough share one of the first
    n - ceil(.75 n) + 1, and where the first shared one stands bounds their overlap, so passages that many share
    bring nothing together. A test compares the node's set with all of the component, chunk by chunk, and gives one link.
    """
    sized = crowd.join(crowd.groupBy("component").agg(F.count("*").alias("size")), "component")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("node", "component", "size")} | {"n": pa.array([len(x) for x in sets], pa.int64()), "set": pa.array([x.tobytes() for x in sets], pa.binary())})

    sets = stage(with_texts(sized.select("node", "component", "size"), nodes, texts).mapInArrow(packed, "node long, component long, size long, n long, set binary").dropDuplicates(["node"]), "sets")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = pa.array(np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("n"))))
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(take) for c in ("node", "component", "size", "n")} | {"s": pa.array(np.frombuffer(b"".join(batch.column("set").to_pylist()), np.int64))})

    each = sets.mapInArrow(opened, "node long, component long, size long, n long, s long")
    shared = each.join(stage(each.groupBy("s").agg(F.count("*").alias("c")).where("c > 1"), "counted"), "s")
    own = Window.partitionBy("node")
    # shingles that one node alone has come first in its order and meet nothing: they count, and are not kept
    place = F.row_number().over(own.orderBy("c", "s")) + (F.col("n") - F.count("*").over(own))
    first = shared.withColumn("at", place).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * THRESHOLD / 100) + 1)
    first = first.withColumn("most", F.col("n") - F.col("at") + 1).where(_reaches(F.col("most"), F.col("n") + F.ceil(F.col("n") * THRESHOLD / 100)))
    first = stage(first.select("s", "node", "component", "size", "n", "most"), "prefix")
    by_component = stage(first.groupBy("s", "component").agg(F.max("size").alias("size"), F.max("most").alias("most"), F.min("n").alias("least"), F.max("n").alias("greatest")), "by_component")
    largest = stage(by_component.groupBy("s").agg(F.count("*").alias("k"), F.max_by("component", F.struct("size", "component")).alias("largest")).where("k > 1").select("s", "largest"), "largest")
    x, z = first.join(largest, "s").where("component <> largest").alias("x"), by_component.alias("z")
    cond = (F.col("x.s") == F.col("z.s")) & (F.col("x.component") != F.col("z.component")) & ((F.col("z.component") == F.col("x.largest")) | (F.col("x.component") < F.col("z.component")))
    cond &= (F.col("x.n") * 100 >= F.col("z.least") * THRESHOLD) & (F.col("z.greatest") * 100 >= F.col("x.n") * THRESHOLD)
    cond &= _reaches(F.least("x.most", "z.most"), F.col("x.n") + F.col("z.least"))
    tests = stage(x.join(z, cond).select("x.node", F.col("z.component").alias("other")).distinct(), "tests")
    parts = stage(tests.join(sets.select("node", "n"), "node").groupBy("other").agg(F.ceil(F.sum("n") / (4 * CHUNK)).alias("lefts")), "parts")
    chunks = stage(sets.groupBy(F.col("component").alias("other")).agg(F.ceil(F.sum("n") / CHUNK).alias("chunks")), "chunks")
    dealt = lambda of, n: F.pmod(F.xxhash64(of), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    both = parts.join(chunks, "other")
    rights = sets.join(both, sets["component"] == both["other"]).withColumn("chunk", dealt("node", F.col("chunks"))).withColumn("left", every("lefts"))
    lefts = tests.join(both, "other").withColumn("left", dealt("node", F.col("lefts"))).join(sets.select("node", "set"), "node").withColumn("chunk", every("chunks"))
    sides = rights.select("other", "chunk", "left", F.lit(False).alias("asks"), "node", "set").union(lefts.select("other", "chunk", "left", F.lit(True).alias("asks"), "node", "set"))
    return by_group(sides, ["other", "chunk", "left"], _tested, "a long, b long", 500)


def _tested(found: pa.Table) -> Iterator[pa.RecordBatch]:
    """For each asking set, the best link to one of its group's other sets, if there is any."""
    keys = np.stack([np.asarray(found.column(c)) for c in ("other", "chunk", "left")])
    edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))
    nodes, asks, packed = np.asarray(found.column("node")), np.asarray(found.column("asks")), found.column("set").to_pylist()
    a, b = [], []
    for begin, end in zip(edges[:-1], edges[1:]):
        held = [i for i in range(begin, end) if not asks[i]]
        asking = [i for i in range(begin, end) if asks[i]]
        if not held or not asking:
            continue
        sets = [np.frombuffer(packed[i], np.uint64) for i in held]
        sizes = np.array([len(x) for x in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
        for i in asking:
            own = np.frombuffer(packed[i], np.uint64)
            lo, hi = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
            lens = hi - lo
            at = np.repeat(lo - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            good = np.flatnonzero(100 * both >= THRESHOLD * (len(own) + sizes - both))
            if len(good):
                a.append(int(nodes[i]))
                b.append(int(nodes[held[good[np.argmax(both[good])]]]))
    yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _reaches(overlap: Column, sizes: Column) -> Column:
    """Whether an overlap of sets with these sizes in all is enough: 100 o >= THRESHOLD (sizes - o)."""
    return overlap * (100 + THRESHOLD) >= sizes * THRESHOLD


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: `key, n_shingles, component_id, kept`, with `h` (xxhash64 of the text).

    `component_id` is the smallest key reachable over links, itself included, and `kept` says that the row's key
    is that. A null, empty or blank text has no shingles and is linked with nothing; a text of fewer than five
    words is one shingle. Rows with equal shingle sets are linked, repeated rows among them; rows that share a key
    but not their texts each have the component of their own text. A null key is never the smallest one unless no
    other is there. Texts are taken whole, however long. An empty table gives no rows. Other columns are not read.
    """
    rows = stage(signatures(docs, key, text), "signatures")
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    one_of = rows.where("n_shingles > 0").groupBy("n_shingles", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("h", "doc_id"), F.min("h")).alias("h"), F.first("bands").alias("bands"))
    nodes = stage(one_of.withColumn("node", F.monotonically_increasing_id()), "nodes")
    return _linked(rows, nodes, texts, key)


def _crossing(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs (a, b) whose ends are in different components."""
    ends = _labelled(pairs.withColumnRenamed("a", "node"), found).select(F.col("node").alias("a"), "b", F.col("component").alias("ca"))
    ends = _labelled(ends.withColumnRenamed("b", "node"), found).select("a", F.col("node").alias("b"), "ca", "component")
    return ends.where("ca <> component").select("a", "b")


def _linked(rows: DataFrame, nodes: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    banded = nodes.select("node", F.col("n_shingles").cast("int").alias("n_shingles"), F.explode("bands").alias("band"))
    held = stage(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "held")
    shared = stage(banded.join(held, "band"), "shared")  # bands that hold two nodes or more
    # a node that shares its bands with many others is likely to be what they were copied from
    degree = stage(shared.groupBy("node").agg(F.sum("n").alias("degree")), "degree")
    central = F.max_by("node", F.struct("degree", F.negate("node")))
    centre = stage(shared.join(degree, "node").groupBy("band").agg(central.alias("c")), "centre")
    stars = stage(shared.join(centre, "band").where("node <> c").groupBy(F.col("node").alias("a"), F.col("c").alias("b")).agg(F.count("*").alias("n")), "stars")
    best = stage(stars.groupBy("a").agg(F.max_by("b", F.struct("n", F.negate("b"))).alias("b")), "best")
    found = stage(components(stage(confirm(best, nodes, texts), "links")), "components")
    others = _crossing(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), found)
    within = stage(_labelled(shared.select("band", "node", "n_shingles", "n"), found), "within")
    mixed = within.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    left = stage(within.join(stage(mixed, "mixed"), "band"), "left")
    x, y = left.where(F.col("n") <= PAIRWISE).alias("x"), left.where(F.col("n") <= PAIRWISE).alias("y")
    cond = (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))
    cond &= (F.col("x.n_shingles") * 100 >= F.col("y.n_shingles") * THRESHOLD) & (F.col("y.n_shingles") * 100 >= F.col("x.n_shingles") * THRESHOLD)
    pairs = others.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(x.join(y, cond).select(F.col("x.node"), F.col("y.node"))).distinct()
    tried = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = confirm(stage(pairs.join(tried, ["a", "b"], "left_anti"), "pairs"), nodes, texts)
    crowd = stage(left.where(F.col("n") > PAIRWISE).groupBy("node").agg(F.min("component").alias("component")), "crowd")
    links = stage(links.union(crowd_links(crowd, nodes, texts)) if crowd.take(1) else links, "more")
    if links.take(1):
        # each node's edge to its component stands for all links that were there
        found = stage(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links)), "components")
    grouped = _labelled(nodes.select("node", "rep", "n_shingles", "k1", "k2"), found)
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_set = stage(grouped.join(smallest, "component").select("n_shingles", "k1", "k2", "component_id"), "of_set")
    placed = rows.select("doc_id", "h", "n_shingles", "k1", "k2").join(of_set, ["n_shingles", "k1", "k2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return placed.select(F.col("doc_id").alias(key), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "h")
