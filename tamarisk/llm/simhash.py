"""SimHash near-duplicates by pigeonring filtering.

A fingerprint's 64 bits lie in a ring of four segments of 16. Where two fingerprints differ in at most 3 bits, some
segment begins a chain in which the differences so far stay within their share: none in the first, at most 1 in the
first two, 2 in the first three and 3 in all. Equal first segments and at most one difference in the second are a
key that two fingerprints share: each one stands under its own first two segments, and also under those in which one
zero bit of the second is set, for each of the four beginnings. Fingerprints under one key are held against one another
with the rest of the chain, then in full.

Fingerprints that meet under one key give a spanning forest of their links and no pairs, so that a large group of near
copies costs rows in proportion to its size. Keys that more than CROWD fingerprints share are drawn out over the
third segment, with all differences that its budget leaves; 65,536 fingerprints at most share 48 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm._common import bound_batches, by_group, slices, stage
from tamarisk.llm.neardup import components

#: Words of a shingle, bits in which linked fingerprints differ at most, and the seed of the shingles' hashes.
SHINGLE, DISTANCE, SEED = 3, 3, 42
SEGMENTS, WIDTH = 4, 16
#: Differences that a chain of so many segments may have.
BUDGET = [n * DISTANCE // SEGMENTS for n in range(SEGMENTS + 1)]
#: Fingerprints of one key that a task holds against one another.
CROWD = 1 << 14
#: Shingles of one text that are hashed at once.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Each bit is set where over half of the hashes of the text's shingles, repeats included, have it; 0 without words."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    begins, ends = begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(begins), CHUNK):
        found = np.array([digest(joined[b:e], SEED) for b, e in zip(begins[at : at + CHUNK], ends[at : at + CHUNK])], "<u8")
        counts += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(begins), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of each row's text, as a signed long."""
    bound_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "fp": pa.array(found.view(np.int64))})

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key {docs.schema[key].dataType.simpleString()}, fp long")


def _turned(fp: np.ndarray, start: int) -> np.ndarray:
    """Fingerprints turned so that segment `start` is the highest."""
    by = np.uint64(start * WIDTH)
    return fp if start == 0 else (fp << by) | (fp >> (np.uint64(64) - by))


def _within(x: np.ndarray, y: np.ndarray | np.uint64) -> np.ndarray:
    """Places where the turned x and y stay within budget over two segments, three, and all."""
    differ = x ^ y
    at = np.arange(len(differ))
    for n in range(2, SEGMENTS + 1):
        fits = np.bitwise_count(differ[at] >> np.uint64(64 - n * WIDTH)) <= BUDGET[n]
        at = at[fits]
    return at


def _forest(fp: np.ndarray) -> tuple[list[int], list[int]]:
    """Indexes (a, b) of links that join what all links between these turned fingerprints would."""
    a, b = [], []
    left = np.arange(len(fp))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            one = front.pop()
            near = _within(fp[left], fp[one])
            if len(near):
                found = left[near]
                a += [one] * len(found)
                b += found.tolist()
                front += found.tolist()
                left = np.delete(left, near)
    return a, b


def _linked(found: pa.Table) -> Iterator[pa.RecordBatch]:
    """Of whole groups (start, at), links between their fingerprints."""
    start, at = np.asarray(found.column("start")), np.asarray(found.column("at"))
    fp = np.asarray(found.column("fp")).view(np.uint64)
    edges = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1]) | (at[1:] != at[:-1]), [True]]))
    pairs_a, pairs_b = [], []
    sizes = np.diff(edges)
    for begin, n in zip(edges[:-1][sizes > 1], sizes[sizes > 1]):
        own = fp[begin : begin + n]
        turned = _turned(own, int(start[begin]))
        if n == 2:
            if len(_within(turned[:1], turned[1])):
                pairs_a.append(own[:1])
                pairs_b.append(own[1:])
            continue
        a, b = _forest(turned)
        pairs_a.append(own[a])
        pairs_b.append(own[b])
    empty = [np.zeros(0, np.uint64)]
    yield pa.RecordBatch.from_pydict({"a": pa.array(np.concatenate(pairs_a or empty).view(np.int64)), "b": pa.array(np.concatenate(pairs_b or empty).view(np.int64))})


def _flips(most: int) -> list[int]:
    """Segment patterns with at most so many bits set, by that number."""
    return [sum(1 << b for b in bits) for k in range(most + 1) for bits in combinations(range(WIDTH), k)]


def _keyed(fps: DataFrame) -> DataFrame:
    """(start, at, fp): for each beginning, the 32 bits of two segments, and those with one more bit set in the second.

    Of two second segments that differ in one bit, one lacks that bit, so setting bits is enough for them to meet.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array(_flips(1), np.uint64)
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            for start in range(SEGMENTS):
                two = _turned(fp, start) >> np.uint64(64 - 2 * WIDTH)
                row, flip = np.nonzero((two[:, None] & flips[None, :]) == 0)
                at = two[row] | flips[flip]
                yield pa.RecordBatch.from_pydict({"start": pa.array(np.full(len(row), start, np.int32)), "at": pa.array(at.astype(np.int64)), "fp": pa.array(fp[row].view(np.int64))})

    return fps.mapInArrow(work, "start int, at long, fp long")


def _drawn_out(crowded: DataFrame) -> DataFrame:
    """(start, at, fp) of crowded keys: the 32 bits are followed by a third segment, with all it may differ by."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array(_flips(BUDGET[3]), np.uint64)
        left = BUDGET[3] - np.bitwise_count(flips)  # differences that the second segment may still have
        for batch in batches:
            starts, ats, fps = (np.asarray(batch.column(c)) for c in ("start", "at", "fp"))
            for begin in range(0, batch.num_rows, 4096):
                start, at, fp = (x[begin : begin + 4096] for x in (starts, ats, fps))
                turned = np.choose(start, [_turned(fp.view(np.uint64), s) for s in range(SEGMENTS)])
                own, third = at.view(np.uint64), (turned >> np.uint64(64 - 3 * WIDTH)) & np.uint64((1 << WIDTH) - 1)
                used = np.bitwise_count((turned >> np.uint64(64 - 2 * WIDTH)) ^ own)
                row, flip = np.nonzero(used[:, None] <= left[None, :])
                key = (own[row] << np.uint64(WIDTH)) | (third[row] ^ flips[flip])
                yield pa.RecordBatch.from_pydict({"start": pa.array(start[row]), "at": pa.array(key.view(np.int64)), "fp": pa.array(fp[row])})

    return crowded.mapInArrow(work, "start int, at long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that join what all links would."""
    bound_batches(fps.sparkSession)
    keyed = stage(_keyed(fps), "keyed")
    crowds = stage(keyed.groupBy("start", "at").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("start", "at"), "crowds")
    if not crowds.take(1):
        return by_group(keyed, ["start", "at"], _linked, "a long, b long", 20_000)
    # few keys can be crowded: each has over CROWD of the rows
    found = by_group(keyed.join(crowds, ["start", "at"], "left_anti"), ["start", "at"], _linked, "a long, b long", 20_000)
    return found.union(by_group(_drawn_out(keyed.join(crowds, ["start", "at"], "left_semi")), ["start", "at"], _linked, "a long, b long", 20_000))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: `key, fp, component_id`; fp is the 64-bit fingerprint as a signed long.

    `component_id` is the smallest key reachable over links, itself included. Null, empty and blank texts have the
    fingerprint zero and are linked like any other. Rows that share a key but not their texts each have the component
    of their own text; repeated rows come out alike. A null key is never the smallest one unless no other is there.
    Texts are taken whole. An empty table gives no rows. Other columns are not read.
    """
    rows = stage(fingerprints(docs, key, text), "fingerprints")
    least = stage(rows.groupBy("fp").agg(F.min("key").alias("least")), "least")
    found = components(stage(links(least.select("fp")).distinct(), "links"))
    found = stage(found.select(F.col("node").alias("fp"), "component"), "components")
    # a component is one key, and may hold a third of all: minima are formed in each task before the shuffle, and
    # labels come back by a join that adaptive execution may split
    joined = found.join(least, "fp")
    own = joined.groupBy("component").agg(F.min("least").alias("m")).join(least.select(F.col("fp").alias("component"), "least"), "component")
    smallest = own.select("component", F.least("m", "least").alias("component_id"))
    of_fp = least.join(found, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least")
    of_fp = stage(of_fp.join(smallest, "component", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "of_fp")
    return rows.join(of_fp, "fp").select(F.col("key").alias(key), "fp", F.coalesce("component_id", "key").alias("component_id"))


def hexadecimal(fp: F.Column) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
