"""Substring dedup: prefix-partitioned suffix trees over words.

A suffix is the rest of a document from one word on. Suffixes are dealt out by a prefix into groups that fit a
task's memory. A group's tree is its sorted suffixes with the common-prefix lengths of neighbours; its deep internal
nodes, those of WINDOW words or more, are the repeats, and consecutive suffixes under deep nodes make up a maximal one.

The trees are sparse: of each WINDOW consecutive words one place is sampled, where the least-hashed PREFIX-word
sequence begins, so equal windows are sampled alike. The prefix of the suffix at that place deals out the windows
around it, as one row of consecutive suffixes, and only rows whose prefix occurs in two different texts leave their
document at all. Prefixes are of variable length: where the rows of a prefix hold more than GROUP_BYTES, their
suffixes are dealt out by WINDOW words of their own. All suffixes of such a group are under one deep node, of which
only the smallest document counts, and Spark sums that up before the shuffle. Exact copies of texts that have a window are
found by digest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm._common import Words, bound_batches, by_group, mix, rolling, slices, split_words, stage

#: Words of a repeat, and of the prefix that suffixes are dealt out by.
WINDOW, PREFIX = 50, 16
#: Bytes of words in the group of one prefix, which a task can make a tree of, and rows that it makes trees of at once (more where a group has more).
GROUP_BYTES, ROWS = 4 << 20, 2000
#: Digests of repeated texts, of some 40 bytes each, that go to every task as a table; more are joined by a shuffle.
DIGESTS = 200_000
#: Steps by which sorted suffixes are compared; their sum is the depth that trees are built to.
STEPS = (32, 32, 16, 8, 4, 2, 1)
#: Rows of repeated windows of hot prefixes up to which they go to the tasks as one table, of 12 MB at most.
TABLE = 500_000
#: Windows of hot prefixes that a task sums up at once.
SUMMED = 1 << 20


def prefixes(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each document the hashes of its PREFIX-word sequences, and for each of its windows the place of the least one (the first of ties)."""
    grams, first = rolling(words.hashes(), PREFIX), words.first
    span = WINDOW - PREFIX + 1
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        own = grams[a : max(a, b - PREFIX + 1)]
        if b - a < WINDOW:
            yield own, np.zeros(0, np.int64)
        else:
            yield own, np.lib.stride_tricks.sliding_window_view(own, span).argmin(axis=1) + np.arange(b - a - WINDOW + 1)


def _index(docs: DataFrame, key_type: str) -> DataFrame:
    """(doc_id, h, digest, n_words, anchors): for each document the prefixes of its windows and their places."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = split_words(batch.column("text"))
            first = words.first
            found, at, sizes, lens = [], [], [], []
            for a, (grams, least) in zip(first[:-1].tolist(), prefixes(words)):
                places = np.unique(least)
                lo, hi = np.searchsorted(least, places, "left"), np.searchsorted(least, places, "right") - 1
                found.append(grams[places])
                at.append(places)
                sizes.append(words.ends[a + hi + WINDOW - 1] - words.starts[a + lo])
                lens.append(len(places))
            offsets = pa.array(np.cumsum([0, *lens]), pa.int32())
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(sizes).astype(np.int32))], ["prefix", "at", "size"])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "digest": batch.column("digest"), "n_words": pa.array(np.diff(first)), "anchors": pa.ListArray.from_arrays(offsets, pairs)})

    return docs.mapInArrow(work, f"doc_id {key_type}, h long, digest binary, n_words long, anchors array<struct<prefix:long,at:int,size:int>>")


def _with_words(docs: DataFrame, key_type: str) -> DataFrame:
    """Texts as words joined by one space."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            joined = [b" ".join((t or b"").split()).decode() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            counts = np.diff(split_words(batch.column("text")).first)
            arrays = {n: batch.column(n) for n in ("doc_id", "h", "copy", "hot", "cold")}
            yield pa.RecordBatch.from_pydict(arrays | {"n_words": pa.array(counts), "words": pa.array(joined, pa.string())})

    return docs.mapInArrow(work, f"doc_id {key_type}, h long, copy boolean, hot array<int>, cold array<int>, n_words long, words string")


def _runs(least: np.ndarray, wanted: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, first window, last window) of each wanted place; the windows of a place are consecutive."""
    lo, hi = np.searchsorted(least, wanted, "left"), np.searchsorted(least, wanted, "right") - 1
    return [(int(p), int(a), int(b)) for p, a, b in zip(wanted, lo, hi) if a <= b]


def _occurrences(cut: DataFrame, key_type: str) -> DataFrame:
    """(prefix, doc_id, h, begin, n, words): around each place of a cold prefix, the words of the n windows that it deals out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            words = split_words(batch.column("words"))
            rows: list[tuple] = []
            ids, hs = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            for i, (places, (grams, least)) in enumerate(zip(batch.column("cold").to_pylist(), prefixes(words))):
                a = int(words.first[i])
                for p, lo, hi in _runs(least, np.unique(np.array(places, np.int64))):
                    piece = words.data[words.starts[a + lo] : words.ends[a + hi + WINDOW - 1]].tobytes()
                    rows.append((int(grams[p].view(np.int64)), ids[i], hs[i], lo, hi - lo + 1, piece))
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_pydict({"prefix": pa.array(columns[0], pa.int64()), "doc_id": pa.array(columns[1], batch.column("doc_id").type), "h": pa.array(columns[2], pa.int64()), "begin": pa.array(columns[3], pa.int32()), "n": pa.array(columns[4], pa.int32()), "words": pa.array(columns[5], pa.binary())})

    return cut.where(F.size("cold") > 0).mapInArrow(work, f"prefix long, doc_id {key_type}, h long, begin int, n int, words binary")


def ranks(hashes: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
    """For k = 1, 2, 4 ... 32 the rank of the k words from each place on; what lies beyond a row's end (`ends` by place) ranks lowest."""
    at = np.arange(len(hashes))
    found = {1: np.unique(hashes, return_inverse=True)[1].astype(np.int64) + 1}
    k = 1
    while k < max(STEPS):
        own, ahead = found[k], np.zeros(len(hashes), np.int64)
        inside = at + k < ends
        ahead[inside] = own[at[inside] + k]
        found[2 * k] = np.unique(own * (len(hashes) + 1) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        k *= 2
    return found


def suffix_tree(hashes: np.ndarray, ends: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at `starts` in order within their groups, and each one's common prefix with the one before it, in words.

    The second is 0 at a group's first suffix. An internal node of depth d is a longest run of suffixes whose common
    prefixes with the ones before them are d or more, all but the first. Depths stop at the sum of STEPS.
    """
    rank = ranks(hashes, ends)
    widest = max(STEPS)
    further = np.where(starts + widest < ends[starts], rank[widest][np.minimum(starts + widest, len(hashes) - 1)], 0)
    order = np.lexsort((starts, further, rank[widest][starts], groups))
    x, y = starts[order][:-1], starts[order][1:]
    common = np.zeros(len(x), np.int64)
    for k in STEPS:
        i, j = x + common, y + common
        inside = (i + k <= ends[x]) & (j + k <= ends[y])
        same = inside.copy()
        same[inside] = rank[k][i[inside]] == rank[k][j[inside]]
        common += np.where(same, k, 0)
    common[groups[order][1:] != groups[order][:-1]] = 0
    return order, np.concatenate([np.zeros(min(1, len(order)), np.int64), common])


def deep_suffixes(docs: np.ndarray, order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which suffixes are under a node of WINDOW words or more that a smaller document starts in too."""
    begins = np.flatnonzero(common < WINDOW)
    least = np.minimum.reduceat(docs[order], begins)
    gone = np.zeros(len(order), bool)
    gone[order] = docs[order] > np.repeat(least, np.diff(np.concatenate([begins, [len(order)]])))
    return gone


def _subtrees(occurrences: DataFrame, key_type: str) -> DataFrame:
    """(doc_id, h, starts): windows to remove, found tree by tree; a tree's rows hold GROUP_BYTES at most."""

    def f(found: pa.Table) -> Iterator[pa.RecordBatch]:
        one = {c: found.column(c).combine_chunks() if isinstance(found.column(c), pa.ChunkedArray) else found.column(c) for c in found.column_names}
        words = split_words(one["words"])
        if not len(words.starts):
            return
        n, prefix = np.asarray(one["n"]).astype(np.int64), np.asarray(one["prefix"])
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        ends = np.repeat(words.first[1:], np.diff(words.first))
        group = np.cumsum(np.concatenate([[0], prefix[1:] != prefix[:-1]]))[row]
        coded = pd.factorize(one["doc_id"].to_pandas(), sort=True)[0]
        order, common = suffix_tree(words.hashes(), ends, words.first[:-1][row] + within, group)
        gone = np.flatnonzero(deep_suffixes(coded[row], order, common))
        if len(gone):
            of, begins = np.unique(row[gone], return_index=True)
            starts = (np.asarray(one["begin"])[row[gone]] + within[gone]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([begins, [len(gone)]]), pa.int32()), pa.array(starts))
            yield pa.RecordBatch.from_pydict({"doc_id": one["doc_id"].take(pa.array(of)), "h": one["h"].take(pa.array(of)), "starts": lists})

    return by_group(occurrences, ["prefix"], f, f"doc_id {key_type}, h long, starts array<int>", ROWS)


def _hot_windows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, places, two hashes) of the windows that hot prefixes deal out, for each row with any."""
    words = split_words(batch.column("words"))
    hashes = words.hashes()
    one, two = rolling(hashes, WINDOW), rolling(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), WINDOW)
    for i, (places, (_, least)) in enumerate(zip(batch.column("hot").to_pylist(), prefixes(words))):
        at = np.flatnonzero(np.isin(least, np.array(places, np.int64)))
        if len(at):
            yield i, at, one[words.first[i] + at], two[words.first[i] + at]


def _summed(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """(w1, w2, least, greatest), each pair of hashes once."""
    w1, w2, least, greatest = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((w2, w1))
    w1, w2 = w1[order], w2[order]
    begins = np.flatnonzero(np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])) if len(w1) else np.zeros(0, np.int64)
    if not len(begins):
        return w1, w2, least, greatest
    return w1[begins], w2[begins], np.minimum.reduceat(least[order], begins), np.maximum.reduceat(greatest[order], begins)


def _ends_batch(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array(x) for name, x in zip(("w1", "w2", "least", "greatest"), found)})


def _leaves(cut: DataFrame, key_type: str) -> DataFrame:
    """(doc_id, h, starts): windows to remove among those of hot prefixes, which are told apart by all their words.

    The windows that come more than once go to the tasks as a table where they are counted to be few, and are joined else.
    """

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words"):
            found = list(_hot_windows(batch))
            if found:
                rows = pa.array(np.concatenate([np.full(len(at), i) for i, at, _, _ in found]))
                one, two = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (2, 3))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(rows), "h": batch.column("h").take(rows), "w1": pa.array(one), "w2": pa.array(two), "start": pa.array(np.concatenate([f[1] for f in found]).astype(np.int32))})

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each window once for every SUMMED of them, with its smallest and greatest document."""
        held: list[tuple] = []
        n = 0
        for batch in windows(batches):
            known = batch.filter(batch.column("doc_id").is_valid())
            ids = np.asarray(known.column("doc_id"))
            held.append((np.asarray(known.column("w1")), np.asarray(known.column("w2")), ids, ids))
            n += len(ids)
            if n > SUMMED:
                held = [_summed(held)]
                n = len(held[0][0])
                if n > SUMMED // 2:
                    yield _ends_batch(held.pop())
                    n = 0
        if held:
            yield _ends_batch(_summed(held))

    hot = cut.where(F.size("hot") > 0).select("doc_id", "h", "hot", "words")
    each = hot.mapInArrow(windows, f"doc_id {key_type}, h long, w1 long, w2 long, start int")
    first_last = hot.mapInArrow(ends, "w1 long, w2 long, least long, greatest long") if key_type == "bigint" else each.select("w1", "w2", F.col("doc_id").alias("least"), F.col("doc_id").alias("greatest"))
    least = stage(first_last.groupBy("w1", "w2").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest")).where("least < greatest").select("w1", "w2", "least"), "least")
    if key_type != "bigint" or least.count() > TABLE or least.groupBy("w1").count().where("count > 1").take(1):
        met = each.join(least, ["w1", "w2"]).where("doc_id > least")
        return met.groupBy("doc_id", "h").agg(F.collect_list("start").alias("starts"))
    rows = least.orderBy("w1").toPandas()  # TABLE rows at most
    shipped = cut.sparkSession.sparkContext.broadcast(tuple(rows[c].to_numpy(np.int64) for c in ("w1", "w2", "least")))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w1, w2, first = shipped.value
        for batch in slices(batches, "words"):
            ids = batch.column("doc_id").to_pylist()
            out = []
            for i, at, one, two in _hot_windows(batch):
                place = np.minimum(np.searchsorted(w1, one.view(np.int64)), len(w1) - 1)
                gone = (w1[place] == one.view(np.int64)) & (w2[place] == two.view(np.int64)) & (first[place] < ids[i])
                if gone.any():
                    out.append((i, at[gone].astype(np.int32)))
            if out:
                rows = pa.array([i for i, _ in out])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(rows), "h": batch.column("h").take(rows), "starts": pa.array([x for _, x in out], pa.list_(pa.int32()))})

    schema = f"doc_id {key_type}, h long, starts array<int>"
    return hot.mapInArrow(marked, schema) if len(rows) else cut.sparkSession.createDataFrame([], schema)


def _without(rows: DataFrame, key_type: str) -> DataFrame:
    """Rows (doc_id, n_words, words, copy, starts) as (doc_id, n_words, n_removed, spans, kept_text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for n, text, copy, starts in zip(*(batch.column(c).to_pylist() for c in ("n_words", "words", "copy", "starts"))):
                if copy:
                    starts = range(n - WINDOW + 1) if n >= WINDOW else ()
                gone = np.zeros(n + 1, np.int32)
                begins = np.unique(np.fromiter(starts, np.int64))
                np.add.at(gone, begins, 1)
                np.add.at(gone, begins + WINDOW, -1)
                covered = np.cumsum(gone)[:n] > 0
                words = text.split(" ") if n else []
                edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                removed.append(int(covered.sum()))
                spans.append([{"begin": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                kept.append(" ".join(w for w, c in zip(words, covered) if not c))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), "kept_text": pa.array(kept, pa.string())})

    return rows.select("doc_id", "n_words", "words", "copy", "starts").mapInArrow(work, f"doc_id {key_type}, n_words long, n_removed long, spans array<struct<begin:int,end:int>>, kept_text string")


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: `key, n_words, n_removed, spans, kept_text`.

    A word goes if it lies in WINDOW consecutive words that also start in a document with a smaller key; spans are
    ranges of word places, and kept words are joined by one space. All windows are judged on the input. Null,
    empty and blank texts have no words. Rows with a null key are left whole, and no other row loses words to
    them. Rows that share a key don't count as smaller than each other; repeated rows come out alike. An empty
    table gives no rows. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    index = stage(_index(source.select("doc_id", "h", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"), "text"), kind), "index")
    # short texts, null and empty ones among them, have no window and so no copies
    long = index.where(F.col("n_words") >= WINDOW).select("doc_id", "h", "digest")
    first = stage(long.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "first")
    first = F.broadcast(first) if first.count() <= DIGESTS else first
    copies = stage(long.join(first, "digest", "left").select("doc_id", "h", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")), "copies")
    anchors = index.select("doc_id", "h", F.explode("anchors").alias("a")).select("doc_id", "h", "a.prefix", "a.at", "a.size")
    repeated = stage(anchors.groupBy("prefix").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.sum("size").alias("bytes")).where("lo < hi").select("prefix", (F.col("bytes") > GROUP_BYTES).alias("is_hot")), "repeated")
    places = anchors.join(repeated, "prefix").groupBy("doc_id", "h").agg(F.collect_set(F.when(F.col("is_hot"), F.col("at"))).alias("hot"), F.collect_set(F.when(~F.col("is_hot"), F.col("at"))).alias("cold"))
    originals = copies.groupBy("doc_id", "h").agg(F.max("copy").alias("copy"))
    none = F.array().cast("array<int>")
    told = originals.join(places, ["doc_id", "h"], "left").select("doc_id", "h", "copy", F.when(F.col("copy") | F.col("hot").isNull(), none).otherwise(F.col("hot")).alias("hot"), F.when(F.col("copy") | F.col("cold").isNull(), none).otherwise(F.col("cold")).alias("cold"))
    told = stage(told.where(F.col("copy") | (F.size("hot") > 0) | (F.size("cold") > 0)), "told")
    joined = source.join(told, ["doc_id", "h"], "left").select("doc_id", "h", "text", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("hot", none).alias("hot"), F.coalesce("cold", none).alias("cold"))
    cut = stage(_with_words(joined, kind), "cut")
    gone = _subtrees(_occurrences(cut, kind), kind).unionByName(_leaves(cut, kind))
    gone = stage(gone.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("starts")).alias("starts")), "gone")
    touched = F.col("copy") | (F.size("hot") > 0) | (F.size("cold") > 0)
    rest = cut.where(~touched).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"), F.col("words").alias("kept_text"))
    changed = cut.where(touched).join(gone, ["doc_id", "h"], "left").withColumn("starts", F.coalesce("starts", none))
    return rest.unionByName(_without(changed, kind)).withColumnRenamed("doc_id", key)
