"""Shared helpers: staged tables, Arrow batch bounds and a vectorised byte tokenizer."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; bounds what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Bytes of text that one numpy step works on, cut at document ends.
SLICE_BYTES = 1 << 18


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches to Python workers stay small whatever the rows' width."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on local masters a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tamarisk-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.staged_path = path
    return found


def drop_staged(df: DataFrame) -> None:
    """Deletes a table that stage() wrote, where no later job reads it."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(conf).delete(path.getParent(), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: str) -> list:
    """Columns that tell rows with one doc_id and different texts apart: length and hash of the text."""
    return [F.xxhash64(*cols).alias("_h"), F.octet_length(cols[0]).alias("_n")]


def is_word(separators: bytes) -> np.ndarray:
    """256 flags: False for the separator bytes."""
    flags = np.ones(256, bool)
    flags[list(separators)] = False
    return flags


#: Word bytes of `[^\x20\x09-\x0D]+`.
SPACED = is_word(bytes([0x20, *range(0x09, 0x0E)]))
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64, so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        base = np.uint64(_BASE if which == "up" else _INVERSE)
        have = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, SLICE_BYTES + 1), base, np.uint64))])
        _powers[which] = have
    return have[:n]


class Words(NamedTuple):
    """Words of a slice of texts: bytes, byte ranges, the text each is in, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[self.data] * powers("up", n), out=sums[1:])
        found = (sums[self.ends] - sums[self.starts]) * powers("down", n + 1)[self.starts]
        return mix(found + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array, without copy, and its offsets from 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()[:3]
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def split_words(texts: pa.Array, flags: np.ndarray = SPACED, lower: bool = False) -> Words:
    """All words of all texts; null texts have none. No word crosses from one text into the next."""
    data, at = text_bytes(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = flags[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    heads = at[:-1][at[:-1] < n]
    before[heads] = False
    after[heads[heads > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, at)
    return Words(data, starts, ends, np.repeat(np.arange(len(at) - 1), np.diff(first)), first)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut to about SLICE_BYTES of text each; a longer text is a slice of its own."""
    for batch in batches:
        sizes = text_bytes(batch.column(text))[1]
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(sizes, sizes[begin] + SLICE_BYTES, side="right")) - 1
            end = max(begin + 1, end)
            yield batch.slice(begin, end - begin)
            begin = end


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words, in order, from the words' own hashes; in two passes whatever k is."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers("up", len(hashes)), out=sums[1:])
    return mix((sums[k:] - sums[:n]) * powers("down", n))


def by_group(df: DataFrame, key: list[str], f: Callable, schema: str, at_least: int = 1) -> DataFrame:
    """f over Arrow tables of whole groups, each table of `at_least` rows where there are as many; groups lie side by side."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < max(2, at_least):
                continue
            whole = pa.Table.from_batches(held)
            keys = [np.asarray(whole.column(k)) for k in key]
            last = np.ones(n, bool)
            for k in keys:
                last &= k == k[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield from f(whole.slice(0, cut).combine_chunks())
                held = whole.slice(cut).to_batches()
                n -= cut
        if n:
            yield from f(pa.Table.from_batches(held).combine_chunks())
        held = []
        pa.default_memory_pool().release_unused()  # the worker lives on beside those of other stages

    return df.repartition(*key).sortWithinPartitions(*key).mapInArrow(work, schema)
