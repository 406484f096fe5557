"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of whole texts are made in numpy over Arrow batches. Random Fourier features approximate a Gaussian
kernel over the standardised statistics; each partition sums its part of the normal equations, Spark adds the
parts cell by cell, and the driver solves one system of fixed size. Scores of a held-back part of the labelled
rows are binned, and pooled adjacent violators turn them into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk.llm._common import LOWER, SPACED, bound_batches, mix, slices, split_words, stage, text_bytes

#: Random features, kernel width (1 / (2 sigma^2) a statistic), ridge penalty a row, seed.
FEATURES, GAMMA, RIDGE, SEED = 192, 0.5, 1e-4, 7
#: One training row in so many is held back to calibrate on; bins of that fit.
CALIBRATE_ONE_IN, BINS = 4, 2000
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "short_words", "upper", "digit", "space", "newline", "punct", "stops",
    "other_symbol", "high_bytes", "word_end_symbol", "distinct_words", "top_word", "distinct_lines", "line_len", "cap_words", "lone_symbols",
    "symbol_runs", "sentence_len", "end_stop", "distinct_bigrams", "word_entropy",
)


def _members(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


_KINDS = {"upper": _members(bytes(range(65, 91))), "digit": _members(b"0123456789"), "space": ~SPACED, "newline": _members(b"\n"), "punct": _members(b",;:'\"()-"), "stops": _members(b".!?"), "other_symbol": _members(b"#$%&*+/<=>@[\\]^_`{|}~"), "high_bytes": np.arange(256) > 127}
_LETTER = _members(bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; a null or empty text has zeros (logs of 1) in all."""
    words = split_words(texts)
    data, first, n_docs = words.data, words.first, len(words.first) - 1
    at = text_bytes(texts)[1]
    n_bytes, n_words = np.diff(at).astype(float), np.diff(first).astype(float)
    per_byte, per_word = np.maximum(n_bytes, 1), np.maximum(n_words, 1)

    def by_range(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return sums[edges[1:]] - sums[edges[:-1]]

    out = {"log_bytes": np.log1p(n_bytes), "log_words": np.log1p(n_words)}
    lens = (words.ends - words.starts).astype(float)
    out["mean_word"] = by_range(lens, first) / per_word
    out["sd_word"] = np.sqrt(np.maximum(0, by_range(lens**2, first) / per_word - out["mean_word"] ** 2))
    out["long_words"], out["short_words"] = by_range(lens > 20, first) / per_word, by_range(lens < 3, first) / per_word
    for name, flags in _KINDS.items():
        out[name] = by_range(flags[data], at) / per_byte
    last, head = data[words.ends - 1], data[words.starts]
    out["word_end_symbol"] = by_range(_KINDS["other_symbol"][last], first) / per_word
    out["cap_words"] = by_range(_KINDS["upper"][head], first) / per_word
    out["lone_symbols"] = by_range((lens == 1) & ~_LETTER[head], first) / per_word
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & ~_LETTER[data[1:]] & SPACED[data[1:]]
    out["symbol_runs"] = by_range(same, at) / per_byte
    ends_sentence = _KINDS["stops"][last]
    out["sentence_len"] = np.log1p(n_words / np.maximum(1, by_range(ends_sentence, first)))
    has = n_words > 0
    out["end_stop"] = np.zeros(n_docs)
    out["end_stop"][has] = ends_sentence[first[1:][has] - 1]
    hashes = split_words_hash(words)
    doc = words.doc.astype(np.uint64)

    def distinct(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of distinct keys, largest count and sum of c log c, for each document."""
        order = np.sort(mix(keys + owners * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFF) | owners << np.uint64(40))
        begins = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, int)
        counts = np.diff(np.concatenate([begins, [len(order)]])).astype(float)
        of = (order[begins] >> np.uint64(40)).astype(int)
        top = np.zeros(n_docs)
        np.maximum.at(top, of, counts)
        return np.bincount(of, minlength=n_docs).astype(float), top, np.bincount(of, weights=counts * np.log(counts), minlength=n_docs)

    n_distinct, top, clogc = distinct(hashes, doc)
    out["distinct_words"], out["top_word"] = n_distinct / per_word, top / per_word
    out["word_entropy"] = np.where(has, np.log(per_word) - clogc / per_word, 0)
    pairs = hashes[:-1] * np.uint64(3) + hashes[1:] if len(hashes) else hashes
    inside = doc[:-1] == doc[1:]
    n_pairs = np.maximum(1, n_words - 1)
    out["distinct_bigrams"] = distinct(mix(pairs[inside]), doc[:-1][inside])[0] / n_pairs
    lines = split_words(texts, ~_KINDS["newline"])
    n_lines = np.maximum(1, np.diff(lines.first).astype(float))
    out["distinct_lines"] = distinct(lines.hashes(), lines.doc.astype(np.uint64))[0] / n_lines
    out["line_len"] = np.log1p(n_bytes / n_lines)
    return np.stack([out[name] for name in STATISTICS], axis=1)


def split_words_hash(words) -> np.ndarray:
    """Hashes of words with A-Z lower-cased."""
    return words._replace(data=LOWER[words.data]).hashes()


def with_statistics(docs: DataFrame, text: str = "text", to: str = "statistics") -> DataFrame:
    """All columns of docs but the text, and its statistics as an array of doubles."""
    bound_batches(docs.sparkSession)
    schema = T.StructType([f for f in docs.schema.fields if f.name not in (text, to)] + [T.StructField(to, T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = statistics(batch.column(text))
            arrays = {n: batch.column(n) for n in batch.schema.names if n not in (text, to)}
            arrays[to] = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * len(STATISTICS), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_pydict(arrays)

    return docs.mapInArrow(work, schema)


class Model:
    """Centre and scale of the statistics, the random features, ridge weights and the calibration curve; all of fixed size."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.centre, self.scale = centre, scale
        self.directions = rng.normal(0, np.sqrt(2 * GAMMA / len(centre) * 2), (len(centre), FEATURES))
        self.phases = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.curve = (np.array([0.0]), np.array([0.5]))

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.centre) / self.scale, -4, 4)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def probability(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.curve), 0, 1)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))


def fit(labelled: DataFrame) -> Model:
    """Fits on rows of (statistics, label 0/1, calibrate boolean).

    Where only one of the two parts has rows, they serve for both fits; with no rows, every score is 0.5.
    """
    n = len(STATISTICS)
    at = [F.element_at("statistics", i + 1) for i in range(n)]
    row = labelled.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(at)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(at)], F.count(F.when(F.col("calibrate"), 1)).alias("back"), F.count("*").alias("all")).first()
    learn, back = (F.lit(True), F.lit(True)) if row["back"] in (0, row["all"]) else (~F.col("calibrate"), F.col("calibrate"))
    centre = np.array([row[f"m{i}"] or 0.0 for i in range(n)])
    scale = np.array([max(row[f"s{i}"] or 0.0, 1e-6) for i in range(n)])
    model = Model(centre, scale)
    size = FEATURES + 2  # the label stands as a last column

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            full = np.hstack([model.features(_matrix(batch.column("statistics"))), np.asarray(batch.column("label"), float)[:, None]])
            total += full.T @ full
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({"cell": pa.array((i * size + j).astype(np.int32)), "value": pa.array(total[i, j])})

    cells = labelled.where(learn).select("statistics", "label").mapInArrow(normal_equations, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    full = np.zeros(size * size)
    full[cells["cell"]] = cells["value"]
    full = full.reshape(size, size)
    full = np.triu(full) + np.triu(full, 1).T
    rows = full[size - 2, size - 2]
    if rows:
        model.weights = np.linalg.solve(full[:-1, :-1] + np.eye(size - 1) * RIDGE * rows, full[:-1, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column("statistics")))
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.floor(np.clip(raw, -1, 2) * BINS / 3).astype(np.int32)), "raw": pa.array(raw), "label": pa.array(np.asarray(batch.column("label"), float))})

    bins = labelled.where(back).select("statistics", "label").mapInArrow(binned, "bin int, raw double, label double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("raw").alias("raw"), F.sum("label").alias("label")).orderBy("bin").toPandas()
    if len(bins):
        model.curve = isotonic(bins["raw"].to_numpy() / bins["n"].to_numpy(), bins["label"].to_numpy(), bins["n"].to_numpy())
    return model


def isotonic(x: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over ascending x; points to interpolate between, with half a case of either kind added."""
    blocks: list[list[float]] = []
    for a, p, n in zip(x, positives, counts):
        blocks.append([a * n, p, n])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.maximum.accumulate(np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks]))


def score(with_stats: DataFrame, model: Model, to: str = "score") -> DataFrame:
    """Adds the calibrated probability of label 1, and drops the statistics. A null or empty text gets its score like any other."""
    shipped = with_stats.sparkSession.sparkContext.broadcast(model)  # fixed size
    schema = T.StructType([f for f in with_stats.schema.fields if f.name not in ("statistics", to)] + [T.StructField(to, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = {n: batch.column(n) for n in batch.schema.names if n not in ("statistics", to)}
            arrays[to] = pa.array(shipped.value.probability(_matrix(batch.column("statistics"))))
            yield pa.RecordBatch.from_pydict(arrays)

    return with_stats.mapInArrow(work, schema)


def score_texts(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """All columns of docs, texts among them, and the score, in one pass."""
    bound_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in docs.schema.fields if f.name != to] + [T.StructField(to, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            arrays = {n: batch.column(n) for n in batch.schema.names if n != to}
            arrays[to] = pa.array(shipped.value.probability(statistics(batch.column(text))))
            yield pa.RecordBatch.from_pydict(arrays)

    return docs.mapInArrow(work, schema)


def labelled_rows(stats: DataFrame, labels: DataFrame, train: F.Column, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """Training rows: statistics of documents with a label of 0 or 1 for which `train` holds; a part is held back to calibrate on.

    Rows without key, statistics or label are left out; a document with two labels counts with both.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("label"))
    back = F.pmod(F.xxhash64(F.col(key), F.lit(SEED)), F.lit(CALIBRATE_ONE_IN)) == 0
    return stats.where(train).join(known, F.col(key) == F.col("_key")).select("statistics", "label", back.alias("calibrate"))


def fit_on(docs: DataFrame, labels: DataFrame, train: F.Column, key: str = "doc_id", text: str = "text") -> Model:
    """A model from the documents with labels for which `train` holds.

    Documents and labels with a null key, and labels other than 0 and 1, take no part; null and empty texts learn
    from their zero statistics; repeated rows count as often as they are there; without any labelled row, and so on
    an empty table, scores are 0.5. Other columns are not read.
    """
    some = labels.where(F.col("quality").isin(0, 1)).select(F.col(key)).distinct()
    stats = with_statistics(docs.select(key, text).where(train).join(some, key, "left_semi"), text)
    return fit(stage(labelled_rows(stats, labels, train, key), "labelled"))


def classify(docs: DataFrame, labels: DataFrame, train: F.Column, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, to: str = "score") -> DataFrame:
    """Scores of all documents by a model that learns from the rows for which `train` holds. `keep`: columns passed through.

    A null or empty text is scored like any other, repeated rows alike, and a row with a null key is scored and not
    learnt from. Long texts are read whole. An empty table gives no rows. For the model see fit_on.
    """
    stats = stage(with_statistics(docs.select(*dict.fromkeys([key, *(keep or []), text]))), "statistics")
    return score(stats, fit(stage(labelled_rows(stats, labels, train, key), "labelled")), to)
