"""Phrase collocation mining with pivot partitioning.

Each n-gram belongs to its rarest word, the pivot. Around each occurrence of a word, the text is rewritten for that
pivot: words rarer than it are blanks and end the fragment, as nothing that spans them is its own. Fragments go to
their pivot's part, equal ones as one row with a count, and are mined there: an n-gram is counted at the first
occurrence of the pivot in it, so each one is counted once, in one part. Parts of common pivots are split, so their
counts are summed once more. Within a task, rows are told apart by 64-bit hashes; between tasks, by their texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.llm._common import Words, bound_batches, by_group, is_word, mix, powers, slices, split_words, stage

#: Bytes that end a piece, and with space and tab those that end a word.
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_WORD, _BREAK = is_word(BREAKS + b"\x20\x09"), ~is_word(BREAKS)
#: Words whose ranks go to every task, commonest first, at 24 bytes each. Rarer words come after all of them, by hash.
RANKED = 1 << 20
#: Occurrences of a pivot for which it has one part.
PART = 1 << 16
#: Parts that each language's phrases are dealt into for the first cut of its best.
BEST_PARTS = 64
#: Distinct rows that a task holds before it sends their counts on.
HELD = 1 << 18


def _hashes(words: Words, langs: np.ndarray) -> np.ndarray:
    return mix(words.hashes() ^ langs[words.doc])


def _lang_hashes(langs: pa.Array) -> np.ndarray:
    """A hash for each value, the same in every task."""
    encoded = langs.dictionary_encode()
    of = split_words(encoded.dictionary, flags=np.ones(256, bool))
    found = np.zeros(len(encoded.dictionary), np.uint64)
    found[of.doc] = of.hashes()
    return mix(found + np.uint64(1))[np.asarray(encoded.indices)]


def _packed(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words one after another, each behind one separator, and where each separator is."""
    lens = words.ends - words.starts + 1
    at = np.concatenate([[0], np.cumsum(lens)])
    source = np.arange(at[-1]) + np.repeat(words.starts - 1 - at[:-1], lens)
    out = words.data[np.maximum(source, 0)] if at[-1] else np.zeros(0, np.uint8)
    out[at[:-1]] = 32
    return out, at


def _strings(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of slices of data."""
    lens = ends - begins
    at = np.concatenate([[0], np.cumsum(lens)])
    return data[np.arange(at[-1]) + np.repeat(begins - at[:-1], lens)], at


def _array(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Counted(NamedTuple):
    """Distinct rows of a slice: a hash that tells them apart, how often each is there, and the rows themselves."""

    hash: np.ndarray
    n: np.ndarray
    rows: pa.Table


def _counts(hashes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct hash, in ascending order of hashes, and how often it is there."""
    if n is None:
        return np.unique(hashes, return_index=True, return_counts=True)[1:]
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, group, n)
    return first, total


def _merged(held: list[Counted]) -> Counted:
    hashes = np.concatenate([c.hash for c in held])
    first, n = _counts(hashes, np.concatenate([c.n for c in held]))
    return Counted(hashes[first], n, pa.concat_tables([c.rows for c in held]).take(pa.array(first)))


def _counted(batches: Iterator[pa.RecordBatch], f: Callable[[pa.RecordBatch], Counted]) -> Iterator[pa.RecordBatch]:
    """Rows of f over slices with their number `n`, equal ones once while few enough are held."""
    held: list[Counted] = []

    def sent() -> Iterator[pa.RecordBatch]:
        whole = _merged(held)
        yield from whole.rows.append_column("n", pa.array(whole.n)).to_batches(max_chunksize=20_000)

    rows = 0
    for batch in slices(batches):
        held.append(f(batch))
        rows += len(held[-1].hash)
        if rows > HELD:
            yield from sent()
            held, rows = [], 0
    if rows:
        yield from sent()


def _langs(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("lang").cast(pa.large_string())


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, h, n) of docs (lang, text): occurrences of each word, lower-cased, and its hash."""

    def of(batch: pa.RecordBatch) -> Counted:
        words = split_words(batch.column("text"), _WORD, lower=True)
        langs = _langs(batch)
        own = _hashes(words, _lang_hashes(langs))
        first, n = _counts(own)
        word = _array(*_strings(words.data, words.starts[first], words.ends[first]))
        return Counted(own[first], n, pa.table({"lang": langs.take(pa.array(words.doc[first])), "word": word, "h": own[first].view(np.int64)}))

    found = docs.mapInArrow(lambda batches: _counted(batches, of), "lang string, word string, h long, n long")
    return found.groupBy("lang", "word").agg(F.min("h").alias("h"), F.sum("n").alias("n"))


def _spans(hashes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (begins, ends) that gives a hash of the words between, from the words' own hashes."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers("up", len(hashes)), out=sums[1:])
    down = powers("down", len(hashes) + 1)
    return lambda b, e: mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64))


def fragments(docs: DataFrame, hashes: np.ndarray, ranks: np.ndarray, parts: np.ndarray, whole: bool, longest: int) -> DataFrame:
    """(h, part, split, lang, fragment, n): each pivot with the words around it that are commoner, up to longest - 1 on each side.

    `hashes`, ascending, with `ranks` (0: commonest) and `parts` say how common words are and over how many parts each
    is dealt; `whole` says that other words are too rare to count. `h` is the pivot's hash, `split` says that it has
    several parts. A fragment's words follow a space each, its pivot a tab. The pivot may come again behind it, not before.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((hashes, ranks, parts))
    rarest = np.uint64(np.iinfo(np.uint64).max)

    def of(batch: pa.RecordBatch) -> Counted:
        known, rank_of, parts_of = sent.value
        words = split_words(batch.column("text"), _WORD, lower=True)
        langs = _langs(batch)
        n = len(words.starts)
        own = _hashes(words, _lang_hashes(langs))
        rank = np.full(n, rarest) if whole else own >> np.uint64(1) | np.uint64(1 << 63)
        dealt = np.ones(n, np.uint64)
        if len(known) and n:
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own
            rank[hit] = rank_of[at[hit]]
            dealt[hit] = parts_of[at[hit]]
        breaks = np.concatenate([[0], np.cumsum(_BREAK[words.data])])
        piece = breaks[words.starts] + words.doc  # both only grow, so equal sums are equal pairs
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for side, step in ((left, -1), (right, 1)):
            open_ = rank != rarest
            for k in range(1, min(longest, n)):
                fits = np.zeros(n, bool)
                a, b = (slice(k, n), slice(0, n - k)) if step < 0 else (slice(0, n - k), slice(k, n))
                fits[a] = (piece[a] == piece[b]) & ((rank[b] < rank[a]) if step < 0 else (rank[b] <= rank[a]))
                open_ &= fits
                side += open_
        keep = np.flatnonzero(left + right)
        text = mix(_spans(own)(keep - left[keep], keep + right[keep] + 1) + left[keep].astype(np.uint64))
        first, count = _counts(text)
        keep, text = keep[first], text[first]
        data, at = _packed(words)
        begins, ends = at[keep - left[keep]], at[keep + right[keep] + 1]
        bytes_, offsets = _strings(data, begins, ends)
        bytes_[offsets[:-1] + at[keep] - begins] = 9
        rows = pa.table({"h": own[keep].view(np.int64), "part": (text % dealt[keep]).astype(np.int64), "split": dealt[keep] > 1, "lang": langs.take(pa.array(words.doc[keep])), "fragment": _array(bytes_, offsets)})
        return Counted(text, count, rows)

    return docs.mapInArrow(lambda batches: _counted(batches, of), "h long, part long, split boolean, lang string, fragment string, n long")


def _mined(longest: int, least: int):
    """Of a part's fragments, the n-grams that its pivot owns: (lang, phrase, words, n), without rare ones where the part is all there is."""

    def work(found: pa.Table) -> Iterator[pa.RecordBatch]:
        text = found.column("fragment").cast(pa.large_string()).combine_chunks()
        words = split_words(text, is_word(b"\x20\x09"))
        first, pivot = words.first, np.zeros(len(text), np.int64)
        tabbed = np.flatnonzero(words.data[words.starts - 1] == 9)
        pivot[words.doc[tabbed]] = tabbed
        key = np.asarray(found.column("h")).view(np.uint64)
        times, split = np.asarray(found.column("n")), found.column("split").combine_chunks().to_numpy(zero_copy_only=False)
        span = _spans(words.hashes())
        rows, begins, ends = [], [], []
        for left in range(longest):
            for right in range(longest - left):
                if left + right:
                    has = np.flatnonzero((pivot - left >= first[:-1]) & (pivot + right < first[1:]))
                    rows.append(has)
                    begins.append(pivot[has] - left)
                    ends.append(pivot[has] + right + 1)
        row, begin, end = map(np.concatenate, (rows, begins, ends))
        at, n = _counts(mix(span(begin, end) + key[row]), times[row])
        keep = (n >= least) | split[row[at]]
        at, n = at[keep], n[keep]
        clear = np.where(words.data == 9, np.uint8(32), words.data)
        phrase = _array(*_strings(clear, words.starts[begin[at]], words.ends[end[at] - 1]))
        yield from pa.table({"lang": found.column("lang").take(pa.array(row[at])), "phrase": phrase, "words": end[at] - begin[at], "n": n}).combine_chunks().to_batches(max_chunksize=20_000)

    return work


def phrase_counts(docs: DataFrame, counts: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, words, n) of phrases of 2 to `longest` words that occur `least` times or more."""
    head = counts.where(F.col("n") >= least)
    # a bounded table: where there are more words than RANKED, the rest are ordered by their hashes
    held = head.orderBy(F.desc("n"), "lang", "word").select("h", "n").limit(RANKED + 1).toPandas() if head.take(1) else None
    whole = held is None or len(held) <= RANKED
    hashes = np.array([] if held is None else held["h"].to_numpy()[:RANKED], np.int64).view(np.uint64)
    parts = np.array([] if held is None else -(-held["n"].to_numpy()[:RANKED] // PART), np.uint64)
    order = np.argsort(hashes, kind="stable")
    found = fragments(docs, hashes[order], order.astype(np.uint64), parts[order], whole, longest)
    mined = by_group(found, ["h", "part"], _mined(longest, least), "lang string, phrase string, words long, n long", 20_000)
    return mined.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("n")).where(F.col("n") >= least)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = 3, least: int = 10, contained: int = 50, best: int | None = None) -> DataFrame:
    """Phrases of 2 to `longest` words by language, by how much oftener they occur than their parts let expect.

    `lang, rank, phrase, a, l, r, n, score`: the phrase occurs a times (`least` or more) among n words; of the cuts
    into a first part (l times) and a rest (r times), the one with the lowest floor(1000000 a a / (l r)), of equals the
    first. Phrases that lie within a longer one which occurs at least `contained` per cent as often are left out. Ranks
    run from 1 by score, count and phrase (UTF-8 order); `best` keeps the first so many of each language.

    Null languages are `und`; null, empty and blank texts have no words. Texts are whole, repeated rows count each,
    an empty table gives no rows, and other columns are not read. Counts are below 10^15.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    counts = stage(word_counts(docs), "words")
    phrases = stage(phrase_counts(docs, counts, longest, least), "phrases")
    known = phrases.select("lang", "phrase", "n").union(counts.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), "n"))
    part = lambda begin, n: F.array_join(F.slice("w", begin, n), " ")
    cut = phrases.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words").cast("int") - 1)))
    cut = cut.select("lang", "phrase", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w")).alias("rest"))
    cut = cut.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cut = cut.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0)) * 1000000) DIV (CAST(l AS DECIMAL(15, 0)) * CAST(r AS DECIMAL(15, 0)))")
    lowest = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.score")
    if longest > 2:
        spans = [(b, n) for n in range(2, longest) for b in range(longest - n + 1)]
        within = phrases.where("words > 2").withColumn("w", F.split("phrase", " "))
        inner = F.explode(F.array_distinct(F.filter(F.array(*[F.when((F.size("w") > n) & (F.size("w") >= b + n), part(F.lit(b + 1), F.lit(n))) for b, n in spans]), lambda x: x.isNotNull())))
        longer = within.select("lang", inner.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
        lowest = lowest.join(longer, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") * 100 < F.col("a") * contained, F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if best is None:
        ranked = _ranked(lowest, order)
    else:
        # each language's best lie among the best of its parts
        dealt = lowest.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(BEST_PARTS)))
        some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= best)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _ranked(phrases: DataFrame, order: list) -> DataFrame:
    """Ranks of all phrases of each language; a language's phrases are dealt by score and counted on by part."""
    scores = phrases.groupBy("lang", "score").agg(F.count("*").alias("same"))
    before = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    scores = scores.withColumn("above", F.coalesce(F.sum("same").over(before), F.lit(0)))  # at most 1,000,001 scores
    own = F.row_number().over(Window.partitionBy("lang", "score").orderBy(*order))
    return phrases.withColumn("own", own).join(scores.drop("same"), ["lang", "score"]).withColumn("rank", F.col("above") + F.col("own")).drop("own", "above")
