"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

A word is reached through classes within classes. At each class a softmax over at most WIDTH children takes the next
step: the class's most frequent words are children of their own, all its other words share the remaining ones, and
the last classes hold what is left. So P(word | history) = P(child | class, history) down to the word, and for words
that never become a child of their own, times their add-one relative frequency within the last class.

Every softmax adds hashed weights of the words before: of the last one, of the last two together, and of the last but
one alone (a skip), each together with the class, so that the history tells the words of a class apart; the first class
also has the endings of the last three. How many weights there are grows with the training tokens, how many levels with
the vocabulary. Each worker makes gradient updates over its
own documents from the round's weights; Spark averages the workers' rows, each weighted with how often it was seen.
A round takes a part of the documents; rounds go on over all parts, and from the first again, until the loss over
documents that no round takes is flat. These documents then make up the last round.

Counts are exact over all training documents. A fixed number of frequent words goes to the tasks as a table; the
others of each document meet the counts in a join.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from itertools import chain, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk.llm._common import bound_batches, mix, slices, split_words, stage, text_bytes

#: Children of the first class that are words, and classes by ending besides; of any other class words, and classes besides.
FIRST, ENDINGS = 16, 16
OWN, SHARED_BITS = 24, 3
SHARED = 1 << SHARED_BITS
WIDTH = FIRST + ENDINGS
#: Features of a history; minibatch in tokens; step size, and what it is damped by beside the times a row was seen.
FEATURES, MINIBATCH, STEP, DAMPING = 4, 8192, 0.5, 4
#: The feature that only the first class has: endings say which ending comes next, and little about the words that share it.
SHAPE = 3
#: Steps of a minibatch that meet one row, up to which they are added place by place, which is faster for many rows.
FEW = 32
#: Steps whose weights are worked on at a time, so that these stay in a core's own cache.
BLOCK = 4096
#: Weight rows of a feature: this many times the fourth root of the training tokens, to the nearest power of two.
ROWS_PER_ROOT = 640
#: Words that are children of their own are at least so many times the square root of all distinct ones, by more levels; five at most, for a table of HEAD words.
PER_ROOT, DEEPEST = 1.5, 5
#: Workers of a round: as many as the cluster has cores, or one for so many partitions where these are more.
PARTITIONS_A_WORKER = 16
#: Parts of the documents that rounds take in turn; rounds end, after one over each, when the loss falls by less than this share.
PARTS, SETTLED = 2, 0.03
#: One training document in so many tells when to stop, and is learnt from after that.
HELD_BACK_ONE_IN = 32
#: Words that go to tasks as a table: a fixed number whatever the corpus.
HEAD = 1 << 17
_GOLDEN = 0x9E3779B97F4A7C15
_END = np.uint64(0x2545F4914F6CDD1D)
_START = np.uint64(0x9FB21C651E98DF25)
_IMPOSSIBLE = -20.0
_ONES = np.ones(WIDTH, np.float32)
#: A minibatch has a step for each level of its tokens at most, so its steps' places take so many bits.
PLACE_BITS = 20
#: Leading bits of a hash by which frequent words are looked up: some half a word for each value of these.
PREFIX_BITS = 18
#: Rows of weights that a task holds at least before it adds up those of one place.
FOLDED = 1 << 14


class Tokens(NamedTuple):
    """Tokens of a slice of texts, each text followed by its end: hashes, classes by ending, and where texts begin."""

    hashes: np.ndarray
    endings: np.ndarray
    first: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    words = split_words(texts, lower=True)
    n_docs = len(words.first) - 1
    first = words.first + np.arange(n_docs + 1)
    at = np.arange(len(words.starts)) + words.doc
    hashes = np.full(first[-1], _END)
    hashes[at] = words.hashes()
    last = words.data[words.ends - 1].astype(np.uint64)
    before = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    endings = np.zeros(first[-1], np.int64)
    endings[at] = (mix(last * np.uint64(256) + before + np.uint64(1)) & np.uint64(ENDINGS - 1)).astype(np.int64)
    return Tokens(hashes, endings, first)


def codes(hashes: np.ndarray) -> np.ndarray:
    """30 bits that deal a word out to shared classes, three a level."""
    return (mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(34)).astype(np.int64)


def level_nodes(depth: int) -> np.ndarray:
    """Where each level's classes begin among all: the first class, then ENDINGS, ENDINGS * SHARED ... and after the last level its shared children."""
    return np.cumsum([0, 1, *(ENDINGS * SHARED**i for i in range(depth))])


def place(endings: np.ndarray, code: np.ndarray, level: int) -> np.ndarray:
    """The class within its level (from 2) that words by these endings and codes are in."""
    bits = SHARED_BITS * (level - 2)
    return (endings << bits) + (code & ((1 << bits) - 1))


def put_rows(table: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """table[at] = values for contiguous tables; a row is written as one item, which is faster than place by place."""
    item = np.dtype((np.void, table.strides[0]))
    table.view(item)[:, 0][at] = values.view(item)[:, 0]


def add_rows(table: np.ndarray, at: np.ndarray, values: np.ndarray, held: np.ndarray | None = None) -> None:
    """table[at] += values for distinct rows; `held`: table[at], where it is at hand, and is used up."""
    new = table.take(at, axis=0, mode="clip") if held is None else held
    new += values
    put_rows(table, at, new)


def binaries(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.itemsize * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, ascending, and their summed values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    begins = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[begins], np.add.reduceat(values[order], begins, axis=0)


class Model:
    """Frequent words with counts and places, class totals and weights. Sizes hang on HEAD, the depth and the number of rows."""

    def __init__(self, head: np.ndarray, counts: np.ndarray, endings: np.ndarray, n_words: int, n_tokens: int):
        order = np.argsort(head)
        self.head, self.head_counts, self.head_endings = head[order], counts[order], endings[order].astype(np.int64)
        self.begins = np.searchsorted(self.head >> np.uint64(64 - PREFIX_BITS), np.arange(1 << PREFIX_BITS, dtype=np.uint64)).astype(np.int32)
        self.depth = 2
        while self.depth < DEEPEST and FIRST + ENDINGS * OWN * (SHARED ** (self.depth - 1) - 1) // (SHARED - 1) < PER_ROOT * n_words**0.5:
            self.depth += 1
        self.node_keys = mix(np.arange(level_nodes(self.depth)[-2], dtype=np.uint64) + np.uint64(0x51ED27))
        self.rows = 1 << int(np.round(np.log2(ROWS_PER_ROOT * max(n_tokens, 64) ** (1 / 4))))
        self.weights = np.zeros((FEATURES * self.rows, WIDTH), np.float32)
        self.seen = np.zeros(FEATURES * self.rows)
        # the level at which each frequent word is a child of its own (depth + 1: nowhere), and which child
        self.level, self.child = np.full(len(head), self.depth + 1), np.zeros(len(head), np.int64)
        often = np.argsort(-self.head_counts, kind="stable")
        self.level[often[:FIRST]], self.child[often[:FIRST]] = 1, np.arange(len(often[:FIRST]))
        code = codes(self.head)
        for level in range(2, self.depth + 1):
            left = np.flatnonzero(self.level > self.depth)
            node = place(self.head_endings[left], code[left], level)
            order = np.lexsort((-self.head_counts[left], node))
            left, node = left[order], node[order]
            rank = np.arange(len(left)) - np.searchsorted(node, node)
            own = rank < OWN
            self.level[left[own]], self.child[left[own]] = level, rank[own]

    def packed(self) -> Model:
        """To ship: half precision holds the weights as they are, as the means of a round come in it."""
        small = copy.copy(self)
        small.weights = self.weights.astype(np.float16)
        return small

    def opened(self) -> Model:
        """A worker's own copy of a packed model."""
        own = copy.copy(self)
        own.weights, own.seen, own.step_of = self.weights.astype(np.float32), self.seen.copy(), np.zeros(self.rows, np.int32)
        return own

    def set_counts(self, bucket: np.ndarray, n: np.ndarray, v: np.ndarray) -> None:
        """From tokens and distinct words of last classes, without words that are children of their own: biases and denominators."""
        begins = level_nodes(self.depth)
        size = ENDINGS * SHARED ** (self.depth - 1)
        mass, words = np.zeros(size), np.zeros(size)
        mass[bucket], words[bucket] = n, v
        self.denominators = mass + words + 1
        self.bias = np.full((begins[-2], WIDTH), _IMPOSSIBLE, np.float32)
        code = codes(self.head)
        for level in range(self.depth, 0, -1):
            at = np.flatnonzero(self.level == level)
            nodes, shared = (ENDINGS * SHARED ** (level - 2), SHARED) if level > 1 else (1, ENDINGS)
            own = np.zeros((nodes, WIDTH - shared))
            own[place(self.head_endings[at], code[at], level) if level > 1 else 0, self.child[at]] = self.head_counts[at]
            # bits of a code are used from the low end, so class x of a level has the children x + r * (classes of that ending)
            below = mass.reshape(ENDINGS, SHARED, -1).transpose(0, 2, 1).reshape(nodes, SHARED) if level > 1 else mass.reshape(1, ENDINGS)
            total = own.sum(axis=1) + below.sum(axis=1)
            logs = np.log(np.hstack([own, below]) + np.hstack([np.zeros_like(own), np.ones_like(below)]) + 1e-9) - np.log(total + shared)[:, None]
            self.bias[begins[level - 1] : begins[level - 1] + nodes] = np.maximum(logs, _IMPOSSIBLE)
            mass = total

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words in the table, and whether they are there."""
        last = len(self.head) - 1
        if last < 0:
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(self.begins.take((hashes >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)), last).astype(np.int64)
        # most are the first word with these leading bits, or the next; the others are searched for
        behind = np.flatnonzero(self.head.take(at) < hashes)
        if len(behind):
            at[behind] += 1
            far = behind[self.head.take(np.minimum(at[behind], last)) < hashes[behind]]
            at[far] = np.searchsorted(self.head, hashes[far])
        np.minimum(at, last, out=at)
        return at, self.head.take(at) == hashes

    def steps(self, t: Tokens, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, class, child) of every softmax on the way to each token, and each token's last class, -1 for words that are children."""
        at, there = self.known(t.hashes) if known is None else known
        level = np.where(there, self.level.take(at) if len(self.head) else 0, self.depth + 1)
        child = np.where(there, self.child.take(at) if len(self.head) else 0, 0)
        code, begins = codes(t.hashes), level_nodes(self.depth)
        found = [(np.arange(len(level)), np.zeros(len(level), np.int64), np.where(level == 1, child, FIRST + t.endings))]
        for k in range(2, self.depth + 1):
            on = np.flatnonzero(level >= k)
            code_on = code.take(on)
            shared = code_on >> SHARED_BITS * (k - 2) & (SHARED - 1)
            found.append((on, begins[k - 1] + place(t.endings.take(on), code_on, k), np.where(level.take(on) == k, child.take(on), OWN + shared)))
        bucket = np.where(level > self.depth, place(t.endings, code, self.depth + 1), -1)
        return (*(np.concatenate(x) for x in zip(*found)), bucket)

    def histories(self, t: Tokens) -> np.ndarray:
        """Keys of each token's history, one for each feature."""
        n = len(t.hashes)
        one, two, shape = np.full(n, _START), np.full(n, _START), np.zeros(n, np.uint64)
        heads = np.zeros(n, bool)
        heads[t.first[:-1]] = True
        since = np.arange(n) - np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        for back, h in ((1, one), (2, two), (3, None)):
            ok = np.flatnonzero(since >= back)
            shape[ok] = shape[ok] * np.uint64(ENDINGS + 1) + t.endings[ok - back].astype(np.uint64) + np.uint64(1)
            if h is not None:
                h[ok] = t.hashes[ok - back]
        return np.stack([mix(one + np.uint64(1)), mix(mix(one) + two * np.uint64(_GOLDEN) + np.uint64(4)), mix(two + np.uint64(2)), mix(shape + np.uint64(3))])

    def at_rows(self, keys: np.ndarray, tokens: np.ndarray, nodes: np.ndarray) -> list[np.ndarray]:
        """For each feature its weight rows, counted from its own first, at tokens and classes; those of SHAPE for the leading steps only, one a token."""
        own, found = self.node_keys.take(nodes), []
        for i, k in enumerate(keys):
            x = mix(k ^ own[: len(k)] if i == SHAPE else k.take(tokens) ^ own)
            x >>= np.uint64(20)
            x &= np.uint64(self.rows - 1)
            found.append(x.astype(np.int64))
        return found

    def of(self, feature: int) -> np.ndarray:
        """A feature's weights."""
        return self.weights[feature * self.rows : (feature + 1) * self.rows]

    def logits(self, tables: list[np.ndarray], rows: list[np.ndarray], nodes: np.ndarray, into: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, behind the last, biases and weights of all children) for BLOCK steps at a time; `into` holds all steps, or one block after the other."""
        held = np.empty((min(BLOCK, len(nodes)), WIDTH), np.float32)
        for a in range(0, len(nodes), BLOCK):
            b = min(a + BLOCK, len(nodes))
            z = into[a:b] if len(into) == len(nodes) else into[: b - a]
            self.bias.take(nodes[a:b], axis=0, out=z, mode="clip")  # rows are within the table; clipping saves a copy
            for table, r in zip(tables, rows):
                r = r[a:b]
                if len(r):
                    z[: len(r)] += table.take(r, axis=0, out=held[: len(r)], mode="clip")
            yield a, b, np.minimum(z, 80, out=z) if z.max() > 80 else z  # beyond, single precision overflows

    def log_probabilities(self, rows: list[np.ndarray], nodes: np.ndarray, children: np.ndarray) -> np.ndarray:
        """The natural log of each step's probability."""
        found = np.empty(len(nodes), np.float32)
        for a, b, z in self.logits([self.of(i) for i in range(FEATURES)], rows, nodes, np.empty((min(BLOCK, len(nodes)), WIDTH), np.float32)):
            taken = z.reshape(-1).take(np.arange(0, (b - a) * WIDTH, WIDTH) + children[a:b])
            found[a:b] = taken - np.log(np.exp(z, out=z) @ _ONES)
        return found

    def batches(self, t: Tokens, steps: tuple | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, tokens, classes, children) of the steps to MINIBATCH tokens at a time, each step once; those of the first class lead, one a token."""
        token, node, child, _ = steps or self.steps(t)
        keys = self.histories(t)
        levels = [0, *(np.flatnonzero(token[1:] <= token[:-1]) + 1).tolist(), len(token)]
        edges = np.append(np.arange(0, len(t.hashes), MINIBATCH), len(t.hashes))
        at = [a + np.searchsorted(token[a:b], edges) for a, b in zip(levels[:-1], levels[1:])]
        for i, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            tokens, nodes, children = (np.concatenate([x[e[i] : e[i + 1]] for e in at]) for x in (token, node, child))
            yield self.at_rows(keys[:, lo:hi], tokens - lo, nodes), tokens, nodes, children

    def met(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The last step at each distinct row, first of those met most often (over FEW times in any order), how often it is met, and each step's place among these."""
        self.step_of[rows] = np.arange(len(rows))
        one = self.step_of.take(rows)
        times = np.bincount(one, minlength=len(rows))
        more = np.flatnonzero(times > 1)
        more = more[np.argsort(-np.minimum(times.take(more), FEW + 1).astype(np.int16), kind="stable")]
        distinct = np.concatenate([more, np.flatnonzero(times == 1)])
        at = np.empty(len(rows), np.int64)
        at[distinct] = np.arange(len(distinct))
        return distinct, times.take(distinct), at.take(one)

    def update(self, rows: list[np.ndarray], nodes: np.ndarray, children: np.ndarray) -> None:
        """One gradient step over a minibatch; a row's step shrinks with how often it was seen.

        Each distinct row is fetched from the table once: steps take it from the few fetched, and it goes back changed.
        """
        gradient = np.empty((len(nodes), WIDTH), np.float32)
        met = [self.met(r) for r in rows]
        fetched = [self.of(i).take(r.take(distinct), axis=0, mode="clip") for i, (r, (distinct, _, _)) in enumerate(zip(rows, met))]
        for _, _, z in self.logits(fetched, [at for _, _, at in met], nodes, gradient):
            np.exp(z, out=z)
            z *= (-1 / (z @ _ONES))[:, None]
        gradient.reshape(-1)[np.arange(0, len(nodes) * WIDTH, WIDTH) + children] += 1
        for i, (r, (distinct, counts, at), held) in enumerate(zip(rows, met, fetched)):
            which, own = r.take(distinct), self.seen[i * self.rows : (i + 1) * self.rows]
            seen = own.take(which) + counts
            own[which] = seen
            scale = (STEP / np.sqrt(seen + DAMPING)).astype(np.float32)[:, None]
            more = np.searchsorted(-np.minimum(counts, FEW + 1), -np.arange(FEW + 1)).tolist()  # rows met more than k times
            again, few, n = np.flatnonzero(at < more[1]), more[FEW], more[1]
            order = np.sort(at.take(again) << PLACE_BITS | again) & ((1 << PLACE_BITS) - 1)
            begins = np.cumsum(counts[:n]) - counts[:n]
            sums = gradient.take(distinct[:n], axis=0)
            for k in range(1, FEW):
                if few < more[k]:
                    sums[few : more[k]] += gradient.take(order.take(begins[few : more[k]] + (k - 1)), axis=0)  # a row's last step is there already
            if few:
                ones = np.ones(counts[:few].max(), np.float32)
                for k, (begin, times) in enumerate(zip(begins[:few].tolist(), counts[:few].tolist())):
                    np.matmul(ones[:times], gradient.take(order[begin : begin + times], axis=0), out=sums[k])  # a sum of rows, faster than sum()
            sums *= scale[:n]
            add_rows(self.of(i), which[:n], sums, held[:n])
            for a in range(n, len(which), BLOCK):
                sums = gradient.take(distinct[a : a + BLOCK], axis=0)
                sums *= scale[a : a + BLOCK]
                add_rows(self.of(i), which[a : a + BLOCK], sums, held[a : a + BLOCK])


def _counts(docs: DataFrame) -> DataFrame:
    """(word, ending, code, n): exact token counts; a task sends each word once for each batch of texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tokens(batch.column("text"))
            order = np.argsort(found.hashes)
            hashes = found.hashes.take(order)
            begins = np.flatnonzero(np.concatenate([np.ones(min(1, len(hashes)), bool), hashes[1:] != hashes[:-1]]))
            words, endings = hashes.take(begins), found.endings.take(order.take(begins))
            yield pa.RecordBatch.from_pydict({"word": pa.array(words.view(np.int64)), "ending": pa.array(endings.astype(np.int32)), "code": pa.array(codes(words).astype(np.int32)), "n": pa.array(np.diff(begins, append=len(hashes)))})

    return docs.select("text").mapInArrow(work, "word long, ending int, code int, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.min("code").alias("code"), F.sum("n").alias("n"))


def _trained(docs: DataFrame, model: Model) -> Model:
    """The model after one round: updates by each worker, then the weighted mean of each row.

    A worker sends every row that it has seen, so there are fewer workers than partitions.
    """
    sc = docs.sparkSession.sparkContext
    shipped = sc.broadcast(model.packed())

    def updates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value.opened()
        for batch in slices(batches):
            for rows, _, nodes, children in own.batches(tokens(batch.column("text"))):
                own.update(rows, nodes, children)
        fresh = (own.seen - shipped.value.seen).astype(np.float32)
        used = np.flatnonzero(fresh)
        for part in np.array_split(used, 1 + len(used) // 4096):
            if len(part):
                yield pa.RecordBatch.from_pydict({"row": pa.array(part.astype(np.int32)), "fresh": pa.array(fresh[part]), "weights": binaries(own.weights[part].astype(np.float16))})

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = np.zeros(0, np.int32), np.zeros((0, WIDTH + 2))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                fresh = np.asarray(batch.column("fresh")).astype(np.float64)[:, None]
                packed = text_bytes(batch.column("weights"))[0].view(np.float16).reshape(-1, WIDTH)
                held.append((np.asarray(batch.column("row")), fresh * np.hstack([np.ones_like(fresh), fresh, packed])))
                n += batch.num_rows
            if held and (batch is None or n >= max(FOLDED, len(rows))):  # what is held stays in proportion to the task's own rows
                rows, sums = row_sums(*(np.concatenate(x) for x in zip((rows, sums), *held)))
                held, n = [], 0
        if len(rows):
            yield pa.RecordBatch.from_pydict({"row": pa.array(rows, pa.int32()), "fresh": pa.array(sums[:, 1] / sums[:, 0]), "weights": binaries((sums[:, 2:] / sums[:, :1]).astype(np.float16))})

    workers = max(1, sc.defaultParallelism, docs.rdd.getNumPartitions() // PARTITIONS_A_WORKER)
    parts = docs.select("text").coalesce(workers).mapInArrow(updates, "row int, fresh float, weights binary")
    rows = stage(parts.repartition("row").mapInArrow(means, "row int, fresh double, weights binary"), "weights").toArrow()  # as many as the model has rows
    new = copy.copy(model)
    new.weights, new.seen = model.weights.copy(), model.seen.copy()
    for part in rows.to_batches():
        at = np.asarray(part.column("row"))
        new.seen[at] += np.asarray(part.column("fresh"))
        new.weights[at] = text_bytes(part.column("weights"))[0].view(np.float16).reshape(len(at), WIDTH)
    shipped.destroy()
    return new


def _loss(docs: DataFrame, model: Model) -> float:
    """The mean loss of a token in nats, as far as it hangs on the weights; 0 without documents."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.packed())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value.opened()
        for batch in slices(batches):
            t, loss = tokens(batch.column("text")), 0.0
            for rows, _, nodes, children in own.batches(t):
                loss -= float(own.log_probabilities(rows, nodes, children).sum())
            yield pa.RecordBatch.from_pydict({"loss": pa.array([loss]), "n": pa.array([len(t.hashes)])})

    loss, n = docs.select("text").mapInArrow(work, "loss double, n long").agg(F.sum("loss"), F.sum("n")).first()
    shipped.destroy()
    return (loss or 0.0) / max(1, n or 0)


def fit(train: DataFrame, vocabulary: DataFrame) -> Model:
    """A model of training documents (text) and their word counts. How documents lie in partitions moves its weights a little."""
    n_all, n_distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = vocabulary.orderBy(F.desc("n"), "word").limit(HEAD).toPandas()
    model = Model(head["word"].to_numpy(np.int64).view(np.uint64), head["n"].to_numpy(np.int64), head["ending"].to_numpy(), n_distinct, n_all)
    placed = model.head[model.level <= model.depth].view(np.int64)
    own = train.sparkSession.createDataFrame(pa.table({"word": placed}))  # HEAD at most
    bucket = F.col("ending").cast("long") * SHARED ** (model.depth - 1) + F.pmod("code", F.lit(SHARED ** (model.depth - 1)))
    totals = vocabulary.join(F.broadcast(own), "word", "left_anti").groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toPandas()  # a row for each last class
    model.set_counts(totals["bucket"].to_numpy(np.int64), totals["n"].to_numpy(float), totals["v"].to_numpy(float))
    hashed = F.xxhash64("text")
    back, rest = stage(train.where(F.pmod(hashed, F.lit(HELD_BACK_ONE_IN)) == 0).select("text"), "held-back"), train.where(F.pmod(hashed, F.lit(HELD_BACK_ONE_IN)) != 0)
    before = np.inf
    for i in count(1):
        model = _trained(rest.where(F.pmod(F.shiftright(hashed, 8), F.lit(PARTS)) == i % PARTS), model)
        if i >= PARTS - 1:
            loss = _loss(back, model)
            if i >= PARTS and loss >= before * (1 - SETTLED):
                return _trained(back, model)
            before = loss


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: tokens, summed logs of steps within denominators, and of the words' counts as far as the table goes; the others in `tail`."""
    shipped = docs.sparkSession.sparkContext.broadcast(model.packed())
    tail = T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("n", T.IntegerType())]))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("step_sum", T.DoubleType()), T.StructField("head_sum", T.DoubleType()), T.StructField("head_known", T.LongType()), T.StructField("tail", tail)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value.opened()
        logs, denominators = np.log10(own.head_counts + 1.0), np.log10(own.denominators)
        for batch in slices(batches):
            t = tokens(batch.column("text"))
            n = len(t.hashes)
            at, known = own.known(t.hashes)
            value = np.where(known, logs[at] if len(logs) else 0.0, 0.0)
            steps = own.steps(t, (at, known))
            bucket = steps[3]
            # a word that is no child of its own has its count within its last class; that of words beyond the table joins later
            chosen = np.where(bucket >= 0, value - denominators[bucket], 0.0)
            for rows, token, nodes, children in own.batches(t, steps):
                sums = np.bincount(token - token[0], own.log_probabilities(rows, nodes, children)) / np.log(10)
                chosen[token[0] : token[0] + len(sums)] += sums
            doc = np.repeat(np.arange(batch.num_rows), np.diff(t.first))
            rest = np.flatnonzero(~known)
            order = rest[np.lexsort((t.hashes[rest], doc[rest]))]
            new = np.ones(len(order), bool)
            new[1:] = (t.hashes[order][1:] != t.hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            begins = np.flatnonzero(new)
            counts = np.diff(np.concatenate([begins, [len(order)]]))
            offsets = np.searchsorted(doc[order][begins], np.arange(batch.num_rows + 1))
            pairs = pa.StructArray.from_arrays([pa.array(t.hashes[order][begins].view(np.int64)), pa.array(counts.astype(np.int32))], ["word", "n"])
            add = lambda v: np.add.reduceat(v, t.first[:-1])  # noqa: E731  each document has at least its end
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "held_out": batch.column("held_out"),
                    "n_tokens": pa.array(np.diff(t.first)),
                    "step_sum": pa.array(add(chosen)),
                    "head_sum": pa.array(add(value)),
                    "head_known": pa.array(add(known.astype(np.int64))),
                    "tail": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs),
                }
            )

    return docs.select("doc_id", "held_out", "text").mapInArrow(work, schema)


def score(docs: DataFrame, held_out: F.Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: `key, held_out, n_tokens, n_known, train_tokens, base_score, score`, scores in log10.

    The model and all counts come from the rows for which `held_out` is false. `base_score` is the add-one unigram
    model's. Null, empty and blank texts are their end alone. Repeated rows count as often as they are there and are
    scored alike; a null key makes `held_out` null, which trains. Without training rows, counts are zero and classes
    equally likely. An empty table gives no rows. Other columns are not read. Words are told apart by 64-bit hashes:
    two of 10^9 distinct words share one with a chance of about 3 %. `score` hangs a little on how rows lie in
    partitions, as workers' weights are averaged; all other columns do not.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    source = docs.select(F.col(key).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(text, F.lit("")).alias("text"))
    train = source.where("not held_out")
    vocabulary = stage(_counts(train), "vocabulary")
    n_all, n_distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    scored = stage(_scored(source, fit(train, vocabulary)), "scored").withColumn("_row", F.monotonically_increasing_id())
    tails = scored.select("_row", F.explode("tail").alias("t")).select("_row", "t.word", F.col("t.n").alias("tf"))
    found = tails.join(vocabulary.select("word", "n"), "word").groupBy("_row").agg(F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("tail_sum"), F.sum("tf").alias("tail_known"))
    tail = F.coalesce("tail_sum", F.lit(0.0))
    base = F.col("head_sum") + tail - F.col("n_tokens") * F.log10(F.lit(float(n_all + n_distinct + 1)))
    return scored.join(found, "_row", "left").select(F.col("doc_id").alias(key), "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("step_sum") + tail).alias("score"))
