import math
import os
import re
import sys
from collections import Counter
from hashlib import sha256
from random import Random

import numpy as np
import pytest
import xxhash
from edge_cases import ROWS

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import assert_same

from tamarisk.llm import codes, phrases, queries, simhash


@pytest.mark.parametrize("name", ["op11_codes", "op13_phrases"])
def test_sql(name, spark, sf_dir):
    assert_same(queries.QUERIES[name], queries.ORACLE[name], spark, sf_dir)


# ---- vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(k, v, label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dims = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dims]
    w = -(-dims // parts)
    ints = [[math.floor(1024 * x) for x in v] + [0] * (parts * w - dims) for _, v, _ in kept]
    cut = [[x[p * w : (p + 1) * w] for p in range(parts)] for x in ints]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda j: (dist(x[p], books[p][j]), j))
    for _ in range(rounds):
        at = [[nearest(p, x) for p in range(parts)] for x in cut]
        for p in range(parts):
            for j in range(len(books[p])):
                own = [x[p] for x, a in zip(cut, at) if a[p] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    at = [[nearest(p, x) for p in range(parts)] for x in cut]
    errors = [sum(dist(x[p], books[p][a[p]]) for p in range(parts)) for x, a in zip(cut, at)]
    by_label = Counter()
    for (_, _, label), e in zip(kept, errors):
        by_label[label] += e
    digest = sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((k, "".join(f"{j:02x}" for j in a), e, by_label[label], digest) for (k, _, label), a, e in zip(kept, at, errors)), key=str)


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, error string, x int, at long"


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, label, "own", 1, 2) for k, v, label in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("entries", [7, 40])
def test_codes_on_few_values(spark, entries):
    """Whole numbers of a small range, so that ties and copies are everywhere."""
    rng = Random(3)
    rows = [(i, [rng.randint(-2, 2) / 1024 for _ in range(8)], rng.choice([None, 1, 2])) for i in range(400)]
    assert shown(codes.compress(vectors(spark, rows), entries=entries)) == brute_codes(rows, entries=entries)


def test_codes_of_edge_cases(spark):
    rng = Random(4)
    v = lambda n=6: [rng.gauss(0, 1) for _ in range(n)]
    rows = [(1, v(), 1), (2, None, 1), (3, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (4, [float("nan")] * 6, 1), (5, [float("inf")] * 6, 2), (6, v(5), 2), (7, v(), None), (7, v(), 3), (None, v(), None)]
    rows += [(8, rows[0][1], 1)] * 2 + [(20 + i, v(), i % 3) for i in range(30)]
    assert shown(codes.compress(vectors(spark, rows))) == brute_codes(rows)
    assert shown(codes.compress(vectors(spark, [(i, [], None) for i in range(3)]))) == brute_codes([(i, [], None) for i in range(3)])
    assert codes.compress(vectors(spark, rows).where("false")).count() == 0


def test_codes_of_large_numbers(spark):
    rng = Random(5)
    rows = [(i, [rng.gauss(0, 30_000) for _ in range(4)], 0) for i in range(60)]
    assert shown(codes.compress(vectors(spark, rows), entries=9)) == brute_codes(rows, entries=9)


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(6)
    x = (rng.normal(0, 300, (3000, 8)) + rng.integers(0, 40, (3000, 1)) * 100).astype(np.int64)
    books = x[:64].copy()
    found = codes.measured_all(x, books)
    gap = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1).astype(float))
    for _ in range(3):
        new = books.copy()
        for j in range(64):
            if (found.at == j).any():
                new[j] = x[found.at == j].sum(axis=0) // (found.at == j).sum()
        packed, unit = codes._pack(found.lower)
        was = codes.Bounds(found.at, found.upper, packed * unit[:, None])
        found = codes.moved(was, x, new, gap(new, books) * (1 + codes.SLACK), gap(new[:, None], new[None]) * (1 - codes.SLACK))
        books, true = new, gap(x[:, None], new[None])
        assert (found.at == ((x[:, None] - new[None]) ** 2).sum(axis=-1).argmin(axis=1)).all()
        assert (found.lower <= true).all() and (found.upper >= true[np.arange(len(x)), found.at]).all()
        assert found.measured < 0.5 * len(x) * 64


# ---- simhash


def brute_fingerprint(text):
    data = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, fps):
    root = list(range(len(keys)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(((k, f, least.get(top(i))) for i, (k, f) in enumerate(zip(keys, fps))), key=str)


def test_simhash(docs, empty):
    found = sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == brute_components([i for i, _ in ROWS], [brute_fingerprint(t) for _, t in ROWS])
    assert simhash.near_duplicates(empty).count() == 0


def test_hashes_are_sparks(spark):
    text = "Some Words é here"
    assert spark.sql("SELECT hex(xxhash64('some words é'))").first()[0].lower() == f"{xxhash.xxh64_intdigest('some words é'.encode(), 42):016x}"
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("crowd", [1 << 14, 3])
def test_chains_lose_no_link(spark, monkeypatch, crowd):
    """Clusters of fingerprints around random ones, at all distances, many under one key; small crowds are drawn out."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = Random(7)
    fps = {0, (1 << 64) - 1}
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(12):
            new = base
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 3, 4, 4, 5])):
                new ^= 1 << b
            fps.add(new)
    low = rng.getrandbits(64)
    fps |= {low ^ rng.getrandbits(20) for _ in range(150)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in links)
    root = {f: f for f in signed}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        root[top(r.a)] = top(r.b)
    own = {}
    for f in signed:
        own.setdefault(top(f), []).append(f % (1 << 64))
    expected = {}
    for k, _, c in brute_components(list(range(len(fps))), fps):
        expected.setdefault(c, []).append(fps[k])
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, expected.values()))


# ---- phrases


def brute_phrases(rows, longest=3, least=10, best=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        data = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", data):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cands.items():
        if any(other == lang and len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in cands.items()):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, b" ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:best]))


def corpus():
    rng = Random(8)
    vocabulary = ["a", "b", "c", "d", "E", "é", "x1", "the", "of", "\x01z"]
    rows = [(None, None), ("en", ""), ("en", " \t "), ("und", "a b " * 20)]
    for i in range(300):
        words = [rng.choices(vocabulary, [40, 20, 10, 8, 6, 5, 4, 30, 25, 2])[0] for _ in range(rng.randint(0, 30))]
        rows.append((rng.choice(["en", "fr", None]), "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " "]) for w in words)))
    return [*rows, ("en", "the of " * 2000), ("en", "a a a a a a a a a a a a a")]


@pytest.mark.parametrize("longest,ranked,part", [(3, 1 << 20, 1 << 16), (3, 4, 5), (5, 3, 40)])
def test_phrases(spark, monkeypatch, longest, ranked, part):
    """Also with ranks for a few words only, and with common pivots in several parts."""
    monkeypatch.setattr(phrases, "RANKED", ranked)
    monkeypatch.setattr(phrases, "PART", part)
    rows = corpus()
    df = spark.createDataFrame([(lang, text, 1, "x", 2) for lang, text in rows], "lang string, text string, n int, phrase string, rank int").repartition(3)
    found = sorted(tuple(r) for r in phrases.collocations(df, longest=longest, best=50).collect())
    assert found == brute_phrases(rows, longest=longest, best=50)
    if longest == 3:
        every = sorted(tuple(r) for r in phrases.collocations(df).collect())
        assert every == brute_phrases(rows, best=10**9)
    assert phrases.collocations(df.where("false")).count() == 0
