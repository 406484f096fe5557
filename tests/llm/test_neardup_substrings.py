import re

import pytest
from edge_cases import BASE, ROWS

from tamarisk.llm import neardup, substrings


def words(text, lower=True):
    data = (text or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", data.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) if lower else data)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return sorted(((rows[i][0], len(sets[i]), least[root[i]], rows[i][0] == least[root[i]]) for i in range(len(rows))), key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()), key=str)


def test_near_duplicates(docs, empty):
    assert found(docs) == brute_components(ROWS)
    assert neardup.near_duplicates(empty).count() == 0


def test_crowds(spark, monkeypatch):
    """A group whose copies differ more and more, and texts that share a passage; all bands go by rare shingles."""
    monkeypatch.setattr(neardup, "PAIRWISE", 1)
    monkeypatch.setattr(neardup, "CHUNK", 700)
    rows = []
    for i in range(60):
        w = BASE.split()
        for j in range(i % 6):
            w[(13 * j + 5) % 120] = f"own{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, BASE[:200] + " " + " ".join(f"t{i}w{k}" for k in range(40))) for i in range(40)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute_components(rows)


def test_registers_agree_as_often_as_sets():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(1, 2**63, 4000).astype(np.uint64)
    for n in (4, 40, 4000):
        got = np.mean([neardup.estimate(neardup.sketch(a[: 3 * n // 4]), neardup.sketch(a)) for a in (rng.choice(pool, n, replace=False) for _ in range(20))])
        assert got == pytest.approx(0.75, abs=0.06)


def brute_repeats(rows):
    least = {}
    for i, t in rows:
        w = words(t, lower=False)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t, lower=False)
        gone = {p for k in range(len(w) - 49) if i is not None and least.get(tuple(w[k : k + 50]), i) < i for p in range(k, k + 50)}
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("group", "table"), [(1 << 18, 500_000), (1, 500_000), (1, 0)])
def test_repeats(docs, empty, monkeypatch, group, table):
    monkeypatch.setattr(substrings, "GROUP_BYTES", group)
    monkeypatch.setattr(substrings, "TABLE", table)
    got = substrings.drop_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=str) == brute_repeats(ROWS)
    assert all(sum(s.end - s.begin for s in r.spans) == r.n_removed for r in got)
    if group > 1:
        assert substrings.drop_repeats(empty).count() == 0


def test_suffix_trees():
    """Order and common prefixes of random suffixes, against sorted tuples."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(30):
        rows = [rng.integers(0, rng.integers(2, 4), rng.integers(55, 120)) for _ in range(4)]
        rows += [np.concatenate([rows[0][5:60], rng.integers(0, 3, 30)])]
        first = np.cumsum([0, *map(len, rows)])
        starts = np.concatenate([np.arange(a, b - 49) for a, b in zip(first[:-1], first[1:])])
        ends = np.repeat(first[1:], np.diff(first))
        every = np.concatenate(rows).astype(np.uint64)
        groups = np.repeat([0, 1, 0, 1, 0], [len(r) - 49 for r in rows])
        order, common = substrings.suffix_tree(every, ends, starts, groups)
        text = lambda i: tuple(every[starts[i] : ends[starts[i]]].tolist())
        keys = [(groups[i], text(i)[:64]) for i in order]
        assert keys == sorted(keys) and common[0] == 0
        for x, y, c in zip(order[:-1], order[1:], common[1:]):
            lcp = next((k for k, (p, q) in enumerate(zip(text(x), text(y))) if p != q), min(len(text(x)), len(text(y))))
            assert c == (min(lcp, 95) if groups[x] == groups[y] else 0)
