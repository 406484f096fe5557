import heapq
import random
import re
import textwrap
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from edge_cases import ROWS

from tamarisk.llm import decontam, licenses, shards


def heap_takes(loads, size, n):
    heap, taken = [(x, s) for s, x in enumerate(loads)], [0] * len(loads)
    heapq.heapify(heap)
    for _ in range(n):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        taken[s] += 1
    return taken


def test_takes_are_those_of_a_heap():
    random.seed(3)
    for _ in range(300):
        loads = [random.randint(0, 60) for _ in range(random.randint(1, 9))]
        size, n = random.randint(1, 30), random.randint(1, 90)
        assert shards.takes(np.array(loads), size, n).tolist() == heap_takes(loads, size, n)


def test_loads_are_those_of_a_heap(spark, monkeypatch):
    """Loads of shards against a heap over all groups, one by one, with sizes up to 100,000 bytes."""
    monkeypatch.setattr(shards, "HELD", 50)
    random.seed(4)
    texts = ["x" * random.choice([random.randint(0, 40), random.randint(0, 3000), random.randint(50_000, 100_000)]) + str(random.randint(0, 9)) for _ in range(600)]
    rows = shards.shard_by_size(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 7).collect()
    got = [sum(r.size for r in rows if r.shard == s) for s in range(7)]
    loads = [0] * 7
    for size in sorted((sum(16 + len(t) for t in texts if t == u) for u in set(texts)), reverse=True):
        loads[loads.index(min(loads))] += size
    assert got == loads


def test_shards(docs, empty):
    rows = shards.shard_by_size(docs, 4).collect()
    assert len(rows) == len(ROWS)
    slots, places = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        places[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(p) == 1 for p in places.values())
    want = sorted((-1 if i is None else i, 16 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode())) for i, t in ROWS)
    assert sorted(((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows), key=str) == sorted(want, key=str)
    assert shards.shard_by_size(empty, 4).count() == 0


def test_licenses(spark, empty):
    mit = "Copyright (c) 2020 Someone\n" + licenses.TEXTS["MIT"].upper().replace("SUBLICENSE", "sub-licence").replace(", ", "  ,\n")
    rows = [(1, mit), (2, "text\nReleased under the MIT Licence\nLicensed under CC BY-NC 4.0."), (3, None), (4, ""), (4, "released under the mit license!"), (5, "nothing"), (5, "nothing")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, license string")
    found = licenses.scan(frame, licenses.known(spark)).collect()
    got = sorted(((r.doc_id, r.whole_license, r.n_license_lines, r.line_licenses) for r in found), key=str)
    assert got == sorted([(1, "MIT", 0, ""), (2, None, 2, "CC-BY-NC-4.0,MIT"), (3, None, 0, ""), (4, None, 0, ""), (4, "MIT", 1, "MIT"), (5, None, 0, ""), (5, None, 0, "")], key=str)
    assert licenses.scan(empty, licenses.known(spark)).count() == 0


def test_licenses_bring_a_line_to_its_form_once(spark):
    """In the optimized plan, one form of whole texts and one of lines; a filter on digests must not hold another."""
    docs = spark.createDataFrame([(1, "text\n\nMIT License")], "doc_id long, text string")
    out = licenses.scan(docs, licenses.known(spark))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sub-license") == 2
    assert [(r.whole_license, r.n_license_lines) for r in out.collect()] == [(None, 1)]


def test_licenses_in_full(spark):
    """As files hold them: wrapped, with and without title, copyright and reserved rights; texts from outside the package where the system has them."""
    wrap = lambda t: "\n\n".join(textwrap.fill(x, 76, break_on_hyphens=False) for x in t.split("\n"))
    body = {k: licenses.TEXTS.get(k) for k in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense")}
    titles = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Unlicense": "The Unlicense"}
    owner = "Copyright (c) 2020, Some One"
    rows = [(k, f"{head}{wrap(t or '')}\n") for k, t in body.items() for head in ("", f"{owner}\n\n", f"{titles[k]}\n\n{owner}\n\n", f"{titles[k]}\n\n{owner}\nAll rights reserved.\n\n")]
    rows += [(k, textwrap.fill(t or "", width, break_on_hyphens=False)) for k, t in body.items() for width in (60, 66, 72, 80, 100)]
    for k, name in [("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("LGPL-2.0", "LGPL-2"), ("LGPL-2.1", "LGPL-2.1"), ("GPL-1.0", "GPL-1"), ("MPL-1.1", "MPL-1.1"), ("GFDL-1.2", "GFDL-1.2"), ("GFDL-1.3", "GFDL-1.3"), ("Artistic-1.0", "Artistic"), ("BSD-3-Clause", "BSD")]:
        path = Path("/usr/share/common-licenses", name)
        text = (path if path.exists() else Path(licenses.__file__).parent / "license_texts" / f"{k}.txt").read_text()
        rows += [(k, text), (k, text.replace("[yyyy]", "2020"))]
    text = Path(licenses.__file__).parent.joinpath("license_texts", "Apache-2.0.txt").read_text()
    rows += [("Apache-2.0", text[text.index("TERMS AND") : text.index("APPENDIX")]), (None, text.replace("Grant of Patent", "Grant of No Patent")), (None, "MIT License\n\nnothing else")]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.whole_license for r in licenses.scan(frame, licenses.known(spark)).collect()} == {i: k for i, (k, _) in enumerate(rows)}


def test_licenses_as_source_files_hold_them(spark):
    """Curly quotes, bullets for numbers, items on one line, and comment blocks of several styles with their copyright line."""
    mit, bsd = licenses.TEXTS["MIT"], licenses.TEXTS["BSD-3-Clause"]
    wrapped = lambda t, mark: "\n".join(f"{mark}{line}" for x in t.split("\n") for line in textwrap.wrap(x, 60, break_on_hyphens=False))
    owned = lambda t: "MIT License\nCopyright (c) 2020 Some One\n" + t
    curly = mit.replace('"Software"', "\u201cSoftware\u201d").replace('"AS IS"', "\u00abAS IS\u00bb")
    bullets = re.sub(r"(?m)^\d\. ", "* ", bsd)
    rows = [("MIT", curly), ("BSD-3-Clause", bullets), ("BSD-3-Clause", bullets.replace("* ", "\u2022 ")), ("BSD-3-Clause", re.sub(r"(?m)^(\d)\. ", r"(\1) ", bsd)), ("BSD-3-Clause", bsd.replace("\n", " ")), ("BSD-3-Clause", wrapped(bsd, " * "))]
    rows += [("MIT", f"/*\n{wrapped(owned(mit), ' * ')}\n */")] + [("MIT", wrapped(owned(mit), mark)) for mark in ("# ", "// ", "-- ", ";; ", "% ")]
    rows += [(None, "GPL version 2."), ("GPL-2.0", "Licensed under GNU General Public License, version 2."), ("GPL-3.0", "Licensed under GNU General Public License, version 3.")]
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.whole_license for r in licenses.scan(frame, licenses.known(spark)).collect()} == {i: k for i, (k, _) in enumerate(rows)}


def plain_form(text):
    """A text without copyright lines, in equivalent spellings, lower case and single blanks, made line by line and word by word."""
    kept = []
    for line in (text or "").lower().split("\n"):
        bare = line.lstrip("".join(c for c in map(chr, range(128)) if not c.isalnum() and c not in "\n"))
        bare = "(c)" if line.lstrip(" \t*#/-;%").startswith("(c)") else bare
        follows = bare[len("copyright") :].strip(" \t").split(" ")[0].rstrip(".,;:") if bare.startswith("copyright") else None
        is_statement = bare.startswith(("(c)", "©")) or follows is not None and not (bare[len("copyright") : len("copyright") + 1] in (" ", "\t") and re.fullmatch(r"(notice|holder|owner|interest|law)s?\b.*", follows))
        kept.append("" if is_statement else line)
    out = "\n".join(kept)
    # numbers of items: behind the end of a sentence, or at the beginning
    words, ended = [], True
    for piece in re.split(r"(\s+)", out):
        number = piece.strip("".join(c for c in map(chr, range(128)) if not c.isalnum()))
        if ended and re.fullmatch(r"[^0-9a-z]*\d\d?[.)]", piece):
            piece = piece.replace(number, "").replace(".", " ").replace(")", " ")
        if piece.strip() and not re.fullmatch(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]*", piece):
            ended = re.search(r"[.:;][\x00-\x2f\x3a-\x60\x7b-\x7f]*$", piece) is not None
        elif re.search("[.:;]", piece):
            ended = True
        words.append(piece)
    out = "".join(words)
    for form, to in licenses.SPELLINGS:
        out = to.join(out.split(form))
    odd = {*range(0xA0, 0xC0), *range(0x2000, 0x2070), *range(0x25A0, 0x2600), *range(0x3000, 0x3040), 0xFEFF}
    return " ".join(x for x in "".join(c if (c.isalnum() or ord(c) > 127) and ord(c) not in odd else " " for c in out).split(" ") if x)


def test_licenses_by_brute_force(spark, sf_dir):
    rows = [(r.license, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("'' AS license", "text").collect()]
    known = {}
    for name, text in [*licenses.TEXTS.items(), *licenses.full_texts(), *((k, form.format(name)) for k, names in licenses.NAMES.items() for name in names for form in licenses.NOTICES)]:
        known[plain_form(text)] = min(name, known.get(plain_form(text), name))
    want = []
    for _, text in rows:
        found = [known[f] for line in (text or "").split("\n") if (f := plain_form(line)) and f in known]
        want.append((known.get(plain_form(text)) if plain_form(text) else None, len(found), ",".join(sorted(set(found)))))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: (r.whole_license, r.n_license_lines, r.line_licenses) for r in licenses.scan(docs, licenses.known(spark)).collect()}
    assert [got[i] for i in range(len(rows))] == want and sum(n for _, n, _ in want) > 0


def brute(rows, items):
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[k : k + 13])].add(i)
    out = []
    for i, t in rows:
        w, hit, names = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    names |= {str(x) for x in found if x is not None}
        out.append((i, len(w), len(hit), ",".join(sorted(names))))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_decontamination(spark, docs, empty, monkeypatch, most):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", most)
    items = [(1, "two words"), (2, ROWS[0][1][:200].upper()), (10, ROWS[0][1][:200]), (3, None), (4, ""), (None, "seven eight nine"), (5, "éa ÉA"), (6, "never seen here")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contamination(docs, benchmark).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in found), key=str) == brute(ROWS, items)
    assert decontam.contamination(empty, benchmark).count() == 0
    assert {r.n_hit for r in decontam.contamination(docs, benchmark.where("false")).collect()} == {0}
