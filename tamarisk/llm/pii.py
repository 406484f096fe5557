"""Format-preserving Feistel pseudonyms for personal data and secrets.

Numbers, dates, addresses and keys are found by pattern, checked by their own rules (Luhn, mod 97, octets, calendar),
and put through a keyed permutation of all values of the same format. One value has one surrogate in every
document, so links between documents stay; different values of a format never meet; each surrogate passes the
check its original passed and is as long.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b, shake_256
from ipaddress import AddressValueError, IPv6Address

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tamarisk.llm._common import bound_batches, slices

FEISTEL_ROUNDS = 10
#: Dates are permuted among the days of these years.
YEARS = (1900, 2099)


@lru_cache(maxsize=1000)
def _shuffled(n: int, key: bytes, tweak: str) -> tuple[int, ...]:
    """range(n) in the order of its values' keyed digests."""
    return tuple(sorted(range(n), key=lambda v: blake2b(f"{tweak}|{n}|{v}".encode(), key=key, digest_size=16).digest()))


def permute(value: int, left: int, right: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(left * right): an alternating Feistel network over Z_left x Z_right.

    A half of one value would leave a network nothing but a shift, so there the few values are put in a keyed order.
    """
    if min(left, right) == 1 and left * right <= 4096:
        return _shuffled(left * right, key, tweak)[value]
    a, b = divmod(value, right)
    for i in range(FEISTEL_ROUNDS):
        half = b if i % 2 == 0 else a
        noise = int.from_bytes(blake2b(f"{tweak}|{i}|{left}|{right}|{half}".encode(), key=key, digest_size=32).digest(), "big")
        if i % 2 == 0:
            a = (a + noise) % left
        else:
            b = (b + noise) % right
    return a * right + b


def permute_symbols(symbols: list[int], radices: list[int], key: bytes, tweak: str) -> list[int]:
    """The same over sequences whose i-th symbol is below radices[i] (65,536 at most), in time that grows with their length.

    The halves are sequences too: in each round every symbol of one is shifted by noise of its own, drawn from a
    digest of the whole other half, so that each place hangs on all others however long the value is.
    """
    if len(radices) < 2:
        return [_shuffled(r, key, tweak)[s] for s, r in zip(symbols, radices)]
    half = len(radices) // 2
    sizes = np.array(radices, np.uint64)
    value = np.array(symbols, np.uint64)
    sides = (value[:half], sizes[:half]), (value[half:], sizes[half:])
    begun = blake2b(f"{tweak}|{len(radices)}|".encode(), key=key, digest_size=32)
    begun.update(sizes.astype("<u2").tobytes())
    for i in range(FEISTEL_ROUNDS):
        (own, radix), (other, _) = sides if i % 2 == 0 else sides[::-1]
        digest = begun.copy()
        digest.update(bytes([i]) + other.astype("<u2").tobytes())
        noise = np.frombuffer(shake_256(digest.digest()).digest(8 * len(own)), "<u8")
        own[:] = (own + noise % radix) % radix
    return value.tolist()


# Alphabets that characters are permuted within.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_OF = {c: (alphabet, i) for alphabet in _ALPHABETS for i, c in enumerate(alphabet)}


def permute_text(text: str, key: bytes, tweak: str) -> str:
    """Letters and digits within their kind and case; all else stays in place."""
    at = [i for i, c in enumerate(text) if c in _OF]
    if not at:
        return text
    shape = "".join("9aA"[_ALPHABETS.index(_OF[text[i]][0])] for i in at)
    symbols = permute_symbols([_OF[text[i]][1] for i in at], [len(_OF[text[i]][0]) for i in at], key, f"{tweak}|{shape}")
    out = list(text)
    for i, s in zip(at, symbols):
        out[i] = _OF[text[i]][0][s]
    return "".join(out)


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c in _ALPHABETS[0]]


def _put_digits(text: str, digits: list[int]) -> str:
    new = iter(digits)
    return "".join(str(next(new)) if c in _ALPHABETS[0] else c for c in text)


def luhn(digits: list[int]) -> int:
    """The check digit that makes digits + [it] valid."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _card(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if luhn(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = d[:1] + permute_symbols(d[1:-1], [10] * (len(d) - 2), key, f"card|{len(d)}|{d[0]}")
    return _put_digits(text, [*body, luhn(body)])


def _phone(text: str, key: bytes) -> str | None:
    d = _digits(text)
    if not 8 <= len(d) <= 15:
        return None
    north = (text.startswith("+1") and len(d) == 11) or (not text.startswith("+") and len(d) == 10)
    kept = len(d) - 10 if north else (len(_digits(re.match(r"\+\d{1,3}", text)[0])) if text.startswith("+") else 0)
    body = d[kept:]
    lows = [2 if north and i in (0, 3) else 0 for i in range(len(body))]
    if any(x < low for x, low in zip(body, lows)):  # not in use as a number, and told apart from those that are
        while True:
            body = permute_symbols(body, [10] * len(body), key, "phone|unassigned")
            if any(x < low for x, low in zip(body, lows)):
                return _put_digits(text, d[:kept] + body)
    new = permute_symbols([x - low for x, low in zip(body, lows)], [10 - low for low in lows], key, f"phone|{'north' if north else len(body)}")
    return _put_digits(text, d[:kept] + [x + low for x, low in zip(new, lows)])


def _ssn(text: str, key: bytes) -> str | None:
    valid = lambda d: (a := d[0] * 100 + d[1] * 10 + d[2]) not in (0, 666) and a < 900 and any(d[3:5]) and any(d[5:])
    d = _digits(text)
    if not valid(d):
        return None
    while True:  # walks along the permutation's cycle to the next valid number
        d = permute_symbols(d, [10] * 9, key, "ssn")
        if valid(d):
            return _put_digits(text, d)


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    lows, sizes = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
    shape = [len(p) for p in parts]
    new = permute_symbols([int(p) - lows[n] for p, n in zip(parts, shape)], [sizes[n] for n in shape], key, f"ip|{shape}")
    return ".".join(str(x + lows[n]) for x, n in zip(new, shape))


_FIRST, _DAYS = date(YEARS[0], 1, 1).toordinal(), date(YEARS[1], 12, 31).toordinal() - date(YEARS[0], 1, 1).toordinal() + 1
_SIDE = int(_DAYS**0.5) + 1


def _date(text: str, key: bytes) -> str | None:
    fields = re.findall(r"\d+", text)
    if len(fields[0]) == 4:
        order = (0, 1, 2)
    elif int(fields[1]) > 12 or (text.count("/") == 2 and int(fields[0]) <= 12):
        order = (2, 0, 1)  # month first
    else:
        order = (2, 1, 0)
    y, m, d = (int(fields[i]) for i in order)
    try:
        day = date(y, m, d).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= day < _DAYS:
        return None

    def shown(n: int) -> str | None:
        new = date.fromordinal(_FIRST + n)
        out = [""] * 3
        for i, x in zip(order, (new.year, new.month, new.day)):
            out[i] = str(x).zfill(len(fields[i]))
        if [len(x) for x in out] != [len(x) for x in fields]:
            return None
        if order[0] == 2 and "/" in text and (order[1] == 0) != (int(out[1]) > 12 or int(out[0]) <= 12):
            return None  # would be read in the other order
        rest = iter(out)
        return re.sub(r"\d+", lambda _: next(rest), text)

    while True:
        day = permute(day, _SIDE, _SIDE, key, f"date|{order}")
        if day < _DAYS and (out := shown(day)):
            return out


def _ip6(text: str, key: bytes) -> str | None:
    try:
        IPv6Address(text)
    except AddressValueError:
        return None
    groups = re.split("(:+)", text.lower())
    digits = [(g, i) for g, group in enumerate(groups) for i, c in enumerate(group) if c != ":"]
    padded = ["0" if len(g) > 1 and g[0] == "0" else "" for g in groups]  # such a zero stays, and no other comes to be
    lows = [1 if i == 0 and len(groups[g]) > 1 and not padded[g] else 0 for g, i in digits]
    sizes = [1 if i == 0 and padded[g] else 16 - low for (g, i), low in zip(digits, lows)]
    shape = ",".join(g if ":" in g else f"{len(g)}{zero}" for g, zero in zip(groups, padded))
    new = permute_symbols([int(groups[g][i], 16) - low for (g, i), low in zip(digits, lows)], sizes, key, f"ip6|{shape}")
    drawn = iter(f"{x + low:x}" for x, low in zip(new, lows))
    out = "".join(":" if c == ":" else next(drawn) for c in text)
    return out.upper() if text != text.lower() else out


def _iban(text: str, key: bytes) -> str | None:
    value = lambda s: int("".join(str(int(c, 36)) for c in s))
    packed = text.replace(" ", "")
    if not 15 <= len(packed) <= 34 or value(packed[4:] + packed[:4]) % 97 != 1:
        return None
    body = permute_text(packed[4:], key, f"iban|{packed[:2]}")  # the case of letters stays
    new = iter(packed[:2] + f"{98 - value(body + packed[:2] + '00') % 97:02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


def _email(text: str, key: bytes) -> str | None:
    local, domain = text.rsplit("@", 1)
    labels = domain.split(".")
    return permute_text(local, key, "local") + "@" + ".".join([*(permute_text(x, key, "label") for x in labels[:-1]), labels[-1]])


def _key_id(text: str, key: bytes) -> str | None:
    return text[:4] + permute_text(text[4:], key, "key")


def _secret(text: str, key: bytes) -> str | None:
    mark = text[-1]
    if mark not in "\"'":
        begin = _BARE_VALUE.match(text).start("value")
        return text[:begin] + permute_text(text[begin:], key, "secret")
    begin = text.index(mark, 0, len(text) - 1) + 1
    return text[:begin] + permute_text(text[begin:-1], key, "secret") + mark


#: Names of secrets; a value without quotes is told from prose by its digits and letters together.
_SECRET_NAME = r"(?i:token|secret|password|passwd|api[_\-]?key)[\"']? ?[=:] ?"
_BARE_VALUE = re.compile(_SECRET_NAME + r"(?P<value>(?=[A-Za-z_+/=.~!#$%^&*\-]*\d)(?=[\d_+/=.~!#$%^&*\-]*[A-Za-z])[A-Za-z0-9_+/=.~!#$%^&*\-]{7,}[A-Za-z0-9_+/=])(?![\"'])", re.ASCII)


#: Kinds in the order in which they are tried where several begin.
RULES: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "email": (r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}", _email),
    "secret": (r"(?i:token|secret|password|passwd|api[_\-]?key)[\"']? ?[=:] ?(?P<mark>[\"'])[^\"'\s]{16,}(?P=mark)", _secret),
    "key": (r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|xox[abprs]-[A-Za-z0-9\-]{10,255})(?![A-Za-z0-9])", _key_id),
    "iban": (r"(?<![A-Za-z0-9])(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}[a-z0-9]{11,30})(?![A-Za-z0-9])", _iban),
    "ip6": (r"(?<![A-Za-z0-9:.])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])|(?<![A-Za-z0-9:.])(?=[0-9A-Fa-f:]*\d)(?=(?:::?[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}::?){3})(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![A-Za-z0-9:])", _ip6),
    "ip": (r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)", _ip),
    "date": (r"(?<![\d/.\-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/\-]|\.\d)", _date),
    "ssn": (r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])", _ssn),
    "card": (r"(?<![\d\-])\d(?:[ \-]?\d){12,18}(?![\d\-])", _card),
    "phone": (r"(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|(?<![\d.])\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4})(?!\d)", _phone),
}
#: Kinds that are looked for on their own, as their beginnings are common.
_APART = ("email", "secret")
_NUMERIC = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, (pattern, _) in RULES.items() if kind not in _APART), re.ASCII)
#: What every secret holds in lower case, and every key as it is; one of them is asked for before the search.
_SECRET_WORDS = ("token", "secret", "password", "passwd", "api")
_KEY_WORDS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox")
_EMAIL = re.compile(RULES["email"][0], re.ASCII)
_DIGIT = re.compile("[0-9]")
_GROUP = re.compile("[0-9]+")
_PRINTED = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{4,5})(?![0-9])")
_SINGLE = {kind: re.compile(pattern, re.ASCII) for kind, (pattern, _) in RULES.items()}


#: Characters of a value up to which its surrogate is remembered, so that what a worker holds is bounded.
_REMEMBERED = 256


@lru_cache(maxsize=100_000)
def _short_surrogate(kind: str, text: str, key: bytes) -> str | None:
    return RULES[kind][1](text, key)


def surrogate(kind: str, text: str, key: bytes) -> str | None:
    """The pseudonym, or None where the text breaks the kind's own rules."""
    return _short_surrogate(kind, text, key) if len(text) <= _REMEMBERED else RULES[kind][1](text, key)


def _tries(text: str, at: int) -> Iterator[tuple[str, int, int]]:
    """What may begin here: each kind at its longest, then cards of fewer digit groups, as other numbers may follow a card."""
    for kind in RULES:
        if kind not in _APART and (m := _SINGLE[kind].match(text, at)):
            yield kind, at, m.end()
    if m := _SINGLE["card"].match(text, at):
        ends = [x.end() for x in _GROUP.finditer(text, at, m.end())]
        n = len(_digits(m[0]))
        for end, after in zip(ends[-2::-1], ends[:0:-1]):
            n -= len(_digits(text[end:after]))
            if n < 13:
                break
            later = (_PRINTED.match(text, x.start()) for x in _GROUP.finditer(text, at + 1, end))
            if _PRINTED.fullmatch(text, at, end) or not any(x and x.end() > end and _card(x[0], b"") for x in later):
                yield "card", at, end  # unless it is a chance hit that cuts off the end of a card as they are printed


def find(text: str, key: bytes) -> list[tuple[str, int, int, str]]:
    """Valid (kind, begin, end, surrogate) in order, none overlapping; begin and end in characters."""
    found = []
    if "@" in text:
        at = 0
        while (sign := text.find("@", at)) >= 0:
            begin = sign
            while begin > at and text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
                begin -= 1
            m = _EMAIL.match(text, begin)
            if m and begin < sign:
                found.append(("email", m.start(), m.end(), surrogate("email", m[0], key)))
                at = m.end()
            else:
                at = sign + 1
    lower = text.lower()
    if any(word in lower for word in _SECRET_WORDS):
        emails, inside, secrets = found, set(), []
        begins = [x[1] for x in emails]
        quoted = list(_SINGLE["secret"].finditer(text))
        begins_quoted = {m.start() for m in quoted}
        bare = [m for m in _BARE_VALUE.finditer(text) if m.start() not in begins_quoted]
        outer, at = [], 0
        for m in sorted([*quoted, *bare], key=lambda m: m.start()):
            if m.start() >= at:  # a name inside another's value goes with it
                outer.append(m)
                at = m.end()
        for m in outer:
            # an address inside a secret goes with it; a name of a secret that ends an address stays with the address
            i = bisect_right(begins, m.start())
            begin = max(m.start(), emails[i - 1][2] if i else 0)
            secrets.append(("secret", begin, m.end(), surrogate("secret", m[0], key)[begin - m.start() :]))
            inside.update(range(i, bisect_right(begins, m.end())))
        found = [x for i, x in enumerate(emails) if i not in inside] + secrets
    if _DIGIT.search(text) or any(word in text for word in _KEY_WORDS):
        spans = sorted({(b, e) for _, b, e, _ in found})
        begins = [b for b, _ in spans]
        free = lambda b, e: (i := bisect_right(begins, e - 1)) == 0 or spans[i - 1][1] <= b
        pos = 0
        while m := _NUMERIC.search(text, pos):
            pos = m.start() + 1  # where nothing holds, the search goes on inside
            for kind, begin, end in _tries(text, m.start()):
                if free(begin, end) and (new := surrogate(kind, text[begin:end], key)) is not None:
                    found.append((kind, begin, end, new))
                    pos = end
                    break
    return sorted(found, key=lambda x: x[1])


def replace(text: str, found: list[tuple[str, int, int, str]]) -> str:
    out, at = [], 0
    for _, begin, end, new in found:
        out += [text[at:begin], new]
        at = end
    return "".join([*out, text[at:]]) if found else text


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str | None = "entities") -> DataFrame:
    """All columns of docs, the text with surrogates in place.

    `spans`: a column of (kind, begin, end, surrogate), in characters of the text; one of that name is replaced.
    Null texts stay null and have null spans, empty ones stay empty; texts are read whole. Each row stands for
    itself, so repeated rows come out alike. An empty table gives no rows. The same key gives the same surrogates in every table and run.
    """
    if not 1 <= len(key) <= 64:
        raise ValueError("the key has 1 to 64 bytes")
    bound_batches(docs.sparkSession)
    entity = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("surrogate", T.StringType())]))
    schema = T.StructType([f for f in docs.schema.fields if f.name != spans] + ([T.StructField(spans, entity)] if spans else []))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            values = batch.column(text).to_pylist()
            found = [None if v is None else find(v, key) for v in values]
            arrays = {n: batch.column(n) for n in batch.schema.names if n != spans}
            arrays[text] = pa.array([None if v is None else replace(v, f) for v, f in zip(values, found)], pa.string())
            if spans:
                arrays[spans] = pa.array([None if f is None else [dict(zip(("kind", "begin", "end", "surrogate"), x)) for x in f] for f in found], kind)
            yield pa.RecordBatch.from_pydict(arrays)

    return docs.mapInArrow(work, schema)
