"""Joins, unions and reshaping by name, with null keys that match and nulls that stay."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions.text import shown
from tamarisk.operators.staging import settled


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Names that a pattern occurs in, whatever their case."""
    return [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]


def span(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from one column to another, by position."""
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def snake(name: str) -> str:
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower()


def snake_names(df: DataFrame) -> DataFrame:
    """Column names in snake case, made distinct by numbers from 2 where they fall together."""
    seen: dict[str, int] = {}
    out = []
    for c in map(snake, df.columns):
        seen[c] = seen.get(c, 0) + 1
        out.append(c if seen[c] == 1 else f"{c}_{seen[c]}")
    return df.toDF(*out)


def _null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def join_suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_right") -> DataFrame:
    """Left join on named keys, null matching null. Right columns that clash get the suffix; left names stay."""
    renamed = {c: f"__key_{c}" if c in keys else (c + suffix if c in left.columns else c) for c in right.columns}
    other = right.select([F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
    joined = left.join(other, _null_safe(left, other, [(k, f"__key_{k}") for k in keys]), "left")
    return joined.drop(*[f"__key_{k}" for k in keys])


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on all shared names, in the order the left has them; null keys match null keys."""
    keys = [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("the tables share no column")
    return join_suffixed(left, right, keys)


#: Rows of one key on a side, from which an outer join deals them over several tasks.
HOT = 1 << 17


def merge_outer(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Full outer join, null matching null; the key comes once, under the left name, and right columns that clash get `_y`.

    Adaptive execution does not split skewed full outer joins. Where a side has more than HOT rows of a key, rows that
    match and the rest of either side are found apart: the rests by anti joins, which it does split, and matches of hot
    keys over a grid of parts, in which each pair of rows meets once.
    """
    renamed = {c: "__key" if c == right_key else (f"{c}_y" if c in left.columns else c) for c in right.columns}
    other = right.select([F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
    rest = [c for c in left.columns if c != left_key]
    theirs = [n for n in renamed.values() if n != "__key"]
    sizes = left.groupBy(F.col(left_key).alias("__k")).agg(F.count(F.lit(1)).alias("__l")), other.groupBy(F.col("__key").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    hot = any(s.where(F.col(n) > HOT).take(1) for s, n in zip(sizes, ("__l", "__n")))
    if not hot:
        joined = left.join(other, left[left_key].eqNullSafe(other["__key"]), "full_outer")
        key = F.coalesce(left[left_key], other["__key"]).alias(left_key)
        return joined.select(key, *[left[c] for c in rest], *[other[n] for n in theirs])
    both = sizes[0].join(sizes[1], F.col("__k").eqNullSafe(F.col("__r")))
    both = settled(both.select("__k", *[F.ceil(F.col(n) / HOT).alias(to) for n, to in (("__l", "__parts_l"), ("__n", "__parts_r"))]))
    # numbered once and for all, so that a task that runs again deals rows as before
    mine, own = (settled(df.withColumn("__at", F.monotonically_increasing_id())) for df in (left, other))
    only_left = mine.join(both, F.col(left_key).eqNullSafe(F.col("__k")), "left_anti")
    only_right = own.join(both, F.col("__key").eqNullSafe(F.col("__k")), "left_anti")
    part = lambda n: F.pmod(F.xxhash64("__at"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    x = mine.join(both, F.col(left_key).eqNullSafe(F.col("__k"))).withColumn("__a", part("__parts_l")).withColumn("__b", every("__parts_r")).select(left_key, *rest, "__a", "__b")
    y = own.join(both, F.col("__key").eqNullSafe(F.col("__k"))).withColumn("__b", part("__parts_r")).withColumn("__a", every("__parts_l")).select("__key", *theirs, "__a", "__b")
    meets = x[left_key].eqNullSafe(y["__key"]) & (x["__a"] == y["__a"]) & (x["__b"] == y["__b"])
    matched = x.join(y, meets).select(x[left_key], *[x[c] for c in rest], *[y[n] for n in theirs])
    return matched.unionByName(only_left.select(left_key, *rest), allowMissingColumns=True).unionByName(only_right.select(F.col("__key").alias(left_key), *theirs), allowMissingColumns=True)


def flag_in(df: DataFrame, key: str, other: DataFrame, other_key: str, flag: str) -> DataFrame:
    """Adds whether the key is among the other table's; false for null."""
    distinct = other.select(F.col(other_key).alias("__in")).where("__in is not null").distinct()
    return df.join(distinct, df[key] == distinct["__in"], "left").withColumn(flag, F.col("__in").isNotNull()).drop("__in")


def lookup(df: DataFrame, key: str, codes: DataFrame, origin: str, destination: str, to: str) -> DataFrame:
    """Adds a code's translation; null for unknown codes. Codes that the lookup repeats count once."""
    other = codes.groupBy(F.col(origin).alias("__code")).agg(F.min(destination).alias(to))
    return df.join(other, df[key] == other["__code"], "left").drop("__code")


def bind_rows(*frames: DataFrame) -> DataFrame:
    """All rows, by name; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def longer(df: DataFrame, columns: list[str], names_to: str = "name", values_to: str = "value") -> DataFrame:
    """Columns as rows, nulls among them."""
    return df.unpivot([c for c in df.columns if c not in columns], columns, names_to, values_to)


def wider(df: DataFrame, names_from: str, values_from: str, names: list[str]) -> DataFrame:
    """Rows as columns. Fails where a cell has two values."""
    ids = [c for c in df.columns if c not in (names_from, values_from)]
    one = F.when(F.count(F.lit(1)) <= 1, F.first(values_from)).otherwise(F.raise_error(F.lit("a cell has more than one value")))
    return df.groupBy(*ids).pivot(names_from, names).agg(one)


def separate(df: DataFrame, column: str, into: list[str], sep: str = r"\.") -> DataFrame:
    """Pieces of a text as columns; further pieces go, missing ones are null."""
    pieces = F.split(F.col(column), sep, -1)
    kept = [F.get(pieces, i).alias(n) for i, n in enumerate(into)]
    return df.select(*[c for x in df.columns for c in (kept if x == column else [F.col(f"`{x}`")])])


def unite(df: DataFrame, to: str, columns: list[str], sep: str = "_") -> DataFrame:
    """Columns pasted together, which stay; null reads NA."""
    return df.withColumn(to, F.concat_ws(sep, *[shown(F.col(c)) for c in columns]))


def row_sum(columns: list[str]) -> Column:
    """Sum over columns, null as 0; null where all are."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])
    return F.when(F.coalesce(*[F.col(c) for c in columns]).isNotNull(), total)


def drop_tag_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows without the line of # tags below the header, told by its content."""
    return df.where(F.col(column).isNull() | ~F.col(column).startswith("#"))
