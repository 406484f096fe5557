"""Exact ranks and medians of groups of any size.

Values are counted first, as equal ones need one row only. Groups whose distinct values fit a sort in one task go
through a window. Where one has more, all rows are dealt by ranges of (group, value), each part is counted, and a part
begins from the counts of those before it; equal values are one row, so no tie crosses from one part into the next.

Rows are written and counted before they are dealt, and a task gets some ROWS of them whatever the number of shuffle
partitions is set to, so that its memory does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tamarisk.operators.staging import settled

#: Distinct values of a group that one task may sort.
SORTED = 1 << 20
#: Rows, one for each value, that a task gets on average.
ROWS = 1 << 18
#: Files that so many rows are written to at least.
FILES = 4


def parts_for(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))


def binned(df: DataFrame, parts: int, by: list[Column]) -> DataFrame:
    """df dealt by a hash, kept as __bin: what is grouped by __bin and more stays where it is."""
    return df.withColumn("__bin", F.pmod(F.xxhash64(*by), F.lit(16 * parts))).repartition(parts, "__bin")


def counted(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> tuple[DataFrame, int]:
    """How many rows of each group have a value: keys, __which (column), __v (null for unknown), n; and tasks for them.

    Rows are dealt evenly and counted within a task, then by value, so that a value that many rows have is few rows in
    the task where its counts meet. The tasks that deal them hold what they read until it is sorted by receiver, and so
    read small files.
    """
    wide = settled(df.select(*keys, *[value.alias(f"__v{i}") for i, value in enumerate(columns.values())]), plain=True, rows=ROWS // FILES)
    parts = parts_for(df, wide.count() * len(columns))
    pairs = F.array(*[F.struct(F.lit(name).alias("which"), F.col(f"__v{i}").alias("v")) for i, name in enumerate(columns)])
    long = binned(wide, parts, [F.monotonically_increasing_id()]).select(*keys, "__bin", F.explode(pairs).alias("__p"))
    here = long.select(*keys, "__bin", F.col("__p.which").alias("__which"), F.col("__p.v").alias("__v")).groupBy(*keys, "__bin", "__which", "__v").agg(F.count(F.lit(1)).alias("n"))
    group = [*keys, "__which", "__v"]
    return settled(binned(here.drop("__bin"), parts, [F.col(c) for c in group]).groupBy("__bin", *group).agg(F.sum("n").alias("n")).drop("__bin"), plain=True), parts


def counted_before(known: DataFrame, keys: list[str], value: str, parts: int) -> DataFrame:
    """Of counted known values: keys, value, n, before (rows of the group with smaller ones), __total (rows of the group)."""
    whole = Window.partitionBy(*keys)
    large = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("__d")).where(F.col("__d") > SORTED).take(1)
    if not large:
        own = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        dealt = known.repartition(parts, *keys) if keys else known
        return dealt.withColumns({"before": F.coalesce(F.sum("n").over(own), F.lit(0).cast("long")), "__total": F.sum("n").over(whole)})
    parts = max(2, known.sparkSession.sparkContext.defaultParallelism, known.count() // SORTED)
    dealt = settled(known.repartitionByRange(parts, *keys, value).withColumn("__part", F.spark_partition_id()))
    # one row for each part of a group
    totals = dealt.groupBy(*keys, "__part").agg(F.sum("n").alias("__n"))
    ahead = Window.partitionBy(*keys).orderBy("__part")
    before = F.coalesce(F.sum("__n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    total = F.sum("__n").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    totals = totals.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keys)], F.col("__part").alias("__p"), before.alias("__ahead"), total.alias("__total"))
    own = Window.partitionBy(*keys, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    here = dealt.withColumn("__own", F.coalesce(F.sum("n").over(own), F.lit(0).cast("long")))
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    return here.join(totals, same).select(*keys, value, "n", (F.col("__own") + F.col("__ahead")).alias("before"), "__total")


def medians(df: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """Exact median of each column (by new name) over the known values of each group; null where there are none."""
    found, parts = counted(df, keys, {name: value.cast("double") for name, value in columns.items()})
    placed = counted_before(found.where("__v is not null"), [*keys, "__which"], "__v", parts)
    low, high = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
    picked = placed.select(*keys, "__which", "__v", holds(low).alias("__low"), holds(high).alias("__high")).where("__low or __high")
    # groups of unknown values only have a row too
    picked = picked.unionByName(found.where("__v is null").select(*keys, "__which", "__v", F.lit(False).alias("__low"), F.lit(False).alias("__high")))
    picked = picked.repartition(parts, *keys) if keys else picked
    middle = [F.max(F.when((F.col("__which") == name) & F.col(f"__{side}"), F.col("__v"))).alias(f"__{side}_{i}") for i, name in enumerate(columns) for side in ("low", "high")]
    mean = lambda a, b: F.when(a == b, a).otherwise((a + b) / 2)
    return picked.groupBy(*keys).agg(*middle).select(*keys, *[mean(F.col(f"__low_{i}"), F.col(f"__high_{i}")).alias(name) for i, name in enumerate(columns)])


def ranked(df: DataFrame, keys: list[str], value: str, to: str = "rank") -> DataFrame:
    """Adds the ascending rank within `keys` (all rows, where there are none), ties given the mean of their places; null for null."""
    found, parts = counted(df, keys, {value: F.col(value)})
    known = found.where("__v is not null").select(*keys, F.col("__v").alias(value), "n")
    ranks = counted_before(known, keys, value, parts).select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keys)], F.col(value).alias("__value"), (F.col("before") + (F.col("n") + 1) / 2).alias(to))
    same = F.col(value) == F.col("__value")
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"__{i}"))
    return df.join(ranks, same, "left").select(*[F.col(c) for c in df.columns if c != to], to)
