"""Sharding by longest processing time: groups of equal texts, largest first, each to the least-loaded shard.

Groups are not placed one by one on the driver. Groups of one size are alike to the rule, so the driver sees only
(size, number of groups), largest first and a few at a time, and gives each size its quota of each shard: a heap of
loads that is popped n times for groups of one size takes the n least of all load + j * size, ties to the smaller
shard, which is found by bisection. The groups then take their places within the quotas on Spark. Sizes are exact,
and the loads are those of a heap over all groups.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tamarisk.llm._common import stage

#: Groups of one size that one task ranks at most, on average; those of more frequent sizes are dealt in parts.
RANKED = 500_000
#: Quotas that the driver holds at once.
HELD = 50_000
#: Rows of one shard that one task numbers, on average.
NUMBERED = 500_000


def takes(loads: np.ndarray, size: int, n: int) -> np.ndarray:
    """How many of n groups of one size each shard takes, if each group goes to the least-loaded shard, ties to the smaller one."""
    taken = np.zeros(len(loads), np.int64)
    if n == 1 or not size:
        taken[loads.argmin()] = n
        return taken
    below = lambda level: np.maximum(0, -((loads - level) // size))  # noqa: E731  places of each shard that are lower than the level
    lo = int(loads.min())
    hi = lo + size * n
    while lo < hi:  # the highest level with no more than n places below it
        middle = (lo + hi + 1) // 2
        lo, hi = (middle, hi) if below(middle).sum() <= n else (lo, middle - 1)
    taken = below(lo)
    at_level = np.flatnonzero((loads <= lo) & ((lo - loads) % size == 0))
    taken[at_level[: n - taken.sum()]] += 1
    return taken


def quotas(classes: DataFrame, shards: int) -> DataFrame:
    """(_size, _part, _shards, _ends): for groups of a size, the shards that take them and where each one's run of ranks ends."""
    schema = T.StructType([T.StructField("_size", T.LongType()), T.StructField("_part", T.IntegerType()), T.StructField("_shards", T.ArrayType(T.IntegerType())), T.StructField("_ends", T.ArrayType(T.LongType()))])
    loads, done, held = np.zeros(shards, np.int64), [], []

    def put() -> None:
        rows = pd.DataFrame({f.name: [r[i] for r in held] for i, f in enumerate(schema.fields)})
        done.append(stage(classes.sparkSession.createDataFrame(rows if held else [], schema), "quotas"))
        held.clear()

    for size, part, n in classes.orderBy(F.desc("_size"), "_part").select("_size", "_part", "n").toLocalIterator():
        taken = takes(loads, size, n)
        loads += taken * size
        used = np.flatnonzero(taken)
        held.append((size, part, used.tolist(), np.cumsum(taken[used]).tolist()))
        if len(held) >= HELD:
            put()
    put()
    return reduce(DataFrame.unionByName, done)


def shard_by_size(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Shard and slot of each row: `key, size, text_crc32, law, shard, slot, grown_shard, group_bytes`.

    Size is the text's UTF-8 bytes (none for null) plus `overhead`. Rows with equal texts stay together; null
    texts are one group, empty texts another, and a null text has a null checksum. A group larger than a fair
    share makes its shard larger, for it can't be split. Slots number each shard's rows from 0 without gaps;
    repeated rows and null keys get slots like any other. An empty table gives no rows. Other columns of the
    input are not read.
    """
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(overhead).cast("long")
    digest = F.coalesce(F.unhex(F.md5(F.col(text).cast("binary"))), F.lit(b"").cast("binary"))
    rows = stage(docs.select(F.col(key).alias("_key"), size.alias("size"), F.crc32(F.col(text).cast("binary")).alias("text_crc32"), digest.alias("_digest")), "rows")
    groups = stage(rows.groupBy("_digest", "size").agg(F.count("*").alias("_rows")).select("_digest", "_rows", (F.col("size") * F.col("_rows")).alias("_size")), "groups")
    counted = groups.groupBy("_size").agg(F.count("*").alias("n"))
    parts = 1 + max([0, *(r[0] or 0 for r in counted.agg(F.max("n")).collect())]) // RANKED
    part = F.pmod(F.xxhash64("_digest"), F.lit(parts)).cast("int")
    places = quotas(groups.groupBy("_size", part.alias("_part")).agg(F.count("*").alias("n")), shards)
    ranked = groups.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy("_size", "_part").orderBy("_digest")) - 1)
    placed = ranked.join(places, ["_size", "_part"]).select("_digest", F.col("_size").alias("group_bytes"), F.element_at("_shards", F.size(F.filter("_ends", lambda end: end <= F.col("_rank"))) + 1).alias("shard"))
    dealt = stage(rows.join(placed, "_digest").drop("_digest"), "dealt")
    runs = 1 + rows.count() // NUMBERED
    run = F.pmod(F.xxhash64("_key", "text_crc32"), F.lit(16 * runs)).cast("int")
    dealt = dealt.withColumn("_run", run)
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs_of = dealt.groupBy("shard", "_run").agg(F.count("*").alias("_n")).select("shard", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("shard", "_run").orderBy("_key", "text_crc32")) - 1
    return dealt.withColumn("_at", within).join(runs_of, ["shard", "_run"]).select(F.col("_key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_base") + F.col("_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_bytes")
