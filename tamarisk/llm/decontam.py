"""Benchmark decontamination: a prefix-filtered set join of item-sized word windows, in Spark SQL functions only.

Every window of an item is a set of positioned words. Words are ordered by how rare they are in the documents;
since a hit must hold all words of a window, its rarest word is the whole necessary prefix. Document words meet
windows on that word alone; the word's place gives the only possible start, which length and position bounds and
the first and last word test before the whole window is compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm._common import stage

#: Words of a window.
WINDOW = 13
#: Bytes up to which a staged table that comes from the benchmark is broadcast; beyond it Spark shuffles both sides.
BROADCAST_BYTES = 64 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What lies between words. A-Z count as word characters here, as they are lower-cased only where words are compared.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: F.Column) -> F.Column:
    """The words of a text in order, in their own case; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def exact(text: F.Column) -> F.Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def small(staged: DataFrame) -> tuple[DataFrame, bool]:
    """A staged table, to be broadcast if its rows are counted to hold few bytes, and whether they do."""
    texts = [F.octet_length(f.name) for f in staged.schema.fields if f.dataType.typeName() == "string"]
    held = staged.agg(F.sum(sum(texts, F.lit(24 * len(staged.columns))))).first()[0] or 0
    return (F.broadcast(staged), True) if held <= BROADCAST_BYTES else (staged, False)


def windows(items: DataFrame, item: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win_id, window, length) and which items have them (win_id, item)."""
    cut = items.select(F.col(item).alias("item"), words(exact(F.col(text))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    each = stage(cut.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), size).alias("w")).select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("length")), "each")
    distinct = stage(each.select("window", "length").distinct().withColumn("win_id", F.monotonically_increasing_id()), "windows")
    return distinct, each.join(distinct, "window").select("win_id", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """For each row of docs: `key, _h, _n, n_words, n_hit, items` (array of item ids as strings, sorted as strings).

    A document word is hit if it lies inside any occurrence of an item's window; an item of fewer than `size`
    words is one window. Null and empty texts have no words and no hits, on either side. Rows are told apart by
    key and text (`_h`, `_n`: hash and length), so repeated keys are safe, and repeated rows give the same result
    each. Items with a null id hit words but name no item. An empty table on either side gives no hits. Columns
    besides key and text are not read.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).select("key", F.xxhash64("text").alias("_h"), F.coalesce(F.octet_length("text"), F.lit(-1)).alias("_n"), words(F.col("text")).alias("w"))
    distinct, held_by = windows(items, item, item_text, size)
    parts = distinct.select("win_id", F.posexplode(F.split("window", " ")).alias("off", "word")).withColumn("word", F.lower("word"))
    vocabulary, _ = small(stage(parts.select("word").distinct(), "vocabulary"))
    found = docs.select(F.explode("w").alias("word")).select(F.lower("word").alias("word")).join(vocabulary, "word").groupBy("word").agg(F.count("*").alias("seen"))
    found, _ = small(stage(found, "found"))  # no larger than the vocabulary; broadcast, the commonest word is not one task's
    rarest = parts.join(found, "word", "left").groupBy("win_id").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "word", "off")).alias("p"))
    ends = F.split("window", " ")
    prefix = rarest.where("p.seen > 0").join(distinct, "win_id").select("win_id", "window", "length", F.col("p.word").alias("word"), F.col("p.off").alias("off"), F.lower(F.element_at(ends, 1)).alias("head"), F.lower(F.element_at(ends, -1)).alias("tail"))
    prefix, is_small = small(stage(prefix, "prefix"))
    row = ["key", "_h", "_n"]
    placed = docs.select(*row, *(["w"] if is_small else []), F.posexplode("w").alias("pos", "word"))
    placed = placed.withColumn("word", F.lower("word")).join(prefix, "word")
    start = F.col("pos") - F.col("off")
    if not is_small:
        # words meet prefixes by themselves, and only the rows of documents that meet any fetch the words around
        met = stage(placed.where(start >= 0).select(*row, "win_id", "window", "length", "head", "tail", "pos", "off"), "met")
        placed = met.alias("m").join(docs.alias("t"), F.col("m.key").eqNullSafe(F.col("t.key")) & (F.col("m._h") == F.col("t._h")) & (F.col("m._n") == F.col("t._n"))).select("m.*", "t.w")
    placed = placed.where((start >= 0) & (start + F.col("length") <= F.size("w"))).where(
        (F.lower(F.get("w", start)) == F.col("head")) & (F.lower(F.get("w", start + F.col("length") - 1)) == F.col("tail")) & (exact(F.array_join(F.slice("w", start + 1, F.col("length")), " ")) == F.col("window"))
    )
    hits = stage(placed.select("key", "_h", "_n", "win_id", start.alias("begin"), (start + F.col("length")).alias("end")).distinct(), "hits")
    zero = F.struct(F.lit(0).alias("until"), F.lit(0).alias("covered"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(F.greatest(a["until"], s["end"]).alias("until"), (a["covered"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["until"], s["begin"]))).alias("covered")), lambda a: a["covered"])
    spans = hits.groupBy(row).agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans")).select(*row, covered.cast("long").alias("n_hit"))
    named = hits.select(*row, "win_id").distinct().join(held_by.where("item is not null"), "win_id").groupBy(row).agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    same = lambda a, b: (F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key"))) & (F.col(f"{a}._h") == F.col(f"{b}._h")) & (F.col(f"{a}._n") == F.col(f"{b}._n"))
    hit = spans.alias("s").join(named.alias("i"), same("s", "i"), "left").select("s.*", "i.items")
    counted = docs.select("key", "_h", "_n", F.size("w").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return counted.alias("d").join(hit.alias("h"), same("d", "h"), "left").select(F.col("d.key").alias(key), "d._h", "d._n", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))


def contaminated(share: int = 20) -> F.Column:
    """At least one word in `share` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
