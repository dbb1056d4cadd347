"""Reproducible shuffle and sharding by a Feistel permutation over global row numbers.

Rows are numbered 0 to n - 1 by a fixed order: a hash bucket of the key, then the key, then the other
columns asked for. The number depends on the data alone, not on partitions or retries. A generalised
Feistel network permutes a x b >= n cells, where a and b are about sqrt(n); cells beyond n are walked
through again (cycle walking). The place p of a row gives shard p mod shards and slot p div shards,
so shard sizes are at most one apart, slots are gapless, and the row of a given shard and slot can be
computed backwards.

All of it is DataFrame expressions. The one table that is broadcast holds a row per bucket, BUCKETS
at most. Null keys are one key; repeated rows get numbers of their own; an empty table gives an empty
result. All columns are kept; shard, slot and place replace input columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NAME = "op2_feistel_shards"
SHARDS = 40
SEED = 20_240_601
ROUNDS = 6
#: Hash buckets of the numbering: tasks at most; offsets to broadcast.
BUCKETS = 4096
#: Steps of cycle walking. At most a - 1 cells lie beyond n, so 64 steps always do up to 4096 rows;
#: beyond that the chance to need more is under (1/64)^64 a row, and such a row raises an error.
WALK = 64


def numbered(df: DataFrame, key: str, ties: list[str], into: str) -> DataFrame:
    """df with its global row number (from 0) in column `into`."""
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(BUCKETS)).cast("int")
    counts = df.select(bucket.alias("__bucket")).groupBy("__bucket").count()
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"))
    order = [F.col(c).asc_nulls_first() for c in [key, *ties]]
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    held = df.withColumn("__bucket", bucket).withColumn("__within", within)
    return held.join(F.broadcast(offsets), "__bucket").withColumn(into, F.col("__offset") + F.col("__within") - 1).drop("__bucket", "__within", "__offset")


def sides(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and a * b - n < a."""
    a = max(1, int(n**0.5))
    return a, max(1, -(-n // a))


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over cell x: rounds change the left and the right half in turn."""
    start = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
    noise = lambda half, i, m: F.pmod(F.xxhash64(half, i, F.lit(seed)), F.lit(m))

    def turn(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 0, F.pmod(s["l"] + noise(s["r"], i, a), F.lit(a))).otherwise(s["l"])
        right = F.when(i % 2 == 0, s["r"]).otherwise(F.pmod(s["r"] + noise(s["l"], i, b), F.lit(b)))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["r"] * a + s["l"])


def permuted(x: Column, n: int, seed: int = SEED) -> Column:
    """The place of row number x among n."""
    a, b = sides(n)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.lit(-1).cast("long"), lambda p, i: F.when((p >= 0) & (p < n), p).otherwise(_network(F.when(p < 0, x).otherwise(p), a, b, seed)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walking ended early")).cast("long"))


def assign(df: DataFrame, shards: int = SHARDS, key: str = "doc_id", ties: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """df with place, shard and slot."""
    n = df.count()
    df = df.drop(*[c for c in ("place", "shard", "slot") if c in df.columns])
    placed = numbered(df, key, ties or [], "__row").withColumn("place", permuted(F.col("__row"), max(n, 1), seed)).drop("__row")
    return placed.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.floor(F.col("place") / shards).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law `rows`."""
    text = F.col("text")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    return assign(docs, SHARDS, ties=["size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLE_SQL = None
