"""Ranks, percentiles and top-k over (target, source, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tie_rank(scores: DataFrame, group: str = "target", score: str = "score") -> DataFrame:
    """Average rank of ties among the rows that are there."""
    by = Window.partitionBy(group)
    rank = F.rank().over(by.orderBy(F.desc(score))) + (F.count(F.lit(1)).over(Window.partitionBy(group, score)) - 1) / 2.0
    return scores.withColumn("tie_rank", rank.cast("double"))


def top_k(scores: DataFrame, k: int, group: str = "target", score: str = "score", tie: str = "source") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))
    return scores.withColumn("__n", rank).where(F.col("__n") <= k).drop("__n")


def gold_rank(scores: DataFrame, gold: DataFrame, n_sources: int | Column) -> DataFrame:
    """record, rank, hit: average-tie rank of a record's best correct source among all sources.

    gold has record, target, source. Absent pairs score 0: a zero's rank is the middle of the zero block,
    computed from the number of positive scores instead of filling in the zeros.
    """
    n = F.lit(n_sources) if isinstance(n_sources, int) else n_sources
    positive = scores.where("score > 0")
    per_target = positive.groupBy("target").agg(F.count(F.lit(1)).alias("n_pos"))
    ranked = tie_rank(positive).select("target", "source", "score", "tie_rank")
    best = gold.join(ranked, ["target", "source"], "left").groupBy("record", "target").agg(F.min("tie_rank").alias("tie_rank"))
    joined = best.join(per_target, "target", "left").withColumn("n_pos", F.coalesce("n_pos", F.lit(0)))
    zero = F.col("n_pos") + (n - F.col("n_pos") + 1) / 2.0
    return joined.select("record", F.coalesce("tie_rank", zero).cast("double").alias("rank"), F.col("tie_rank").isNotNull().alias("hit"))


def percentiles(scores: DataFrame, group: str = "target", score: str = "score", tie: str = "source") -> DataFrame:
    """pct_order (position / n), pct_average ((average rank - 1) / (n - 1)), pct_below (share strictly below)."""
    by = Window.partitionBy(group)
    n = F.count(F.lit(1)).over(by)
    low = by.orderBy(score)
    average = F.rank().over(low) + (F.count(F.lit(1)).over(Window.partitionBy(group, score)) - 1) / 2.0
    return scores.select(
        "*",
        F.round((F.row_number().over(by.orderBy(score, tie)) - 1) / n, 6).alias("pct_order"),
        F.round((average - 1) / F.greatest(n - 1, F.lit(1)), 6).alias("pct_average"),
        F.round((F.rank().over(low) - 1) / n, 6).alias("pct_below"),
    )


def quantile_bin(order: list[Column], bins: int) -> Column:
    """least(bins - 1, floor(position * bins / n)): the remainder goes to the last bins, unlike ntile."""
    whole = Window.partitionBy()
    position = F.row_number().over(whole.orderBy(*order)) - 1
    return F.least(F.lit(bins - 1), F.floor(position * bins / F.count(F.lit(1)).over(whole)).cast("int"))


def capped_top(scores: DataFrame, cap: int, top: int, by: str = "target", score: str = "score", tie: tuple[str, ...] = ("target", "source")) -> DataFrame:
    """The best `top` rows overall with at most `cap` of each `by`."""
    mine = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), *tie))
    return scores.withColumn("__n", mine).where(F.col("__n") <= cap).drop("__n").orderBy(F.desc(score), *tie).limit(top)


def carry_forward(value: str, partition: str, order: list[str]) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def islands(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Runs of consecutive integers: group, first, last, n."""
    run = F.col(value) - F.row_number().over(Window.partitionBy(*group).orderBy(value))
    return df.select(*group, value).distinct().withColumn("island", run).groupBy(*group, "island").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count(F.lit(1)).alias("n")).drop("island")
