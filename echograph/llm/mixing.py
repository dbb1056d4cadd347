"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's part of the whole mix; where it exceeds `most` times the source's
size, the excess is shared among the others by weight. target / size is the copies that a word of the
source gets on average: its whole part is allocated to every document for certain, its fraction f is
the mean inclusion probability of one copy more. Probabilities differ inside a source: a document of
length score g = size / (size + HALF) has

    pi = f + min(f, 1 - f) * (g - mean g),        mean g taken over the source's words,

so longer documents are likelier to be repeated, every pi is in (0, 1), and the expected words are f
times the source's. Documents are ranked by random odds divided by inclusion odds,
u (1 - pi) / ((1 - u) pi), and the first of them are taken: a sample of unequal probabilities whose
fixed size is measured in words. A document that crosses the target is taken if that brings the source
nearer to it, so a source misses its target by half a document at most.

u comes from a hash of the key (of the text where the key is null) and the seed: reruns agree. Ranks
are not sorted in one place. Each rank has a digit string; sizes are summed by source and digit, level
after level, until the digit at the cut is known, and only rows that share all digits with the cut are
ranked among each other.

Null text: size 0. Null source: a source of its own, after the others. Repeated rows share one u; they
are taken in turn. Sources without words have target 0. An empty table gives an empty result. Columns
of any name are carried along; the operator's own names begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NAME = "op9_pareto_mix"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Words at which the length score is a half; scores are whole thousandths, so that their sums are exact.
HALF, GRAIN = 200, 1_000
#: Digits of a rank: LEVELS of BITS bits each.
BITS, LEVELS = 10, 3


def uniform(name: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from md5: 48 bits, never an end point."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), name).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def name_of(key: Column, text: Column) -> Column:
    """What a document's draw hangs on: its key, or a digest of its text where it has none."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("~"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def length_score(size: Column) -> Column:
    return F.floor(size * GRAIN / (size + HALF)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from source, source_size; one row per source, so it fits one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*map(F.lit, weights))[(F.row_number().over(by_name) - 1) % len(weights)]
    t = sizes.select("source", "source_size", weight.cast("double").alias("weight"))
    t = t.withColumn("cap", (F.col("source_size") * most).cast("double"))
    # capped are those of least cap per weight: the level that the others share settles which
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everything = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    total = F.sum("source_size").over(everything) * share
    t = t.withColumn("left", total - (F.sum("cap").over(upto) - F.col("cap"))).withColumn("heavy", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
    t = t.withColumn("level", F.when(F.col("cap") / F.col("weight") > F.col("left") / F.col("heavy"), F.col("left") / F.col("heavy")))
    level = F.min("level").over(everything)
    # the first source that stays under its cap sets the level
    first = F.min_by("level", F.when(F.col("level").isNotNull(), F.col("cap") / F.col("weight"))).over(everything)
    return t.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", first * F.col("weight"))).alias("target"))


def _digit(rank: Column, level: int) -> Column:
    return F.floor(rank * F.lit(float(1 << BITS * (level + 1)))).cast("long") % (1 << BITS)


def inclusion() -> Column:
    """The probability of one copy more, from f and the mean score of the source and the row's own score."""
    return F.col("__f") + F.least(F.col("__f"), 1 - F.col("__f")) * (F.col("__g") / F.lit(float(GRAIN)) - F.col("__mean"))


def _ranked(rows: DataFrame, goal: DataFrame, seed: str) -> DataFrame:
    """rows (__name, __source, __size and others) with their source's goal, rank and digits."""
    u = uniform(F.col("__name"), seed)
    odds = (u / (1 - u)) / (F.col("__pi") / (1 - F.col("__pi")))
    met = rows.withColumn("__g", length_score(F.col("__size"))).join(goal, F.col("__source").eqNullSafe(F.col("__s")), "left").withColumn("__pi", inclusion())
    ranked = met.withColumn("__rank", F.when(F.col("__f") > 0, odds / (1 + odds)))
    return ranked.withColumns({f"__d{level}": _digit(F.col("__rank"), level) for level in range(LEVELS)})


def _here(level: int) -> Column:
    """Whether a row shares its first digits with the cut."""
    same = F.lit(True)
    for i in range(level):
        same = same & (F.col(f"__d{i}") == F.col(f"__c{i}"))
    return same


def plan(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """A row per source: __s, source_size, target, __whole, __f, __mean, __need, the digits __c0.. of its cut and what is left there (__rest).

    narrow has __name, __source, __size; it is read once per level and should be a written table.
    """
    size, ratio = F.col("source_size"), F.col("__ratio")
    sums = narrow.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("source_size"), F.sum(F.col("__size") * length_score(F.col("__size"))).alias("scores"))
    goal = targets(sums, weights, share, most).join(sums.select(F.col("source").alias("__s"), F.when(size > 0, F.col("scores") / (size * F.lit(float(GRAIN)))).otherwise(F.lit(0.0)).alias("__mean")), F.col("source").eqNullSafe(F.col("__s")))
    goal = goal.withColumn("__ratio", F.when(size > 0, F.col("target") / size).otherwise(F.lit(0.0))).withColumn("__whole", F.floor(ratio).cast("long")).withColumn("__f", ratio - F.col("__whole")).withColumn("__need", F.col("target") - F.col("__whole") * size)
    goal = common.written(goal.select("__s", "source_size", "target", "__whole", "__f", "__mean", "__need", F.col("__need").alias("__rest")), "mix-goal")
    for level in range(LEVELS):
        mine = _ranked(narrow, common.bounded(goal), seed).where((F.col("__f") > 0) & _here(level))
        words = mine.groupBy("__s", f"__d{level}").agg(F.sum("__size").alias("words"))
        until = Window.partitionBy("__s").orderBy(f"__d{level}").rowsBetween(Window.unboundedPreceding, -1)
        words = words.withColumn("before", F.coalesce(F.sum("words").over(until), F.lit(0)))
        words = words.join(common.bounded(goal.select(F.col("__s").alias("__gs"), "__rest")), F.col("__s").eqNullSafe(F.col("__gs")))
        cut = words.where((F.col("before") < F.col("__rest")) & (F.col("before") + F.col("words") >= F.col("__rest"))).select("__gs", F.col(f"__d{level}").alias(f"__c{level}"), (F.col("__rest") - F.col("before")).alias("__less"))
        goal = common.written(goal.join(cut, F.col("__s").eqNullSafe(F.col("__gs")), "left").select(*goal.columns[:-1], f"__c{level}", F.coalesce("__less", "__rest").alias("__rest")), "mix-goal")
    return goal


def apply(rows: DataFrame, goal: DataFrame, seed: str = SEED) -> DataFrame:
    """rows (__name, __source, __size and others, none of them source_size, target or copies) with source_size, target and copies."""
    at = _ranked(rows, common.bounded(goal), seed)
    digits, cuts = F.array(*[f"__d{i}" for i in range(LEVELS)]), F.array(*[f"__c{i}" for i in range(LEVELS)])
    # no cut: a source of which all is taken (rounding) or that needs nothing
    state = F.when(F.col("__rank").isNull() | (F.col("__need") <= 0), 0).when(F.col(f"__c{LEVELS - 1}").isNull(), 1).when(digits < cuts, 1).when(digits == cuts, 2).otherwise(0)
    at = at.withColumn("__state", state)
    last = Window.partitionBy("__s").orderBy("__rank", "__name", "__size").rowsBetween(Window.unboundedPreceding, -1)
    tied = at.where("__state = 2").withColumn("__before", F.coalesce(F.sum("__size").over(last), F.lit(0)))
    near = (F.col("__before") < F.col("__rest")) & (F.abs(F.col("__before") + F.col("__size") - F.col("__rest")) <= F.abs(F.col("__before") - F.col("__rest")))
    columns = [*rows.columns, "source_size", "target"]
    done = at.where("__state <> 2").select(*columns, (F.col("__whole") + F.col("__state")).alias("copies"))
    return done.unionByName(tied.select(*columns, (F.col("__whole") + near.cast("long")).alias("copies")))


def mix(df: DataFrame, size: Column, source: str = "source", key: str = "doc_id", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """df, each row as often as the mix takes it. size is an expression over df."""
    own = [F.col(c).alias(f"__own_{i}") for i, c in enumerate(df.columns)]
    rows = df.select(*own, name_of(F.col(key), F.col(text)).alias("__name"), F.col(source).alias("__source"), F.coalesce(size, F.lit(0)).cast("long").alias("__size"))
    goal = plan(common.written(rows.select("__name", "__source", "__size"), "mix"), weights, share, most, seed)
    taken = apply(rows, goal, seed).where("copies > 0").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(f"__own_{i}").alias(c) for i, c in enumerate(df.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed; weights 3, 1, 2 in turn, 150 % of all words, two copies at most."""
    text = F.col("text")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", name_of(F.col("doc_id"), text).alias("__name"), F.col("source").alias("__source"), common.word_count(text).alias("__size"))
    rows = common.written(docs, "mix")
    return apply(rows, plan(rows)).select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("copies") * F.col("__size")).alias("taken"), "copies")


ORACLE_SQL = r"""
WITH d AS (
  SELECT *, floor(size * 1000 / (size + 200))::BIGINT AS g, ((('0x' || substr(md5('mix-1:' || name), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM (SELECT doc_id, source, coalesce(doc_id::VARCHAR, '~' || md5(coalesce(text, ''))) AS name, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size, CASE WHEN sum(size) > 0 THEN sum(size * g)::DOUBLE / (sum(size)::DOUBLE * 1000.0::DOUBLE) ELSE 0 END AS mean FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER r - cap) AS remain, sum(weight) OVER () - sum(weight) OVER r + weight AS heavy
      FROM w WINDOW r AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT remain / heavy AS level FROM o WHERE cap / weight > remain / heavy ORDER BY cap / weight LIMIT 1),
t AS (SELECT source, source_size, mean, CASE WHEN (SELECT count(*) FROM l) = 0 THEN cap ELSE least(cap, (SELECT level FROM l) * weight) END AS target FROM o),
g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM t),
h AS (SELECT *, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS f, target - floor(ratio) * source_size AS need FROM g),
p AS (SELECT d.doc_id, d.name, d.size, d.u, h.*, f + least(f, 1 - f) * (g / 1000.0::DOUBLE - mean) AS pi FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
k AS (SELECT *, CASE WHEN f > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS odds FROM p),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds), name, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies
FROM (SELECT *, whole + CASE WHEN f > 0 AND need > 0 AND before < need AND abs(before + size - need) <= abs(before - need) THEN 1 ELSE 0 END AS copies FROM r)
"""
