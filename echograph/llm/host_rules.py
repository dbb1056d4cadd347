"""Quality rules on documents, and host-level rules from their failures.

Rules of a document: too few words, or too many words inside five-word windows that occur twice or
more. Failures are summed by host; a beta prior is fitted to the hosts' rates by moments, each host's
rate is shrunk towards it, and documents of hosts whose shrunk rate exceeds `most` go as well.

All of it is DataFrame expressions. A window is told by the 64-bit hash of its words. Counting within
a document sorts its windows and takes memory in proportion to that document. Failures are partly
summed in each task before the shuffle; verdicts are broadcast only if their number is bounded.

Null text: no words, so base_failed. Null hosts are one host. Repeated rows count each time. An empty
table gives an empty result; one host alone gets its own rate as the prior's mean. judge() carries no
columns other than key, text and host; keep() keeps all, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

NAME = "op10_host_rules"
WINDOW = 5
LEAST_WORDS = 10
REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: Shrunk failure rate beyond which a host's documents all go.
MOST = 0.5
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 1_000.0)


def _long(c: Column) -> Column:
    return c.cast("long")


def features(df: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", window: int = WINDOW, mark: bool = False) -> DataFrame:
    """key, host, [__mark,] n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = df.select(F.col(key).alias("key"), F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"), *([_mark(text, host).alias("__mark")] if mark else []))
    t = t.withColumn("words", F.filter(F.split("t", common.GAP), lambda w: w != ""))
    t = t.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(common.WORD)))
    t = t.withColumn("n", F.size("words"))
    starts = F.when(F.col("n") >= window, F.sequence(F.lit(1), F.greatest(F.col("n") - (window - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    # two uses of each array below keep the optimizer from computing it again for each element
    t = t.withColumn("grams", F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, window))))
    t = t.withColumn("repeats", F.size("grams") > F.size(F.array_distinct("grams")))
    t = t.withColumn("sorted", F.when(F.col("repeats"), F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    after = F.zip_with("sorted", F.slice("sorted", 2, F.size("sorted")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    t = t.withColumn("same", F.when(F.col("repeats"), after))
    twice = F.zip_with("same", F.concat(F.array(F.lit(False)), F.slice("same", 1, F.size("same") - 1)), lambda a, b: a | b)
    at = F.filter(F.zip_with("sorted", twice, lambda s, yes: F.when(yes, s["i"])), lambda i: i.isNotNull())
    t = t.withColumn("at", F.when(F.col("repeats"), F.array_sort(at)))
    steps = F.zip_with("at", F.slice("at", 2, F.size("at")), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
    covered = F.when(F.col("repeats"), F.aggregate(steps, F.lit(0), lambda s, x: s + x)).otherwise(0)
    return t.select(
        "key",
        "host",
        *(["__mark"] if mark else []),
        _long(F.col("n")).alias("n_words"),
        _long(F.length(F.regexp_replace("t", common.GAP, ""))).alias("word_chars"),
        _long(F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        _long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        _long(covered).alias("n_repeat_words"),
    )


def failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < LEAST_WORDS) | (100 * F.col(n_repeat_words) > REPEATED_PERCENT * F.col(n_words))


def verdicts(judged: DataFrame, most: float = MOST) -> DataFrame:
    """host, docs, failures, host_rate (shrunk), host_ok from host and base_failed."""
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    # moments over hosts, weighted by documents: mean m and variance v of the rate give the strength m (1 - m) / v - 1
    rate = F.col("failures") / F.col("docs")
    sums = hosts.agg(F.sum("docs").alias("n"), F.sum("failures").alias("k"), F.sum(F.col("docs") * rate * rate).alias("q"), F.count(F.lit(1)).alias("hosts"), F.sum(1 / F.col("docs")).alias("inv"))
    m = F.col("k") / F.col("n")
    spread = F.greatest(F.col("q") / F.col("n") - m * m - m * (1 - m) * F.col("hosts") / F.col("n"), F.lit(0.0))
    strength = F.when(spread > 0, m * (1 - m) / spread - 1).otherwise(F.lit(STRENGTH[1]))
    prior = sums.where("n > 0").select(m.alias("mean"), F.greatest(F.least(F.round(strength, 6), F.lit(STRENGTH[1])), F.lit(STRENGTH[0])).alias("strength"))
    shrunk = (F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("docs") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "docs", "failures", shrunk.alias("host_rate"), (shrunk <= most).alias("host_ok"))


def judge(df: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", most: float = MOST, mark: bool = False) -> DataFrame:
    """key, host, the features, base_failed, host_rate and kept. The features go to the shared folder once."""
    found = common.written(features(df, text, key, host, mark=mark).withColumn("base_failed", failed()), "host-rules")
    by_host = common.bounded(common.written(verdicts(found, most), "host-verdicts").select(F.col("host").alias("vh"), "host_rate", "host_ok"))
    joined = found.join(by_host, F.col("host").eqNullSafe(F.col("vh")), "left")
    return joined.select(F.col("key").alias(key), F.col("host"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_ok")).alias("kept"), *(["__mark"] if mark else []))


def _mark(text: str, host: str) -> Column:
    """A digest of what a row is judged by."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(host))


def keep(df: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", most: float = MOST) -> DataFrame:
    """df without the documents that judge() rejects, row by row: of two texts under one key each goes or stays by itself."""
    judged = judge(df, text, key, host, most, mark=True)
    gone = common.written(judged.where("not kept").select(F.col(key).alias("__gone"), F.col("__mark").alias("__gone_mark")).distinct(), "rejected", df.count())
    same = F.col(key).eqNullSafe(F.col("__gone")) & (_mark(text, host) == F.col("__gone_mark"))
    return df.join(common.bounded(gone, common.BROADCAST_IDS), same, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document judged."""
    return judge(common.table(spark, sf_dir, "documents")).drop("host", "host_rate")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, hash(array_to_string(list_slice(ws, i, i + 4), ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, sum(least(5, n)) AS covered FROM (SELECT doc_id, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5) AS n FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, w.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM f),
h AS (SELECT source, count(*) AS docs, sum(base_failed::INT) AS failures FROM b GROUP BY source),
p AS (SELECT sum(failures) / sum(docs) AS m, sum(docs * (failures / docs) * (failures / docs)) / sum(docs) AS q, count(*) / sum(docs) AS hn FROM h),
s AS (SELECT m, greatest(q - m * m - m * (1 - m) * hn, 0) AS spread FROM p),
a AS (SELECT m, greatest(least(CASE WHEN spread > 0 THEN round(m * (1 - m) / spread - 1, 6) ELSE 1000 END, 1000), 1) AS strength FROM s),
v AS (SELECT source, (failures + m * strength) / (docs + strength) <= 0.5 AS host_ok FROM h, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND host_ok) AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
