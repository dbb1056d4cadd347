"""Shared inputs of the queries, for both engines: documents are the targets, benchmark passages the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.functions import text as T
from echograph.operators import features as FG


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def targets(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").alias("unit"), "text")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("unit"), "text")


#: Documents of a partition whose rows stay together.
UNITS_A_PART = 4_000
ROWS_A_PART = 500_000


def spread(units: DataFrame) -> DataFrame:
    """Units dealt out by id, a bounded number a partition: what is then counted or joined by unit or by pair is not shuffled again."""
    parts = max(units.sparkSession.sparkContext.defaultParallelism, -(-units.count() // UNITS_A_PART))
    return units.repartition(parts, "unit")


def together(pairs: DataFrame, key: str) -> DataFrame:
    """Rows of pairs dealt out by one of their keys, a bounded number a partition."""
    parts = max(pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // ROWS_A_PART))
    return pairs.repartition(parts, key)


def target_lists(spark: SparkSession, sf: str, together: bool = False) -> DataFrame:
    units = targets(spark, sf)
    return FG.word_lists(spread(units) if together else units)


def source_lists(spark: SparkSession, sf: str) -> DataFrame:
    return FG.word_lists(sources(spark, sf))


def target_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return FG.token_table(targets(spark, sf))


def source_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return FG.token_table(sources(spark, sf))


def stem_tokens(units: DataFrame) -> DataFrame:
    return FG.token_table(units).withColumn("w", T.stem(F.col("w")))


#: SQL twins: token tables tt and st (unit, pos, w) over tables d and b (unit, text).
UNITS = """d AS (SELECT doc_id AS unit, text FROM documents), b AS (SELECT item_id AS unit, text FROM benchmark)"""


def tokens_sql(name: str, of: str) -> str:
    return rf"""{name} AS (SELECT unit, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w
  FROM (SELECT unit, regexp_extract_all(lower(text), '\p{{L}}{{2,}}') AS ws FROM {of}))"""


TOKENS = f"{UNITS}, {tokens_sql('tt', 'd')}, {tokens_sql('st', 'b')}"


def lead_sql(k: int) -> str:
    return f"lead(w, {k}) OVER (PARTITION BY unit ORDER BY pos)"


def ngrams_sql(name: str, of: str, sizes: tuple[int, ...]) -> str:
    parts = [f"SELECT unit, pos, {n} AS n, " + " || ' ' || ".join(["w", *[lead_sql(k) for k in range(1, n)]]) + f" AS f FROM {of}" for n in sizes]
    return f"{name} AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE f IS NOT NULL)"


def skip_sql(name: str, of: str) -> str:
    parts = [f"SELECT unit, w, {lead_sql(k)} AS v FROM {of}" for k in (1, 2, 3)]
    return f"{name} AS (SELECT unit, least(w, v) || ' ' || greatest(w, v) AS f FROM ({' UNION ALL '.join(parts)}) WHERE v IS NOT NULL)"


def char_sql(name: str, of: str, n: int = 4) -> str:
    return rf"""{name} AS (SELECT unit, substr(t, i, {n}) AS f FROM (SELECT unit, t, unnest(range(1, greatest(length(t) - {n - 1}, 1) + 1)) AS i
  FROM (SELECT unit, ' ' || trim(regexp_replace(lower(text), '\s+', ' ', 'g')) || ' ' AS t FROM {of})))"""


def edges_sql(name: str, of: str) -> str:
    return f"""{name} AS (SELECT c.unit, h.w AS head, CASE WHEN c.pos % 2 = 0 THEN 'even' ELSE 'odd' END AS rel, c.w AS child, h.pos AS p, c.pos AS c
  FROM {of} c JOIN {of} h ON c.unit = h.unit AND c.pos > 0 AND h.pos = (c.pos - 1) // 2)"""


def bag_sql(name: str, of: str) -> str:
    return f"{name} AS (SELECT unit, f, count(*) AS tf FROM {of} GROUP BY ALL)"


def cosine_sql(t: str, s: str, weight: str = "tfidf", smooth: bool = False, oov: bool = True, rare: float | None = None) -> str:
    tf = "tf" if weight == "tfidf" else "1"
    idf = f"ln({'1 + ' if smooth else ''}(SELECT count(DISTINCT unit) FROM {s})::DOUBLE / greatest(coalesce(df, 0), 1))"
    keep = f"HAVING count(*) <= {rare} * (SELECT count(DISTINCT unit) FROM {s})" if rare is not None else ""
    how = "LEFT JOIN" if oov and rare is None else "JOIN"
    return f"""cdf AS (SELECT f, count(*) AS df FROM {s} GROUP BY f {keep}),
cwt AS (SELECT unit, x.f, {tf} * {idf} AS w FROM {t} x {how} cdf ON x.f = cdf.f),
cws AS (SELECT unit, x.f, {tf} * {idf} AS w FROM {s} x JOIN cdf ON x.f = cdf.f),
cnt AS (SELECT unit, sqrt(sum(w * w)) AS nt FROM cwt GROUP BY unit), cns AS (SELECT unit, sqrt(sum(w * w)) AS ns FROM cws GROUP BY unit),
cdot AS (SELECT a.unit AS target, b.unit AS source, sum(a.w * b.w) AS dot FROM cwt a JOIN cws b ON a.f = b.f GROUP BY ALL),
score AS (SELECT target, source, round(dot / (nt * ns), 6) AS score FROM cdot JOIN cnt ON target = cnt.unit JOIN cns ON source = cns.unit WHERE nt > 0 AND ns > 0)"""


def bm25_sql(t: str, s: str, k1: float = 1.2, b: float = 0.75) -> str:
    return f"""blen AS (SELECT unit, sum(tf) AS dl FROM {s} GROUP BY unit), bn AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM blen), bdf AS (SELECT f, count(*) AS df FROM {s} GROUP BY f),
post AS (SELECT x.f, x.unit AS source, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl)) AS w
  FROM {s} x JOIN bdf ON x.f = bdf.f JOIN blen ON x.unit = blen.unit, bn),
score AS (SELECT x.unit AS target, source, round(sum(w), 6) AS score FROM {t} x JOIN post ON x.f = post.f GROUP BY ALL)"""
