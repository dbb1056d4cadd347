"""Queries of text sources: pages, notes, paragraphs, sentences, chunks, and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.catalog import register
from echograph.functions import text as T
from echograph.plans import base as B
from echograph.streaming import events as EV


@register("io_chunk", f"WITH {B.UNITS}, {B.tokens_sql('tt', 'd')} SELECT unit, pos // 128 AS chunk, count(*) AS n, string_agg(w, ' ' ORDER BY pos) AS words FROM tt GROUP BY ALL")
def io_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 128 tokens."""
    w = T.tokens(F.col("text"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("ws") - 1, F.lit(0)), F.lit(128)), lambda s: F.slice("ws", s + 1, 128))
    rows = B.targets(spark, sf).select("unit", w.alias("ws")).where(F.size("ws") > 0).select("unit", F.posexplode(cut).alias("chunk", "part"))
    return rows.select("unit", "chunk", F.size("part").cast("long").alias("n"), F.array_join("part", " ").alias("words"))


@register("io_paras", r"SELECT conv_id, count(*) AS n_lines, string_agg(text, ' ' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id")
def io_paras(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return B.read(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(lines, lambda x: x["text"]), " ").alias("text"))


@register("io_sink", "SELECT doc_id, translate(text, chr(9) || chr(10) || chr(13), '   ') AS t FROM documents")
def io_sink(spark: SparkSession, sf: str) -> DataFrame:
    return B.read(spark, sf, "documents").select("doc_id", T.one_line(F.col("text")).alias("t"))


@register("pf_refparse", r"""WITH r AS (SELECT n_nationkey AS k, 'PSA.' || n_nationkey || '.3-7;MAT.1.' || (n_nationkey + 2) || ';bad' AS refs FROM nation),
p AS (SELECT k, unnest(string_split(refs, ';')) AS ref FROM r) SELECT k, split_part(ref, '.', 1) AS book, split_part(ref, '.', 2)::INT AS chapter, split_part(split_part(ref, '.', 3), '-', 1)::INT AS v_from, coalesce(nullif(split_part(split_part(ref, '.', 3), '-', 2), ''), split_part(ref, '.', 3))::INT AS v_to
FROM p WHERE regexp_full_match(ref, '[A-Z0-9]+\.\d+\.\d+(-\d+)?')""")
def pf_refparse(spark: SparkSession, sf: str) -> DataFrame:
    """References `A.1.2-5;B.3.4` as rows; what does not parse is left out."""
    refs = F.concat(F.lit("PSA."), F.col("n_nationkey"), F.lit(".3-7;MAT.1."), F.col("n_nationkey") + 2, F.lit(";bad"))
    rows = B.read(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.explode(F.split(refs, ";")).alias("ref")).where(F.col("ref").rlike(r"^[A-Z0-9]+\.\d+\.\d+(-\d+)?$"))
    at = lambda i: F.regexp_extract("ref", r"^([A-Z0-9]+)\.(\d+)\.(\d+)(?:-(\d+))?$", i)
    return rows.select("k", at(1).alias("book"), at(2).cast("int").alias("chapter"), at(3).cast("int").alias("v_from"), F.coalesce(F.nullif(at(4), F.lit("")), at(3)).cast("int").alias("v_to"))


@register("ev_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ev_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    return EV.windowed_counts(B.read(spark, sf, "events"))


@register("ev_session", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k")
def ev_session(spark: SparkSession, sf: str) -> DataFrame:
    return EV.sessions(B.read(spark, sf, "events"))
