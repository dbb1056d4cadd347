"""Queries of learned fusion and of operators that SQL cannot express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echograph import store
from echograph.catalog import register
from echograph.operators import learn as ML
from echograph.plans import base as B
from echograph.plans import evaluation  # noqa: F401  its inputs
from echograph.plans.common_sql import given, run

FEATURES = ["word", "bigram", "trigram"]


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates of documents with a verbatim passage, three scores and the label."""
    return run(spark, sf, "SELECT k.target, k.source, CASE WHEN g.record IS NULL THEN 0 ELSE 1 END AS label, coalesce(a.word, 0e0) AS word, coalesce(a.bigram, 0e0) AS bigram, coalesce(a.trigram, 0e0) AS trigram FROM (SELECT target, source FROM {gold_natpool} UNION SELECT target, source FROM {gold}) k LEFT JOIN {gold} g ON k.target = g.target AND k.source = g.source LEFT JOIN {pairs_gold} a ON k.target = a.target AND k.source = a.source")


@register("ml_loto")
def ml_loto(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of each correct source under models that did not see its document."""
    return ML.ranks(ML.leave_one_target_out(pool(spark, sf), FEATURES))


@register("ml_pairwise")
def ml_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    """The same with models of differences between right and wrong candidates."""
    return ML.ranks(ML.leave_one_target_out(pool(spark, sf), FEATURES, "pairwise"))


@register("ml_ablate")
def ml_ablate(spark: SparkSession, sf: str) -> DataFrame:
    """All features, each left out in turn, each alone."""
    sets = {"all": FEATURES} | {f"without {f}": [x for x in FEATURES if x != f] for f in FEATURES} | {f"only {f}": [f] for f in FEATURES}
    return ML.ablation(store.written(pool(spark, sf), "pool"), sets)


@register("ml_loo")
def ml_loo(spark: SparkSession, sf: str) -> DataFrame:
    """Detection: each document with gold scored by a model of all others, from its length and best scores."""
    units = run(spark, sf, "SELECT u.unit, u.y, ln(u.len + 1) AS len, coalesce(m.word, 0e0) AS word, coalesce(m.bigram, 0e0) AS bigram FROM {units} u LEFT JOIN {tops} m ON u.unit = m.target")
    return ML.leave_one_out(units, ["len", "word", "bigram"])


@register("ml_heldout")
def ml_heldout(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on the documents of a third of the sources, applied to those of each of the others and of all these together; with what random order would give."""
    rows = store.written(pool(spark, sf).join(given(spark, sf, "units").select(F.col("unit").alias("target"), "chapter"), "target").withColumn("part", F.pmod(F.crc32(F.col("chapter").cast("binary")), F.lit(3))), "pool")
    fused = ML.held_out(rows.where("part = 0"), rows.where("part <> 0"), FEATURES)
    own = Window.partitionBy("target")
    placed = fused.withColumn("pos", F.row_number().over(own.orderBy(F.desc("fused"), "source"))).withColumn("size", F.count(F.lit(1)).over(own)).withColumn("right", F.sum("label").over(own))
    best = placed.where("label = 1").groupBy("chapter", "target").agg(F.min("pos").alias("pos"), ((F.max("size") + 1) / (F.max("right") + 1)).alias("chance"))
    figures = [F.count(F.lit(1)).alias("n"), F.percentile("pos", F.lit(0.5)).alias("median_rank"), F.round(F.avg(F.log("pos")), 6).alias("mean_ln_rank"), F.round(F.avg("chance"), 6).alias("chance_rank")]
    return best.groupBy("chapter").agg(*figures).unionByName(best.agg(*figures).withColumn("chapter", F.lit("pooled")))


@register("sc_contain")
def sc_contain(spark: SparkSession, sf: str) -> DataFrame:
    """Containment of the passage in the document, by words and by characters, for pairs that share a trigram."""
    parts = given(spark, sf, "s3").select("target", "source").join(B.sources(spark, sf).withColumnsRenamed({"unit": "source", "text": "part"}), "source")
    sent = parts.groupBy("target").agg(F.collect_list(F.struct("source", "part")).alias("parts"))
    return ML.contained(B.spread(B.targets(spark, sf)).withColumnRenamed("unit", "target").join(sent, "target"))


@register("ln_iso")
def ln_iso(spark: SparkSession, sf: str) -> DataFrame:
    """Score less its isotonic expectation from length, and the same over the isotonic size of these residuals."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    best = given(spark, sf, "best").select("unit", "score", F.col("len").cast("double").alias("len"))
    rows = VectorAssembler(inputCols=["len"], outputCol="features").transform(best)
    model = IsotonicRegression(labelCol="score", featuresCol="features").fit(rows)
    left = model.transform(rows).withColumn("residual", F.col("score") - F.col("prediction")).withColumn("size", F.abs("residual")).drop("prediction")
    scale = IsotonicRegression(labelCol="size", featuresCol="features").fit(left)
    return scale.transform(left).select("unit", F.round("residual", 6).alias("residual"), F.round(F.col("residual") / F.greatest("prediction", F.lit(1e-3)), 4).alias("z"))


@register("fg_pc1")
def fg_pc1(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors without their first principal component, of length one."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    from echograph.operators.scorers import dot

    v = B.read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pc = PCA(k=1, inputCol="x", outputCol="y").fit(v.select(array_to_vector("v").alias("x"))).pc.toArray()[:, 0].tolist()
    axis = F.array(*map(F.lit, pc))
    less = v.withColumn("p", dot("v", axis)).withColumn("u", F.zip_with("v", axis, lambda a, b: a - b * F.col("p")))
    return less.withColumn("n", F.sqrt(dot("u", "u"))).select("vec_id", F.transform("u", lambda a: F.round(a / F.col("n"), 6)).alias("v"))


@register("fg_maxpool", "SELECT label, i AS dim, round(max(embedding[i + 1]::DOUBLE), 6) AS x FROM embeddings, (SELECT unnest(range(0, 64)) AS i) GROUP BY label, i")
def fg_maxpool(spark: SparkSession, sf: str) -> DataFrame:
    """Largest value of each dimension among the vectors of a label."""
    rows = B.read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.max(F.col("x").cast("double")), 6).alias("x"))
