"""Scorers: features of targets and sources to (target, source, score).

A score is a posting join: target and source rows meet on the feature, so cost follows the shared
features, not targets x sources. Absent pairs have score 0. Scores are rounded before any rank, so
the order of summation does not decide ties. Source-side statistics have a row per feature of the
sources. Where the sources have at most FEW rows they are sent to every task, so that the rows of a target
meet all its sources in one place and are summed up there; beyond that a shuffle join runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from echograph.operators import features as FG

DIGITS = 6


#: Rows of features of the sources up to which they are sent to the tasks.
FEW = 2_000_000
#: Cosines that are computed at once.
BLOCK = 200_000


def small(sources: DataFrame, rows: int = FEW) -> Callable[[DataFrame], DataFrame]:
    """What marks a table made of `sources` for broadcast, if these have few rows; else it leaves it as it is."""
    return F.broadcast if sources.limit(rows + 1).count() <= rows else lambda df: df


def _distinct(bag: DataFrame) -> DataFrame:
    """unit, f without repeats; a bag has none."""
    return bag.select("unit", "f") if "tf" in bag.columns else bag.select("unit", "f").distinct()


def _one(df: DataFrame) -> DataFrame:
    """A table of one row, to be joined with every row."""
    return F.broadcast(df)


def bm25(targets: DataFrame, sources: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 with a binary query; both are bags (unit, f, tf)."""
    sent = small(sources)
    size = sources.groupBy("unit").agg(F.sum("tf").alias("dl"))
    whole = size.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    df = sources.groupBy("f").agg(F.count(F.lit(1)).alias("df"))
    postings = sources.join(df, "f").join(size, "unit").crossJoin(_one(whole))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    postings = postings.select("f", F.col("unit").alias("source"), weight.alias("w"))
    met = targets.select(F.col("unit").alias("target"), "f").join(sent(postings), "f")
    return met.groupBy("target", "source").agg(F.round(F.sum("w"), DIGITS).alias("score"))


def cosine(targets: DataFrame, sources: DataFrame, weight: str = "tfidf", smooth: bool = False, oov: bool = True, rare: float | None = None) -> DataFrame:
    """Cosine of weighted bags. weight: tfidf or binary (idf alone); smooth: ln(1 + n/df) in place of ln(n/df).

    oov: target features that no source has count in the target's norm with the largest idf, else they
    are dropped. rare: only features in at most this share of sources.
    """
    sent = small(sources)
    n = sources.select("unit").distinct().agg(F.count(F.lit(1)).alias("n"))
    df = sources.groupBy("f").agg(F.count(F.lit(1)).alias("df"))
    if rare is not None:
        df = df.crossJoin(_one(n)).where(F.col("df") <= rare * F.col("n")).drop("n")
    idf = F.log((1 if smooth else 0) + F.col("n") / F.greatest(F.col("df"), F.lit(1)))
    tf = F.col("tf") if weight == "tfidf" else F.lit(1)

    def weighted(bag: DataFrame, how: str) -> DataFrame:
        rows = bag.join(sent(df), "f", how).withColumn("df", F.coalesce("df", F.lit(0))).crossJoin(_one(n))
        return rows.select("unit", "f", (tf * idf).alias("w"))

    t, s = weighted(targets, "left" if oov and rare is None else "inner"), weighted(sources, "inner")
    norm = lambda x: x.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = t.select(F.col("unit").alias("target"), "f", F.col("w").alias("wt")).join(sent(s.select(F.col("unit").alias("source"), "f", F.col("w").alias("ws"))), "f").groupBy("target", "source").agg(F.sum(F.col("wt") * F.col("ws")).alias("dot"))
    out = dot.join(norm(t).select(F.col("unit").alias("target"), F.col("norm").alias("nt")), "target").join(sent(norm(s).select(F.col("unit").alias("source"), F.col("norm").alias("ns"))), "source")
    return out.where("nt > 0 and ns > 0").select("target", "source", F.round(F.col("dot") / (F.col("nt") * F.col("ns")), DIGITS).alias("score"))


def shared_idf(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Sum of source idf over shared distinct features."""
    n = sources.select("unit").distinct().agg(F.count(F.lit(1)).alias("n"))
    df = FG.document_frequency(sources).crossJoin(_one(n)).select("f", F.log(F.col("n") / F.col("df")).alias("idf"))
    postings = _distinct(sources).withColumnRenamed("unit", "source").join(df, "f")
    met = _distinct(targets).withColumnRenamed("unit", "target").join(small(sources)(postings), "f")
    return met.groupBy("target", "source").agg(F.round(F.sum("idf"), DIGITS).alias("score"), F.count(F.lit(1)).alias("n_shared"), F.round(F.max("idf"), DIGITS).alias("best_idf"))


def best_ngram(targets: DataFrame, sources: DataFrame, sizes: tuple[int, ...] = (3, 4, 5, 6), least: float = 0.0) -> DataFrame:
    """Largest idf sum of a shared run of tokens, with the run; idf of tokens over sources and targets together; both are token lists (unit, ws).

    Only words of the sources can be in a shared run, so only these are counted, and a run's sum is made from the sources' runs.
    """
    words = lambda lists: FG.once(FG.word_features(lists))
    s = FG.once(FG.ngram_lists(sources, sizes)).select(F.col("unit").alias("source"), F.col("f").alias("gram"))
    sent = small(s)
    known = sent(words(sources).select("f").distinct())
    n = targets.select("ws").unionByName(sources.select("ws")).where(F.size("ws") > 0).agg(F.count(F.lit(1)).alias("n"))
    df = words(targets).join(known, "f").unionByName(words(sources)).groupBy("f").agg(F.count(F.lit(1)).alias("df"))
    idf = df.crossJoin(_one(n)).select("f", F.log(F.col("n") / F.col("df")).alias("idf"))
    grams = s.select("gram").distinct()
    worth = grams.select("gram", F.explode(F.split("gram", " ")).alias("f")).join(idf, "f").groupBy("gram").agg(F.round(F.sum("idf"), DIGITS).alias("score"))
    t = FG.each(FG.ngram_lists(targets, sizes)).select(F.col("unit").alias("target"), F.col("f").alias("gram"))
    shared = t.join(sent(s.join(worth, "gram").withColumn("n", F.size(F.split("gram", " ")))), "gram").distinct()
    best = shared.groupBy("target", "source").agg(F.max("score").alias("score"), F.max_by("gram", F.struct("score", "gram")).alias("ngram"), F.max("n").alias("longest"), F.count(F.lit(1)).alias("n_matches"))
    return best.where(F.col("score") >= least)


def longest_run(target_tok: DataFrame, source_tok: DataFrame) -> DataFrame:
    """Length of the longest common contiguous run of tokens: shared positions, islands on each diagonal."""
    met = target_tok.select(F.col("unit").alias("target"), F.col("pos").alias("p"), "w").join(source_tok.select(F.col("unit").alias("source"), F.col("pos").alias("q"), "w"), "w")
    along = Window.partitionBy("target", "source", F.col("p") - F.col("q")).orderBy("p")
    runs = met.withColumn("island", F.col("p") - F.row_number().over(along)).groupBy("target", "source", (F.col("p") - F.col("q")).alias("diagonal"), "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("target", "source").agg(F.max("n").alias("score"))


def bigram_run(target_tok: DataFrame, source_tok: DataFrame) -> DataFrame:
    """Largest idf sum over a maximal run of source positions whose bigram occurs anywhere in the target."""
    n = source_tok.select("unit").distinct().agg(F.count(F.lit(1)).alias("n"))
    idf = FG.document_frequency(source_tok.withColumnRenamed("w", "f")).crossJoin(_one(n)).select(F.col("f").alias("w"), F.log(F.col("n") / F.col("df")).alias("idf"))
    tb = FG.ngrams(target_tok, (2,)).select(F.col("unit").alias("target"), "f").distinct()
    sb = FG.ngrams(source_tok, (2,)).select(F.col("unit").alias("source"), "pos", "f")
    hits = tb.join(sb, "f").select("target", "source", "pos")
    at = hits.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("target", "source").orderBy("pos")))
    spans = at.groupBy("target", "source", "island").agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("last"))
    words = source_tok.join(idf, "w").select(F.col("unit").alias("source"), F.col("pos").alias("i"), "idf")
    inside = spans.withColumn("i", F.explode(F.sequence("first", "last"))).join(words, ["source", "i"])
    total = inside.groupBy("target", "source", "island").agg(F.sum("idf").alias("score"))
    return total.groupBy("target", "source").agg(F.round(F.max("score"), DIGITS).alias("score"))


def coverage(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Share of a source's distinct features that the target has, and their number."""
    sent = small(sources)
    s = _distinct(sources).withColumnRenamed("unit", "source")
    size = sent(s.groupBy("source").agg(F.count(F.lit(1)).alias("size")))
    met = _distinct(targets).withColumnRenamed("unit", "target").join(sent(s), "f").groupBy("target", "source").agg(F.count(F.lit(1)).alias("n_shared"))
    return met.join(size, "source").select("target", "source", "n_shared", F.round(F.col("n_shared") / F.col("size"), DIGITS).alias("score"))


def dot(x: str | Column, y: str | Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dense_cosine(targets: DataFrame, sources: DataFrame, best: str | None = None) -> DataFrame:
    """Cosine of (unit, v array) for every target and source; sources are a stated set that fits an executor.

    best: a column of the sources; instead of every source, the largest cosine with those of each of its values.
    Products are summed up dimension by dimension, as `dot` does, for blocks of targets and all sources at once.
    """
    sc = targets.sparkSession.sparkContext
    known = [r for r in sources.select("unit", "v", *([best] if best else [])).collect() if r.v is not None and None not in r.v]
    if len({len(r.v) for r in known}) > 1:
        raise ValueError("vectors of several lengths")
    u = np.array([r.v for r in known], float).reshape(len(known), len(known[0].v) if known else 0)
    norms = np.sqrt(_summed(u, u))
    known, u, norms = [r for r, n in zip(known, norms, strict=True) if n > 0], u[norms > 0], norms[norms > 0]
    names = [r[best or "unit"] for r in known]
    groups = sorted(set(names), key=lambda x: (x is None, x)) if best else []
    kind, out = targets.schema["unit"].dataType.simpleString(), sources.schema[best or "unit"].dataType.simpleString()
    name_type = to_arrow_type(sources.schema[best or "unit"].dataType)
    sent = sc.broadcast((u, norms, pa.array(groups or names, name_type), [np.array([k for k, x in enumerate(names) if x == g]) for g in groups]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, norms, names, members = sent.value
        for b in batches:
            seen = [(k, len(v)) for k, v in enumerate(b["v"].to_pylist()) if v is not None and None not in v and any(v)]
            whole = [k for k, n in seen if n == u.shape[1]]
            odd = pa.array([k for k, n in seen if n != u.shape[1]], pa.int64())  # no cosine, yet a row
            if len(odd) and len(names):
                yield pa.RecordBatch.from_arrays([b["unit"].take(odd).take(pa.array(np.repeat(np.arange(len(odd)), len(names)))), names.take(pa.array(np.tile(np.arange(len(names)), len(odd)))), pa.nulls(len(odd) * len(names), pa.float64())], ["target", best or "source", "score"])
            ids, v = b["unit"].take(pa.array(whole, pa.int64())), np.array(b["v"].take(pa.array(whole, pa.int64())).flatten().to_numpy(zero_copy_only=False), float).reshape(len(whole), u.shape[1])
            own = np.sqrt(_summed(v, v))
            for start in range(0, len(whole), max(1, BLOCK // max(1, len(u)))):
                at = np.arange(start, min(len(whole), start + max(1, BLOCK // max(1, len(u)))))
                at = at[own[at] > 0]
                x = np.zeros((len(at), len(u)))
                for d in range(u.shape[1]):
                    x += np.multiply.outer(v[at, d], u[:, d])
                x /= np.multiply.outer(own[at], norms)
                if members:
                    x = np.stack([x[:, m].max(axis=1) for m in members], axis=1)
                left = pa.array(np.repeat(at, len(names)))
                right = pa.array(np.tile(np.arange(len(names)), len(at)))
                yield pa.RecordBatch.from_arrays([ids.take(left), names.take(right), pa.array(x.ravel())], ["target", best or "source", "score"])

    rows = targets.select("unit", "v").repartition(4 * sc.defaultParallelism).mapInArrow(run, f"target {kind}, {best or 'source'} {out}, score double")
    return rows.withColumn("score", F.round("score", DIGITS))


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total
