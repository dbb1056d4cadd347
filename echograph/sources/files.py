"""Readers and writers with explicit schemas: tab-separated tables, annotations, rank sets, packed vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATION = "id string, lemmas array<string>, pos array<string>, edges array<array<string>>, sents array<string>, sent_of array<int>, heads array<int>, rels array<string>, adp_of array<string>, raw string"
RANKS = "label string, ranks map<string,int>"


class EmptyInput(ValueError):
    """A source without rows is an error, not an empty result."""


def not_empty(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise EmptyInput(name)
    return df


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header row, tab separated, quotes are data, all strings."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return not_empty(spark.read.option("sep", "\t").option("header", True).option("quote", "").schema(schema).csv(path), path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tabs and line breaks inside fields become spaces."""
    plain = [F.translate(F.col(c).cast("string"), "\t\n\r", "   ").alias(c) for c in df.columns]
    df.select(*plain).write.option("sep", "\t").option("header", True).option("quote", "").mode("overwrite").csv(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of annotated units: unit, pos, w, upos, head (null: none), rel, adp."""
    df = not_empty(spark.read.schema(ANNOTATION).json(path), path)
    n = F.size("lemmas")
    filled = df.select(F.col("id").alias("unit"), F.posexplode(F.arrays_zip("lemmas", "pos", F.coalesce("heads", F.array_repeat(F.lit(-1), n)).alias("heads"), F.coalesce("rels", F.array_repeat(F.lit(""), n)).alias("rels"), F.coalesce("adp_of", F.array_repeat(F.lit(""), n)).alias("adp_of"))).alias("i", "t"))
    return filled.select("unit", F.col("i").alias("pos"), F.col("t.lemmas").alias("w"), F.col("t.pos").alias("upos"), F.when(F.col("t.heads") >= 0, F.col("t.heads")).alias("head"), F.col("t.rels").alias("rel"), F.col("t.adp_of").alias("adp"))


def write_annotations(df: DataFrame, path: str) -> None:
    """One JSON object a line, of columns named as in ANNOTATION; missing ones are left out."""
    known = [c.split()[0] for c in ANNOTATION.split(", ")]
    df.select(*[c for c in known if c in df.columns]).write.mode("overwrite").json(path)


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """unit, v of archives with `ids` and `embeddings`; a file is one task's."""
    import io

    import numpy as np
    import pandas as pd

    def rows(batches):
        for b in batches:
            for content in b["content"]:
                z = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"unit": [str(x) for x in z["ids"]], "v": list(z["embeddings"].astype(float))})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "unit string, v array<double>")


def write_scores(scores: DataFrame, path: str) -> None:
    """A cache of scores (scorer, target, source, score), a folder for each scorer."""
    scores.write.mode("overwrite").partitionBy("scorer").parquet(path)


def read_scores(spark: SparkSession, path: str, scorer: str | None = None) -> DataFrame:
    """The cache, or one scorer's folder of it."""
    df = spark.read.parquet(path).select(F.col("scorer").cast("string").alias("scorer"), "target", "source", "score")
    return df.where(F.col("scorer") == scorer) if scorer else df


def read_zipped_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of the tab-separated files inside zip archives, header lines left out; an archive is one task's."""
    import io
    import zipfile

    import pandas as pd

    def rows(batches):
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        lines = z.read(name).decode("utf-8").splitlines()[1:]
                        cells = [(x.split("\t") + [None] * len(columns))[: len(columns)] for x in lines if x and not x.startswith("#")]
                        yield pd.DataFrame(cells, columns=columns)

    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """label, record, rank of rank sets; null: no correct source in the pool."""
    df = spark.read.schema(RANKS).json(path)
    return df.select("label", F.explode("ranks").alias("record", "rank"))


def append_ranks(ranks: DataFrame, path: str) -> None:
    sets = ranks.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("record", "rank"))).alias("ranks"))
    sets.write.mode("append").json(path)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items without a result yet: what a resumed job still has to do."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def read_xml_segments(spark: SparkSession, path: str, row_tag: str = "seg") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)
