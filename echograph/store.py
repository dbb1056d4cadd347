"""Tables that several queries need, written once for each session and input folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_made: dict[tuple[str, str, str], DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session gets one of its own where it is unset."""
    sc = spark.sparkContext
    got = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not got:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="echograph-"))
        got = sc.getCheckpointDir()
    return got


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read again; it goes as the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, sf: str, name: str, make: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """The table `name` over folder sf: made and written at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _made:
        _made[key] = written(make(spark, sf), name)
    return _made[key]
