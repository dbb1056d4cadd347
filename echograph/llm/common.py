"""What the operators of this subpackage share: paths, the shared folder, small helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Upper limit on rows of a table that is sent whole to every executor; beyond it a shuffle join runs.
BROADCAST_ROWS = 50_000
#: The same for a table of one id column.
BROADCAST_IDS = 1_000_000
#: Rows of a file of a narrow table (ids and numbers), where a bound on its rows is known.
FILE_ROWS = 500_000
#: Rows of an Arrow batch at most: executor and worker each hold one, whole texts included.
ARROW_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session (tests) gets one of its own where it is unset."""
    sc = spark.sparkContext
    got = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not got:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="echograph-"))
        got = sc.getCheckpointDir()
    return got


def files(spark: SparkSession, rows: int) -> int:
    """Files of a narrow table of `rows` rows: one a core or FILE_ROWS rows, and no more than a shuffle would leave."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))))


def written(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage and survives lost executors. It goes as the driver ends.

    rows: an upper bound on the rows of a narrow table. They are dealt out evenly to a few files, where a
    shuffle of many partitions would leave a small file in each, whatever the table's size.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.repartition(files(spark, rows))
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `limit` rows; reads no more than that."""
    return df.limit(limit + 1).count() <= limit


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its row count allows it, else df itself."""
    return F.broadcast(df) if few(df, limit) else df


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def release() -> None:
    """Gives memory that this worker no longer uses back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_holder: list = []


def hold(owner: str, drop: Callable[[], None]) -> None:
    """Called as a task begins: a worker keeps the caches of one operator at a time, those of the one before go."""
    if _holder and _holder[0] != owner:
        _holder[1]()
        gc.collect()
        release()
    _holder[:] = [owner, drop]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Readies a session for Python workers: short Arrow batches, and this package importable where PYTHONPATH or the working folder lack it."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    root = Path(__file__).resolve().parents[2]
    seen = [Path(p or ".").resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    app = spark.sparkContext.applicationId
    if root in seen or any((p / "echograph").exists() for p in seen) or app in _shipped:
        return
    out = Path(tempfile.mkdtemp()) / "echograph.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in root.glob("echograph/**/*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)
