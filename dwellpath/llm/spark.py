"""Small Spark helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch that a written table's Python steps get; the JVM and Python hold a batch of texts more than once each.
BATCH_ROWS = 2_000
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def rest() -> None:
    """Give memory that is free back to the system, as an idle Python worker stays beside an executor that grows."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone keeps it otherwise
        trim(0)


def rested(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with a ``rest`` at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        rest()

    return whole


def small_batches(spark: SparkSession) -> None:
    """Let the session's Python steps get at most BATCH_ROWS rows at a time from now on."""
    rows = int(spark.conf.get(BATCH_KEY))
    spark.conf.set(BATCH_KEY, str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is missing a temporary folder serves on one machine; a cluster must name one.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get(CHECKPOINT_KEY)
        if not named and not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *split: str, share: int = 1) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    Smaller than a checkpoint; with ``split`` columns a reader of one part opens only its files.
    ``share``: write from one of so many shuffle partitions only, for tables much smaller than
    what the partitions are sized for; partitions are joined without another shuffle. Python steps
    get at most BATCH_ROWS rows at a time while it is written; the session's setting is as before afterwards.
    """
    if share > 1:
        df = df.coalesce(max(1, -(-shuffle_width(df.sparkSession) // share)))
    path = f"{_checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    rows = conf.get(BATCH_KEY)
    small_batches(df.sparkSession)
    try:
        df.write.partitionBy(*split).parquet(path)
    finally:
        conf.set(BATCH_KEY, rows)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more; other DataFrames are left alone."""
    for t in tables:
        if path := _FOLDERS.pop(t, None):
            context = t.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
