"""Session helpers: written intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A planner hint alone: results are the same on either side of it.
BROADCAST_BYTES = 32 * 2 ** 20
# Rows that make a task of their own worth while where much is done for each.
ROWS_PER_TASK = 25_000

# Folder of this run in the shared folder, by application; the innermost `scratch` is in use.
_FOLDERS: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``; a folder of its own only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marketgauge-"))
    return sc.getCheckpointDir()


def run_folder(spark: SparkSession) -> str:
    """The folder that intermediate tables go to: one for each application, removed when Python
    ends, or the one of the `scratch` block that is open."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = [f"{shared_dir(spark)}/marketgauge-{app}-{uuid.uuid4().hex[:8]}"]
        atexit.register(_remove, spark, _FOLDERS[app][0])
    return _FOLDERS[app][-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made in the block are removed behind it. Frames that read them must
    have been written or collected by then."""
    inner = f"{run_folder(spark)}/{uuid.uuid4().hex[:8]}"
    stack = _FOLDERS[spark.sparkContext.applicationId]
    stack.append(inner)
    try:
        yield inner
    finally:
        stack.remove(inner)
        _remove(spark, inner)


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder made here, with the file system that Spark writes to."""
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - a stopped session can delete nothing
        pass


def cut_counted(df: DataFrame, folder: str | None = None) -> tuple[DataFrame, int]:
    """Writes `df` to the shared folder in one job and returns the written copy and its rows.

    Later steps read the copy: it survives lost executors, keeps fitted values and partition
    numbers fixed, is pruned by column and is not computed twice.
    """
    spark = df.sparkSession
    path = f"{folder or run_folder(spark)}/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["rows"]


def cut_dealt(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, int]:
    """As `cut_counted`, dealt evenly over as many files as there are cores, or one for each
    `rows_per_task` rows if those are fewer: rows of one Parquet row group stay in one task through
    all that is derived from them, however long that works on a row."""
    stored, rows = cut_counted(df)
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, rows // rows_per_task)
    if len(stored.inputFiles()) >= tasks:
        return stored, rows
    return cut_counted(stored.repartition(tasks))


def cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    return cut_counted(df, folder)[0]


def row_bytes(df: DataFrame) -> int:
    """Bytes of a row by its types; text and nested columns count as in Spark's own estimate."""
    return 8 + df._jdf.schema().defaultSize()


def checked_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint behind a count of rows times their size. Above the limit Spark picks a
    shuffle join; the result is the same."""
    small, rows = cut_counted(df)
    return F.broadcast(small) if rows * row_bytes(small) <= max_bytes else small
