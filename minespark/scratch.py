"""Written intermediate tables in the folder all executors share.

Iterative operators cut their lineage here: a parquet table outlives a lost
executor, is read by columns, and is compressed.  The folder is the one the
cluster names in ``spark.checkpoint.dir``; only where that is unset and the
master is local (tests on one machine) a folder of the session's own is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables of this application; ValueError on a cluster that names none."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _local:
            _local[app] = tempfile.mkdtemp(prefix="minespark-")
            atexit.register(_remove, _local[app])
        root = _local[app]
    return f"{root.rstrip('/')}/minespark-{app}"


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, partition_by: list[str] | None = None, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table; ``tidy``: its shuffle files go when it is written, not when the driver collects garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    w = df.write.mode("error")
    if partition_by:
        w = w.partitionBy(*partition_by)
    before = spark.conf.get(CLEANUP, None)
    if tidy:
        spark.conf.set(CLEANUP, "true")
    try:
        w.parquet(path)
    finally:
        if tidy:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._minespark_path = path
    return out


def path_of(df: DataFrame) -> str:
    """Where a table is written, for ``batches``; a table not yet written is."""
    return df._minespark_path if hasattr(df, "_minespark_path") else materialize(df)._minespark_path


def batches(path: str, columns: list[str], rows: int, words: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """A written table from within a task, some rows at a time, so that a task meets all of it without a copy in a shuffle.

    The shared folder must be one that Arrow opens (a mounted one, HDFS, S3,
    GCS).  ``words``: lists of strings that come as dictionary codes.
    """
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path)
    for f in sorted(system.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
        if f.base_name.endswith(".parquet"):
            with system.open_input_file(f.path) as at, pq.ParquetFile(at, read_dictionary=[f"{w}.list.element" for w in words]) as table:
                yield from table.iter_batches(rows, columns=columns)


def release(*frames: DataFrame) -> None:
    """Delete written tables that no later result reads."""
    for df in frames:
        path = getattr(df, "_minespark_path", None)
        if path:
            delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application (after its results are written)."""
    delete(spark, shared_dir(spark))


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
