"""The folder that all executors share, and the intermediate tables in it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Where it is unset a temporary one is made, on a
    local master only: on a cluster each executor would write to its own disk, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = getattr(spark, "_lexmill_shared", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="lexmill_")
            spark._lexmill_shared = folder
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again: its lineage is cut, and the loss of an executor costs no
    recomputation. Every call has a path of its own, removed by ``discard`` or ``clean_up``, at the latest when the driver
    ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean_up)
    _written.append((spark, path))
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort: a table left behind is no error of a query, nor is a session that has ended."""
    try:
        context = spark.sparkContext
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and nothing reads any more."""
    path = df._lexmill_path
    for spark, p in [w for w in _written if w[1] == path]:
        _written.remove((spark, p))
        _remove(spark, p)


def clean_up() -> None:
    """Remove all tables written so far; frames that read them end with this."""
    while _written:
        _remove(*_written.pop())
