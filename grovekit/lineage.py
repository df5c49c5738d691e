"""Where plans end: checkpoints and files in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master, as in tests, gets a folder of its own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(shared_folder, "own", None) or f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        shared_folder.own = base
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder: later steps start from files that survive lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame) -> DataFrame:
    """A table in the shared folder, read again: like ``cut``, but the optimizer sees its real size, where loops of joins would multiply estimates. It stays until the driver ends."""
    path = new_folder(df.sparkSession, "step")
    df.write.parquet(path)
    _WRITTEN.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        for spark, path in _WRITTEN:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
