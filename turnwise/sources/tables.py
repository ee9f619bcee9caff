"""Parquet tables of one data directory, and the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data directory; columns are pruned and filters pushed down by the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    A cluster names it in ``spark.checkpoint.dir``; without it only a local session, whose executors are this process, gets
    a folder of this machine, once an application and removed at its end.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", "") or _own.get(context.applicationId, "")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="turnwise-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = _own[context.applicationId] = "file://" + folder
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, used for one written table."""
    path = os.path.join(shared_folder(spark), f"{what}-{uuid.uuid4().hex}")
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes all tables that this application has written to the shared folder; results not yet stored go with them."""
    paths = _made.pop(spark.sparkContext.applicationId, [])
    jvm = spark._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage in a way that survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
