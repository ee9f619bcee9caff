"""The package on the executors, however the job was started."""

from __future__ import annotations

import importlib.util
import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from turnwise.sources.tables import shared_folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's sources to the executors, once an application."""
    context: SparkContext = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if context.parallelize([0], 1).map(lambda _: importlib.util.find_spec("turnwise") is not None).first():
        return  # the workers find it already
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # In the folder that all share; where that is no path of this machine, the driver's own copy is served by Spark.
    shared = shared_folder(spark)
    folder = shared.removeprefix("file://") if shared.startswith(("file://", "/")) else tempfile.mkdtemp()
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"turnwise-{context.applicationId}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    archive.write(whole, os.path.join("turnwise", os.path.relpath(whole, root)))
    context.addPyFile(path)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, with the package sent first."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
