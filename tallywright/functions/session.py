"""Makes this package known to Python workers that don't have it."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HOME = Path(__file__).resolve().parents[2]
_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once, unless PYTHONPATH already leads to it."""
    if str(HOME) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _sent:
        return
    at = Path(tempfile.mkdtemp(prefix="spark-"))
    shutil.copytree(HOME / "tallywright", at / "tallywright", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(at / "tallywright"), "zip", at, "tallywright"))
    _sent.add(spark.sparkContext.applicationId)


def ship(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        send_package(spark)
        return query(spark, sf_dir)

    return run
