"""Lets Python workers find this package where it isn't installed: their path gets the folder it was imported from. On a
cluster whose executors don't see that folder, install the package or pass it by --py-files."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def for_workers(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    paths = (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def on_workers(df: DataFrame) -> DataFrame:
    """df, after for_workers()."""
    for_workers(df.sparkSession)
    return df
