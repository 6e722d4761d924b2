"""Table access: one Parquet file or folder per table below a root folder."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_HOME = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    Workers start with the path of the session, which needn't hold a package that was
    found by other means.  On a cluster the package must be installed or shipped.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, PACKAGE_HOME])


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` below `root`, with every column; Catalyst prunes what is not used."""
    reachable(spark)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
