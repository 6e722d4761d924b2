"""Session helpers: a local session for tests, and lineage cuts in the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.host": "127.0.0.1",
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": "8g",
}


def local_session(cores: str = "8", app: str = "convoloom") -> SparkSession:
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=LOCAL_CONF).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where it is unset, a session on the driver's machine alone (master `local`) gets a folder
    there; on a cluster that is an error, as executors can't read each other's disks.
    """
    sc = spark.sparkContext
    here = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if here:
        return here
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not there:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="convoloom-")
    sc.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint, which survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
