"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import SparkSession


def build_session(app: str = "tandem", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume.

    Shuffle partition counts and memory are left to the cluster; AQE coalesces
    small partitions and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # rows that go to Python may be whole pages
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        # checkpoints go when nothing refers to them any more; run folders are for the owner of the folder to remove
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and run tables.

    On a cluster it is whatever ``spark.checkpoint.dir`` names, which must be on
    storage every executor can reach. A temporary folder is used only when the
    setting is missing and the master is local.
    """
    conf = spark.sparkContext.getConf()
    configured = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return configured or current.get()
    if configured is None:
        if not conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tandem-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def small_table(spark: SparkSession, rows: list[tuple], schema: str):
    """A table of fixed values as a local relation, so that the planner knows how small it is."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), schema)


def cut_lineage(df):
    """Materialise on reliable storage, so a lost executor costs a re-read and not a re-run."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
