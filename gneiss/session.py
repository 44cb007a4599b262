"""Session settings shared by queries, tests and the benchmark."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "gneiss", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session in UTC with ANSI arithmetic and adaptive execution.

    Only what results depend on is fixed here; memory and cluster settings stay with the deployment.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame, written once to the folder that spark.checkpoint.dir names, for plans that read it in several branches.

    Unless the master is local, the folder must be set, so that it is one that all machines share.
    """
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="gneiss-"))
    return frame.checkpoint()
