"""Session settings the jobs are tuned for; everything here can be overridden by the cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# Wide rows make generated methods longer than the JVM compiles (8000 bytes); fall back to shorter ones.
WIDE_ROWS = {"spark.sql.codegen.hugeMethodLimit": "8000"}
# A few columns of a compressed file hold far more than their share of its bytes: a side taken for less than 10 MB was one of
# 609 MB, built in the driver. So only tables of a few kilobytes are broadcast by their files; others by their measured rows.
ROWS_BY_FILES = {"spark.sql.sources.fileCompressionFactor": "100"}
SETTINGS = {**WIDE_ROWS, **ROWS_BY_FILES}


def build_session(app_name: str = "registra", master: str | None = None, **settings: str) -> SparkSession:
    """Create (or reuse) a session. On a cluster leave `master` unset and let spark-submit decide."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        **SETTINGS,
        # Plans here are built from thousands of small calls; recording each call's source line doubles that.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for name, value in {**defaults, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> None:
    """Apply the settings for wide rows and for sizes of tables to a session somebody else made, where it left them unset."""
    for name, value in SETTINGS.items():
        if spark.sparkContext.getConf().get(name) is None:
            spark.conf.set(name, value)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in spark.checkpoint.dir.

    Only a local master, whose executors share the driver's disk, gets a fresh local folder where the setting is
    missing. Anywhere else a made-up folder would silently lose what other machines write.
    """
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or context.getCheckpointDir()
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")
