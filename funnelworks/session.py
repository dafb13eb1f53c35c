"""Spark session settings the models rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job needs: UTC for timestamp_micros / date parts, AQE for
# runtime coalescing, skew splitting and broadcast decisions on measured sizes.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # HotSpot does not JIT methods over 8000 bytecodes: let Spark split such
    # fused stages instead of running one huge interpreted method (Spark docs).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}


# Applied only when a session is created: bound the driver's job/stage/task status history
# (kept even with the UI off), so a long-lived driver does not grow with every query.
STATIC_CONF = {
    "spark.ui.retainedJobs": "100",
    "spark.ui.retainedStages": "100",
    "spark.ui.retainedTasks": "10000",
    "spark.sql.ui.retainedExecutions": "50",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "funnelworks", extra_conf: dict | None = None) -> SparkSession:
    """Return (or create) a session with the settings above.

    On a cluster ``master`` stays None and the launcher decides; tests pass
    ``local[N]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in {**STATIC_CONF, **BASE_CONF, **(extra_conf or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    for k, v in BASE_CONF.items():
        if k != "spark.ui.enabled":
            spark.conf.set(k, v)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    Uses the session's ``spark.checkpoint.dir`` (the cluster's shared folder). Only a local master,
    whose tasks all run on this machine, gets a scratch folder where it is unset; any other raises,
    because executors elsewhere would not see each other's files.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="funnelworks-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    current = sc._jsc.sc().getCheckpointDir()
    return current.get() if current.isDefined() else d
