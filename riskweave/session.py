"""Session factory used by the tests, the benchmark and interactive work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g", **extra: str) -> SparkSession:
    """A UTC session with AQE on; a cluster brings its own session instead."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.driver.memory": driver_memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    return SparkSession.builder.master(f"local[{cores}]").appName("riskweave").config(map=conf).getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that all executors share; only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        base = tempfile.mkdtemp(prefix="riskweave-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
