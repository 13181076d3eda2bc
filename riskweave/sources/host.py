"""The inventory of a host as frames: disks, arrays, links and processes, read from the system's own files below a root.

Nothing is started on the host. A root other than / is a copy of these files from
another machine. The rules that class what is found are columns of
``operators.metadata``.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metadata

DISKS = "name string, rota string, tran string, model string, size_bytes bigint, removable boolean"
LINKS = "name string, state string, address string, speed string"
_VIRTUAL = ("dm-", "loop", "md", "ram", "sr", "zram")


def _text(path: Path) -> str | None:
    try:
        return path.read_text(errors="replace").strip() or None
    except OSError:
        return None


def _transport(name: str, device: Path) -> str | None:
    if name.startswith("nvme"):
        return "nvme"
    where = os.path.realpath(device)
    return next((kind for part, kind in (("/usb", "usb"), ("/ata", "sata"), ("/virtio", "virtio"), ("/sas", "sas")) if part in where), None)


def disks(spark: SparkSession, root: str = "/") -> DataFrame:
    """Whole disks with their kind: name, rota, tran, model, size_bytes, removable, kind."""
    base, rows = Path(root, "sys/block"), []
    for d in sorted(base.iterdir()) if base.is_dir() else []:
        if not d.name.startswith(_VIRTUAL):
            sectors = _text(d / "size")
            rows.append((d.name, _text(d / "queue/rotational"), _transport(d.name, d), _text(d / "device/model"), int(sectors) * 512 if sectors and sectors.isdigit() else None, _text(d / "removable") == "1"))
    return spark.createDataFrame(rows, DISKS).withColumn("kind", metadata.disk_linux(F.col("rota"), F.col("tran"), F.col("model")))


def arrays(spark: SparkSession, root: str = "/") -> DataFrame:
    """Software arrays with their level: line and level."""
    lines = [(x,) for x in (_text(Path(root, "proc/mdstat")) or "").splitlines() if x.startswith("md")]
    return spark.createDataFrame(lines, "line string").withColumn("level", metadata.raid_level(F.col("line")))


def links(spark: SparkSession, root: str = "/") -> DataFrame:
    """Network interfaces but the loopback: name, state, address, speed and mbps."""
    base, rows = Path(root, "sys/class/net"), []
    for d in sorted(base.iterdir()) if base.is_dir() else []:
        if d.name != "lo":
            speed = _text(d / "speed")
            rows.append((d.name, _text(d / "operstate"), _text(d / "address"), f"{speed} Mbps" if speed and speed.isdigit() else None))
    return spark.createDataFrame(rows, LINKS).withColumn("mbps", metadata.link_mbps(F.col("speed")))


def services(spark: SparkSession, root: str = "/") -> DataFrame:
    """Names of the processes at work."""
    base = Path(root, "proc")
    names = {_text(d / "comm") for d in base.iterdir() if d.name.isdigit()} if base.is_dir() else set()
    return spark.createDataFrame([(n,) for n in sorted(x for x in names if x)], "service string")


def summary(spark: SparkSession, root: str = "/") -> DataFrame:
    """One row: disks by kind, bytes in all, arrays, links that are up, and the backup products at work."""
    d = disks(spark, root).agg(*[F.count_if(F.col("kind") == k).alias(k.lower() + "_disks") for k in ("SSD", "HDD", "NVMe", "Unknown")], F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))
    a = arrays(spark, root).agg(F.count("*").alias("arrays"))
    n = links(spark, root).agg(F.count_if(F.col("state") == "up").alias("links_up"))
    b = metadata.backup_agents(services(spark, root)).agg(F.array_join(F.array_sort(F.collect_list("agent")), ",").alias("backup_agents"))
    return d.crossJoin(a).crossJoin(n).crossJoin(b)
