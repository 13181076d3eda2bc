"""Structured Streaming: incremental re-audits, scan sessions of live logs, and event windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import pii


def read_new(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Files that arrive below a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def reaudit(stream: DataFrame, key: str, text: str, out: str, checkpoint: str) -> None:
    """Scans what arrived since the checkpoint, and appends its matches to ``out``. Each document is judged within its own batch."""

    def batch(rows: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure replaces what it wrote before
        pii.matches(rows, key, text).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def event_windows(events: DataFrame, width: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """Extension: counts by type in windows, tumbling or (with ``slide``) hopping, with a watermark for late events."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Extension: each user's sessions, which end after a gap without events."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


def run_complete(aggregate: DataFrame, out: str, checkpoint: str) -> None:
    """Runs an aggregation over what is there now, and leaves its final state in ``out``."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(out)

    aggregate.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


SESSION = "log_id bigint, scan bigint, lines bigint, ended boolean"


def live_sessions(lines: DataFrame) -> DataFrame:
    """Scan sessions of live logs (log_id, line_no, line): a state for each log holds the scan under way; ended scans are given out."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        scan, n = state.get if state.exists else (0, -1)
        rows = pd.concat(list(batches)).sort_values("line_no")
        begins = np.flatnonzero(rows["line"].str.contains("Scan started", regex=False).to_numpy(bool))
        ends = np.flatnonzero(rows["line"].str.contains("Scan completed", regex=False).to_numpy(bool))
        out = []
        # one step for each scan: its lines lie between two starts
        for k, (a, b) in enumerate(zip([0, *(begins + 1)], [*begins, len(rows)])):
            if k:
                if n >= 0:
                    out.append((key[0], scan, n, False))
                scan, n = scan + 1, 0
            if n >= 0:
                e = ends[np.searchsorted(ends, a) :][:1]
                if len(e) and e[0] < b:
                    out.append((key[0], scan, n + int(e[0]) - a + 1, True))
                    n = -1
                else:
                    n += b - a
        scan, n = int(scan), int(n)
        state.update((scan, n))
        yield pd.DataFrame(out, columns=["log_id", "scan", "lines", "ended"])

    return lines.groupBy("log_id").applyInPandasWithState(fold, SESSION, "scan bigint, n bigint", "append", GroupStateTimeout.NoTimeout)


def progress(query) -> dict:
    """What a running stream has done: batch, rows in all, rows a second, and whether it is at rest."""
    last = query.lastProgress or {}
    total = sum(p.get("numInputRows", 0) if isinstance(p, dict) else p.numInputRows for p in query.recentProgress)
    return {"batch": last.get("batchId"), "rows": total, "rows_per_second": last.get("processedRowsPerSecond"), "active": query.isActive, "waiting": not (query.status or {}).get("isTriggerActive", False)}


def reaudit_files(stream: DataFrame, snapshots: str, source_id: str, out: str, checkpoint: str, tolerance: float = 1.0) -> None:
    """Inventories that arrive are compared with the last snapshot of their source: changes are appended to ``out``, and each batch becomes the next snapshot.

    A batch that is repeated after a failure is compared with the snapshot before it and replaces its own.
    """
    from ..operators import files
    from ..sources import records

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        now = files.fingerprint(rows)
        try:
            seen = spark.read.option("inferSchema", "false").parquet(snapshots).where((F.col("source_id") == source_id) & (F.col("taken").cast("int") < number))
            last = seen.agg(F.max(F.col("taken").cast("int"))).first()[0]
        except Exception as x:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(x):
                raise
            last = None
        if last is None:
            changes = now.select("path_hash", F.lit("new").alias("status"))
        else:
            old = seen.where(F.col("taken").cast("int") == last).select("path_hash", "size", "mtime", "previous_pii")
            changes = files.snapshot_diff(now, old, tolerance).select("path_hash", "status")
        changes.write.mode("overwrite").parquet(f"{out}/batch={number}")
        records.save_snapshot(now.select("path_hash", "size", "mtime", F.lit(None).cast("boolean").alias("previous_pii")), snapshots, source_id, f"{number:08d}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
