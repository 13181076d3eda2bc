"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that goes to a Python worker, where the session has the default of 10,000; texts are a hundred times as long as usual rows.
BATCH_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, so that they need no copy of their own; and keeps the batches that they get small."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, str(BATCH_ROWS))
    sc = spark.sparkContext
    if getattr(sc, "_riskweave_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    fd, name = tempfile.mkstemp(prefix="riskweave-", suffix=".zip")  # the driver serves it to the executors
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(name)
    sc._riskweave_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session's ``spark.checkpoint.dir`` names it. Only a local session that names none gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir names no shared folder")
            where = tempfile.mkdtemp(prefix="riskweave-checkpoint-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes the rows to the folder that all executors share and cuts the lineage; the files go when nothing refers to the rows, where the session cleans its checkpoints."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """The rows as a Parquet table in the shared folder, and what deletes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)

    def drop() -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    return spark.read.schema(df.schema).parquet(path), drop


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, for the number of fragments."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


#: Rows of a side that is sent to every task.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame) -> DataFrame:
    """Marks a narrow table for broadcast if it has at most BROADCAST_ROWS rows; a larger one is left to the planner. It is computed once."""
    kept = checkpoint(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def integer_ids(df: DataFrame, column: str) -> Column:
    """The identifier as a bigint: itself where its type is an integer, else a 64-bit hash; null stays null."""
    own = dict(df.dtypes)[column] in _INTEGERS
    return F.col(column).cast("bigint") if own else F.when(F.col(column).isNotNull(), F.xxhash64(F.col(column)))


def named_ids(found: DataFrame, source: DataFrame, column: str, columns: list[str]) -> DataFrame:
    """Puts the identifiers of ``source`` back into columns that hold ``integer_ids`` of them."""
    if dict(source.dtypes)[column] in _INTEGERS:
        return found
    names = source.where(F.col(column).isNotNull()).select(F.col(column).alias("_name"), integer_ids(source, column).alias("_id")).distinct()
    out = found
    for c in columns:
        out = out.join(names.select(F.col("_id").alias(c), F.col("_name").alias(f"_name_{c}")), c, "left")
    return out.select(*[F.col(f"_name_{c}").alias(c) if c in columns else F.col(c) for c in found.columns])
