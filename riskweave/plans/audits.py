"""Audits as whole plans: each stage is a transformation of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import files, pii
from ..session import shared_dir


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder, as several branches of the plan read them."""
    path = shared_dir(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def pruned(inventory: DataFrame, previous: DataFrame | None, as_of: float, config: files.Exclusions = files.Exclusions(), floor_share: int = 10, floor: int = 1000) -> DataFrame:
    """What is left to scan: representatives of duplicates, new or modified, sampled; with exclusion_reason.

    The comparison is of every file with the snapshot, so that a duplicate that
    stands for no group doesn't look deleted. A file's status follows from the
    row of the snapshot with its hash, so representatives are looked up there.
    """
    rows = files.representatives(inventory)
    if previous is not None:
        todo = files.snapshot_diff(rows.select("path_hash", "size", "mtime"), previous).where("status in ('new', 'modified')").select("path_hash")
        rows = rows.join(todo, "path_hash", "left_semi")
    rows = files.sample(_kept(rows, "pruned"), as_of, floor_share, floor).where("selected")
    return rows.withColumn("exclusion_reason", files.exclusion_reason(config))


def file_audit(inventory: DataFrame, previous: DataFrame | None, contents: DataFrame, as_of: float, floor_share: int = 10, floor: int = 1000, mode: str = "line") -> DataFrame:
    """Counters by zone. Findings of a representative count for its whole group, too."""
    todo = _kept(pruned(inventory, previous, as_of, floor_share=floor_share, floor=floor).select("doc_id", "zone", "group_size", "exclusion_reason"), "todo")
    kept = todo.where("exclusion_reason is null").select("doc_id")
    found = pii.per_document(pii.matches(contents.join(kept, "doc_id", "left_semi"), "doc_id", "text", mode), "doc_id")
    hit = F.col("pii_count").isNotNull()
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return (
        todo.join(found, "doc_id", "left")
        .groupBy("zone")
        .agg(
            F.count("*").alias("selected_files"),
            F.sum("group_size").alias("represented_files"),
            F.count_if(F.col("exclusion_reason").isNotNull()).alias("excluded_files"),
            F.count_if(hit).alias("files_with_pii"),
            zero("pii_count").alias("pii_count"),
            zero(F.when(hit, F.col("group_size"))).alias("represented_with_pii"),
        )
    )
