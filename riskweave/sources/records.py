"""Exports of cloud drives, applications and directories, reports and logs; and the sinks of audits."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLOUD_ITEM = "id string, name string, size bigint, folder string, web_url string, permissions array<struct<roles:array<string>,user:string,group_name:string,link_scope:string,app:string>>"


def cloud_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLOUD_ITEM).json(path)


def entities(spark: SparkSession, path: str) -> DataFrame:
    """Application records, one JSON object a line; nested values become text."""
    return spark.read.option("primitivesAsString", "true").json(path)


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """log_id, line_no (from 1) and line. A log is read in parts of any number: lines are numbered within each, behind the lines of the parts before it."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("log_id"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_seq"), F.col("value").alias("line"))
    counts = rows.groupBy("log_id", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("log_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("log_id", "_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("log_id", "_part").orderBy("_seq"))
    return rows.join(starts, ["log_id", "_part"]).select("log_id", (F.col("_before") + place).cast("int").alias("line_no"), "line")


def directory_entries(spark: SparkSession, path: str) -> DataFrame:
    """Users and groups from an export of a directory (LDIF): dn and its attributes, each a list of values; base64 values and folded lines are resolved."""
    whole = spark.read.option("lineSep", "\n\n").text(path).where(F.col("value").rlike("(?m)^dn:"))
    unfolded = F.regexp_replace(F.regexp_replace("value", "\r", ""), "\n ", "")
    pairs = F.filter(F.split(unfolded, "\n"), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9;-]*::? ?"))
    one = F.transform(pairs, lambda x: F.struct(F.lower(F.regexp_extract(x, "^([A-Za-z0-9-]+)", 1)).alias("k"), F.when(x.rlike("^[^:]+::"), F.decode(F.unbase64(F.trim(F.regexp_replace(x, "^[^:]+::", ""))), "UTF-8")).otherwise(F.trim(F.regexp_replace(x, "^[^:]+:", ""))).alias("v")))
    names = F.array_distinct(F.transform("e", lambda x: x["k"]))
    rows = whole.select(one.alias("e"))
    values = F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.transform(F.filter("e", lambda x: x["k"] == n), lambda x: x["v"]))))
    return rows.select(values.alias("attributes")).select(F.get(F.col("attributes")["dn"], F.lit(0)).alias("dn"), "attributes")


def directory_users(entries: DataFrame) -> DataFrame:
    """dn, description, uac, spn and member_of of the entries that are people or accounts."""
    a = lambda k: F.col("attributes")[k]
    people = F.arrays_overlap(F.transform(a("objectclass"), F.lower), F.array(*map(F.lit, ("account", "inetorgperson", "person", "posixaccount", "user"))))
    return entries.where(people).select("dn", F.get(a("description"), F.lit(0)).alias("description"), F.get(a("useraccountcontrol"), F.lit(0)).try_cast("int").alias("uac"), a("serviceprincipalname").alias("spn"), a("memberof").alias("member_of"))


def directory_groups(entries: DataFrame) -> DataFrame:
    """cn and member of the entries that are groups."""
    a = lambda k: F.col("attributes")[k]
    groups = F.arrays_overlap(F.transform(a("objectclass"), F.lower), F.array(*map(F.lit, ("group", "groupofnames", "groupofuniquenames", "posixgroup"))))
    return entries.where(groups).select(F.get(a("cn"), F.lit(0)).alias("cn"), F.coalesce(a("member"), a("uniquemember"), a("memberuid"), F.array().cast("array<string>")).alias("member"))


def report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def report_files(reports: DataFrame) -> DataFrame:
    """The counters of a file report, taken anew from its files."""
    f = reports.select(F.explode("files").alias("f")).select("f.*")
    return f.agg(F.count("*").alias("total_files"), F.sum("size").alias("total_size_bytes"), F.count_if("pii_detected").alias("pii_files"))


def report_tables(reports: DataFrame) -> DataFrame:
    """The counters of a database report, taken anew from its tables (table_name, row_count, size_bytes, pii_types)."""
    t = reports.select(F.explode("tables").alias("t")).select("t.*")
    return t.agg(F.count("*").alias("total_tables"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"), F.sum("size_bytes").alias("total_size_bytes"), F.count_if(F.size("pii_types") > 0).alias("pii_tables"))


def report_drives(reports: DataFrame) -> DataFrame:
    """The counters of a cloud report, taken anew from its files: drives, files, bytes, files with personal data and shared files (any grant by link)."""
    f = reports.select(F.explode("files").alias("f")).select("f.*")
    shared = F.exists("permissions", lambda p: p["link_scope"].isNotNull())
    return f.agg(F.count_distinct("drive_id").alias("drives"), F.count("*").alias("total_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size_bytes"), F.count_if("pii_detected").alias("pii_files"), F.count_if(F.coalesce(shared, F.lit(False))).alias("shared_files"))


def report_kind(reports: DataFrame) -> str:
    """files, database or cloud, by the report's source type or by what it lists."""
    if "source_type" in reports.columns and (kind := reports.select("source_type").first()) and kind[0]:
        return {"files": "files", "database": "database", "db": "database"}.get(kind[0], "cloud")
    return "database" if "tables" in reports.columns else "files"


# --- sinks ------------------------------------------------------------------------------------------


def write_report(summary: DataFrame, files: DataFrame, path: str, source_type: str = "files", version: str = "1") -> None:
    """A folder with the envelope as JSON and the files as partitioned JSON lines, so that no task holds the whole report."""
    envelope = summary.select(F.lit(source_type).alias("source_type"), F.lit(version).alias("version"), F.current_timestamp().alias("timestamp"), F.lit("success").alias("status"), F.struct("*").alias("summary"))
    envelope.coalesce(1).write.mode("overwrite").json(f"{path}/report")
    files.write.mode("overwrite").json(f"{path}/files")


def minimal(summary: DataFrame, source: str) -> DataFrame:
    """The preview of a report: source_path, total_files, files_with_pii and pii_by_type of a row of totals."""
    return summary.select(F.lit(source).alias("source_path"), "total_files", "files_with_pii", "pii_by_type")


def to_json(summary: DataFrame) -> DataFrame:
    return summary.select(F.to_json(F.struct("*")).alias("json"))


def file_name(source: str, stamp: str) -> str:
    name = source.rstrip("/").rsplit("/", 1)[-1] or "root"
    return f"scan_{re.sub(r'[^A-Za-z0-9_-]', '_', name)}_{stamp}.json"


def save_snapshot(fingerprints: DataFrame, path: str, source_id: str, taken: str) -> None:
    """Writes a snapshot; one of the same source and time is replaced."""
    rows = fingerprints.withColumns({"source_id": F.lit(source_id), "taken": F.lit(taken)})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id", "taken").parquet(path)


def latest_snapshot(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """The fingerprints of the latest snapshot; both filters prune partitions."""
    rows = spark.read.option("inferSchema", "false").parquet(path).where(F.col("source_id") == source_id)
    last = rows.agg(F.max(F.col("taken").cast("string"))).first()[0]
    return rows.where(F.col("taken").cast("string") == last).drop("source_id", "taken")


def latest_by_source(snapshots: DataFrame) -> DataFrame:
    place = F.rank().over(Window.partitionBy("source_id").orderBy(F.desc("taken")))
    return snapshots.withColumn("_n", place).where("_n = 1").drop("_n")
