"""Streams over the tables' files, run to their end; the results are final states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..streaming import audits
from ._common import Query, table
from .pii import matches_sql


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return audits.read_new(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema)


def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_dir(spark, "reaudit")
    audits.reaudit(_stream(spark, sf_dir, "documents"), "doc_id", "text", f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").groupBy("type").agg(F.count("*").alias("matches"), F.count_distinct("doc_id").alias("documents"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_dir(spark, "windows")
    audits.run_complete(audits.event_windows(_stream(spark, sf_dir, "events")), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 2).alias("total"))


def hopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_dir(spark, "hopping")
    audits.run_complete(audits.event_windows(_stream(spark, sf_dir, "events"), "2 days", "1 day", "1 day"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 2).alias("total"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all users over the events at hand; the same plan runs over a stream."""
    return audits.event_sessions(table(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "stream_incremental": (incremental, f"select type, count(*) as matches, count(distinct doc_id) as documents from {matches_sql('documents', 'doc_id', 'text')} group by type"),
    "stream_event_hopping": (hopping, """select strftime(d, '%Y-%m-%d') as day, event_type, count(*) as events, round(sum(value), 2) as total from (
      select event_type, value, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 1 day]) d from events) group by all"""),
    "stream_sessions": (sessions, """select user_id, sum(begins)::bigint as sessions, count(*) as events from (select user_id, (ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minutes or lag(ts) over (partition by user_id order by ts) is null)::int begins from events) group by user_id"""),
    "stream_event_windows": (windows, "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as events, round(sum(value), 2) as total from events group by all"),
}
