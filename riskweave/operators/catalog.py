"""Database catalogs as tables: structure, keys, indexes, sizes, times, totals and lineage.

The operators work on frames in the shape of the standard information schema,
whatever gave them: ``sources.databases.catalog_frame`` over JDBC, an export, or
the session's own catalog.

``columns``      schema, table_name, column_name, ordinal, data_type
``constraints``  schema, constraint_name, table_name, kind (PRIMARY KEY or FOREIGN KEY), ref_schema, ref_constraint
``usage``        schema, constraint_name, column_name, ordinal
``index_columns`` schema, table_name, index_name, column_name, ordinal, is_unique, scans
``stats``        schema, table_name, row_count, data_bytes, index_bytes and four times of changes
``views``, ``triggers``, ``routines``  schema, name, definition (triggers also table_name)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import bucket
from .tables import referenced_tables

SYSTEM_SCHEMAS = ("information_schema", "mysql", "performance_schema", "pg_catalog", "pg_toast", "sys")
TIMES = ("last_vacuum", "last_autovacuum", "last_analyze", "last_autoanalyze")


def user_schemas(frame: DataFrame, own_tables: tuple[str, ...] = ()) -> DataFrame:
    """Rows outside system schemas and outside tables that an audit made itself; a null schema stays."""
    rows = frame.where(F.coalesce(~F.lower("schema").isin(*SYSTEM_SCHEMAS), F.lit(True)))
    return rows.where(~F.col("table_name").isin(*own_tables)) if own_tables else rows


def _listed(column: str, order: str = "ordinal"):
    """The values of a group in the order of another column, as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), ",")


def structure(columns: DataFrame) -> DataFrame:
    """Each table of the user's schemas: schema, table_name, column_count, and its columns as name:type in order."""
    rows = user_schemas(columns).withColumn("c", F.concat_ws(":", "column_name", "data_type"))
    return rows.groupBy("schema", "table_name").agg(F.count("*").alias("column_count"), _listed("c").alias("columns"))


def schemas(columns: DataFrame) -> DataFrame:
    """schema, tables and columns of each of the user's schemas."""
    return user_schemas(columns).groupBy("schema").agg(F.count_distinct("table_name").alias("tables"), F.count("*").alias("columns"))


def primary_keys(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """schema, table_name and key: the columns of the primary key in order."""
    own = constraints.where("kind = 'PRIMARY KEY'").select("schema", "constraint_name", "table_name")
    return own.join(usage, ["schema", "constraint_name"]).groupBy("schema", "table_name").agg(_listed("column_name").alias("key"))


def foreign_keys(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """One row for each column of each foreign key, with the column that it refers to: matched by place, so that keys of several columns aren't multiplied."""
    own = constraints.where("kind = 'FOREIGN KEY'").select("schema", "constraint_name", "table_name", "ref_schema", "ref_constraint")
    target = constraints.select(F.col("schema").alias("ref_schema"), F.col("constraint_name").alias("ref_constraint"), F.col("table_name").alias("ref_table"))
    there = usage.select(F.col("schema").alias("ref_schema"), F.col("constraint_name").alias("ref_constraint"), F.col("column_name").alias("ref_column"), "ordinal")
    rows = own.join(usage, ["schema", "constraint_name"]).join(target, ["ref_schema", "ref_constraint"]).join(there, ["ref_schema", "ref_constraint", "ordinal"])
    return rows.select("schema", "table_name", "constraint_name", "ordinal", "column_name", "ref_schema", "ref_table", "ref_column")


def indexes(index_columns: DataFrame) -> DataFrame:
    """schema, table_name, index_name, columns (in order) and is_unique."""
    return index_columns.groupBy("schema", "table_name", "index_name").agg(_listed("column_name").alias("columns"), F.max("is_unique").alias("is_unique"))


def index_usage(tables: DataFrame, index_columns: DataFrame) -> DataFrame:
    """Of every table: the number of its indexes and how often they were read; 0 where there is none."""
    each = index_columns.groupBy("schema", "table_name", "index_name").agg(F.max("scans").alias("scans"))
    each = each.groupBy("schema", "table_name").agg(F.count("*").alias("indexes"), F.sum("scans").alias("index_scans"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return tables.select("schema", "table_name").join(each, ["schema", "table_name"], "left").select("schema", "table_name", zero("indexes"), zero("index_scans"))


def sizes(stats: DataFrame) -> DataFrame:
    """schema, table_name, size_bytes (data and indexes; null where neither is known), last_updated, and the place by size."""
    size = F.when(F.col("data_bytes").isNotNull() | F.col("index_bytes").isNotNull(), F.coalesce("data_bytes", F.lit(0)) + F.coalesce("index_bytes", F.lit(0)))
    return stats.select("schema", "table_name", size.cast("bigint").alias("size_bytes"), F.greatest(*TIMES).alias("last_updated"))


def largest(stats: DataFrame, n: int = 10) -> DataFrame:
    """The n largest tables, first the largest; unknown sizes come last."""
    return sizes(stats).orderBy(F.desc_nulls_last("size_bytes"), "schema", "table_name").limit(n).select("schema", "table_name", "size_bytes")


def totals(stats: DataFrame) -> DataFrame:
    """tables, total_rows, and total_bytes over the tables whose size is known (null if none is)."""
    return sizes(stats).join(stats.select("schema", "table_name", "row_count"), ["schema", "table_name"]).agg(F.count("*").alias("tables"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"), F.sum("size_bytes").alias("total_bytes"), F.count_if(F.col("size_bytes").isNull()).alias("unknown_sizes"))


def personal_summary(found: DataFrame) -> DataFrame:
    """Over rows (table_name, pii_type): tables with personal data, and the distinct types in order."""
    return found.agg(F.count_distinct("table_name").alias("tables_with_pii"), F.array_join(F.array_sort(F.collect_set("pii_type")), ",").alias("pii_types"))


def lineage(views: DataFrame, materialised: DataFrame, triggers: DataFrame, routines: DataFrame) -> DataFrame:
    """Edges (kind, schema, name, table_name) from views, materialised views, triggers and routines to the tables that they read or watch."""
    edge = lambda d, kind: d.select(F.lit(kind).alias("kind"), "schema", "name", F.explode(referenced_tables(F.col("definition"))).alias("table_name"))
    watched = triggers.select(F.lit("trigger").alias("kind"), "schema", "name", "table_name")
    rows = edge(views, "view").unionByName(edge(materialised, "materialised view")).unionByName(edge(routines, "routine")).unionByName(edge(triggers, "trigger")).unionByName(watched)
    return rows.distinct()


def first_rows(table: DataFrame, n: int = 100, order: list[str] | None = None) -> DataFrame:
    """A sample of n rows for an inspection: the first as they come, or by the given columns so that it can be repeated."""
    return (table.orderBy(*order) if order else table).limit(n)


def sampled(table: DataFrame, key: str, size: int) -> DataFrame:
    """A sample of the given size that depends on the key only: the rows of the least hash, as many as ``tables.sample_size`` allows."""
    return table.orderBy(bucket(F.col(key).cast("string")), key).limit(size)


def sampled_each(rows: DataFrame, group: list[str], key: str, size: str = "sample_size") -> DataFrame:
    """The rows of many tables in one frame, each table sampled down to its own size, by counts of hash ranges.

    No task holds a whole table: counts of 1,024 ranges of the hash give where
    each range begins, and rows are numbered within their range only.
    """
    rows = rows.withColumn("_h", bucket(F.col(key).cast("string"))).withColumn("_r", F.shiftright("_h", 22))
    counts = rows.groupBy(*group, "_r").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).drop("_n")
    place = F.row_number().over(Window.partitionBy(*group, "_r").orderBy("_h", key))
    return rows.join(starts, [*group, "_r"]).where(F.col("_before") < F.col(size)).withColumn("_place", place).where(F.col("_place") + F.col("_before") <= F.col(size)).drop("_h", "_r", "_before", "_place")
