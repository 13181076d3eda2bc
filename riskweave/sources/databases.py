"""Relational and document databases through Spark's own readers, by a registry of connectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import SYSTEM_SCHEMAS
from ..operators.tables import check_read_only



@dataclass(frozen=True)
class Connector:
    name: str
    url: str
    port: int
    driver: str


CONNECTORS = {
    c.name: c
    for c in (
        Connector("postgresql", "jdbc:postgresql://{host}:{port}/{database}", 5432, "org.postgresql.Driver"),
        Connector("mysql", "jdbc:mysql://{host}:{port}/{database}", 3306, "com.mysql.cj.jdbc.Driver"),
        Connector("mariadb", "jdbc:mariadb://{host}:{port}/{database}", 3306, "org.mariadb.jdbc.Driver"),
        Connector("sqlserver", "jdbc:sqlserver://{host}:{port};databaseName={database}", 1433, "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    )
}


def query(spark: SparkSession, kind: str, sql: str, host: str, database: str, port: int | None = None, **options: str) -> DataFrame:
    """A read-only query; filters, columns and limits over it are pushed to the database."""
    c = CONNECTORS[kind]
    url = c.url.format(host=host, port=port or c.port, database=database)
    return spark.read.format("jdbc").options(url=url, driver=c.driver, query=check_read_only(sql), **options).load()


def table(spark: SparkSession, kind: str, name: str, host: str, database: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 32, port: int | None = None, **options: str) -> DataFrame:
    """A whole table, read by ranges of a numeric key side by side where one is given."""
    c = CONNECTORS[kind]
    url = c.url.format(host=host, port=port or c.port, database=database)
    reader = spark.read.format("jdbc").options(url=url, driver=c.driver, dbtable=name, fetchsize="10000", **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def catalog(spark: SparkSession, database: str | None = None) -> DataFrame:
    """schema, table_name and columns of the session's tables, without system schemas."""
    rows = []
    for t in spark.catalog.listTables(database):
        schema = (t.namespace or [None])[0]
        if schema not in SYSTEM_SCHEMAS:
            rows.append((schema, t.name, [(c.name, c.dataType) for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{schema}.{t.name}")]))
    return spark.createDataFrame(rows, "schema string, table_name string, columns array<struct<name:string,type:string>>")


_STANDARD = {
    "columns": "SELECT table_schema AS {q}schema{q}, table_name, column_name, ordinal_position AS ordinal, data_type FROM information_schema.columns",
    "constraints": """SELECT t.constraint_schema AS {q}schema{q}, t.constraint_name, t.table_name, t.constraint_type AS kind, r.unique_constraint_schema AS ref_schema, r.unique_constraint_name AS ref_constraint
  FROM information_schema.table_constraints t LEFT JOIN information_schema.referential_constraints r ON r.constraint_schema = t.constraint_schema AND r.constraint_name = t.constraint_name{extra}
  WHERE t.constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY')""",
    "usage": "SELECT constraint_schema AS {q}schema{q}, constraint_name, column_name, ordinal_position AS ordinal FROM information_schema.key_column_usage",
    "views": "SELECT table_schema AS {q}schema{q}, table_name AS name, view_definition AS definition FROM information_schema.views",
    "routines": "SELECT routine_schema AS {q}schema{q}, routine_name AS name, routine_definition AS definition FROM information_schema.routines",
    "triggers": "SELECT trigger_schema AS {q}schema{q}, trigger_name AS name, event_object_table AS table_name, action_statement AS definition FROM information_schema.triggers",
}
_NO_ROWS = "SELECT table_schema AS {q}schema{q}, table_name AS name, table_name AS definition FROM information_schema.tables WHERE 1 = 0"
#: The selects that give the frames of ``operators.catalog``, by kind of database.
CATALOG_SQL: dict[str, dict[str, str]] = {
    "postgresql": {k: v.format(q='"', extra="") for k, v in _STANDARD.items()}
    | {
        "materialised": "SELECT schemaname AS \"schema\", matviewname AS name, definition FROM pg_catalog.pg_matviews",
        "index_columns": """SELECT n.nspname AS "schema", t.relname AS table_name, i.relname AS index_name, a.attname AS column_name, k.place AS ordinal, x.indisunique AS is_unique, coalesce(s.idx_scan, 0) AS scans
  FROM pg_catalog.pg_index x JOIN pg_catalog.pg_class i ON i.oid = x.indexrelid JOIN pg_catalog.pg_class t ON t.oid = x.indrelid JOIN pg_catalog.pg_namespace n ON n.oid = t.relnamespace
  CROSS JOIN LATERAL unnest(x.indkey) WITH ORDINALITY k(attnum, place) JOIN pg_catalog.pg_attribute a ON a.attrelid = t.oid AND a.attnum = k.attnum LEFT JOIN pg_catalog.pg_stat_user_indexes s ON s.indexrelid = x.indexrelid""",
        "stats": """SELECT schemaname AS "schema", relname AS table_name, n_live_tup AS row_count, pg_table_size(relid) AS data_bytes, pg_indexes_size(relid) AS index_bytes, last_vacuum, last_autovacuum, last_analyze, last_autoanalyze FROM pg_catalog.pg_stat_user_tables""",
    },
    "mysql": {k: v.format(q="`", extra=" AND r.table_name = t.table_name") for k, v in (_STANDARD | {"materialised": _NO_ROWS}).items()}
    | {
        # every primary key has the same name here, so the table belongs to the name
        "constraints": """SELECT t.constraint_schema AS `schema`, concat(t.table_name, '.', t.constraint_name) AS constraint_name, t.table_name, t.constraint_type AS kind, r.unique_constraint_schema AS ref_schema, concat(r.referenced_table_name, '.', r.unique_constraint_name) AS ref_constraint
  FROM information_schema.table_constraints t LEFT JOIN information_schema.referential_constraints r ON r.constraint_schema = t.constraint_schema AND r.constraint_name = t.constraint_name AND r.table_name = t.table_name WHERE t.constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY')""",
        "usage": "SELECT constraint_schema AS `schema`, concat(table_name, '.', constraint_name) AS constraint_name, column_name, ordinal_position AS ordinal FROM information_schema.key_column_usage",
        "index_columns": "SELECT table_schema AS `schema`, table_name, index_name, column_name, seq_in_index AS ordinal, non_unique = 0 AS is_unique, 0 AS scans FROM information_schema.statistics",
        "stats": "SELECT table_schema AS `schema`, table_name, table_rows AS row_count, data_length AS data_bytes, index_length AS index_bytes, update_time AS last_vacuum, create_time AS last_autovacuum, check_time AS last_analyze, NULL AS last_autoanalyze FROM information_schema.tables WHERE table_type = 'BASE TABLE'",
    },
    "sqlserver": {k: v.format(q='"', extra="") for k, v in (_STANDARD | {"materialised": _NO_ROWS}).items()}
    | {
        "triggers": 'SELECT schema_name(t.schema_id) AS "schema", g.name, t.name AS table_name, m.definition FROM sys.triggers g JOIN sys.tables t ON t.object_id = g.parent_id JOIN sys.sql_modules m ON m.object_id = g.object_id',
        "index_columns": """SELECT schema_name(t.schema_id) AS "schema", t.name AS table_name, i.name AS index_name, c.name AS column_name, x.key_ordinal AS ordinal, i.is_unique, coalesce(u.user_seeks + u.user_scans + u.user_lookups, 0) AS scans
  FROM sys.indexes i JOIN sys.tables t ON t.object_id = i.object_id JOIN sys.index_columns x ON x.object_id = i.object_id AND x.index_id = i.index_id JOIN sys.columns c ON c.object_id = x.object_id AND c.column_id = x.column_id
  LEFT JOIN sys.dm_db_index_usage_stats u ON u.object_id = i.object_id AND u.index_id = i.index_id AND u.database_id = db_id()""",
        "stats": """SELECT schema_name(t.schema_id) AS "schema", t.name AS table_name, sum(CASE WHEN p.index_id < 2 THEN p.row_count END) AS row_count, sum(CASE WHEN p.index_id < 2 THEN p.used_page_count END) * 8192 AS data_bytes, sum(CASE WHEN p.index_id >= 2 THEN p.used_page_count END) * 8192 AS index_bytes,
  max(t.modify_date) AS last_vacuum, max(t.create_date) AS last_autovacuum, NULL AS last_analyze, NULL AS last_autoanalyze FROM sys.tables t JOIN sys.dm_db_partition_stats p ON p.object_id = t.object_id GROUP BY t.schema_id, t.name""",
    },
}
CATALOG_SQL["mariadb"] = CATALOG_SQL["mysql"]


def catalog_frame(spark: SparkSession, kind: str, what: str, host: str, database: str, port: int | None = None, **options: str) -> DataFrame:
    """One of the frames of ``operators.catalog``, read from a database's own catalog."""
    return query(spark, kind, CATALOG_SQL[kind][what], host, database, port, **options)


def sample(spark: SparkSession, kind: str, name: str, host: str, database: str, n: int = 100, port: int | None = None, **options: str) -> DataFrame:
    """The first n rows of a table, cut off by the database itself."""
    if not all(part.replace("_", "").isalnum() for part in name.split(".")):
        raise ValueError(f"not a table's name: {name}")
    sql = f"SELECT TOP {int(n)} * FROM {name}" if kind == "sqlserver" else f"SELECT * FROM {name} LIMIT {int(n)}"
    return query(spark, kind, sql, host, database, port, **options)


def documents(spark: SparkSession, path: str, sampling: float = 1.0) -> DataFrame:
    """An exported collection: one JSON object a line, its schema inferred."""
    return spark.read.option("samplingRatio", sampling).json(path)


def stored_size(df: DataFrame) -> DataFrame:
    """Bytes and last change of the files below a table."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return files.agg(F.sum("file_size").alias("size_bytes"), F.max("file_modification_time").alias("last_updated"))
