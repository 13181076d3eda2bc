"""Profiling tables: nulls, completeness, duplicates, orphans, type validity, sampling plans, snapshots, lineage."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_percent(df: DataFrame) -> DataFrame:
    """column_name, null_pct of each column with nulls, by one pass over the table."""
    total = F.count("*")
    each = [F.struct(F.lit(c).alias("column_name"), F.round(100.0 * (total - F.count(df[c])) / total, 2).alias("null_pct")) for c in df.columns]
    return df.agg(F.explode(F.array(*each)).alias("x")).select("x.*").where("null_pct > 0")


def completeness(df: DataFrame) -> DataFrame:
    """row_count and 100 less the mean null percentage over all columns; 100 for an empty table."""
    total = F.count("*")
    nulls = [F.coalesce(F.round(100.0 * (total - F.count(df[c])) / F.nullif(total, F.lit(0)), 2), F.lit(0.0)) for c in df.columns]
    return df.agg(total.alias("row_count"), F.round(100 - reduce(lambda a, b: a + b, nulls) / len(nulls), 2).alias("completeness"))


def duplicates(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """row_count, and the rows beyond the first of each distinct key (all columns by default)."""
    groups = df.groupBy(*(keys or df.columns)).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def profile(df: DataFrame) -> DataFrame:
    """One row: row_count, column_count, null_cells, completeness, and duplicate_rows over all columns."""
    nulls = reduce(lambda a, b: a + b, [F.count_if(df[c].isNull()) for c in df.columns])
    cells = df.agg(F.count("*").alias("row_count"), nulls.alias("null_cells"))
    share = F.coalesce(100.0 * F.col("null_cells") / F.nullif(F.col("row_count") * len(df.columns), F.lit(0)), F.lit(0.0))
    return cells.crossJoin(duplicates(df).select("duplicate_rows")).select("row_count", F.lit(len(df.columns)).alias("column_count"), "null_cells", F.round(100 - share, 2).alias("completeness"), "duplicate_rows")


def candidate_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return duplicates(df, keys).select((F.col("duplicate_rows") == 0).alias("is_key"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of the child whose key isn't null and has no parent."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti").agg(F.count("*").alias("orphan_rows"))


EMAIL, PHONE, NUMBER = r"^[\w.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", r"^\+?[-0-9\s()]{8,}$", r"^-?[0-9]+(\.[0-9]+)?$"


def rule_of(column: str, is_text: bool) -> str | None:
    """The pattern that a column's name asks for."""
    low = column.lower()
    if "mail" in low:
        return EMAIL
    if "phone" in low or "tel" in low:
        return PHONE
    return NUMBER if is_text and re.search("amount|count|price|quantity", low) else None


def invalid_values(df: DataFrame) -> DataFrame:
    """column_name, checked and invalid values of the columns that a rule applies to, by one pass."""
    rules = [(c, r) for c, t in df.dtypes if (r := rule_of(c, t == "string"))]
    each = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("checked"), F.count_if(F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(r)).alias("invalid")) for c, r in rules]
    if not each:
        return df.sparkSession.createDataFrame([], "column_name string, checked bigint, invalid bigint")
    return df.agg(F.explode(F.array(*each)).alias("x")).select("x.*")


SENSITIVE_SCHEMAS = tuple(sorted({"account", "banking", "compensation", "customers", "employee", "finance", "hr", "payroll", "personal", "personnel", "rh", "users"}))
SENSITIVE_TABLES = ("accounts", "clients", "contracts", "customers", "employees", "invoices", "payments", "personnel", "salaries", "transactions", "users")
ARCHIVE_TABLES = ("archive", "audit", "backup", "deprecated", "history", "log", "old", "snapshot", "staging", "temp", "test", "tmp")
RATES = {"SENSITIVE": 100, "NORMAL": 30, "ARCHIVE": 5}


def _holds(name: Column, words: tuple[str, ...]) -> Column:
    return name.rlike("|".join(words))


def zone(schema: Column, name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.lower(schema).isin(*SENSITIVE_SCHEMAS) | _holds(low, SENSITIVE_TABLES), "SENSITIVE").when(_holds(low, ARCHIVE_TABLES), "ARCHIVE").otherwise("NORMAL")


def sample_size(zone_: Column, rows: Column, least: int = 1000, most: int = 100_000) -> Column:
    rate = F.when(zone_ == "SENSITIVE", RATES["SENSITIVE"]).when(zone_ == "ARCHIVE", RATES["ARCHIVE"]).otherwise(RATES["NORMAL"])
    share = F.floor(rows * rate / 100)
    return F.when(rows <= least, rows).otherwise(F.greatest(F.lit(least), F.when(rows < 1_000_000, share).otherwise(F.least(share, F.lit(most))))).cast("bigint")


def column_hash(columns: Column) -> Column:
    """32 hex digits over name:type of an array of structs (name, type)."""
    return F.substring(F.sha2(F.array_join(F.transform(columns, lambda c: F.concat(c["name"], F.lit(":"), c["type"])), "|"), 256), 1, 32)


def source_id(db_type: Column, host: Column, database: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("_", db_type, host, database), 256), 1, 16)


def snapshot_diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """schema, table_name and status of each current table, by row count, column count and column hash; a null schema is public."""
    key = lambda d: d.withColumn("schema", F.coalesce("schema", F.lit("public")))
    p = key(previous).select("schema", "table_name", *[F.col(c).alias(f"_{c}") for c in ("row_count", "column_count", "column_hash")], F.lit(True).alias("_there"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("row_count", "column_count", "column_hash")])
    status = F.when(F.col("_there").isNull(), "new").when(same, "unchanged").otherwise("modified")
    return key(current).join(p, ["schema", "table_name"], "left").select("schema", "table_name", status.alias("status"))


def audit_columns(names: Column) -> Column:
    """Whether lower-cased column names hold two of created, updated and deleted times."""
    sets = (("created_at", "created_date", "creation_date", "date_created", "insert_timestamp"), ("date_modified", "modification_date", "update_timestamp", "updated_at", "updated_date"), ("date_deleted", "deleted_at", "deleted_date"))
    low = F.transform(names, F.lower)
    return reduce(lambda a, b: a + b, [F.arrays_overlap(low, F.array(*map(F.lit, s))).cast("int") for s in sets]) >= 2


def encryption_signs(columns: Column) -> Column:
    """Whether a structure of (name, type) looks encrypted: by name, or a binary column with a name that says so."""
    named = lambda c: c["name"].rlike("_encrypted$|_hash$")
    binary = lambda c: (c["type"] == "bytea") & c["name"].rlike("encrypted|cipher|_enc$|^enc_")
    return F.exists(columns, lambda c: named(c) | binary(c))


def size_balance(sizes: DataFrame) -> DataFrame:
    """Balance of table sizes by the largest share, and by the coefficient of variation."""
    share, cv = F.max("size") / F.sum("size"), F.stddev_pop("size") / F.avg("size")
    largest = F.when(share <= 0.5, 1.0).otherwise(2 * (1 - share))
    return sizes.agg(F.round(largest, 4).alias("by_largest"), F.round(F.when(F.count("*") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv))), 4).alias("by_variation"))


FORBIDDEN = ("ALTER", "CREATE", "DELETE", "DROP", "GRANT", "INSERT", "REVOKE", "UPDATE")


def forbidden_word(query: Column) -> Column:
    """The first verb (by the alphabet) that a read-only query must not have, or null."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(query), F.lit(rf"\b({'|'.join(FORBIDDEN)})\b"), F.lit(1))))
    return F.get(found, F.lit(0))


def read_only(query: Column) -> Column:
    return forbidden_word(query).isNull() & F.startswith(F.upper(F.trim(query)), F.lit("SELECT"))


def check_read_only(sql: str) -> str:
    """Returns a query that only reads; anything else is an error."""
    if (bad := re.search(rf"\b({'|'.join(FORBIDDEN)})\b", sql.upper())) or not sql.strip().upper().startswith("SELECT"):
        raise ValueError(f"not a read-only query: {bad[1] if bad else sql[:20]}")
    return sql


def referenced_tables(definition: Column) -> Column:
    """Distinct tables after FROM and JOIN in a view's text, without schema and quotes."""
    names = F.regexp_extract_all(definition, F.lit(r'(?i)\b(?:FROM|JOIN)\s+(?:"?\w+"?\.)?"?(\w+)"?'), F.lit(1))
    return F.array_sort(F.array_distinct(names))
