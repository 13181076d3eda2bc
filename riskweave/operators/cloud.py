"""Files of cloud drives: which to download, what their scan found, dates; sets of what was seen before; and sessions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXTRACTIBLE = tuple(sorted(".bat .c .cfg .conf .cpp .csv .go .h .htm .html .ini .java .js .json .log .md .php .py .rb .sql .txt .xlsx .xml .yaml .yml".split()))
MOST_BYTES = 5 * 1024 * 1024


def extractible(extension: Column, size: Column, item_id: Column, extensions: tuple[str, ...] = EXTRACTIBLE, most: int = MOST_BYTES) -> Column:
    """Whether the content of a cloud file is fetched: a known extension, at most 5 MB and an identifier; unknown values say no."""
    return F.coalesce(F.lower(extension).isin(*extensions) & (size <= most) & item_id.isNotNull(), F.lit(False))


def with_results(files: DataFrame, results: DataFrame, key: str = "item_id") -> DataFrame:
    """Every file with what its scan found: pii_detected, pii_types and pii_count; false, none and 0 without a result."""
    own = results.select(key, *[F.col(c).alias(f"_{c}") for c in ("pii_detected", "pii_types", "pii_count")])
    return files.join(own, key, "left").select(
        *files.columns,
        F.coalesce("_pii_detected", F.lit(False)).alias("pii_detected"),
        F.coalesce("_pii_types", F.array().cast("array<string>")).alias("pii_types"),
        F.coalesce("_pii_count", F.lit(0)).cast("bigint").alias("pii_count"),
    )


def with_zone(files: DataFrame, zones: DataFrame, key: str = "path_hash") -> DataFrame:
    """Every file with the zone of its fingerprint, ``normal`` where it has none."""
    return files.join(zones.select(key, F.col("zone").alias("_zone")), key, "left").withColumn("zone", F.coalesce("_zone", F.lit("normal"))).drop("_zone")


def iso_seconds(text: Column) -> Column:
    """Epoch seconds of an ISO 8601 time with a zone (Z or +hh:mm) or without one (then UTC), null if it is none."""
    t = F.regexp_replace(text, r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d)(\.\d{1,6})?\d*(Z|[+-]\d\d:?\d\d)?$", "$1 $2$3$4")
    zoned = F.when(t.rlike(r"(Z|[+-]\d\d:?\d\d)$"), t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d"), F.try_to_timestamp(zoned).cast("double"))


def all_of(*inventories: DataFrame) -> DataFrame:
    """The inventories of several roots or drives, one below the other; a column that one lacks is null there."""
    out = inventories[0]
    for x in inventories[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def first_files(inventory: DataFrame, most: int, root: str = "root") -> DataFrame:
    """At most so many files of each root, by path."""
    place = F.row_number().over(Window.partitionBy(root).orderBy("path"))
    return inventory.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


# --- what was seen before: exact, where a filter of hashes would only be nearly so -------------------------


def contains(keys: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The distinct keys, each with whether it was seen."""
    known = seen.select(key).distinct().withColumn("seen", F.lit(True))
    return keys.select(key).distinct().join(known, key, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))


def filter_new(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The rows whose key wasn't seen, one for each key."""
    return rows.join(seen.select(key), key, "left_anti").dropDuplicates([key])


def check_and_add(rows: DataFrame, seen: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The new rows, and the keys seen with them."""
    new = filter_new(rows, seen, key)
    return new, seen.select(key).unionByName(new.select(key)).distinct()


# --- document stores and sessions ----------------------------------------------------------------------

_MINI = re.compile(r"""^\s*select\s+(?P<what>\*|[\w.]+(?:\s*,\s*[\w.]+)*)\s+from\s+(?P<name>[\w.-]+)(?:\s+where\s+(?P<field>[\w.]+)\s*=\s*(?P<value>'[^']*'|"[^"]*"|\S+))?(?:\s+limit\s+(?P<limit>\d+))?\s*;?\s*$""", re.I)
MINI_LIMIT = 1000


def mini_query(sql: str) -> dict:
    """A small read-only query over a collection: its name, columns, one equality (numbers are compared as numbers) and limit (1,000 by default)."""
    m = _MINI.match(sql)
    if not m:
        raise ValueError(f"not a query over one collection: {sql[:40]}")
    value: object = m["value"]
    if isinstance(value, str):
        if value[:1] in "'\"":
            value = value[1:-1]
        elif re.fullmatch(r"-?\d+", value):
            value = int(value)
        elif re.fullmatch(r"-?\d+\.\d+", value):
            value = float(value)
    columns = None if m["what"] == "*" else [c.strip() for c in m["what"].split(",")]
    return {"collection": m["name"], "columns": columns, "field": m["field"], "value": value, "limit": int(m["limit"] or MINI_LIMIT)}


def run_mini(collections: dict[str, DataFrame], sql: str, order: list[str] | None = None) -> DataFrame:
    """Runs a small query; with ``order`` the rows that the limit keeps are the same each time."""
    q = mini_query(sql)
    rows = collections[q["collection"]]
    if q["field"]:
        rows = rows.where(F.col(q["field"]) == F.lit(q["value"]))
    rows = rows.orderBy(*order).limit(q["limit"]) if order else rows.limit(q["limit"])
    return rows.select(*q["columns"]) if q["columns"] else rows


def evicted(sessions: DataFrame, as_of: float, ttl: float = 3600.0, most: int = 50) -> DataFrame:
    """Sessions (session_id, created) with whether they go: too old, or beyond the newest ``most`` of the rest.

    Only the newest are ranked, by a limit that needs no task to hold them all.
    """
    rows = sessions.withColumn("expired", F.col("created") < as_of - ttl)
    kept = rows.where("not expired").orderBy(F.desc("created"), "session_id").limit(most).select("session_id", F.lit(True).alias("_kept"))
    return rows.join(F.broadcast(kept), "session_id", "left").select("session_id", "created", F.col("_kept").isNull().alias("evicted"))
