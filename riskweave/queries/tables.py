"""The table audit: profiles, integrity, sampling plans, snapshots, lineage and the read-only guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from ._common import Derived, Query, quote, table

#: Orders with nulls, bad phones and bad numbers at known places; the same text in both engines.
DIRTY = """select o_orderkey, case when o_orderkey % 7 = 0 then null else o_custkey end as o_custkey, nullif(o_orderpriority, '1-URGENT') as o_orderpriority, o_orderstatus,
  case when o_orderkey % 11 = 0 then null when o_orderkey % 5 = 0 then 'broken@' else concat('u', cast(o_orderkey as varchar(20)), '@example.org') end as contact_email,
  case when o_orderkey % 9 = 0 then 'call me' else concat('+33 1 00 ', lpad(cast(o_orderkey % 10000 as varchar(20)), 4, '0')) end as phone,
  case when o_orderkey % 13 = 0 then '12,5' else cast(o_orderkey % 1000 as varchar(20)) end as amount_text from orders"""
_DIRTY_COLUMNS = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "contact_email", "phone", "amount_text"]


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))


_PCT = "round(100.0::double * (count(*) - count({0})) / count(*), 2)"
_NULLS = " union all ".join(f"select '{c}' as column_name, {_PCT.format(c)} as null_pct from ({DIRTY})" for c in _DIRTY_COLUMNS)
_RULES = [(c, r) for c in _DIRTY_COLUMNS if (r := tables.rule_of(c, c not in ("o_orderkey", "o_custkey")))]
_ALL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Child, foreign key, parent, key.
KEYS = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("labels", "doc_id", "documents", "doc_id"))


def orphans_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key with a tenth of the parents taken away."""
    out = None
    for child, fk, parent, pk in KEYS:
        kept = table(spark, sf_dir, parent).where(f"{pk} % 10 <> 3")
        row = tables.orphans(table(spark, sf_dir, child), fk, kept, pk).select(F.lit(child).alias("child"), F.lit(fk).alias("fk"), "orphan_rows")
        out = row if out is None else out.unionByName(row)
    return out


def orphans_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key against all its parents, with the number of child rows looked at."""
    out = None
    for child, fk, parent, pk in KEYS:
        found = tables.orphans(table(spark, sf_dir, child), fk, table(spark, sf_dir, parent), pk)
        checked = table(spark, sf_dir, child).agg(F.count(fk).alias("checked"))
        row = found.crossJoin(checked).select(F.lit(child).alias("child"), F.lit(fk).alias("fk"), "checked", "orphan_rows")
        out = row if out is None else out.unionByName(row)
    return out


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in _ALL:
        df = table(spark, sf_dir, t)
        row = df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"))
        out = row if out is None else out.unionByName(row)
    return out


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table, and the orders with gaps, profiled over all rows and columns."""
    out = None
    for name, df in [(t, table(spark, sf_dir, t)) for t in _ALL] + [("dirty_orders", dirty(spark, sf_dir))]:
        row = tables.profile(df).select(F.lit(name).alias("table_name"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def _profile_sql(name: str, source: str, columns: str) -> str:
    nulls = f"(select count(*) from (select unnest([{columns}]) x from {source}) where x is null)" if columns else "0"
    return f"select '{name}' as table_name, n as row_count, c as column_count, nulls::bigint as null_cells, round(100 - 100.0::double * nulls / (n * c), 2) as completeness, n - distinct_rows as duplicate_rows from (select (select count(*) from {source}) n, (select count(*) from (describe select * from {source}))::int c, {nulls} nulls, (select count(*) from (select distinct * from {source})) distinct_rows)"


# the tables of the folder have no nulls (the query counts them all the same); the orders with gaps have
_PROFILES = " union all ".join([_profile_sql(t, t, "") for t in _ALL] + [_profile_sql("dirty_orders", f"({DIRTY})", ", ".join(f"{c}::varchar" for c in _DIRTY_COLUMNS))])
_TOTALS = " union all ".join(f"select '{t}' as table_name, (select count(*) from {t}) as row_count, (select count(*) from (describe {t}))::int as column_count" for t in _ALL)
CATALOG = Derived("""select case p_partkey % 6 when 0 then 'public' when 1 then 'HR' when 2 then 'sales' when 3 then null when 4 then 'finance' else 'dwh' end as schema,
  concat(case p_size % 9 when 0 then 'users' when 1 then 'products' when 2 then 'access_log' when 3 then 'notes' when 4 then 'Payments' when 5 then 'old_orders' else 'facts' end, '_', p_partkey) as table_name,
  cast(case p_partkey % 4 when 0 then p_size when 1 then p_size * 100 when 2 then p_size * 20000 else p_size * 2000000 end as bigint) as row_count from part""")
_holds = lambda words: f"regexp_matches(lower(table_name), '{'|'.join(words)}')"
_TZONE = f"case when lower(coalesce(schema, '')) in ({', '.join(map(quote, tables.SENSITIVE_SCHEMAS))}) or {_holds(tables.SENSITIVE_TABLES)} then 'SENSITIVE' when {_holds(tables.ARCHIVE_TABLES)} then 'ARCHIVE' else 'NORMAL' end"


SAMPLE_SIZE_SQL = f"""select schema, table_name, row_count, zone, case when row_count <= 1000 then row_count else greatest(1000, case when row_count < 1000000 then share else least(share, 100000) end) end::bigint as sample_size from (
  select schema, table_name, row_count, zone, floor(row_count * case zone when 'SENSITIVE' then 100 when 'ARCHIVE' then 5 else 30 end / 100)::bigint share from (select *, {_TZONE} as zone from {CATALOG.sql}))"""


def zone_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = tables.zone(F.coalesce("schema", F.lit("")), F.col("table_name"))
    return CATALOG.frame(spark, sf_dir).withColumn("zone", zone).withColumn("sample_size", tables.sample_size(F.col("zone"), F.col("row_count")))


_NOW = Derived("select case p_partkey % 3 when 0 then null when 1 then 'public' else 'x' end as schema, concat('t', p_partkey) as table_name, cast(p_size * 10 as bigint) as row_count, cast(p_size % 7 + 1 as int) as column_count, concat('h', p_size % 5) as column_hash from part where p_partkey % 10 <> 1")
_OLD = Derived("""select case p_partkey % 6 when 0 then null when 1 then 'public' when 2 then 'x' when 3 then 'public' when 4 then null else 'x' end as schema, concat('t', p_partkey) as table_name, cast(p_size * 10 + case when p_partkey % 8 = 0 then 1 else 0 end as bigint) as row_count,
  cast(p_size % 7 + 1 as int) as column_count, case when p_partkey % 9 = 0 then 'other' when p_partkey % 13 = 0 then null else concat('h', p_size % 5) end as column_hash from part where p_partkey % 10 <> 2""")
_COLUMNS = Derived("""select distinct concat('t', l_partkey) as table_name, l_linenumber as pos, case when l_linenumber = 1 and l_partkey % 3 = 0 then 'created_at' when l_linenumber = 2 and l_partkey % 2 = 0 then 'Updated_At' when l_linenumber = 3 and l_partkey % 5 = 0 then 'deleted_at'
  when l_linenumber = 4 and l_partkey % 7 = 0 then 'pin_hash' when l_linenumber = 5 and l_partkey % 4 = 0 then 'cipher_key' else concat('c', l_linenumber) end as name, case when l_linenumber = 5 and l_partkey % 8 = 0 then 'bytea' else 'text' end as type from lineitem""")


def schema_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _COLUMNS.frame(spark, sf_dir).groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "type"))).alias("c"))
    return rows.select("table_name", tables.column_hash(F.col("c")).alias("column_hash"), tables.audit_columns(F.col("c.name")).alias("has_audit_columns"), tables.encryption_signs(F.col("c")).alias("has_encryption"))


_CREATED, _UPDATED, _DELETED = "('created_at', 'created_date', 'creation_date', 'date_created', 'insert_timestamp')", "('date_modified', 'modification_date', 'update_timestamp', 'updated_at', 'updated_date')", "('date_deleted', 'deleted_at', 'deleted_date')"
_IDS = Derived("select case s_suppkey % 3 when 0 then 'postgresql' when 1 then 'mysql' else 'mongodb' end as db_type, concat('db', s_nationkey) as host, s_name as database_name from supplier")
VIEWS = Derived("""select concat('v', p_partkey) as view_name, concat(case p_size % 4 when 0 then 'SELECT a FROM "sales"."orders' when 1 then 'select * from lines' when 2 then 'select 1 -- ' else 'SELECT x FROM hr.staff' end, p_partkey % 20,
  case p_size % 4 when 0 then '" o JOIN clients c ON 1=1' when 3 then ' UNION SELECT y FROM hr.staff1' else '' end) as definition from part""")
STATEMENTS = Derived("""select p_partkey, concat(case p_partkey % 9 when 0 then 'SELECT ' when 1 then '  select created_at, ' when 2 then 'DELETE FROM t where x = ' when 3 then 'select 1; drop table t' when 4 then 'SHOW TABLES ' when 5 then 'WITH x AS (SELECT 1) SELECT ' when 6 then 'SELECT updates, grants, '
  when 7 then 'select ''GRANT'' as x, ' else 'update t set a = 1; delete from t' end, p_size) as query from part""")
_VERB = f"list_sort(list_distinct(regexp_extract_all(upper(query), '\\b({'|'.join(tables.FORBIDDEN)})\\b', 1)))[1]"


def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered string aggregation, as over index columns: the nations of each region by name."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("x"))
    return rows.select("n_regionkey", F.array_join("x", ",").alias("names"))


def _with_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("customer", "orders")
    return spark.sql(EXISTS.format(**{n: "{" + n + "}" for n in names}), **{n: table(spark, sf_dir, n) for n in names})


EXISTS = """select c_nationkey, count(*) as customers, count(distinct c_mktsegment) as segments, cast((select count(*) from {orders} where o_orderstatus = 'F') as bigint) as finished
  from {customer} c where exists (select 1 from {orders} o where o.o_custkey = c.c_custkey and o.o_totalprice > 300000) group by c_nationkey"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "tbl_null_pct": (lambda s, d: tables.null_percent(dirty(s, d)), f"select * from ({_NULLS}) where null_pct > 0"),
    "tbl_completeness": (lambda s, d: tables.completeness(dirty(s, d)), f"select (select count(*) from orders) as row_count, round(100 - sum(null_pct) / {len(_DIRTY_COLUMNS)}, 2) as completeness from ({_NULLS})"),
    "tbl_duplicates": (lambda s, d: tables.duplicates(table(s, d, "documents"), ["text"]), "select count(*) as row_count, count(*) - count(distinct text) as duplicate_rows from documents"),
    "tbl_duplicate_keys": (lambda s, d: tables.duplicates(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "select count(*) as row_count, count(*) - count(distinct (l_orderkey, l_linenumber)) as duplicate_rows from lineitem"),
    "tbl_type_validity": (lambda s, d: tables.invalid_values(dirty(s, d)), " union all ".join(f"select '{c}' as column_name, count({c}) as checked, count_if({c} is not null and not regexp_matches({c}, {quote(r)})) as invalid from ({DIRTY})" for c, r in _RULES)),
    "tbl_orphans": (
        lambda s, d: tables.orphans(table(s, d, "lineitem"), "l_orderkey", table(s, d, "orders").where("o_orderkey % 10 <> 0"), "o_orderkey"),
        "select count(*) as orphan_rows from lineitem where l_orderkey is not null and not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderkey % 10 <> 0)",
    ),
    "tbl_orphans_multi_fk": (orphans_multi, " union all ".join(f"select '{c}' as child, '{fk}' as fk, count(*) as orphan_rows from {c} x where {fk} is not null and not exists (select 1 from {p} y where y.{pk} = x.{fk} and y.{pk} % 10 <> 3)" for c, fk, p, pk in KEYS)),
    "tbl_orphans_whole": (orphans_whole, " union all ".join(f"select '{c}' as child, '{fk}' as fk, count({fk}) as checked, count_if({fk} is not null and not exists (select 1 from {p} y where y.{pk} = x.{fk})) as orphan_rows from {c} x" for c, fk, p, pk in KEYS)),
    "tbl_profiles": (profiles, _PROFILES),
    "tbl_totals": (totals, _TOTALS),
    "tbl_size_balance": (lambda s, d: tables.size_balance(totals(s, d).select(F.col("row_count").alias("size"))), f"""select round(case when max(row_count) / sum(row_count) <= 0.5 then 1.0 else 2 * (1 - max(row_count) / sum(row_count)) end, 4) as by_largest,
      round(greatest(0.0, least(1.0, 1 - stddev_pop(row_count) / avg(row_count))), 4) as by_variation from ({_TOTALS})"""),
    "tbl_zone_sampling": (zone_sampling, SAMPLE_SIZE_SQL),
    "tbl_snapshot_diff": (lambda s, d: tables.snapshot_diff(_NOW.frame(s, d), _OLD.frame(s, d)), f"""select coalesce(c.schema, 'public') as schema, c.table_name, case when p.table_name is null then 'new' when c.row_count = p.row_count and c.column_count = p.column_count and c.column_hash = p.column_hash then 'unchanged' else 'modified' end as status
      from {_NOW.sql} c left join {_OLD.sql} p on coalesce(c.schema, 'public') = coalesce(p.schema, 'public') and c.table_name = p.table_name"""),
    "tbl_column_hash": (schema_signs, f"""select table_name, substr(sha256(string_agg(name || ':' || type, '|' order by pos)), 1, 32) as column_hash,
      bool_or(lower(name) in {_CREATED})::int + bool_or(lower(name) in {_UPDATED})::int + bool_or(lower(name) in {_DELETED})::int >= 2 as has_audit_columns,
      bool_or(name like '%\\_encrypted' escape '\\' or name like '%\\_hash' escape '\\' or (type = 'bytea' and (name like '%encrypted%' or name like '%cipher%' or name like '%\\_enc' escape '\\' or name like 'enc\\_%' escape '\\'))) as has_encryption from {_COLUMNS.sql} group by table_name"""),
    "source_id": (lambda s, d: _IDS.frame(s, d).withColumn("source_id", tables.source_id(F.col("db_type"), F.col("host"), F.col("database_name"))), f"select *, substr(sha256(db_type || '_' || host || '_' || database_name), 1, 16) as source_id from {_IDS.sql}"),
    "lineage_view_refs": (lambda s, d: VIEWS.frame(s, d).select("view_name", F.explode(tables.referenced_tables(F.col("definition"))).alias("table_name")), f"""select distinct view_name, unnest(regexp_extract_all(definition, '(?i)\\b(?:FROM|JOIN)\\s+(?:"?\\w+"?\\.)?"?(\\w+)"?', 1)) as table_name from {VIEWS.sql}"""),
    "readonly_guard": (lambda s, d: STATEMENTS.frame(s, d).select("p_partkey", "query", tables.forbidden_word(F.col("query")).alias("forbidden"), tables.read_only(F.col("query")).alias("read_only")), f"select p_partkey, query, {_VERB} as forbidden, {_VERB} is null and starts_with(upper(trim(query)), 'SELECT') as read_only from {STATEMENTS.sql}"),
    "catalog_ordered_names": (indexes, "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey"),
    "catalog_exists_subquery": (_with_exists, EXISTS.format(orders="orders", customer="customer")),
}
