"""Database catalogs: structure, keys, indexes, sizes, totals, lineage and samples, over frames derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as c
from ..operators import tables as t
from ._common import Derived, Query, quote, table
from .pii import CELL_FOUND, cell_found
from .tables import CATALOG, SAMPLE_SIZE_SQL

COLUMNS = Derived("""select distinct case l_partkey % 12 when 0 then 'pg_catalog' when 1 then 'Sales' when 2 then null when 3 then 'INFORMATION_SCHEMA' else concat('s', l_partkey % 5) end as schema, concat('t', l_partkey) as table_name,
  concat('c', l_linenumber) as column_name, l_linenumber as ordinal, case l_linenumber % 3 when 0 then 'bigint' when 1 then 'text' else 'timestamp' end as data_type from lineitem""")
CONSTRAINTS = Derived("""select concat('s', p_partkey % 5) as schema, concat('pk', p_partkey) as constraint_name, concat('t', p_partkey) as table_name, 'PRIMARY KEY' as kind, cast(null as varchar(20)) as ref_schema, cast(null as varchar(20)) as ref_constraint from part
  union all select concat('s', p_partkey % 5), concat('fk', p_partkey), concat('t', p_partkey), 'FOREIGN KEY', concat('s', p_partkey % 5), concat('pk', p_partkey - 10) from part where p_partkey % 3 = 0 and p_partkey > 10""")
USAGE = Derived("""select concat('s', p_partkey % 5) as schema, concat('pk', p_partkey) as constraint_name, 'c1' as column_name, 1 as ordinal from part
  union all select concat('s', p_partkey % 5), concat('pk', p_partkey), 'a2', 2 from part where p_partkey % 4 = 0
  union all select concat('s', p_partkey % 5), concat('fk', p_partkey), 'f1', 1 from part where p_partkey % 3 = 0 and p_partkey > 10
  union all select concat('s', p_partkey % 5), concat('fk', p_partkey), 'b2', 2 from part where p_partkey % 3 = 0 and p_partkey > 10 and (p_partkey - 10) % 4 = 0""")
INDEX_COLUMNS = Derived("""select distinct concat('s', l_partkey % 5) as schema, concat('t', l_partkey) as table_name, concat('ix', l_linenumber % 3) as index_name, concat('c', l_linenumber) as column_name, 10 - l_linenumber as ordinal,
  l_partkey % 2 = 0 and l_linenumber % 3 = 1 as is_unique, l_partkey * (l_linenumber % 3) as scans from lineitem where l_partkey % 7 <> 0""")
_TIME = "case when p_partkey % {0} = 0 then null else cast(concat('2024-0', (p_size + p_partkey) % {1} + 1, '-01 00:00:00') as timestamp) end"
STATS = Derived(f"""select concat('s', p_partkey % 5) as schema, concat('t', p_partkey) as table_name, cast(p_size * 100 as bigint) as row_count, case when p_partkey % 10 = 0 then null else cast(p_size * 8192 as bigint) end as data_bytes,
  case when p_partkey % 4 = 0 then null else cast(p_partkey * 10 as bigint) end as index_bytes, {_TIME.format(2, 9)} as last_vacuum, {_TIME.format(3, 7)} as last_autovacuum, {_TIME.format(4, 5)} as last_analyze, {_TIME.format(6, 3)} as last_autoanalyze from part""")
_FROM = "concat('select x from s1.t', {0} % 30, case when {0} % 3 = 0 then concat(' join \"s2\".\"u', {0} % 7, '\" on 1 = 1') else '' end)"
VIEWS = Derived(f"select concat('s', p_partkey % 5) as schema, concat('v', p_partkey) as name, {_FROM.format('p_partkey')} as definition from part")
MATERIALISED = Derived(f"select concat('s', s_suppkey % 5) as schema, concat('m', s_suppkey) as name, {_FROM.format('s_suppkey')} as definition from supplier")
ROUTINES = Derived(f"select concat('s', c_custkey % 5) as schema, concat('r', c_custkey % 200) as name, {_FROM.format('c_custkey')} as definition from customer where c_custkey % 11 <> 0")
TRIGGERS = Derived(f"select concat('s', s_suppkey % 5) as schema, concat('g', s_suppkey) as name, concat('t', s_nationkey) as table_name, case when s_suppkey % 2 = 0 then concat('begin ', {_FROM.format('s_suppkey')}, '; end') else 'execute function f()' end as definition from supplier")

_USER = f"(select * from {COLUMNS.sql} where schema is null or lower(schema) not in ({', '.join(map(quote, c.SYSTEM_SCHEMAS))}))"
_SIZES = f"(select *, case when data_bytes is null and index_bytes is null then null else coalesce(data_bytes, 0) + coalesce(index_bytes, 0) end::bigint as size_bytes, greatest({', '.join(c.TIMES)}) as last_updated from {STATS.sql})"
_REFS = """unnest(regexp_extract_all(definition, '(?i)\\b(?:FROM|JOIN)\\s+(?:"?\\w+"?\\.)?"?(\\w+)"?', 1)) as table_name"""
_EDGES = " union ".join(f"select '{kind}' as kind, schema, name, {_REFS} from {d.sql}" for kind, d in (("view", VIEWS), ("materialised view", MATERIALISED), ("routine", ROUTINES), ("trigger", TRIGGERS))) + f" union select 'trigger', schema, name, table_name from {TRIGGERS.sql}"


#: Rows of several tables in one frame, by which a table's sample is drawn down to its own size.
CELLS = Derived("select concat('t', l_suppkey % 20) as table_name, concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', l_quantity, '-', l_extendedprice) as row_key from lineitem")


def table_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table sampled down to the size that its zone allows; here an archive of a few thousand rows gives at least 1,000."""
    rows = CELLS.frame(spark, sf_dir).distinct()
    sizes = rows.groupBy("table_name").agg(F.count("*").alias("row_count"))
    sizes = sizes.withColumn("sample_size", t.sample_size(t.zone(F.lit("dwh"), F.concat(F.lit("old_"), "table_name")), F.col("row_count"), least=100))
    return c.sampled_each(rows.join(sizes, "table_name"), ["table_name"], "row_key").select("table_name", "row_key", "sample_size")


_SAMPLES = f"""select table_name, row_key, sample_size from (select *, count(*) over (partition by table_name) row_count, row_number() over (partition by table_name order by ('0x' || substr(md5(row_key), 1, 8))::bigint, row_key) place from (select distinct * from {CELLS.sql}))
  , lateral (select case when row_count <= 100 then row_count else greatest(100, row_count * 5 // 100) end::bigint as sample_size) where place <= sample_size"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "catalog_structure": (lambda s, d: c.structure(COLUMNS.frame(s, d)), f"select schema, table_name, count(*) as column_count, string_agg(column_name || ':' || data_type, ',' order by ordinal) as columns from {_USER} group by schema, table_name"),
    "catalog_schemas": (lambda s, d: c.schemas(COLUMNS.frame(s, d)), f"select schema, count(distinct table_name) as tables, count(*) as columns from {_USER} group by schema"),
    "catalog_primary_keys": (lambda s, d: c.primary_keys(CONSTRAINTS.frame(s, d), USAGE.frame(s, d)), f"select k.schema, table_name, string_agg(column_name, ',' order by ordinal) as key from {CONSTRAINTS.sql} k join {USAGE.sql} u on u.schema = k.schema and u.constraint_name = k.constraint_name where kind = 'PRIMARY KEY' group by k.schema, table_name"),
    "catalog_keys": (lambda s, d: c.foreign_keys(CONSTRAINTS.frame(s, d), USAGE.frame(s, d)), f"""select k.schema, k.table_name, k.constraint_name, u.ordinal, u.column_name, k.ref_schema, r.table_name as ref_table, v.column_name as ref_column from {CONSTRAINTS.sql} k join {USAGE.sql} u on u.schema = k.schema and u.constraint_name = k.constraint_name
      join {CONSTRAINTS.sql} r on r.schema = k.ref_schema and r.constraint_name = k.ref_constraint join {USAGE.sql} v on v.schema = r.schema and v.constraint_name = r.constraint_name and v.ordinal = u.ordinal where k.kind = 'FOREIGN KEY'"""),
    "catalog_indexes": (lambda s, d: c.indexes(INDEX_COLUMNS.frame(s, d)), f"select schema, table_name, index_name, string_agg(column_name, ',' order by ordinal) as columns, bool_or(is_unique) as is_unique from {INDEX_COLUMNS.sql} group by schema, table_name, index_name"),
    "catalog_index_usage": (lambda s, d: c.index_usage(STATS.frame(s, d), INDEX_COLUMNS.frame(s, d)), f"""select t.schema, t.table_name, coalesce(n, 0)::bigint as indexes, coalesce(scans, 0)::bigint as index_scans from {STATS.sql} t left join (select schema, table_name, count(*) n, sum(scans) scans from (
      select schema, table_name, index_name, max(scans) scans from {INDEX_COLUMNS.sql} group by all) group by all) i on i.schema = t.schema and i.table_name = t.table_name"""),
    "catalog_sizes": (lambda s, d: c.sizes(STATS.frame(s, d)), f"select schema, table_name, size_bytes, last_updated from {_SIZES}"),
    "catalog_largest": (lambda s, d: c.largest(STATS.frame(s, d)), f"select schema, table_name, size_bytes from {_SIZES} order by size_bytes desc nulls last, schema, table_name limit 10"),
    "catalog_totals": (lambda s, d: c.totals(STATS.frame(s, d)), f"select count(*) as tables, sum(row_count)::bigint as total_rows, sum(size_bytes)::bigint as total_bytes, count_if(size_bytes is null) as unknown_sizes from {_SIZES}"),
    "catalog_personal_summary": (lambda s, d: c.personal_summary(cell_found(s, d)), f"select count(distinct table_name) as tables_with_pii, string_agg(distinct pii_type, ',' order by pii_type) as pii_types from ({CELL_FOUND})"),
    "lineage_all": (lambda s, d: c.lineage(VIEWS.frame(s, d), MATERIALISED.frame(s, d), TRIGGERS.frame(s, d), ROUTINES.frame(s, d)), _EDGES),
    "lineage_triggers": (lambda s, d: c.lineage(*[x.frame(s, d) for x in (VIEWS, MATERIALISED, TRIGGERS, ROUTINES)]).where("kind = 'trigger'").groupBy("table_name").agg(F.count("*").alias("triggers")), f"select table_name, count(*) as triggers from ({_EDGES}) where kind = 'trigger' group by table_name"),
    "table_first_rows": (lambda s, d: c.first_rows(table(s, d, "orders"), 100, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus"), "select o_orderkey, o_custkey, o_orderstatus from orders order by o_orderkey limit 100"),
    "table_sampled": (lambda s, d: c.sampled(table(s, d, "customer"), "c_custkey", 120).select("c_custkey", "c_name"), "select c_custkey, c_name from customer order by ('0x' || substr(md5(c_custkey::varchar), 1, 8))::bigint, c_custkey limit 120"),
    "table_samples": (table_samples, _SAMPLES),
    "tables_by_zone": (lambda s, d: CATALOG.frame(s, d).withColumn("zone", t.zone(F.coalesce("schema", F.lit("")), F.col("table_name"))).withColumn("sample_size", t.sample_size(F.col("zone"), F.col("row_count"))).groupBy("zone").agg(F.count("*").alias("tables"), F.sum("sample_size").alias("sampled_rows")), f"select zone, count(*) as tables, sum(sample_size)::bigint as sampled_rows from ({SAMPLE_SIZE_SQL}) group by zone"),
}
