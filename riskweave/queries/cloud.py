"""Cloud drives, document stores and sessions, over frames derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cloud
from ._common import Derived, Query, quote, table

ITEMS = Derived("""select case when doc_id % 13 = 0 then null else concat('item', doc_id) end as item_id, concat('f', doc_id) as name, case doc_id % 8 when 0 then '.XLSX' when 1 then '.txt' when 2 then '.png' when 3 then '.Json' when 4 then null when 5 then '.exe' when 6 then '.md' else '' end as extension,
  case when doc_id % 17 = 0 then null else n_chars * 3000 end as size from documents""")
FOUND = Derived("select concat('item', doc_id) as item_id, true as pii_detected, split(case when doc_id % 2 = 0 then 'email,iban' else 'email' end, ',') as pii_types, cast(doc_id % 5 + 1 as bigint) as pii_count from documents where doc_id % 3 = 0")
DATES = Derived("""select o_orderkey, case o_orderkey % 7 when 0 then 'yesterday' when 1 then concat('2024-0', o_orderkey % 9 + 1, '-15T10:20:30Z') when 2 then concat('2023-1', o_orderkey % 3, '-0', o_orderkey % 9 + 1, 'T23:59:59.1234567Z') when 3 then concat('2022-02-1', o_orderkey % 10, ' 01:02:03')
  when 4 then concat('2021-12-31T22:00:00+0', o_orderkey % 9, ':30') when 5 then null else '' end as text from orders""")
SEEN = Derived("select distinct concat('h', o_custkey % 500) as k from orders where o_custkey % 3 <> 0")
ARRIVED = Derived("select concat('h', c_custkey % 700) as k from customer")
ZONES = Derived("select concat('p', p_partkey) as path_hash, case p_partkey % 3 when 0 then 'sensitive' when 1 then 'archive' else 'normal' end as zone from part where p_partkey % 4 <> 0")
PATHS = Derived("select l_orderkey, l_linenumber, concat('p', l_partkey) as path_hash from lineitem")
SESSIONS = Derived("select concat('s', c_custkey) as session_id, cast(1700000000 - c_custkey * 7 as double) as created from customer")
ROOTS = Derived("select concat('root', doc_id % 6) as root, concat('/d/', doc_id % 97, '/', doc_id) as path from documents")
NOW = 1_700_000_000.0
_EPOCH = r"""case when regexp_matches(text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}') then epoch(try_cast(regexp_replace(regexp_extract(text, '^[^Z+]*'), '(\.[0-9]{6})[0-9]*$', '\1') as timestamp))
  - case when text like '%+%' then cast(substr(split_part(text, '+', 2), 1, 2) as int) * 3600 + cast(substr(split_part(text, '+', 2), 4, 2) as int) * 60 else 0 end end"""


def union_of_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inventories of different columns, one below the other, counted by extension and whether they have a size."""
    items = ITEMS.frame(spark, sf_dir).select("name", "extension", "size")
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.lit(".html").alias("extension"))
    return cloud.all_of(items, pages).groupBy("extension").agg(F.count("*").alias("files"), F.count("size").alias("with_size"))


QUERIES: dict[str, tuple[Query, str | None]] = {
    "cloud_extractible": (lambda s, d: ITEMS.frame(s, d).select("name", cloud.extractible(F.col("extension"), F.col("size"), F.col("item_id")).alias("extractible")), f"select name, coalesce(lower(extension) in ({', '.join(map(quote, cloud.EXTRACTIBLE))}) and size <= {cloud.MOST_BYTES} and item_id is not null, false) as extractible from {ITEMS.sql}"),
    "cloud_results": (lambda s, d: cloud.with_results(ITEMS.frame(s, d), FOUND.frame(s, d)).select("name", "pii_detected", F.array_join("pii_types", ",").alias("pii_types"), "pii_count"), f"select name, coalesce(pii_detected, false) as pii_detected, coalesce(array_to_string(pii_types, ','), '') as pii_types, coalesce(pii_count, 0)::bigint as pii_count from {ITEMS.sql} i left join {FOUND.sql} f on f.item_id = i.item_id"),
    "cloud_dates": (lambda s, d: DATES.frame(s, d).select("o_orderkey", "text", F.round(cloud.iso_seconds(F.col("text")), 3).alias("seconds")), f"select o_orderkey, text, round({_EPOCH}, 3)::double as seconds from {DATES.sql}"),
    "seen_filter_new": (lambda s, d: cloud.filter_new(ARRIVED.frame(s, d), SEEN.frame(s, d), "k"), f"select distinct k from {ARRIVED.sql} where k not in (select k from {SEEN.sql})"),
    "seen_contains": (lambda s, d: cloud.contains(ARRIVED.frame(s, d), SEEN.frame(s, d), "k"), f"select distinct k, k in (select k from {SEEN.sql}) as seen from {ARRIVED.sql}"),
    "seen_check_and_add": (lambda s, d: cloud.check_and_add(ARRIVED.frame(s, d), SEEN.frame(s, d), "k")[1], f"select k from {ARRIVED.sql} union select k from {SEEN.sql}"),
    "zone_lookup": (lambda s, d: cloud.with_zone(PATHS.frame(s, d), ZONES.frame(s, d)).groupBy("zone").agg(F.count("*").alias("files")), f"select coalesce(zone, 'normal') as zone, count(*) as files from {PATHS.sql} p left join {ZONES.sql} z on z.path_hash = p.path_hash group by 1"),
    "sessions_evicted": (lambda s, d: cloud.evicted(SESSIONS.frame(s, d), NOW), f"select session_id, created, created < {NOW} - 3600 or row_number() over (partition by created < {NOW} - 3600 order by created desc, session_id) > 50 as evicted from {SESSIONS.sql}"),
    "first_files": (lambda s, d: cloud.first_files(ROOTS.frame(s, d), 20), f"select * from {ROOTS.sql} qualify row_number() over (partition by root order by path) <= 20"),
    "inventory_union": (union_of_roots, f"select extension, count(*) as files, count(size) as with_size from (select extension, size from {ITEMS.sql} union all select '.html', null from pages) group by extension"),
    "mini_where": (lambda s, d: cloud.run_mini({"orders": table(s, d, "orders")}, "select o_orderkey, o_totalprice from orders where o_custkey = 37 limit 500", ["o_orderkey"]), "select o_orderkey, o_totalprice from orders where o_custkey = 37 order by o_orderkey limit 500"),
}
