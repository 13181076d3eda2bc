"""The file audit over an inventory derived from documents (and pages), the same in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import files, pii
from ._common import Derived, Query, quote, table
from .pii import matches_sql

AS_OF = 1_702_000_000.0
_DIR = """case doc_id % 12 when 0 then '/mnt/vol1/hr' when 1 then '/srv/finance' when 2 then '/srv/data' when 3 then '/srv/backup' when 4 then '/home/u/node_modules/x' when 5 then '/mnt/vol2/Clients'
  when 6 then '/mnt/vol2/archive' when 7 then '/srv/data/tmp' when 8 then '/media/usb/paie/old' when 9 then '/srv/reports/My.egg-info' when 10 then 'share/contracts' else '/data' end"""
_NAME = """case when doc_id % 50 = 11 then concat('.env.', cast(doc_id as varchar(20))) when doc_id % 50 = 13 then concat('.hidden', cast(doc_id as varchar(20))) when doc_id % 50 = 17 then concat('~$doc', cast(doc_id as varchar(20)), '.docx')
  when doc_id % 50 = 19 then concat('f', cast(doc_id as varchar(20)), '.part') else concat('doc_', cast(doc_id as varchar(20)),
  case doc_id % 7 when 0 then '.txt' when 1 then '.CSV' when 2 then '.json' when 3 then '.exe' when 4 then '.log' when 5 then '.docx' else '' end) end"""
INVENTORY = {
    "path": f"concat({_DIR}, '/', source, '/', {_NAME})",
    "size": "case when doc_id % 97 = 5 then 6000000000000 when doc_id % 41 = 7 then 5 else n_chars - n_chars % 500 end",
    "mtime": "cast(1690000000 + doc_id * 9000 % 12000000 as double)",
}
_INV = "(select doc_id, " + ", ".join(f"({e}) as {c}" for c, e in INVENTORY.items()) + " from documents)"


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", *[f"({e}) as {c}" for c, e in INVENTORY.items()])
    return files.fingerprint(rows)


def _any_part(words: tuple[str, ...], path: str = "path") -> str:
    return f"list_has_any(string_split(lower({path}), '/'), [{', '.join(map(quote, words))}])"


_ZONE = f"case when {_any_part(paths.SENSITIVE_WORDS)} then 'sensitive' when {_any_part(paths.ARCHIVE_WORDS)} then 'archive' else 'normal' end"
_PARTS = "string_split(path, '/')"
_VOLUME = f"case when path like '/%' then case when {_PARTS}[2] in ('media', 'mnt', 'volumes') then {_PARTS}[3] else {_PARTS}[2] end else {_PARTS}[2] end"
_FP = f"""(select *, sha256(path) as path_hash, regexp_extract(path, '([^/]*)$', 1) as name, lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)) as extension,
  {_ZONE} as zone, {_VOLUME} as volume_root from {_INV})"""
_CONFIG = files.Exclusions()


def _glob_sql(g: str) -> str:
    return f"regexp_full_match(path, {quote(paths.glob_regex(g)[5:-1])}, 's')"


def _name_sql(r: str) -> str:
    return "(starts_with(name, '.') and not starts_with(name, '.env'))" if "?!" in r else f"regexp_matches(name, {quote(r)})"


_REASON = (
    f"case when extension in ({', '.join(map(quote, _CONFIG.extensions))}) then 'extension: ' || extension when size > {_CONFIG.max_bytes} then 'size: ' || printf('%.1f', size / {1 << 20}.0::double) || 'MB > {_CONFIG.max_bytes >> 20}MB'"
    f" when size < {_CONFIG.min_bytes} then 'size: ' || size || ' bytes < {_CONFIG.min_bytes} min' "
    + " ".join(f"when {_glob_sql(g)} then {quote('path pattern: ' + g)}" for g in _CONFIG.globs)
    + " "
    + " ".join(f"when {_name_sql(r)} then {quote('filename pattern: ' + r)}" for r in _CONFIG.names)
    + " end"
)
_EX = f"(select *, {_REASON} as exclusion_reason from {_FP})"


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory(spark, sf_dir).withColumn("exclusion_reason", files.exclusion_reason())


_PREVIOUS = f"""(select path_hash, case when doc_id % 10 = 1 then size + 1 else size end as size,
  mtime + case when doc_id % 10 = 2 then 1.5 when doc_id % 10 = 3 then 1.0 when doc_id % 10 = 4 then -0.5 else 0 end as mtime, doc_id % 3 = 0 as previous_pii from {_FP} where doc_id % 10 <> 0
  union all select sha256('/gone/' || doc_id), 1, 0.0, false from documents where doc_id % 25 = 0)"""


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older state of the inventory: some files missing, resized, retimed, and some that have gone since."""
    rows = inventory(spark, sf_dir)
    third = F.col("doc_id") % 10
    size = F.col("size") + F.when(third == 1, 1).otherwise(0)
    mtime = F.col("mtime") + F.when(third == 2, 1.5).when(third == 3, 1.0).when(third == 4, -0.5).otherwise(0.0)
    old = rows.where(third != 0).select("path_hash", size.alias("size"), mtime.alias("mtime"), (F.col("doc_id") % 3 == 0).alias("previous_pii"))
    gone = rows.where("doc_id % 25 = 0").select(F.sha2(F.concat(F.lit("/gone/"), "doc_id"), 256).alias("path_hash"), F.lit(1).cast("bigint").alias("size"), F.lit(0.0).alias("mtime"), F.lit(False).alias("previous_pii"))
    return old.unionByName(gone)


_DIFF = f"""(select coalesce(c.path_hash, p.path_hash) as path_hash, case when p.path_hash is null then 'new' when c.path_hash is null then 'deleted' when c.size <> p.size or abs(c.mtime - p.mtime) > 1 then 'modified' else 'unchanged' end as status,
  case when p.path_hash is not null and c.path_hash is not null and c.size = p.size and abs(c.mtime - p.mtime) <= 1 then p.previous_pii end as previous_pii from {_FP} c full join {_PREVIOUS} p on c.path_hash = p.path_hash)"""


def diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.snapshot_diff(inventory(spark, sf_dir), previous(spark, sf_dir))


_BUCKET = "('0x' || substr(md5(path_hash), 1, 8))::bigint"
_RATE = f"""least(100, case zone when 'sensitive' then 100 when 'archive' then 15 else 30 end + case when mtime > {AS_OF} - 5184000 then 50 else 0 end
  + case when extension in ({', '.join(map(quote, paths.SENSITIVE_EXTENSIONS))}) then 20 else 0 end)"""


def _sample_sql(source: str, share: int = 10, floor: int = 1000) -> str:
    return f"""(select * exclude (b, drawn, n_drawn, n_all, place), drawn or place <= greatest(n_all * {share} // 100, {floor}) - n_drawn as selected from (
      select *, sum(drawn::int) over () n_drawn, count(*) over () n_all, case when drawn then 9223372036854775807 else row_number() over (partition by drawn order by b, path_hash) end place from (
      select *, b * 100 < rate * 4294967296 as drawn from (select *, {_RATE} as rate, {_BUCKET} b from {source}))))"""


FLOOR = 300


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.sample(inventory(spark, sf_dir), AS_OF, floor_share=80, floor=FLOOR)


def _repr_sql(source: str) -> str:
    return f"(select * from (select *, count(*) over w2 group_size from {source} window w2 as (partition by volume_root, size, extension)) qualify row_number() over (partition by volume_root, size, extension order by case zone when 'sensitive' then 0 when 'archive' then 2 else 1 end, path_hash) = 1)"


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages: group duplicates, compare, sample, exclude, scan what is left, and give the result to each duplicate."""
    from ..plans.audits import file_audit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return file_audit(inventory(spark, sf_dir), previous(spark, sf_dir), docs, AS_OF, floor_share=80, floor=FLOOR)


_PIPE = f"""with fp as {_FP}, rep as {_repr_sql('fp')}, d as {_DIFF}, todo as (select rep.* from rep join d using (path_hash) where status in ('new', 'modified')),
  s as (select * from {_sample_sql('todo', 80, FLOOR)} where selected), e as (select *, {_REASON} as exclusion_reason from s),
  k as (select doc_id, group_size, exclusion_reason, zone from e),
  p as (select doc_id, count(*) n from {matches_sql('(select doc_id, text from documents)', 'doc_id', 'text')} group by doc_id)
  select zone, count(*) as selected_files, sum(group_size)::bigint as represented_files, count_if(exclusion_reason is not null) as excluded_files,
    count_if(exclusion_reason is null and n is not null) as files_with_pii, coalesce(sum(case when exclusion_reason is null then n end), 0)::bigint as pii_count,
    coalesce(sum(case when exclusion_reason is null and n is not null then group_size end), 0)::bigint as represented_with_pii from k left join p using (doc_id) group by zone"""


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.matches(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.lit(True).alias("pii_detected")).distinct()
    rows = excluded(spark, sf_dir).join(found, "doc_id", "left").withColumn("pii_detected", F.coalesce("pii_detected", F.lit(False)))
    return files.summary(rows)


MOUNTS = Derived("select * from (values ('/', 'ext4'), ('/mnt/vol1', 'nfs4'), ('/mnt', 'ext4'), ('/srv', 'xfs'), ('/srv/data', 'cifs'), ('/mnt/vol2/archive', 'fuse.sshfs')) as t(mount_point, fs_type)")


def pages_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("u"))
    host = F.split("u", "/")[0]
    return url.groupBy(host.alias("host"), paths.extension(F.regexp_replace("u", "[?#].*$", "")).alias("extension")).agg(F.count("*").alias("pages"))


_AUDIT_SQL = f"""select zone, count(*) as total, count_if(selected) as n_selected, round(100.0::double * count_if(selected) / count(*), 2) as rate,
  count_if(selected) >= case zone when 'normal' then 5000 else 500 end as minimum_met from {_sample_sql(_FP, 80, FLOOR)} group by zone"""

QUERIES: dict[str, tuple[Query, str | None]] = {
    "file_exclusion_reason": (lambda s, d: excluded(s, d).select("path", "exclusion_reason"), f"select path, exclusion_reason from {_EX}"),
    "file_zone": (lambda s, d: inventory(s, d).select("path", "zone", "extension", "path_hash"), f"select path, zone, extension, path_hash from {_FP}"),
    "file_volume": (lambda s, d: inventory(s, d).groupBy("volume_root").agg(F.count("*").alias("files"), F.max(paths.depth(F.col("path"))).alias("deepest")), f"select volume_root, count(*) as files, max(len(list_filter({_PARTS}, lambda x: x <> '')) - 1)::int as deepest from {_FP} group by volume_root"),
    "file_scannable": (
        lambda s, d: inventory(s, d).groupBy(files.scannable().alias("scannable")).agg(F.count("*").alias("files")),
        f"select extension in ({', '.join(map(quote, _CONFIG.scannable))}) and size <= {_CONFIG.max_scan_bytes} as scannable, count(*) as files from {_FP} group by 1",
    ),
    "file_dedup_repr": (lambda s, d: files.representatives(inventory(s, d)).select("path_hash", "zone", "volume_root", "size", "extension", "group_size"), f"select path_hash, zone, volume_root, size, extension, group_size from {_repr_sql(_FP)}"),
    "dedup_stats": (lambda s, d: files.dedup_stats(inventory(s, d)), f"select files, groups, round(1 - groups::double / files, 6) as reduction from (select count(*) files, count(distinct (volume_root, size, extension)) groups from {_FP})"),
    "file_snapshot_diff": (diff, f"select * from {_DIFF}"),
    "carryover": (
        lambda s, d: diff(s, d).groupBy("status").agg(F.count("*").alias("files"), F.count_if("previous_pii").alias("carried_pii")),
        f"select status, count(*) as files, count_if(coalesce(previous_pii, false)) as carried_pii from {_DIFF} group by status",
    ),
    "file_sample_rate": (lambda s, d: inventory(s, d).select("path", files.sample_rate(AS_OF).alias("rate")), f"select path, {_RATE} as rate from {_FP}"),
    "file_sample_selected": (lambda s, d: sampled(s, d).select("path_hash", "rate", "selected"), f"select path_hash, rate, selected from {_sample_sql(_FP, 80, FLOOR)}"),
    "sampling_audit": (lambda s, d: files.sampling_audit(sampled(s, d)), _AUDIT_SQL),
    "file_summary": (summary, f"""select count_if(r is null) as total_files, coalesce(sum(case when r is null then size end), 0)::bigint as total_size_bytes, count_if(r is null and has) as files_with_pii, count_if(r is not null) as excluded_count
      from (select size, exclusion_reason r, doc_id in (select doc_id from {matches_sql('documents', 'doc_id', 'text')}) has from {_EX})"""),
    "ext_top10": (lambda s, d: files.top_extensions(inventory(s, d)), f"select extension, count(*) as files from {_FP} group by extension order by files desc, extension limit 10"),
    "fingerprint_stats": (lambda s, d: files.fingerprint_stats(inventory(s, d)), f"""select count(*) as total, count_if(zone = 'sensitive') as sensitive_files, count_if(zone = 'normal') as normal_files, count_if(zone = 'archive') as archive_files,
      round(sum(size) / 1048576.0::double, 2) as total_size_mb from {_FP}"""),
    "folder_discovery": (lambda s, d: files.folders(inventory(s, d)), f"""select folder, count(*) as files, regexp_extract(folder, '([^/]*)$', 1) in ({', '.join(map(quote, _CONFIG.skip_dirs))}) as default_excluded from (select regexp_extract(path, '^(.*)/[^/]*$', 1) folder from {_FP}) group by folder"""),
    "mount_longest_prefix": (lambda s, d: files.mount_of(inventory(s, d), MOUNTS.frame(s, d)), f"""select distinct path, mount_point, fs_type from {_FP} left join {MOUNTS.sql} m on starts_with(path, case mount_point when '/' then '/' else mount_point || '/' end)
      qualify row_number() over (partition by path order by length(mount_point) desc nulls last) = 1"""),
    "pages_by_extension": (pages_files, """select string_split(u, '/')[1] as host, lower(regexp_extract(regexp_extract(regexp_replace(u, '[?#].*$', ''), '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)) as extension, count(*) as pages
      from (select regexp_replace(url, '^[a-z]+://', '') u from pages) group by all"""),
    "scan_pipeline": (pipeline, _PIPE),
}
