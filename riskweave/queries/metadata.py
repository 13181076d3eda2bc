"""Governance, directory, application, host, log and report audits over frames derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metadata as m
from ..operators.tables import FORBIDDEN
from ._common import Derived, Query, quote, table

GRANTS = Derived("""select case o_custkey % 7 when 0 then 'PUBLIC' when 1 then 'audit' when 2 then 'app' when 3 then 'owner' else concat('role', o_custkey % 40) end as grantee, concat('t', o_orderkey % 50) as table_name,
  case o_orderkey % 9 when 0 then 'Insert' when 1 then 'UPDATE' when 2 then 'DELETE' when 3 then 'REFERENCES' else 'SELECT' end as privilege_type from orders""")
ROLES = Derived("select case s_suppkey when 1 then 'audit' when 2 then 'app' when 3 then 'owner' else concat('role', s_suppkey) end as role, s_suppkey % 3 <> 0 as can_login, s_suppkey % 11 = 3 as is_super from supplier")
TABLES = Derived("select concat('t', p_partkey) as table_name, p_size % 3 = 0 as documented, cast(p_size % 20 + 1 as int) as column_count, cast(floor((p_size % 20 + 1) / 3) as int) as documented_columns, p_partkey % 4 = 0 as has_trigger from part")
COLUMNS = Derived("""select distinct concat(case l_suppkey % 6 when 0 then 'ml_' when 1 then 'Audit_' when 2 then 'Feature_' when 3 then 'Model' else 'tbl_' end, l_partkey % 100) as table_name,
  case when l_linenumber = 1 and l_partkey % 3 = 0 then 'run_id' when l_linenumber = 2 and l_partkey % 5 = 0 then 'Updated_At' else concat('c', l_linenumber) end as column_name from lineitem""")
COLLECTIONS = Derived("select concat(case p_partkey % 9 when 0 then 'training_run' when 1 then 'model_' when 2 then 'history' when 3 then 'ml_experiment' else 'coll' end, p_partkey) as name, p_size % 4 <> 0 as has_schema, cast(p_size as double) as size from part")
STORE_USERS = Derived("select s_name as user_name, split(case s_suppkey % 6 when 0 then 'root' when 1 then 'read,dbAdmin' when 2 then 'readWrite' when 3 then 'clusterAdmin,read' else 'read' end, ',') as roles from supplier")


_G, _R, _T, _C = GRANTS.sql, ROLES.sql, TABLES.sql, COLUMNS.sql
_ML = f"regexp_matches(t, '{m.ML_NAMES}')"
_ART11 = f"""select round(least(1.0, case when ml > 0 then 0.4 + 0.3 * v / ml else 0 end + case when trail > 0 then 0.3 else 0 end), 4) as ai_act_article11 from (
  select count_if({_ML}) ml, count_if({_ML} and versioned) v, count_if(regexp_matches(t, '{m.TRAIL_NAMES}')) trail from (
  select lower(table_name) t, bool_or(lower(column_name) in ({', '.join(map(quote, m.VERSION_COLUMNS))})) versioned from {_C} group by 1))"""
_roles = lambda rs: "[" + ", ".join(map(quote, rs)) + "]"
_LOW = f"(select *, lower(name) t from {COLLECTIONS.sql})"
_STORE = f"""select * from (select round(count_if(has_schema) / count(*), 4) as documentation_coverage, round(least(1.0, case when count_if({_ML}) > 0 then 0.4 + 0.3 * count_if({_ML} and regexp_matches(t, 'experiment|registry|run|version')) / count_if({_ML}) else 0 end
    + case when count_if(regexp_matches(t, '{m.TRAIL_NAMES}')) > 0 then 0.3 else 0 end), 4) as ai_act_article11 from {_LOW}),
  (select round(count_if(not list_has_any(roles, {_roles(m.ROOT_ROLES)})) / count(*), 4) as security_compliance, round(count_if(not list_has_any(roles, {_roles(m.WRITE_ROLES)})) / count(*), 4) as access_control from {STORE_USERS.sql}), (select 1.0::double as change_tracking)"""

#: Directory users derived from customers.
AD_USERS = """select case c_custkey % 6 when 0 then 514 when 1 then 66048 when 2 then 66050 else 512 end as uac, case when c_custkey % 4 = 0 then cast('2024-01-10 08:00:00' as timestamp) when c_custkey % 4 = 1 then cast('2024-06-01 23:00:00' as timestamp) end as last_logon,
  c_custkey % 10 = 0 as has_spn, c_custkey % 4 <> 3 as in_groups from customer"""
AS_OF = "2024-06-30"


def _ad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(AD_USERS.replace("from customer", "from {customer}"), customer=table(spark, sf_dir, "customer"))
    some = lambda c, v: F.when(F.col(c), F.array(F.lit(v)))
    return rows.withColumns({"spn": some("has_spn", "HTTP/x"), "member_of": some("in_groups", "cn=g")})


_DORMANT = f"(uac & 2 = 0 and datediff('day', last_logon::date, date '{AS_OF}') > 90)"
LDAP_USERS = Derived("""select concat(case c_custkey % 3 when 0 then 'UID=U' else 'uid=u' end, c_custkey, case when c_custkey % 9 = 0 then ',ou=ServiceAccounts,dc=x' else ',ou=People' end) as dn,
  case c_custkey % 8 when 0 then 'disabled since May' when 1 then 'DORMANT' when 2 then 'Service account; PWD_NO_EXPIRE' when 3 then null when 4 then 'Dormant and DISABLED' else 'Active' end as description from customer""")
GROUPS = Derived("""select case c_nationkey when 0 then 'Domain Admins' when 1 then 'Administrators' when 2 then 'schema_admins' else concat('staff', c_nationkey) end as cn,
  array_agg(case when c_nationkey = 5 or c_custkey % 10 = 0 then 'cn=admin,dc=x' else concat('uid=U', c_custkey, ',ou=people') end) as member from customer group by c_nationkey""")
_REAL = f"(select cn, list_filter(member, lambda x: not starts_with(x, 'cn=admin,')) real, member from {GROUPS.sql})"
_D = "upper(coalesce(description, ''))"

#: Application records derived from tables of the folder: entity, source table and its columns.
APP = {
    "customers": ("customer", {"name": "c_name", "emails": "case when c_custkey % 3 = 0 then concat('c', cast(c_custkey as varchar(20)), '@x.org') when c_custkey % 3 = 1 then '[]' end", "billing_iban": "case when c_custkey % 5 = 0 then 'FR7630006000011234567890189' else ' ' end", "phone": "case when c_custkey % 2 = 0 then '0' else '0612345678' end"}),
    "suppliers": ("supplier", {"name": "s_name", "iban": "case when s_suppkey % 4 = 1 then 'DE89370400440532013000' end", "postal_address": "case when s_suppkey % 2 = 0 then '{}' else '1 Main St' end"}),
    "customer_invoices": ("orders", {"label": "case when o_orderkey % 7 = 0 then '' else concat('Invoice ', cast(o_orderkey as varchar(20))) end"}),
}


def app_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for entity, (source, columns) in APP.items():
        rows = m.entity_fields(entity, table(spark, sf_dir, source).selectExpr(*[f"{e} as {c}" for c, e in columns.items()]))
        out = rows if out is None else out.unionByName(rows)
    return out


_EMPTY = "('', '[]', '{}', '0', '0.0', 'false', 'null')"
_APP_SQL = " union all ".join(
    f"select '{entity}' as entity, '{c}' as field, '{dict(m.FIELDS[entity])[c]}' as classification, count_if(coalesce(trim({e}) not in {_EMPTY}, false)) as populated_count, count(*) as total_count from {source}"
    for entity, (source, columns) in APP.items()
    for c, e in columns.items()
)
_APP_SUMMARY = f"""with e as (select entity, sum(populated_count)::bigint n, max(total_count) total, sum(case when classification = 'iban' then populated_count else 0 end)::bigint iban from ({_APP_SQL}) group by entity)
  select sum(total)::bigint as total_records, sum(n)::bigint as total_pii_values, round(sum(n)::double / sum(total), 4) as density, (select entity from e order by n desc, entity desc limit 1) as highest_risk_entity, sum(iban)::bigint as iban_count, count_if(iban > 0) as bank_data_entities from e"""

DISKS = Derived("""select p_partkey, case p_size % 3 when 0 then '0' when 1 then '1' end as rota, case p_partkey % 5 when 0 then 'nvme' when 1 then 'sata' when 2 then 'sas' when 3 then 'usb' end as tran,
  case p_partkey % 7 when 0 then concat(p_brand, ' SSD') when 1 then concat(p_brand, ' fast nvme') when 2 then null else p_brand end as model from part""")
WIN_DISKS = Derived("""select p_partkey, case p_size % 6 when 0 then 'SSD' when 1 then '4' when 2 then '3' when 3 then 'HDD' when 4 then 'Unspecified' end as media, case p_partkey % 4 when 0 then 'NVMe' when 1 then 'SATA' when 2 then 'USB' end as bus,
  case p_partkey % 7 when 0 then concat(p_brand, ' SSD') when 1 then concat(p_brand, ' nvme') when 2 then concat(p_brand, ' hdd') when 3 then null else p_brand end as model from part""")
MAC_DISKS = Derived("""select p_partkey, case p_size % 4 when 0 then 'PCI-Express' when 1 then 'NVMe' when 2 then 'Apple Fabric' end as protocol, case p_partkey % 3 when 0 then 'USB' when 1 then 'nvme link' end as bus, case p_partkey % 5 when 0 then true when 1 then false end as solid,
  case p_partkey % 7 when 0 then concat(p_brand, ' SSD') when 1 then 'APPLE SSD AP0512' when 2 then null else p_brand end as model from part""")
LINES = Derived("select s_suppkey, case s_suppkey % 3 when 0 then concat('md', s_suppkey, ' : active raid', s_suppkey % 7, ' sdb1[1] sda1[0]') when 1 then concat('md', s_suppkey, ' : inactive sdc') else 'Personalities : [raid1]' end as line from supplier")
SPEEDS = Derived("select s_suppkey, case s_suppkey % 5 when 0 then concat(s_suppkey, ' Gbps') when 1 then concat(s_suppkey, ' Mbps') when 2 then concat(s_suppkey, '.5 Gbps') when 3 then 'fast' else concat('', s_suppkey) end as speed from supplier")
SERVICES = Derived("select concat(case s_suppkey % 40 when 0 then 'VeeamTransport' when 1 then 'restic-backup' when 2 then 'borgmatic' when 3 then 'BACULA-FD' else 'sshd' end, s_suppkey, '.service') as service from supplier")
SECONDS = Derived("select o_orderkey, cast(o_orderkey * 37 % 100000 as int) as seconds from orders")
INTERVALS = Derived("select o_orderkey, case o_orderkey % 5 when 0 then null when 1 then 0 when 2 then 864000000000 when 3 then -1 else -(o_orderkey % 400) * 100000000000 end as passed from orders")
RUNS = Derived("select case o_custkey % 4 when 0 then 'postgresql' when 1 then 'mysql' when 2 then 'files' else 'ldap' end as connector, o_orderstatus <> 'P' as success from orders")
REPORTS = Derived("""select o_orderkey, case o_orderkey % 2 when 0 then 'files' else 'database' end as source_type, cast(o_custkey % 300 as int) as pii_files, cast(o_custkey % 4 as int) as sensitive, cast(o_orderkey % 30 as double) as files_per_second,
  cast(o_custkey % 3 as int) as pii_tables from orders""")
CHECKS = Derived("""select s_suppkey, case when s_suppkey % 7 = 0 then null else s_suppkey * 100000000 end as free_memory, case when s_suppkey % 11 = 0 then null else s_suppkey * 200000000 end as free_disk, cast(s_suppkey % 3 as int) as last_errors from supplier""")

#: Log lines made of events: some begin a scan, some end it, some count files or fail.
LOG_LINES = """select user_id % 5 as log_id, event_id as line_no, concat('2024-01-0', cast(1 + event_id % 9 as varchar(20)), ' 10:', lpad(cast(event_id % 60 as varchar(20)), 2, '0'), ':00,123 - INFO - ',
  case event_id % 8 when 0 then 'Scan started' when 1 then concat('Scanned ', cast(event_id % 500 as varchar(20)), ' files') when 3 then 'Scan completed' when 5 then 'ERROR   disk is full' else 'idle' end) as line from events"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LOG_LINES.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


_STAMP = "regexp_extract(line, '([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})', 1)"
_SESSIONS = f"""(with l as (select log_id, line_no, contains(line, 'Scan started') s, contains(line, 'Scan completed') e, {_STAMP}::timestamp ts, try_cast(regexp_extract(line, 'Scanned\\s*([0-9]+)\\s*files', 1) as bigint) files from ({LOG_LINES})),
    n as (select *, sum(s::int) over (partition by log_id order by line_no) scan from l), c as (select *, coalesce(bool_or(e) over (partition by log_id, scan order by line_no rows between unbounded preceding and 1 preceding), false) done from n where scan > 0),
    g as (select log_id, scan::bigint as scan, min(case when s then ts end) as started, max(case when e then ts end) as ended, coalesce(arg_max(files, line_no) filter (files is not null), 0) as files from c where not done group by all)
  select *, case when ended is not null then 'completed' when scan = max(scan) over (partition by log_id) then 'in_progress' else 'interrupted' end as status, (epoch(ended) - epoch(started))::double as seconds,
    case when epoch(ended) - epoch(started) > 0 and files > 0 then round(files / (epoch(ended) - epoch(started)), 2) end as files_per_second from g)"""
_AGENT_VALUES = ", ".join(f"('{p}', '{n}')" for p, n in m.AGENTS)
CONFIGS = Derived("""select s_suppkey, case s_suppkey % 8 when 0 then 'host' when 1 then 'Password' when 2 then 'api_key' when 3 then 'port' when 4 then 'SSL_key' when 5 then 'client_secret' when 6 then 'tokens' else 'TOKEN' end as k, s_name as v from supplier""")

#: Grants of shared items: by type, what an item must be to have one, who is granted it, and the role (null: read).
_GRANTS = (("user", "s_suppkey % 2 = 0", "concat(lower(s_name), '@x.org')", "'write'"), ("link", "s_suppkey % 3 = 0", "case when s_suppkey % 2 = 0 then 'anonymous' else 'organization' end", "'read'"), ("group", "s_suppkey % 5 = 0", "concat('staff', s_nationkey)", "'owner'"), ("application", "s_suppkey % 7 = 0", "'Sync'", "null"))


def _share(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"user": "user", "group": "group_name", "link": "link_scope", "application": "app"}
    each = []
    for kind, when, who, role in _GRANTS:
        values = ", ".join(f"'{f}', " + (who if k == kind else "cast(null as string)") for k, f in fields.items())
        each.append(f"case when {when} then named_struct('roles', {'array()' if role == 'null' else f'array({role})'}, {values}) end")
    items = table(spark, sf_dir, "supplier").selectExpr("s_suppkey as item_id", f"array_compact(array({', '.join(each)})) as permissions")
    return m.share_grants(items)


_SHARE = " union all ".join(f"select s_suppkey as item_id, '{kind}' as grant_type, {chr(39) + 'link:' + chr(39) + ' || ' if kind == 'link' else ''}{who} as grantee, coalesce({role}, 'read') as role from supplier where {when}" for kind, when, who, role in _GRANTS)


def _each(rows: Derived, names: str, **columns) -> Query:
    return lambda s, d: rows.frame(s, d).withColumns({k: f(*[F.col(c) for c in names.split()]) for k, f in columns.items()})


QUERIES: dict[str, tuple[Query, str | None]] = {
    "governance_documentation": (lambda s, d: m.documentation_coverage(TABLES.frame(s, d)), f"select round(0.4 * count_if(documented) / count(*) + 0.6 * sum(documented_columns) / sum(column_count), 4) as documentation_coverage from {_T}"),
    "governance_security": (lambda s, d: m.security_compliance(GRANTS.frame(s, d), ROLES.frame(s, d), "audit", True, False), f"""select round(0.2::double + (case when (select bool_or(is_super) from {_R} where role = 'audit') then 0 else 0.25 end) + (case when k <= 1 then 0.2 when k <= 3 then 0.1 else 0 end)
      + (case when p <= 5 then 0.1 else 0 end) + (case when (select count_if(can_login) from {_R}) >= 3 then 0.1 else 0 end), 4) as security_compliance from (select count(distinct case when grantee = 'audit' then privilege_type end) k, count_if(grantee = 'PUBLIC') p from {_G})"""),
    "governance_access": (lambda s, d: m.access_control(GRANTS.frame(s, d), ROLES.frame(s, d)), f"""select round((case when (select count_if(not can_login) from {_R}) >= 3 then 0.2::double else 0 end) + (case when p = 0 then 0.25 when p <= 5 then 0.1 else 0 end) + (case when k >= 2 then 0.25 else 0 end)
      + (case when (select avg(n) from (select count(*) n from {_G} where grantee <> 'PUBLIC' group by grantee)) <= 100 then 0.2 else 0 end) + (case when t > 0 then 0.1 else 0 end), 4) as access_control from (select count_if(grantee = 'PUBLIC') p, count(distinct case when grantee <> 'PUBLIC' then privilege_type end) k, count(distinct table_name) t from {_G})"""),
    "governance_tracking": (lambda s, d: m.change_tracking(TABLES.frame(s, d)), f"select round(count_if(has_trigger) / count(*), 4) as change_tracking from {_T}"),
    "governance_models": (lambda s, d: m.model_documentation(COLUMNS.frame(s, d)), _ART11),
    "governance_document_store": (lambda s, d: m.document_store(COLLECTIONS.frame(s, d), STORE_USERS.frame(s, d), True), _STORE),
    "permissions_check": (lambda s, d: m.forbidden_permissions(GRANTS.frame(s, d), "audit", FORBIDDEN), f"select coalesce(string_agg(distinct upper(privilege_type), ',' order by upper(privilege_type)), '') as forbidden, case when count(*) > 0 then 'warning' else 'ok' end as status from {_G} where grantee = 'audit' and upper(privilege_type) in ({', '.join(map(quote, FORBIDDEN))})"),
    "dir_users_ad": (lambda s, d: m.users_ad(_ad(s, d), AS_OF), f"""select count(*) as total, greatest(0, count(*) - count_if(uac & 2 <> 0) - count_if(coalesce({_DORMANT}, false))) as active, count_if(coalesce({_DORMANT}, false)) as dormant_90d, count_if(has_spn) as service_accounts,
      count_if(uac & 65536 <> 0) as pwd_no_expire, count_if(uac & 2 <> 0 and in_groups) as disabled_in_groups from ({AD_USERS})"""),
    "dir_users_ldap": (lambda s, d: m.users_ldap(LDAP_USERS.frame(s, d), GROUPS.frame(s, d)), f"""select count(*) as total, greatest(0, count(*) - count_if(contains({_D}, 'DISABLED')) - count_if(contains({_D}, 'DORMANT'))) as active, count_if(contains({_D}, 'DORMANT')) as dormant_90d, count_if(contains(lower(dn), 'ou=serviceaccounts')) as service_accounts,
      count_if(contains({_D}, 'SERVICE ACCOUNT') or contains({_D}, 'PWD_NO_EXPIRE')) as pwd_no_expire, count_if(contains({_D}, 'DISABLED') and lower(dn) in (select lower(x) from (select unnest(member) x from {GROUPS.sql}))) as disabled_in_groups from {LDAP_USERS.sql}"""),
    "dir_groups": (lambda s, d: m.groups_summary(GROUPS.frame(s, d)), f"select count(*) as total, count_if(len(real) = 0) as empty_groups, count_if(len(real) >= 50) as large_groups_50plus from {_REAL}"),
    "dir_admins": (lambda s, d: m.admins(GROUPS.frame(s, d), LDAP_USERS.frame(s, d).agg(F.count("*").alias("n"))), f"""select total_admins, round(total_admins::double / (select count(*) from {LDAP_USERS.sql}), 4) as admin_ratio from (select count(distinct lower(x)) total_admins from (
      select unnest(real) x from {_REAL} where lower(cn) in ({', '.join(map(quote, m.ADMIN_GROUPS))})))"""),
    "dir_password_age": (_each(INTERVALS, "passed", days=m.filetime_days), f"select *, case when passed < 0 then nullif(-passed // 864000000000, 0) end as days from {INTERVALS.sql}"),
    "app_entity_pii": (app_fields, _APP_SQL),
    "app_summary": (lambda s, d: m.app_summary(app_fields(s, d)), _APP_SUMMARY),
    "infra_disk_class": (_each(DISKS, "rota tran model", kind=m.disk_linux), f"""select *, case when tran = 'nvme' then 'NVMe' when rota = '0' then 'SSD' when rota = '1' and regexp_matches(lower(model), 'ssd|nvme') then 'SSD' when rota = '1' then 'HDD' when contains(lower(model), 'ssd') then 'SSD' when contains(lower(model), 'nvme') then 'NVMe' else 'Unknown' end as kind from {DISKS.sql}"""),
    "infra_disk_windows": (_each(WIN_DISKS, "media bus model", kind=m.disk_windows), f"""select *, case when media in ('4', 'SSD') then case when contains(bus, 'NVMe') then 'NVMe' else 'SSD' end when media in ('3', 'HDD') then 'HDD' when contains(bus, 'NVMe') then 'NVMe' when contains(lower(model), 'ssd') then 'SSD'
      when contains(lower(model), 'nvme') then 'NVMe' when contains(lower(model), 'hdd') then 'HDD' else 'Unknown' end as kind from {WIN_DISKS.sql}"""),
    "infra_disk_mac": (_each(MAC_DISKS, "protocol bus solid model", kind=m.disk_mac), f"""select *, case when contains(lower(coalesce(protocol, '')), 'nvme') or contains(lower(coalesce(bus, protocol, '')), 'nvme') then 'NVMe' when solid then 'SSD' when solid = false then case when contains(lower(coalesce(model, '')), 'ssd') then 'SSD' else 'HDD' end
      when contains(lower(coalesce(model, '')), 'apple ssd') or contains(lower(coalesce(protocol, '')), 'apple fabric') then 'NVMe' when contains(lower(coalesce(model, '')), 'ssd') then 'SSD' else 'Unknown' end as kind from {MAC_DISKS.sql}"""),
    "infra_raid_level": (_each(LINES, "line", level=m.raid_level), f"select *, regexp_extract(line, '^md[^:]*:.*?\\b(raid\\S*)', 1) as level from {LINES.sql}"),
    "link_speed": (_each(SPEEDS, "speed", mbps=m.link_mbps), f"""select *, (case when contains(speed, ' Gbps') then split_part(speed, ' ', 1)::double * 1000 when contains(speed, ' Mbps') then split_part(speed, ' ', 1)::double end)::int as mbps from {SPEEDS.sql}"""),
    "backup_agents": (lambda s, d: m.backup_agents(SERVICES.frame(s, d)), f"select distinct n as agent from {SERVICES.sql}, (values {_AGENT_VALUES}) a(p, n) where contains(lower(service), p)"),
    "eta_format": (_each(SECONDS, "seconds", eta=m.eta), f"select *, case when seconds < 60 then seconds || 's' when seconds < 3600 then (seconds // 60) || 'm ' || (seconds % 60) || 's' else (seconds // 3600) || 'h ' || (seconds % 3600 // 60) || 'm' end as eta from {SECONDS.sql}"),
    "config_redaction": (lambda s, d: CONFIGS.frame(s, d).select("s_suppkey", "k", m.redact(F.create_map("k", "v"))[F.col("k")].alias("v")), f"select s_suppkey, k, case when lower(k) in ({', '.join(map(quote, m.SECRET_KEYS))}) then '***REDACTED***' else v end as v from {CONFIGS.sql}"),
    "cloud_grants": (_share, _SHARE),
    "log_sessions": (lambda s, d: m.log_sessions(_log(s, d)), f"select * from {_SESSIONS}"),
    "log_summary": (lambda s, d: m.log_summary(m.log_sessions(_log(s, d))), f"""select count(*) as total_scans, count_if(status = 'completed') as completed_scans, sum(files)::bigint as total_files, round(coalesce(sum(case when status = 'completed' then seconds end), 0), 2) as total_seconds,
      case when sum(case when status = 'completed' then seconds end) > 0 then round(sum(files) / sum(case when status = 'completed' then seconds end), 2) else 0.0 end as files_per_second from {_SESSIONS}"""),
    "log_last_errors": (lambda s, d: m.last_errors(_log(s, d)), f"select log_id, line_no, {_STAMP} as stamp, 'disk is full' as message from ({LOG_LINES}) where contains(line, 'ERROR') qualify row_number() over (partition by log_id order by line_no desc) <= 50"),
    "alerts": (lambda s, d: m.alerts(REPORTS.frame(s, d)), f"""select *, array_to_string(list_filter([case when source_type = 'files' and pii_files >= 100 then 'HIGH_PII_RISK' end, case when source_type = 'files' and sensitive > 0 then 'SENSITIVE_PII' end,
      case when source_type = 'files' and files_per_second > 0 and files_per_second < 10 then 'LOW_PERFORMANCE' end, case when source_type = 'database' and pii_tables > 0 then 'DB_PII_DETECTED' end], lambda x: x is not null), ',') as alerts from {REPORTS.sql}"""),
    "health": (lambda s, d: m.health(CHECKS.frame(s, d)), f"select *, case when free_memory <= 536870912 or free_disk <= 1073741824 then 'unhealthy' when last_errors > 0 then 'degraded' else 'healthy' end as status from {CHECKS.sql}"),
    "connector_health": (lambda s, d: m.connector_health(RUNS.frame(s, d)), f"select connector, count(*) as runs, round(100 * avg(success::int), 1) as healthy_pct from {RUNS.sql} group by connector"),
}
