"""Audits of metadata: governance indicators, directories, applications, hosts, logs and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- governance: indicators from 0 to 1 -------------------------------------------------------------


def documentation_coverage(tables: DataFrame) -> DataFrame:
    """Over rows (documented, column_count, documented_columns): 0.4 by tables and 0.6 by columns."""
    share = lambda a, b: F.coalesce(a, F.lit(0)) / F.greatest(F.coalesce(b, F.lit(0)), F.lit(1))
    value = 0.4 * share(F.count_if("documented"), F.count("*")) + 0.6 * share(F.sum("documented_columns"), F.sum("column_count"))
    return tables.agg(F.round(value, 4).alias("documentation_coverage"))


def _points(*rules: tuple[Column, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(c, p).otherwise(0.0) for c, p in rules])


def security_compliance(grants: DataFrame, roles: DataFrame, user: str, tls: bool, read_only: bool) -> DataFrame:
    """Grants (grantee, table_name, privilege_type) and roles (role, can_login, is_super), seen by one user."""
    g = grants.agg(F.count_distinct(F.when(F.col("grantee") == user, F.col("privilege_type"))).alias("kinds"), F.count_if(F.col("grantee") == "PUBLIC").alias("public"))
    r = roles.agg(F.count_if("can_login").alias("logins"), F.coalesce(F.max(F.when(F.col("role") == user, F.col("is_super"))), F.lit(True)).alias("super"))
    least = F.when(F.col("kinds") <= 1, 0.2).when(F.col("kinds") <= 3, 0.1).otherwise(0.0)
    score = _points((F.lit(tls), 0.2), (~F.col("super"), 0.25), (F.lit(read_only), 0.2), (F.col("public") <= 5, 0.1), (F.col("logins") >= 3, 0.1)) + least
    return g.crossJoin(r).select(F.round(score, 4).alias("security_compliance"))


def access_control(grants: DataFrame, roles: DataFrame) -> DataFrame:
    own = F.col("grantee") != "PUBLIC"
    g = grants.agg(F.count_if(~own).alias("public"), F.count_distinct(F.when(own, F.col("privilege_type"))).alias("kinds"), F.count_if(own).alias("n"), F.count_distinct(F.when(own, F.col("grantee"))).alias("grantees"), F.count_distinct("table_name").alias("tables"))
    r = roles.agg(F.count_if(~F.col("can_login")).alias("groups"))
    public = F.when(F.col("public") == 0, 0.25).when(F.col("public") <= 5, 0.1).otherwise(0.0)
    score = public + _points((F.col("groups") >= 3, 0.2), (F.col("kinds") >= 2, 0.25), ((F.col("grantees") > 0) & (F.col("n") <= 100 * F.col("grantees")), 0.2), (F.col("tables") > 0, 0.1))
    return g.crossJoin(r).select(F.round(score, 4).alias("access_control"))


def change_tracking(tables: DataFrame) -> DataFrame:
    return tables.agg(F.round(F.count_if("has_trigger") / F.greatest(F.count("*"), F.lit(1)), 4).alias("change_tracking"))


ML_NAMES = "ai_|feature|inference|ml_|model|prediction|training"
VERSION_COLUMNS = ("created_at", "model_version", "run_id", "trained_at", "updated_at", "version")
TRAIL_NAMES = "audit|history|log|tracking"


def model_documentation(columns: DataFrame) -> DataFrame:
    """Over rows (table_name, column_name): machine-learning tables, their version columns, and audit trails."""
    t = columns.groupBy(F.lower("table_name").alias("t")).agg(F.max(F.lower("column_name").isin(*VERSION_COLUMNS)).alias("versioned"))
    ml = F.col("t").rlike(ML_NAMES)
    s = t.agg(F.count_if(ml).alias("ml"), F.count_if(ml & F.col("versioned")).alias("v"), F.count_if(F.col("t").rlike(TRAIL_NAMES)).alias("trail"))
    score = _points((F.col("ml") > 0, 0.4), (F.col("trail") > 0, 0.3)) + F.when(F.col("ml") > 0, 0.3 * F.col("v") / F.col("ml")).otherwise(0.0)
    return s.select(F.round(F.least(score, F.lit(1.0)), 4).alias("ai_act_article11"))


ROOT_ROLES, WRITE_ROLES = ("__system", "clusterAdmin", "root"), ("__system", "clusterAdmin", "dbAdmin", "dbOwner", "readWrite", "root")


def document_store(collections: DataFrame, users: DataFrame, replica_set: bool) -> DataFrame:
    """The same indicators for a document store: collections (name, has_schema, size) and users (user, roles)."""
    name = F.lower("name")
    ml = name.rlike(ML_NAMES)
    share = lambda c, empty: F.coalesce(F.count_if(c) / F.nullif(F.count("*"), F.lit(0)), F.lit(empty))
    without = lambda roles: ~F.arrays_overlap("roles", F.array(*map(F.lit, roles)))
    versioned = F.count_if(ml & name.rlike("experiment|registry|run|version"))
    models = _points((F.count_if(ml) > 0, 0.4), (F.count_if(name.rlike(TRAIL_NAMES)) > 0, 0.3)) + F.coalesce(0.3 * versioned / F.nullif(F.count_if(ml), F.lit(0)), F.lit(0.0))
    c = collections.agg(F.round(share(F.col("has_schema"), 0.0), 4).alias("documentation_coverage"), F.round(F.least(models, F.lit(1.0)), 4).alias("ai_act_article11"))
    u = users.agg(F.round(share(without(ROOT_ROLES), 0.5), 4).alias("security_compliance"), F.round(share(without(WRITE_ROLES), 0.5), 4).alias("access_control"))
    return c.crossJoin(u).withColumn("change_tracking", F.lit(1.0 if replica_set else 0.0))


def forbidden_permissions(grants: DataFrame, user: str, forbidden: tuple[str, ...]) -> DataFrame:
    found = grants.where((F.col("grantee") == user) & F.upper("privilege_type").isin(*forbidden)).select(F.upper("privilege_type").alias("permission")).distinct()
    return found.agg(F.array_join(F.array_sort(F.collect_list("permission")), ",").alias("forbidden")).withColumn("status", F.when(F.col("forbidden") == "", "ok").otherwise("warning"))


# --- directories ------------------------------------------------------------------------------------

DISABLED_BIT, NO_EXPIRY_BIT, DORMANT_DAYS = 0x2, 0x10000, 90
ADMIN_GROUPS = tuple(sorted({"administrateurs du domaine", "administrators", *[f"{k}{s}admins" for k in ("domain", "enterprise", "schema") for s in " _"]}))


def users_ad(users: DataFrame, as_of: str) -> DataFrame:
    """users: uac, last_logon, spn and member_of arrays."""
    off = F.col("uac").bitwiseAND(DISABLED_BIT) != 0
    dormant = ~off & (F.datediff(F.lit(as_of).cast("date"), F.to_date("last_logon")) > DORMANT_DAYS)
    filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return users.agg(
        F.count("*").alias("total"),
        F.greatest(F.lit(0), F.count("*") - F.count_if(off) - F.count_if(dormant)).alias("active"),
        F.count_if(dormant).alias("dormant_90d"),
        F.count_if(filled("spn")).alias("service_accounts"),
        F.count_if(F.col("uac").bitwiseAND(NO_EXPIRY_BIT) != 0).alias("pwd_no_expire"),
        F.count_if(off & filled("member_of")).alias("disabled_in_groups"),
    )


def _members(groups: DataFrame) -> DataFrame:
    real = F.filter(F.coalesce("member", F.array().cast("array<string>")), lambda m: ~F.startswith(m, F.lit("cn=admin,")))
    return groups.withColumn("real", real)


def users_ldap(users: DataFrame, groups: DataFrame) -> DataFrame:
    """users: dn and description, whose words give the flags."""
    says = lambda w: F.contains(F.upper(F.coalesce("description", F.lit(""))), F.lit(w))
    inside = groups.select(F.explode("member").alias("m")).select(F.lower("m").alias("_dn"), F.lit(True).alias("_in")).distinct()
    rows = users.withColumn("_dn", F.lower("dn")).join(inside, "_dn", "left")
    off, dormant = says("DISABLED"), says("DORMANT")
    return rows.agg(
        F.count("*").alias("total"),
        F.greatest(F.lit(0), F.count("*") - F.count_if(off) - F.count_if(dormant)).alias("active"),
        F.count_if(dormant).alias("dormant_90d"),
        F.count_if(F.contains(F.lower("dn"), F.lit("ou=serviceaccounts"))).alias("service_accounts"),
        F.count_if(says("SERVICE ACCOUNT") | says("PWD_NO_EXPIRE")).alias("pwd_no_expire"),
        F.count_if(off & F.coalesce("_in", F.lit(False))).alias("disabled_in_groups"),
    )


def groups_summary(groups: DataFrame) -> DataFrame:
    n = F.size("real")
    return _members(groups).agg(F.count("*").alias("total"), F.count_if(n == 0).alias("empty_groups"), F.count_if(n >= 50).alias("large_groups_50plus"))


def admins(groups: DataFrame, total_users: DataFrame) -> DataFrame:
    """total_users: one row with n."""
    own = _members(groups).where(F.lower("cn").isin(*ADMIN_GROUPS)).select(F.explode("real").alias("m"))
    return own.agg(F.count_distinct(F.lower("m")).alias("total_admins")).crossJoin(total_users).select("total_admins", F.when(F.col("n") > 0, F.round(F.col("total_admins") / F.col("n"), 4)).otherwise(0.0).alias("admin_ratio"))


def filetime_days(interval: Column) -> Column:
    """Whole days of a negative interval of 100 ns; null where there is none."""
    return F.when(interval < 0, F.nullif(F.floor(-interval / F.lit(864_000_000_000)), F.lit(0))).cast("bigint")


# --- applications -----------------------------------------------------------------------------------

FIELDS = {
    "customers": (("name", "name"), ("emails", "email"), ("phone", "phone"), ("billing_iban", "iban"), ("vat_number", "vat"), ("billing_address", "address")),
    "suppliers": (("name", "name"), ("iban", "iban"), ("postal_address", "address")),
    "customer_invoices": (("label", "name"), ("pdf_invoice_free_text", "free_text")),
}


def populated(value: Column) -> Column:
    """Neither null nor blank, nor an empty or falsy value in text form."""
    return F.coalesce(~F.trim(value).isin("", "[]", "{}", "0", "0.0", "false", "null"), F.lit(False))


def entity_fields(entity: str, rows: DataFrame) -> DataFrame:
    """entity, field, classification, populated_count and total_count of the known fields, by one pass."""
    known = [(f, k) for f, k in FIELDS[entity] if f in rows.columns]
    each = [F.struct(F.lit(f).alias("field"), F.lit(k).alias("classification"), F.count_if(populated(F.col(f).cast("string"))).alias("populated_count")) for f, k in known]
    return rows.agg(F.explode(F.array(*each)).alias("x"), F.count("*").alias("total_count")).select(F.lit(entity).alias("entity"), "x.*", "total_count")


def app_summary(fields: DataFrame) -> DataFrame:
    each = fields.groupBy("entity").agg(F.sum("populated_count").alias("n"), F.max("total_count").alias("total"), F.sum(F.when(F.col("classification") == "iban", F.col("populated_count")).otherwise(0)).alias("iban"))
    return each.agg(
        F.sum("total").alias("total_records"),
        F.sum("n").alias("total_pii_values"),
        F.round(F.sum("n") / F.greatest(F.sum("total"), F.lit(1)), 4).alias("density"),
        F.max_by("entity", F.struct("n", "entity")).alias("highest_risk_entity"),
        F.sum("iban").alias("iban_count"),
        F.count_if(F.col("iban") > 0).alias("bank_data_entities"),
    )


# --- hosts ------------------------------------------------------------------------------------------


def disk_linux(rota: Column, tran: Column, model: Column) -> Column:
    m = F.lower(F.coalesce(model, F.lit("")))
    solid = m.rlike("ssd|nvme")
    return F.when(F.lower(tran) == "nvme", "NVMe").when(rota == "0", "SSD").when(rota == "1", F.when(solid, "SSD").otherwise("HDD")).when(F.contains(m, F.lit("ssd")), "SSD").when(F.contains(m, F.lit("nvme")), "NVMe").otherwise("Unknown")


def disk_windows(media: Column, bus: Column, model: Column) -> Column:
    m, nvme = F.lower(F.coalesce(model, F.lit(""))), F.contains(F.coalesce(bus, F.lit("")), F.lit("NVMe"))
    by_name = F.when(F.contains(m, F.lit("ssd")), "SSD").when(F.contains(m, F.lit("nvme")), "NVMe").when(F.contains(m, F.lit("hdd")), "HDD").otherwise("Unknown")
    return F.when(media.isin("4", "SSD"), F.when(nvme, "NVMe").otherwise("SSD")).when(media.isin("3", "HDD"), "HDD").when(nvme, "NVMe").otherwise(by_name)


def disk_mac(protocol: Column, bus: Column, solid: Column, model: Column) -> Column:
    """By the connection, then by what the disk says of itself (a name may overrule a no), then by the name."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    has = lambda c, word: F.contains(low(c), F.lit(word))
    named = F.when(has(model, "ssd"), "SSD")
    return (
        F.when(has(protocol, "nvme") | has(F.coalesce(bus, protocol), "nvme"), "NVMe")
        .when(solid, "SSD")
        .when(~solid, F.coalesce(named, F.lit("HDD")))
        .when(has(model, "apple ssd") | has(protocol, "apple fabric"), "NVMe")
        .otherwise(F.coalesce(named, F.lit("Unknown")))
    )


def raid_level(mdstat_line: Column) -> Column:
    return F.regexp_extract(mdstat_line, r"^md[^:]*:.*?\b(raid\S*)", 1)


def link_mbps(speed: Column) -> Column:
    value, unit = F.regexp_extract(speed, r"^\s*([0-9.]+)\s", 1).try_cast("double"), F.lower(F.regexp_extract(speed, r"^\s*\S+\s+(\S+)", 1))
    return F.when(F.contains(unit, F.lit("gbps")), value * 1000).when(F.contains(unit, F.lit("mbps")), value).cast("int")


AGENTS = (("acronis_mms", "Acronis"), ("acronis_monitor", "Acronis"), ("bacula-fd", "Bacula"), ("bareos-fd", "Bareos"), ("borg", "BorgBackup"), ("cvd", "Commvault"), ("duplicati", "Duplicati"), ("restic", "Restic"), ("urbackupclient", "UrBackup"), ("veeamagent", "Veeam"), ("veeamtransport", "Veeam"))


def backup_agents(services: DataFrame) -> DataFrame:
    """Names of the backup products whose process is among the services (a column ``service``)."""
    low = F.lower("service")
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(n)) for p, n in AGENTS]))
    return services.select(F.explode(hits).alias("agent")).distinct()


def eta(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    part = lambda d, u: F.concat((s / d).cast("bigint").cast("string"), F.lit(u))
    rest = lambda d, m, u: F.concat(F.floor(s % m / d).cast("bigint").cast("string"), F.lit(u))
    return F.when(s < 60, part(1, "s")).when(s < 3600, F.concat(part(60, "m "), rest(1, 60, "s"))).otherwise(F.concat(part(3600, "h "), rest(60, 3600, "m")))


SECRET_KEYS = tuple(sorted("access_token api_key api_secret auth_token bearer_token client_secret credential password private_key refresh_token secret ssl_cert ssl_key token".split()))


def redact(config: Column) -> Column:
    return F.transform_values(config, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS), "***REDACTED***").otherwise(v))


# --- logs, reports and health -----------------------------------------------------------------------

_STAMP = r"([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})"
LOG_RANGE = 100_000
STARTED, ENDED = r"(?:BEGIN SCAN|Starting scan|Scan started)", r"(?:END SCAN|Scan finished|Scan completed)"


def log_sessions(lines: DataFrame, log: str = "log_id") -> DataFrame:
    """Scans of each log (log_id, line_no, line): start, end, status, duration, files and rates.

    A scan runs from a start to the next end or start; one that is neither ended
    nor the last of its log was interrupted.
    """
    rows = lines.withColumns({"is_start": F.col("line").rlike(_STAMP + ".*" + STARTED), "is_end": F.col("line").rlike(_STAMP + ".*" + ENDED), "ts": F.try_to_timestamp(F.regexp_extract("line", _STAMP, 1), F.lit("yyyy-MM-dd HH:mm:ss"))})
    rows = rows.withColumn("files", F.regexp_extract("line", r"(?:Found|Processed|Scanned)\s*([0-9]+)\s*files", 1).try_cast("bigint"))
    # scans are numbered by ranges of lines, so that a long log is no single task
    rows = rows.withColumn("_range", F.expr(f"line_no div {LOG_RANGE}"))
    starts = rows.groupBy(log, "_range").agg(F.sum(F.col("is_start").cast("int")).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(log).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(starts.select(log, "_range", before.alias("_before")), [log, "_range"])
    upto = Window.partitionBy(log, "_range").orderBy("line_no")
    rows = rows.withColumn("scan", F.col("_before") + F.sum(F.col("is_start").cast("int")).over(upto)).where("scan > 0")
    own = Window.partitionBy(log, "scan").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_over", F.coalesce(F.max("is_end").over(own), F.lit(False))).where("not _over")
    each = rows.groupBy(log, "scan").agg(F.min(F.when(F.col("is_start"), F.col("ts"))).alias("started"), F.max(F.when(F.col("is_end"), F.col("ts"))).alias("ended"), F.coalesce(F.max_by("files", F.when(F.col("files").isNotNull(), F.col("line_no"))), F.lit(0)).alias("files"))
    last = F.max("scan").over(Window.partitionBy(log))
    seconds = (F.unix_timestamp("ended") - F.unix_timestamp("started")).cast("double")
    status = F.when(F.col("ended").isNotNull(), "completed").when(F.col("scan") == last, "in_progress").otherwise("interrupted")
    return each.withColumns({"status": status, "seconds": seconds}).withColumn("files_per_second", F.when((F.col("seconds") > 0) & (F.col("files") > 0), F.round(F.col("files") / F.col("seconds"), 2)))


def log_summary(sessions: DataFrame) -> DataFrame:
    done = F.sum(F.when(F.col("status") == "completed", F.col("seconds")))
    return sessions.agg(F.count("*").alias("total_scans"), F.count_if(F.col("status") == "completed").alias("completed_scans"), F.sum("files").alias("total_files"), F.round(F.coalesce(done, F.lit(0.0)), 2).alias("total_seconds"), F.when(done > 0, F.round(F.sum("files") / done, 2)).otherwise(0.0).alias("files_per_second"))


def last_errors(lines: DataFrame, n: int = 50, log: str = "log_id") -> DataFrame:
    """The last errors of each log with their time; the message is cut at 200 characters."""
    rx = _STAMP + r".*(?:FAILED|Failed|ERROR|Error)(.*)$"
    rows = lines.where(F.col("line").rlike(rx)).select(log, "line_no", F.regexp_extract("line", rx, 1).alias("stamp"), F.substring(F.trim(F.regexp_extract("line", rx, 2)), 1, 200).alias("message"))
    place = F.row_number().over(Window.partitionBy(log).orderBy(F.desc("line_no")))
    return rows.withColumn("_n", place).where(F.col("_n") <= n).drop("_n")


SENSITIVE_TYPES = ("credit_card", "iban", "iban_fr", "ssn_fr", "ssn_us")


def alerts(report: DataFrame, high: int = 100, slow: float = 10.0) -> DataFrame:
    """report: source_type, pii_files, sensitive, files_per_second, pii_tables; adds the alerts that hold."""
    files, db = F.col("source_type") == "files", F.col("source_type") == "database"
    found = F.array_compact(F.array(
        F.when(files & (F.col("pii_files") >= high), "HIGH_PII_RISK"),
        F.when(files & (F.col("sensitive") > 0), "SENSITIVE_PII"),
        F.when(files & (F.col("files_per_second") > 0) & (F.col("files_per_second") < slow), "LOW_PERFORMANCE"),
        F.when(db & (F.col("pii_tables") > 0), "DB_PII_DETECTED"),
    ))
    return report.withColumn("alerts", F.array_join(found, ","))


def health(checks: DataFrame) -> DataFrame:
    """checks: free_memory, free_disk (bytes), last_errors."""
    memory, disk = F.coalesce(F.col("free_memory") > 512 << 20, F.lit(True)), F.coalesce(F.col("free_disk") > 1 << 30, F.lit(True))
    return checks.withColumn("status", F.when(~memory | ~disk, "unhealthy").when(F.col("last_errors") > 0, "degraded").otherwise("healthy"))


def connector_health(results: DataFrame) -> DataFrame:
    """Per connector type: runs and the healthy percentage."""
    return results.groupBy("connector").agg(F.count("*").alias("runs"), F.round(100 * F.avg(F.col("success").cast("int")), 1).alias("healthy_pct"))


def share_grants(items: DataFrame) -> DataFrame:
    """One row a grant of shared items: item_id, permissions (roles, user, group_name, link_scope, app)."""
    p = F.col("p")
    role = F.coalesce(F.get(p["roles"], F.lit(0)), F.lit("read"))
    grant = lambda kind, who: F.when(who.isNotNull(), F.struct(F.lit(kind).alias("grant_type"), who.alias("grantee"), role.alias("role")))
    all_ = F.array_compact(F.array(grant("user", p["user"]), grant("group", p["group_name"]), grant("link", F.concat(F.lit("link:"), p["link_scope"])), grant("application", p["app"])))
    return items.select("item_id", F.explode("permissions").alias("p")).select("item_id", F.explode(all_).alias("g")).select("item_id", "g.*")
