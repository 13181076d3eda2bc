"""Catalogs, cloud files, directories, configurations and logs on small cases."""

import base64
import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from riskweave.operators import catalog, cloud, files, metadata, pii
from riskweave.queries.pii import SAMPLES
from riskweave.sources import config, databases, filesystem, records, spreadsheets
from riskweave.streaming import audits


def test_every_family_finds_its_text(spark):
    df = spark.createDataFrame(list(SAMPLES.items()), "family string, text string")
    for mode in ("line", "block"):
        found = {(r.family, r.type) for r in pii.raw_matches(df, "family", "text", mode).select("family", "type").distinct().collect()}
        assert {(f, f) for f in SAMPLES} <= found
        assert len({t for _, t in found}) == 30


def test_composite_keys_are_matched_by_place(spark):
    constraints = spark.createDataFrame([("s", "pk", "a", "PRIMARY KEY", None, None), ("s", "fk", "b", "FOREIGN KEY", "s", "pk")], "schema string, constraint_name string, table_name string, kind string, ref_schema string, ref_constraint string")
    usage = spark.createDataFrame([("s", "pk", "y", 2), ("s", "pk", "x", 1), ("s", "fk", "q", 2), ("s", "fk", "p", 1)], "schema string, constraint_name string, column_name string, ordinal int")
    assert {(r.column_name, r.ref_table, r.ref_column) for r in catalog.foreign_keys(constraints, usage).collect()} == {("p", "a", "x"), ("q", "a", "y")}
    assert catalog.primary_keys(constraints, usage).first().key == "x,y"


def test_catalog_sql_reads_only_and_names_its_columns():
    want = {"columns": "schema table_name column_name ordinal data_type", "constraints": "schema constraint_name table_name kind ref_schema ref_constraint", "usage": "schema constraint_name column_name ordinal", "views": "schema name definition", "materialised": "schema name definition", "routines": "schema name definition", "triggers": "schema name table_name definition", "index_columns": "schema table_name index_name column_name ordinal is_unique scans", "stats": "schema table_name row_count data_bytes index_bytes last_vacuum last_autovacuum last_analyze last_autoanalyze"}
    for kind in databases.CONNECTORS:
        assert set(databases.CATALOG_SQL[kind]) == set(want)
        for what, sql in databases.CATALOG_SQL[kind].items():
            assert databases.check_read_only(sql)
            for name in want[what].split():
                assert re.search(rf"\b{name}\b", sql), (kind, what, name)


def test_catalog_without_system_schemas(spark):
    c = spark.createDataFrame([("pg_catalog", "t", "a", 1, "int"), ("PG_TOAST", "t", "a", 1, "int"), (None, "t", "b", 2, "text"), (None, "t", "a", 1, "int"), ("x", "own", "a", 1, "int")], "schema string, table_name string, column_name string, ordinal int, data_type string")
    assert {(r.schema, r.columns) for r in catalog.structure(c).collect()} == {(None, "a:int,b:text"), ("x", "a:int")}
    assert catalog.user_schemas(c, ("own",)).count() == 2 and catalog.structure(c.limit(0)).count() == 0


def test_samples_of_tables_have_their_size(spark):
    rows = spark.range(5000).select((F.col("id") % 3).cast("string").alias("t"), F.col("id").cast("string").alias("k")).withColumn("sample_size", F.when(F.col("t") == "0", 100).otherwise(20))
    got = {r.t: r["count"] for r in catalog.sampled_each(rows, ["t"], "k").groupBy("t").count().collect()}
    assert got == {"0": 100, "1": 20, "2": 20}
    first = {r.k for r in catalog.sampled_each(rows, ["t"], "k").collect()}
    assert first == {r.k for r in catalog.sampled_each(rows.repartition(7), ["t"], "k").collect()}


def workbook():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>a@</t></r><r><t>x.org</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>12.5</v></c></row><row/><row><c t="s"><v>1</v></c><c t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet10.xml", f"<worksheet {ns}><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>")
    return out.getvalue()


def test_text_of_files(spark, tmp_path):
    assert spreadsheets.workbook_text(workbook()) == "name 12.5\na@x.org in\n7" and spreadsheets.workbook_text(b"no zip") is None
    (tmp_path / "b.xlsx").write_bytes(workbook())
    (tmp_path / "bad.xlsx").write_bytes(b"PK\x03\x04")
    (tmp_path / "a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "a.png").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in spreadsheets.texts(filesystem.contents(spark, str(tmp_path)), (".txt",)).collect()}
    assert got == {"b.xlsx": "name 12.5\na@x.org in\n7", "bad.xlsx": None, "a.txt": "é", "a.png": None}


def test_heads_read_no_more_than_asked(spark, tmp_path):
    (tmp_path / "big").write_bytes(b"ab" * 50_000)
    rows = spark.createDataFrame([(str(tmp_path / "big"),), (str(tmp_path / "none"),)], "path string")
    got = {r.path.rsplit("/", 1)[-1]: r.content for r in filesystem.heads(rows, 5).collect()}
    assert bytes(got["big"]) == b"ababa" and got["none"] is None


def test_tree_is_split_below_the_root(spark, tmp_path):
    for p in ("a/b/c/x.txt", "a/y.txt", "z.txt", "a/b/w.sh"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("1")
    (tmp_path / "a/b/w.sh").chmod(0o555)
    for split in ("0", "1", "2", "9"):
        got = {r.relative_path: (r.depth, r.is_readonly, r.is_executable) for r in filesystem.inventory(spark, str(tmp_path), split=split).collect()}
        assert got == {"z.txt": (0, False, False), "a/y.txt": (1, False, False), "a/b/w.sh": (2, True, True), "a/b/c/x.txt": (3, False, False)}


def test_configuration(tmp_path):
    path = tmp_path / "c.json"
    assert config.exclusions(str(path)) == files.Exclusions()
    path.write_text(json.dumps({"exclusions": {"max_file_size_mb": 2, "extensions": [".EXE"]}, "custom": {"paths": ["*/x/*"]}, "other": 1}))
    got = config.exclusions(str(path))
    assert (got.max_bytes, got.extensions, got.custom_globs, got.min_bytes) == (2 << 20, (".exe",), ("*/x/*",), 10)


def test_mini_queries(spark):
    assert cloud.mini_query("select a, b from users where age = 30 limit 5") == {"collection": "users", "columns": ["a", "b"], "field": "age", "value": 30, "limit": 5}
    assert cloud.mini_query("SELECT * FROM c WHERE x.y = 'a b'")["value"] == "a b" and cloud.mini_query("select * from c")["limit"] == 1000
    for bad in ("delete from c", "select * from a where x > 1", "select * from a join b"):
        with pytest.raises(ValueError, match="query"):
            cloud.mini_query(bad)
    df = spark.createDataFrame([(i % 3, i) for i in range(9)], "k int, v int")
    assert [r.v for r in cloud.run_mini({"c": df}, "select v from c where k = 1 limit 2", ["v"]).collect()] == [1, 4]


def test_cloud_gate_and_dates(spark):
    rows = [(".TXT", 10, "a", True), (".txt", 6 << 20, "a", False), (".txt", 10, None, False), (".exe", 10, "a", False), (None, 10, "a", False), (".txt", None, "a", False)]
    df = spark.createDataFrame(rows, "e string, s long, i string, want boolean")
    assert df.where(cloud.extractible(F.col("e"), F.col("s"), F.col("i")) != F.col("want")).count() == 0
    times = [("2024-01-01T00:00:00Z", 1704067200.0), ("2024-01-01T01:00:00+01:00", 1704067200.0), ("2024-01-01 00:00:00", 1704067200.0), ("2024-01-01T00:00:00.1234567Z", 1704067200.123456), ("soon", None), (None, None), ("2024-13-01T00:00:00Z", None)]
    got = [r[0] for r in spark.createDataFrame(times, "t string, w double").select(cloud.iso_seconds(F.col("t"))).collect()]
    assert got == [w for _, w in times]


def test_directory_export(spark, tmp_path):
    value = base64.b64encode("Müller".encode()).decode()
    (tmp_path / "x.ldif").write_text(f"version: 1\n\ndn: uid=a,ou=People\nobjectClass: inetOrgPerson\ndescription: a long\n  line DISABLED\nmemberOf: cn=g\nmemberOf: cn=h\nsn:: {value}\n\ndn: cn=g,dc=x\nobjectClass: groupOfNames\ncn: Administrators\nmember: uid=a,ou=People\nmember: cn=admin,dc=x\n")
    entries = records.directory_entries(spark, str(tmp_path / "x.ldif"))
    users, groups = records.directory_users(entries), records.directory_groups(entries)
    u = users.first()
    assert (u.dn, u.description, u.member_of) == ("uid=a,ou=People", "a long line DISABLED", ["cn=g", "cn=h"]) and entries.where("dn like 'uid%'").first().attributes["sn"] == ["Müller"]
    assert metadata.users_ldap(users, groups).first().disabled_in_groups == 1 and metadata.groups_summary(groups).first().empty_groups == 0


def test_logs_are_read_in_parts(spark, tmp_path):
    for name, n in (("a.log", 5000), ("b.log", 3)):
        (tmp_path / name).write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = records.log_lines(spark, str(tmp_path))
        assert rows.where(F.col("line_no") != F.regexp_extract("line", r"line (\d+)", 1).cast("int")).count() == 0 and rows.count() == 5003
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_long_logs_are_numbered_by_ranges(spark, monkeypatch):
    stamp = "2024-01-01 10:00:0{0},1 - INFO - {1}"
    lines = [(1, i, stamp.format(i % 9, "Scan started" if i % 4 == 0 else "Scan completed" if i % 4 == 2 else "Scanned 5 files")) for i in range(3, 60)]
    df = spark.createDataFrame(lines, "log_id int, line_no int, line string")
    whole = sorted(map(str, metadata.log_sessions(df).collect()))
    monkeypatch.setattr(metadata, "LOG_RANGE", 7)
    assert sorted(map(str, metadata.log_sessions(df).collect())) == whole and len(whole) == 14


def test_mount_tables(spark):
    lines = ["36 35 98:0 /root / rw,noatime master:1 - ext4 /dev/root rw", "40 36 0:32 / /mnt/my\\040share rw shared:2 - cifs //srv/x rw", "41 36 0:33 / /mnt rw - ext4 /dev/sdb rw", "nonsense"]
    mounts = files.mountinfo(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert {(r.mount_point, r.fs_type) for r in mounts.collect()} == {("/", "ext4"), ("/mnt/my share", "cifs"), ("/mnt", "ext4")}
    paths = spark.createDataFrame([("/mnt/my share/a",), ("/mnt/b",), ("c/d",), ("/mnt/b",)], "path string")
    assert {(r.path, r.is_network) for r in files.on_network(paths, mounts).collect()} == {("/mnt/my share/a", True), ("/mnt/b", False), ("c/d", False)}
    assert {(r.path, r.mount_point) for r in files.mount_of(paths, mounts).collect()} == {("/mnt/my share/a", "/mnt/my share"), ("/mnt/b", "/mnt"), ("c/d", None)}


def test_report_metrics(spark):
    db = spark.createDataFrame([([("t", 5, 10, ["email"]), ("u", 7, None, [])],)], "tables array<struct<table_name:string,row_count:bigint,size_bytes:bigint,pii_types:array<string>>>")
    assert tuple(records.report_tables(db).first()) == (2, 12, 10, 1) and records.report_kind(db) == "database"
    drive = spark.createDataFrame([("onedrive", [("d1", 5, True, [("anonymous",)]), ("d2", 3, False, []), ("d1", None, None, None)])], "source_type string, files array<struct<drive_id:string,size:bigint,pii_detected:boolean,permissions:array<struct<link_scope:string>>>>")
    assert tuple(records.report_drives(drive).first()) == (2, 3, 8, 1, 1) and records.report_kind(drive) == "cloud"
    totals = spark.createDataFrame([(9, 2, {"email": 3}, 1)], "total_files int, files_with_pii int, pii_by_type map<string,int>, more int")
    assert records.minimal(totals, "/x").columns == ["source_path", "total_files", "files_with_pii", "pii_by_type"]
    assert records.file_name("/a/my share/", "2024") == "scan_my_share_2024.json"


def test_seen_keys(spark):
    rows, seen = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "k string, v int"), spark.createDataFrame([("a",), ("a",)], "k string")
    new, known = cloud.check_and_add(rows, seen, "k")
    assert sorted(r.k for r in new.collect()) == ["b", "c"] and sorted(r.k for r in known.collect()) == ["a", "b", "c"]


def test_inventories_are_compared_with_the_last_snapshot(spark, tmp_path):
    schema = "path string, size bigint, mtime double"
    inbox, run = str(tmp_path / "in"), {k: str(tmp_path / k) for k in ("snapshots", "out", "state")}

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = audits.read_new(spark, inbox, schema, 1)
        audits.reaudit_files(stream, run["snapshots"], "src", run["out"], run["state"])

    arrive([("/a", 1, 0.0), ("/b", 1, 0.0)])
    arrive([("/a", 1, 0.5), ("/b", 2, 0.0), ("/c", 1, 0.0)])
    got = spark.read.parquet(run["out"]).groupBy("batch", "status").count().collect()
    assert {(r.batch, r.status, r["count"]) for r in got} == {(0, "new", 2), (1, "unchanged", 1), (1, "modified", 1), (1, "new", 1)}
    assert records.latest_snapshot(spark, run["snapshots"], "src").count() == 3


def test_times_and_latest_snapshots(spark):
    from riskweave.functions import paths

    values = [("12.5", 12.5), ("2024-01-01T00:00:00Z", 1704067200.0), ("2024-01-01 00:00:00", 1704067200.0), ("soon", 0.0), (None, 0.0)]
    assert [r[0] for r in spark.createDataFrame(values, "v string, w double").select(paths.parse_mtime(F.col("v"))).collect()] == [w for _, w in values]
    snaps = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("a", "2", 3), ("b", "1", 4)], "source_id string, taken string, n int")
    assert sorted(r.n for r in records.latest_by_source(snaps).collect()) == [2, 3, 4]


def test_exports_are_read(spark, tmp_path):
    (tmp_path / "items.json").write_text('{"id": "1", "name": "a", "size": 5, "permissions": [{"roles": ["write"], "user": "u"}]}\n{"id": "2", "name": "b"}\n')
    (tmp_path / "entities.json").write_text('{"name": "x", "n": 5, "tags": ["a"]}\n')
    items = records.cloud_items(spark, str(tmp_path / "items.json"))
    assert metadata.share_grants(items.withColumnRenamed("id", "item_id")).first().role == "write" and items.count() == 2
    assert records.entities(spark, str(tmp_path / "entities.json")).first().n == "5"
    documents = databases.documents(spark, str(tmp_path / "items.json"))
    assert documents.where("size is null").count() == 1
    spark.range(3).write.parquet(str(tmp_path / "t"))
    stored = databases.stored_size(spark.read.parquet(str(tmp_path / "t"))).first()
    assert stored.size_bytes > 0 and stored.last_updated is not None
    spark.range(2).createOrReplaceTempView("riskweave_seen")
    assert [c.name for c in databases.catalog(spark).where("table_name = 'riskweave_seen'").first().columns] == ["id"]
    spark.catalog.dropTempView("riskweave_seen")


def test_host_inventory(spark, tmp_path):
    from riskweave.sources import host

    for path, text in {"sys/block/sda/queue/rotational": "1", "sys/block/sda/device/model": "ST1000 ", "sys/block/sda/size": "2048", "sys/block/nvme0n1/queue/rotational": "0", "sys/block/nvme0n1/size": "10", "sys/block/sdb/queue/rotational": "1", "sys/block/sdb/device/model": "My SSD", "sys/block/loop0/size": "1", "proc/mdstat": "Personalities : [raid1]\nmd0 : active raid1 sda[0]\n", "sys/class/net/eth0/speed": "1000", "sys/class/net/eth0/operstate": "up", "sys/class/net/lo/operstate": "up", "sys/class/net/wl/operstate": "down", "proc/12/comm": "veeamagent", "proc/13/comm": "sshd"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text + "\n")
    assert {(r.name, r.kind, r.size_bytes) for r in host.disks(spark, str(tmp_path)).collect()} == {("sda", "HDD", 1 << 20), ("nvme0n1", "NVMe", 5120), ("sdb", "SSD", None)}
    assert host.arrays(spark, str(tmp_path)).first().level == "raid1" and {(r.name, r.mbps) for r in host.links(spark, str(tmp_path)).collect()} == {("eth0", 1000), ("wl", None)}
    got = host.summary(spark, str(tmp_path)).first()
    assert (got.ssd_disks, got.hdd_disks, got.nvme_disks, got.arrays, got.links_up, got.backup_agents) == (1, 1, 1, 1, 1, "Veeam")
    assert host.summary(spark, str(tmp_path / "none")).first().total_bytes == 0


def test_a_plan_is_built_without_a_job(spark):
    from riskweave import queries

    tracker = spark.sparkContext.statusTracker()
    for name in ("pii_line_by_type", "pii_block_by_type", "native_flags_density", "file_snapshot_diff", "file_sample_selected", "log_sessions"):
        spark.sparkContext.setJobGroup(f"plan-{name}", name)
        queries.queries()[name](spark, "/root/testdata/sf0.001")
        shuffles = [i for i in tracker.getJobIdsForGroup(f"plan-{name}") if len(tracker.getJobInfo(i).stageIds) > 1]
        assert not shuffles
    spark.sparkContext.setJobGroup("", "")
