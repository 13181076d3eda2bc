"""File pruning, content analysis, table profiles, metadata, sources and sinks on small cases."""

import hashlib
import os

from pyspark.sql import functions as F

from riskweave.functions import content, paths
from riskweave.operators import files, metadata, tables
from riskweave.sources import filesystem, records


def test_paths(spark):
    rows = [("/mnt/vol1/HR/a.CSV", "vol1", ".csv", "sensitive"), ("/srv/backup/hr/x", "srv", "", "sensitive"), ("/srv/old/.env", "srv", "", "archive"), ("C:/x/y.tar.gz", "C:", ".gz", "normal"), ("a/b.txt", "b.txt", ".txt", "normal"), ("/mnt", "mnt", "", "normal")]
    df = spark.createDataFrame(rows, "path string, v string, e string, z string")
    p = F.col("path")
    bad = df.select("*", paths.volume_root(p).alias("gv"), paths.extension(p).alias("ge"), paths.zone(p).alias("gz")).where("v != gv or e != ge or z != gz")
    assert bad.collect() == []


def test_exclusion_order(spark):
    rows = [("/a/x.exe", 5), ("/a/node_modules/x.js", 50), ("/a/.env", 50), ("/a/.hidden", 50), ("/a/~$d.docx", 50), ("/a/b.txt", 9), ("/a/b.txt", 6 * 10**12), ("/a/p.egg-info/x", 50), ("/a/ok.txt", 50)]
    df = files.fingerprint(spark.createDataFrame(rows, "path string, size bigint").withColumn("mtime", F.lit(0.0)))
    got = [r[0] for r in df.select(files.exclusion_reason()).collect()]
    assert got[0] == "extension: .exe" and got[1] == "path pattern: */node_modules/*" and got[2] is None and got[3].startswith("filename pattern") and got[4].startswith("filename pattern")
    assert got[5] == "size: 9 bytes < 10 min" and got[6].startswith("size: 5722045.9MB >") and got[7] == "path pattern: *.egg-info/*" and got[8] is None


def test_snapshot_diff(spark):
    s = "path_hash string, size bigint, mtime double"
    now = spark.createDataFrame([(k, 1, t) for k, t in (("same", 0.0), ("half", 0.5), ("one", 1.0), ("more", 1.5), ("new", 0.0))] + [("size", 2, 0.0)], s)
    old = spark.createDataFrame([(k, 1, 0.0, True) for k in ("same", "half", "one", "more", "size", "gone")], s + ", previous_pii boolean")
    got = {r.path_hash: (r.status, r.previous_pii) for r in files.snapshot_diff(now, old).collect()}
    assert got == {"same": ("unchanged", True), "half": ("unchanged", True), "one": ("unchanged", True), "more": ("modified", None), "size": ("modified", None), "new": ("new", None), "gone": ("deleted", None)}


def test_sampling_reaches_its_floor_and_keeps_sensitive_files(spark):
    df = files.fingerprint(spark.range(4000).select(F.concat(F.when(F.col("id") % 10 == 0, "/hr/").otherwise("/x/"), "id", F.lit(".bin")).alias("path"), F.lit(1).alias("size"), F.lit(0.0).alias("mtime")))
    got = files.sample(df, 1e9, floor_share=10, floor=2500).agg(F.count("*"), F.count_if("selected"), F.count_if((F.col("zone") == "sensitive") & F.col("selected"))).first()
    assert tuple(got) == (4000, 2500, 400)
    empty = files.sample(df.limit(0), 1e9)
    assert empty.count() == 0


def test_content(spark):
    cases = [bytes(1000), bytes(i % 256 for i in range(1024)), b"plain text here", "é à ü ô".encode(), b"\xe9\xe9\xe9 latin", b"\xef\xbb\xbfbom here", b"", b"short", b"%PDF-1.4 /Encrypt x", b"PK\x03\x04\x14\x00\x01\x00more"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(cases)], "i int, b binary")
    b = F.col("b")
    rows = df.select("i", content.entropy(b).alias("e"), content.encoding(b).alias("enc"), content.is_binary(b).alias("bin"), content.encrypted(b, content.entropy(b)).alias("crypt"), content.content_hash(b).alias("h")).orderBy("i").collect()
    assert rows[0].e == 0.0 and rows[1].e == 8.0 and rows[7].e == 0.0
    assert [r.enc for r in rows[2:6]] == [4, 1, 5, 1]
    assert rows[0].bin and not rows[2].bin and rows[1].crypt and rows[8].crypt and rows[9].crypt and not rows[2].crypt
    assert rows[6].h == "" and rows[2].h == hashlib.sha256(cases[2]).hexdigest()


def test_table_profiles(spark):
    df = spark.createDataFrame([(1, "a@x.org", "10"), (1, "a@x.org", "10"), (2, None, "x"), (3, "bad", None)], "id int, email string, price string")
    assert {(r.column_name, r.null_pct) for r in tables.null_percent(df).collect()} == {("email", 25.0), ("price", 25.0)}
    assert tables.completeness(df).first().completeness == 83.33 and tables.completeness(df.limit(0)).first().completeness == 100.0
    assert tables.duplicates(df).first().duplicate_rows == 1 and tables.duplicates(df.limit(0)).first().duplicate_rows == 0
    assert {(r.column_name, r.checked, r.invalid) for r in tables.invalid_values(df).collect()} == {("email", 3, 1), ("price", 3, 1)}
    sizes = spark.createDataFrame([("public", "users", 50_000, 50_000), ("public", "products", 10_000, 3_000), ("public", "access_logs", 10_000_000, 100_000), ("public", "t", 500, 500), ("public", "latest", 20_000, 1_000)], "s string, t string, n bigint, want bigint")
    assert sizes.where(tables.sample_size(tables.zone(F.col("s"), F.col("t")), F.col("n")) != F.col("want")).collect() == []


def test_read_only_guard():
    assert tables.check_read_only("select created_at from t")
    for bad in ("drop table t", "select 1; delete from t", "show tables"):
        try:
            tables.check_read_only(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_log_sessions(spark):
    lines = ["2024-01-01 10:00:00,1 Scan started", "Scanned 5 files", "2024-01-01 10:00:10,1 Scan completed", "idle", "2024-01-01 11:00:00,1 Starting scan", "2024-01-01 12:00:00,1 Scan started", "Found 7 files"]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(lines)], "log_id string, line_no int, line string")
    got = [(r.status, r.files, r.seconds) for r in metadata.log_sessions(df).orderBy("scan").collect()]
    assert got == [("completed", 5, 10.0), ("interrupted", 0, None), ("in_progress", 7, None)]


def test_file_tree_and_report(spark, tmp_path):
    root = tmp_path / "tree"
    for name, body in {"a.txt": b"hello", "sub/b.csv": b"x,y", "sub/deep/c.log": b"z", ".hidden": b"h", ".env": b"K=1", "node_modules/x.js": b"j"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    os.symlink(root, root / "sub/loop")
    got = {r.relative_path: (r.size, r.depth) for r in filesystem.inventory(spark, str(root)).where("error is null and not is_symlink").collect()}
    assert got == {"a.txt": (5, 0), ".env": (3, 0), "sub/b.csv": (3, 1), "sub/deep/c.log": (1, 2)}
    assert filesystem.inventory(spark, str(root), max_depth="1").where("not is_symlink").count() == 3
    assert filesystem.heads(filesystem.inventory(spark, str(root)).where("name like '%.txt'"), 3).select(filesystem.text_of(F.col("content"))).first()[0] == "hel"
    inv = files.fingerprint(spark.createDataFrame([("/hr/a.txt", 20, 1.0)], "path string, size bigint, mtime double"))
    records.write_report(files.fingerprint_stats(inv), inv, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/report")).first().summary.total == 1
    for taken in ("2024-01-01", "2024-02-01"):
        records.save_snapshot(inv.select("path_hash", "size", "mtime"), str(tmp_path / "snap"), "s1", taken)
    assert records.latest_snapshot(spark, str(tmp_path / "snap"), "s1").count() == 1


def test_live_sessions(spark, tmp_path):
    from riskweave.streaming.audits import live_sessions

    lines = [(1, 0, "Scan started"), (1, 1, "x"), (1, 2, "Scan completed"), (2, 0, "Scan started"), (2, 1, "Scan started")]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(lines, "log_id bigint, line_no bigint, line string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("log_id bigint, line_no bigint, line string").parquet(src)
    q = live_sessions(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, 1, 2, True), (2, 1, 0, False)]
