"""Pruning a file inventory: exclude, group duplicates, compare with a snapshot, sample; and its summaries.

An inventory has path, size and mtime (epoch seconds); ``fingerprint`` adds the rest.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

_MB = 1024 * 1024
#: Directory patterns, by their middle part or as they are.
_DIRS = sorted(
    """.backup .cache .eggs .git .gradle .hg .idea .maven .npm .pytest_cache .svn .sync .tox .venv .vs .vscode .yarn .Trash AppData/Local/Temp Cache Dropbox
    OneDrive SharePoint Windows/Temp __pycache__ backup backups bower_components build cache dist node_modules target temp tmp vendor venv Library/Caches $Recycle.Bin""".split()
)
_MORE = ("*.egg-info/*", "*.xcodeproj/*", "*.xcworkspace/*", "*/AppData/Google/Chrome/**", "*/AppData/Local/BraveSoftware/**", "*/AppData/Microsoft/Edge/**", "*/AppData/Mozilla/Firefox/**", "*/Google Drive/*", "*/Library/Application Support/*/Cache/*", "*/OneDrive - */*", "*/System Volume Information/*", "*/iCloud Drive/*")


@dataclass(frozen=True)
class Exclusions:
    extensions: tuple[str, ...] = tuple(sorted(".app .bak .cache .class .dll .dmg .ds_store .dylib .exe .fseventsd .localized .lock .msi .o .obj .pid .pkg .pyc .pyo .so .spotlight-v100 .swo .swp .sys .temp .tmp .trashes desktop.ini thumbs.db".split()))
    globs: tuple[str, ...] = tuple(f"*/{d}/*" for d in _DIRS) + _MORE
    names: tuple[str, ...] = (r"^\.(?!env)", r"~\$", r"\.part$", r"\.crdownload$", r"\.download$")
    max_bytes: int = 5_000_000 * _MB
    min_bytes: int = 10
    custom_extensions: tuple[str, ...] = ()
    custom_globs: tuple[str, ...] = ()
    scannable: tuple[str, ...] = tuple(sorted(".bat .c .cfg .conf .cpp .csv .env .go .h .htm .html .ini .java .js .json .log .md .php .properties .ps1 .py .rb .rs .rst .sh .sql .ts .txt .xls .xlsx .xml .yaml .yml".split()))
    max_scan_bytes: int = 50 * _MB
    skip_dirs: tuple[str, ...] = field(default=(".cache", ".env", ".git", ".hg", ".svn", ".tmp", ".venv", "__pycache__", "build", "dist", "env", "node_modules", "venv"))


def fingerprint(inventory: DataFrame) -> DataFrame:
    path = F.col("path")
    return inventory.withColumns({"path_hash": paths.path_hash(path), "name": paths.name(path), "extension": paths.extension(path), "zone": paths.zone(path), "volume_root": paths.volume_root(path)})


def exclusion_reason(config: Exclusions = Exclusions()) -> Column:
    """Why a file is left out, or null; the first rule that holds: extension, size, directory, name."""
    ext, size = F.col("extension"), F.col("size")
    over = F.concat(F.lit("size: "), F.format_string("%.1f", size / F.lit(float(_MB))), F.lit(f"MB > {config.max_bytes // _MB}MB"))
    under = F.concat(F.lit("size: "), size.cast("string"), F.lit(f" bytes < {config.min_bytes} min"))
    rules = [F.when(ext.isin(*config.extensions, *config.custom_extensions), F.concat(F.lit("extension: "), ext)), F.when(size > config.max_bytes, over), F.when(size < config.min_bytes, under)]
    path = F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    for g in (*config.globs, *config.custom_globs):
        middle = g[1:-1] if g.startswith("*/") and g.endswith("/*") and "*" not in g[1:-1] else None
        rules.append(F.when(F.contains(path, F.lit(middle)) if middle else path.rlike(paths.glob_regex(g)), f"path pattern: {g}"))
    rules += [F.when(F.col("name").rlike(r), f"filename pattern: {r}") for r in config.names]
    return F.coalesce(*rules)


def scannable(config: Exclusions = Exclusions()) -> Column:
    return F.col("extension").isin(*config.scannable) & (F.col("size") <= config.max_scan_bytes)


def representatives(files: DataFrame) -> DataFrame:
    """One file of each group of equal volume, size and extension, the most sensitive zone first; with the size of its group.

    A group is aggregated where its rows are, so a large one (all empty files of
    an extension) meets in no task.
    """
    rank = F.when(F.col("zone") == "sensitive", 0).when(F.col("zone") == "archive", 2).otherwise(1)
    keys = ["volume_root", "size", "extension"]
    rest = [c for c in files.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(rank, F.col("path_hash")))
    rows = files.groupBy(*keys).agg(best.alias("_best"), F.count("*").alias("group_size"))
    return rows.select(*[F.col(f"_best.{c}").alias(c) if c in rest else F.col(c) for c in files.columns], "group_size")


def dedup_stats(files: DataFrame) -> DataFrame:
    groups = F.count_distinct(F.struct("volume_root", "size", "extension"))
    return files.agg(F.count("*").alias("files"), groups.alias("groups")).withColumn("reduction", F.round(1 - F.col("groups") / F.col("files"), 6))


def snapshot_diff(current: DataFrame, previous: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """path_hash, status (new, modified, unchanged, deleted), and what an unchanged file carries over."""
    c, p = current.alias("c"), previous.alias("p")
    changed = (F.col("c.size") != F.col("p.size")) | (F.abs(F.col("c.mtime") - F.col("p.mtime")) > tolerance)
    status = F.when(F.col("p.path_hash").isNull(), "new").when(F.col("c.path_hash").isNull(), "deleted").when(changed, "modified").otherwise("unchanged")
    rows = c.join(p, F.col("c.path_hash") == F.col("p.path_hash"), "full_outer").withColumn("status", status)
    return rows.select(F.coalesce("c.path_hash", "p.path_hash").alias("path_hash"), "status", F.when(F.col("status") == "unchanged", F.col("p.previous_pii")).alias("previous_pii"))


RATES = {"sensitive": 100, "normal": 30, "archive": 15}
RECENT_DAYS, RECENT_BOOST, EXTENSION_BOOST = 60, 50, 20


def sample_rate(as_of: float) -> Column:
    """The rate in percent; as_of is the epoch second that counts as now."""
    base = F.when(F.col("zone") == "sensitive", RATES["sensitive"]).when(F.col("zone") == "archive", RATES["archive"]).otherwise(RATES["normal"])
    recent = F.when(F.col("mtime") > as_of - RECENT_DAYS * 86400, RECENT_BOOST).otherwise(0)
    known = F.when(F.col("extension").isin(*paths.SENSITIVE_EXTENSIONS), EXTENSION_BOOST).otherwise(0)
    return F.least(F.lit(100), base + recent + known)


def bucket(key: Column) -> Column:
    """A number from 0 to 2**32 - 1 that depends on the key only, in place of a random draw."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def sample(files: DataFrame, as_of: float, floor_share: int = 10, floor: int = 1000) -> DataFrame:
    """Adds rate and selected: drawn by rate, and topped up in hash order to the floor, the larger of a share and a number of files.

    The rank within the top-up is found by ranges of the hash, so no task holds
    all files: counts of 4,096 ranges give where each range begins. Rows that
    repeat a path are selected together.
    """
    rows = files.withColumns({"rate": sample_rate(as_of), "_b": bucket(F.col("path_hash"))})
    rows = rows.withColumn("_drawn", F.col("_b") * 100 < F.col("rate") * F.lit(4294967296))
    need = rows.agg(F.greatest(F.expr(f"count(*) * {floor_share} div 100"), F.lit(floor)).alias("least"), F.count_if("_drawn").alias("drawn")).select(F.greatest(F.col("least") - F.col("drawn"), F.lit(0)).alias("_need"))
    rest = rows.where("not _drawn").select("path_hash", "_b", F.shiftright("_b", 20).alias("_r"))
    before = rest.groupBy("_r").agg(F.count("*").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_r").orderBy("_b", "path_hash"))
    top = rest.withColumn("_place", place).join(F.broadcast(before.select("_r", "_before")), "_r").crossJoin(F.broadcast(need)).where("_place + _before <= _need").select("path_hash", F.lit(True).alias("_topped")).distinct()
    return rows.join(top, "path_hash", "left").withColumn("selected", F.col("_drawn") | F.coalesce("_topped", F.lit(False))).drop("_b", "_drawn", "_topped")


ZONE_MINIMUM = {"sensitive": 500, "normal": 5000, "archive": 500}


def sampling_audit(sampled: DataFrame) -> DataFrame:
    """zone, total, selected, rate and whether the zone's minimum is met."""
    least = F.when(F.col("zone") == "normal", ZONE_MINIMUM["normal"]).otherwise(ZONE_MINIMUM["sensitive"])
    rows = sampled.groupBy("zone").agg(F.count("*").alias("total"), F.count_if("selected").alias("n_selected"))
    return rows.withColumns({"rate": F.round(100.0 * F.col("n_selected") / F.col("total"), 2), "minimum_met": F.col("n_selected") >= least})


def summary(files: DataFrame) -> DataFrame:
    """One row over an inventory with exclusion_reason and pii_detected."""
    kept = F.col("exclusion_reason").isNull()
    return files.agg(
        F.count_if(kept).alias("total_files"),
        F.coalesce(F.sum(F.when(kept, F.col("size"))), F.lit(0)).alias("total_size_bytes"),
        F.count_if(kept & F.col("pii_detected")).alias("files_with_pii"),
        F.count_if(~kept).alias("excluded_count"),
    )


def top_extensions(files: DataFrame, n: int = 10) -> DataFrame:
    return files.groupBy("extension").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "extension").limit(n)


def fingerprint_stats(files: DataFrame) -> DataFrame:
    zones = [F.count_if(F.col("zone") == z).alias(f"{z}_files") for z in ("sensitive", "normal", "archive")]
    return files.agg(F.count("*").alias("total"), *zones, F.round(F.sum("size") / F.lit(float(_MB)), 2).alias("total_size_mb"))


def folders(files: DataFrame, config: Exclusions = Exclusions()) -> DataFrame:
    """Each directory with the number of its own files and whether it is skipped by default."""
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    rows = files.groupBy(parent.alias("folder")).agg(F.count("*").alias("files"))
    return rows.withColumn("default_excluded", paths.name(F.col("folder")).isin(*config.skip_dirs))


def mount_of(files: DataFrame, mounts: DataFrame) -> DataFrame:
    """Each distinct path with the longest mount point that begins it, by an equi-join on the path's own prefixes; null where none does."""
    cuts = F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1)
    prefixes = F.transform(cuts, lambda i: F.when((i == 0) & F.startswith("path", F.lit("/")), F.lit("/")).otherwise(F.array_join(F.slice(F.split("path", "/"), F.lit(1), i + 1), "/")))
    rows = files.select("path").distinct().select("path", F.explode(F.array_distinct(prefixes)).alias("mount_point")).join(mounts.withColumn("_there", F.lit(True)), "mount_point", "left")
    longest = F.max_by(F.when(F.col("_there"), F.struct("mount_point", "fs_type")), F.when(F.col("_there"), F.length("mount_point")))
    return rows.groupBy("path").agg(longest.alias("m")).select("path", "m.mount_point", "m.fs_type")


NETWORK_FS = tuple(sorted("9p afs afpfs ceph cifs davfs fuse.cephfs fuse.davfs2 fuse.glusterfs fuse.rclone fuse.s3fs fuse.sshfs glusterfs lustre ncpfs nfs nfs4 smb2 smb3 smbfs".split()))


def mountinfo(lines: DataFrame, line: str = "line") -> DataFrame:
    """mount_point and fs_type of the lines of a mount table; octal escapes for blanks are resolved."""
    point = F.regexp_extract(line, r"^\d+ \d+ \d+:\d+ \S+ (\S+) ", 1)
    kind = F.regexp_extract(line, r" - (\S+) ", 1)
    return lines.select(F.replace(F.replace(point, F.lit("\\040"), F.lit(" ")), F.lit("\\011"), F.lit("\t")).alias("mount_point"), kind.alias("fs_type")).where("mount_point != '' and fs_type != ''")


def on_network(files: DataFrame, mounts: DataFrame, kinds: tuple[str, ...] = NETWORK_FS) -> DataFrame:
    """path and is_network: whether any mount of a network file system begins the path."""
    found = mount_of(files, mounts.where(F.col("fs_type").isin(*kinds)))
    return found.select("path", F.col("mount_point").isNotNull().alias("is_network"))
