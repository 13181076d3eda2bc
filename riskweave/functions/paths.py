"""Columns over file paths: hash, zone, volume, name, extension, depth, and exclusion patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SENSITIVE_WORDS = tuple("clients confidential confidentiel contracts contrats customer customers finance hr juridique legal paie personnel private prive rh salaire salaires wages".split())
ARCHIVE_WORDS = tuple("archive archives backup backups cache historique history old temp tmp trash".split())
#: Components that the native collector leaves out before it looks for zones.
SYSTEM_WORDS = ("private", "var", "tmp", "usr", "opt", "home", "users")
SENSITIVE_EXTENSIONS = tuple(sorted(".csv .db .doc .docx .json .pdf .sql .sqlite .txt .xls .xlsx .xml".split()))


def path_hash(path: Column) -> Column:
    return F.sha2(path, 256)


def name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def extension(path: Column) -> Column:
    """The lower-cased last suffix of the name with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def fingerprint_extension(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "", F.lit(".no_ext")).otherwise(ext)


def depth(path: Column) -> Column:
    """Directories above the file, below the root."""
    return F.size(F.filter(F.split(path, "/"), lambda x: x != "")) - 1


def zone(path: Column, ignore: tuple[str, ...] = ()) -> Column:
    """sensitive, archive or normal, by whole components of the path; sensitive wins."""
    parts = F.split(F.lower(path), "/")
    if ignore:
        parts = F.array_except(parts, F.array(*map(F.lit, ignore)))
    has = lambda words: F.arrays_overlap(parts, F.array(*map(F.lit, words)))
    return F.when(has(SENSITIVE_WORDS), "sensitive").when(has(ARCHIVE_WORDS), "archive").otherwise("normal")


def volume_root(path: Column) -> Column:
    """Drive letter; what is mounted below mnt, media or volumes; else the first directory."""
    part = lambda i: F.get(F.split(path, "/"), F.lit(i))
    filled = lambda c: F.when(c != "", c)
    absolute = F.when(part(1).isin("media", "mnt", "volumes"), F.coalesce(filled(part(2)), part(1))).otherwise(F.coalesce(filled(part(1)), F.lit("root")))
    relative = F.coalesce(filled(part(1)), part(0))
    return F.when(path == "", "unknown").when(path.rlike("^[A-Za-z]:"), F.substring(path, 1, 2)).when(F.startswith(path, F.lit("/")), absolute).otherwise(relative)


def glob_regex(pattern: str) -> str:
    """A shell pattern as a regular expression for the whole path; * crosses separators."""
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", pattern.replace("\\", "/")))
    return f"(?s)^{out}$"


def parse_mtime(value: Column) -> Column:
    """Epoch seconds of a number or an ISO time; 0 for anything else."""
    return F.coalesce(value.try_cast("double"), F.unix_timestamp(F.try_to_timestamp(value)).cast("double"), F.lit(0.0))
