"""Configuration files of an audit: JSON, or YAML where a parser for it is installed."""

from __future__ import annotations

import dataclasses
import json
import os

from ..operators.files import Exclusions

#: Sections and names of a file, and the fields that they set.
FIELDS = {
    ("exclusions", "extensions"): "extensions", ("exclusions", "directories"): "globs", ("exclusions", "filename_patterns"): "names", ("exclusions", "max_file_size_mb"): "max_bytes", ("exclusions", "min_file_size_bytes"): "min_bytes",
    ("custom", "extensions"): "custom_extensions", ("custom", "paths"): "custom_globs", ("pii", "scannable_extensions"): "scannable", ("pii", "max_file_size_mb"): "max_scan_bytes",
}


def read(path: str) -> dict:
    """The content of a configuration file; empty where there is no file."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as x:
            raise RuntimeError("reading YAML needs a YAML parser; give the configuration as JSON") from x
        return yaml.safe_load(text) or {}
    return json.loads(text or "{}")


def exclusions(path: str) -> Exclusions:
    """The exclusions of a file; what it doesn't name keeps its default."""
    found, changes = read(path), {}
    for (section, name), field in FIELDS.items():
        value = (found.get(section) or {}).get(name)
        if value is None:
            continue
        if name.endswith("_mb"):
            value = int(float(value) * 1024 * 1024)
        elif isinstance(value, list):
            value = tuple(str(v).lower() if field in ("extensions", "custom_extensions", "scannable") else str(v) for v in value)
        changes[field] = value
    return dataclasses.replace(Exclusions(), **changes)
