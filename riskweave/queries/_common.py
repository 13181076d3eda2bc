"""Helpers of the query modules: tables, frames derived from them in both engines, and SQL spelling."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Derived:
    """A frame derived from tables of the folder by one statement, which both engines run alike."""

    def __init__(self, text: str):
        self.text = " ".join(text.split())
        self.sql = f"({self.text})"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        found: dict[str, DataFrame] = {}

        def name(m: re.Match) -> str:
            found.setdefault(m[2], table(spark, sf_dir, m[2]))
            return f"{m[1]} {{{m[2]}}}"

        text = re.sub(rf"\b(from|join) ({'|'.join(TABLES)})\b", name, self.text)
        return spark.sql(text, **found)
