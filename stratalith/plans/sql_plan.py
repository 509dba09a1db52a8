"""Queries whose plan is one SQL statement, written once for Spark and for the engine it is compared with.

Where the two dialects differ the text has a macro: @explode( makes a row of each
element, @like( matches a regular expression, @sha( is SHA-256 in hex, @micros( the
microseconds from one time to another.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import dealt, table
from .registry import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages")
_SPARK = {"@explode(": "explode(", "@like(": "regexp_like(", "@sha(": "sha(", "@size(": "size(", "@double": "DOUBLE", "@text": "STRING", "@micros(": "timestampdiff(MICROSECOND, "}
_OTHER = {"@explode(": "unnest(", "@like(": "regexp_matches(", "@sha(": "sha256(", "@size(": "len(", "@double": "DOUBLE", "@text": "VARCHAR", "@micros(": "date_diff('microsecond', "}


def in_dialect(sql: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        sql = sql.replace(k, v)
    return sql


def run_sql(spark: SparkSession, sf_dir: str, sql: str, keys: dict[str, str] | None = None) -> DataFrame:
    """Runs a statement over the tables that it names; keys: columns by which tables are dealt out first, so that a task's sorts have a fixed number of rows."""
    text = in_dialect(sql, _SPARK)
    text = re.sub(r"\bsha\(([^()]*)\)", r"sha2(\1, 256)", text)
    for name in TABLES:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
            rows = table(spark, sf_dir, name)
            if keys and name in keys:
                rows = dealt(rows, rows.count(), keys[name], each=250_000)
            rows.createOrReplaceTempView(name)
    return spark.sql(text)


def sql_query(name: str, sql: str, keys: dict[str, str] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_sql(spark, sf_dir, sql, keys)

    query(in_dialect(sql, _OTHER), name)(run)
