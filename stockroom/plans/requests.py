"""Requests and reports as JSON: camel-case keys, defaults, and errors for what is not known."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BUDGETS
from . import commands

# Commands and the fields of their requests.
COMMANDS = {
    "scan_path": ("root", "regex", "min_size_bytes", "max_files", "analyze_duplicates", "hash_budget"),
    "search_path": ("root", "regex", "min_size_bytes", "max_files"),
    "compare_folders": ("reference_root", "candidate_root", "max_files"),
    "refresh_index": ("base", "root", "max_files"),
    "search_index": ("base", "root", "regex", "min_size_bytes"),
    "browse_index_tree": ("base", "root", "parent_path", "after", "limit", "generation"),
    "list_indexed_scopes": ("base",),
}
_TYPED = "root string, regex string, minSizeBytes long, maxFiles long, analyzeDuplicates boolean, hashBudget string"


def _snake(name: str) -> str:
    return re.sub("[A-Z]", lambda m: "_" + m[0].lower(), name)


def decode(command: str, request: str) -> dict:
    """Arguments of a command from a JSON object. ValueError for an unknown command or field, or no object; absent and null fields keep their defaults."""
    if command not in COMMANDS:
        raise ValueError(f"unknown command {command}")
    try:
        given = json.loads(request)
    except json.JSONDecodeError as e:
        raise ValueError(f"malformed request: {e}") from None
    if not isinstance(given, dict):
        raise ValueError("a request is an object")
    fields = {_snake(k): v for k, v in given.items() if v is not None}
    if unknown := set(fields) - set(COMMANDS[command]):
        raise ValueError(f"unknown fields {sorted(unknown)}")
    return fields


def run(spark: SparkSession, command: str, request: str) -> str:
    """The report of a command, as JSON."""
    return json.dumps(getattr(commands, command)(spark, **decode(command, request)), ensure_ascii=False)


def decoded(lines: DataFrame, column: str = "value", keep: list[str] = ()) -> DataFrame:
    """Scan requests in bulk: root, regex, min_size_bytes (0 if absent), max_files, analyze_duplicates (true if absent), hash_budget (standard if absent) and
    problem: `malformed`, `root` (none), `budget` (an unknown one); null if the request can run. The columns `keep` stay as they are."""
    r = lines.select(*keep, F.from_json(column, _TYPED).alias("r"), F.try_parse_json(column).isNull().alias("bad")).select(*keep, "r.*", "bad")
    known = [b for b in BUDGETS if b]
    problem = F.when(F.col("bad"), "malformed").when(F.col("root").isNull(), "root").when(~F.coalesce("hashBudget", F.lit("standard")).isin(known), "budget")
    return r.select(*keep, "root", "regex", F.coalesce("minSizeBytes", F.lit(0)).cast("long").alias("min_size_bytes"), F.col("maxFiles").alias("max_files"), F.coalesce("analyzeDuplicates", F.lit(True)).alias("analyze_duplicates"), F.coalesce("hashBudget", F.lit("standard")).alias("hash_budget"), problem.alias("problem"))


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON objects with camel-case keys, in column `value`."""
    return rows.select(F.to_json(F.struct(*(F.col(c).alias(commands._camel(c)) for c in rows.columns)), {"ignoreNullFields": "false"}).alias("value"))
