"""Snapshot scans: hash partitions, keyset pages, cursors and task manifests."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_TASKS = 256


def loads(df: DataFrame) -> DataFrame:
    """A snapshot as change rows."""
    return df.withColumn("op", F.lit("load"))


def hash_partition(col: Column, n: int) -> Column:
    """Partition 0..n-1 of a value; nulls have one of their own value."""
    return F.pmod(F.hash(F.coalesce(col.cast("string"), F.lit("<null>"))), F.lit(n)).cast("long")


def jdbc_predicates(column: str, n: int) -> list[str]:
    """Disjoint and complete predicates for a parallel JDBC scan of PostgreSQL."""
    return [f"mod(mod(hashtext(coalesce({column}::text, '<null>')), {n}) + {n}, {n}) = {i}" for i in range(n)]


def after(keys: list[str], cursor: list, inclusive: bool) -> Column:
    """keys > cursor (or >=) lexicographically, written out: struct comparison would sort nulls."""
    out = F.lit(inclusive)
    for k, v in reversed(list(zip(keys, cursor, strict=True))):
        out = (F.col(k) > F.lit(v)) | ((F.col(k) == F.lit(v)) & out)
    return out


def resume(df: DataFrame, part: str, keys: list[str], cursor: tuple | None) -> DataFrame:
    """Rows from the cursor (partition value, key values) on, itself included; partitions ascend, null last."""
    order = [F.col(part).asc_nulls_last(), *keys]
    if cursor is None:
        return df.orderBy(*order)
    value, key = cursor
    if value is None:
        return df.where(F.col(part).isNull() & after(keys, key, True)).orderBy(*order)
    return df.where((F.col(part) > F.lit(value)) | F.col(part).isNull() | ((F.col(part) == F.lit(value)) & after(keys, key, True))).orderBy(*order)


def page(df: DataFrame, keys: list[str], cursor: list | None, n: int) -> DataFrame:
    """The next n rows after the cursor, itself excluded."""
    return (df.where(after(keys, cursor, False)) if cursor is not None else df).orderBy(*keys).limit(n)


def encode_cursor(part: object, keys: list) -> str:
    text = json.dumps({"v": 1, "null": part is None, "part": part, "keys": keys}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(text: str) -> tuple:
    """(partition value, keys); a plain old cursor is a partition value without keys."""
    try:
        got = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
        if got["v"] != 1:
            raise ValueError(f"cursor version {got['v']}")
        return (None if got["null"] else got["part"]), got["keys"]
    except (json.JSONDecodeError, UnicodeDecodeError, TypeError, KeyError, base64.binascii.Error):
        return text, []


def manifest(tasks: list[dict]) -> tuple[str, list[dict]]:
    """(id, tasks sorted by relation and task); the id is the digest of their canonical JSON."""
    if len(tasks) > MOST_TASKS:
        raise ValueError(f"at most {MOST_TASKS} tasks")
    tasks = sorted(tasks, key=lambda t: (t["relation"], t["task"]))
    return hashlib.sha256(json.dumps(tasks, sort_keys=True, separators=(",", ":")).encode()).hexdigest(), tasks


def discover(spark: SparkSession, database: str) -> list[str]:
    """Base tables of a database, sorted."""
    return sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary and t.tableType != "VIEW")


def unfinished(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """Tasks without a done state."""
    return tasks.join(states.where("state = 'done'").select("task"), "task", "left_anti")
