"""Tables of a catalog: their schemas, changes seen by polling, and fields matched by stable identity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from changeweave.functions.scratch import forget, written
from changeweave.operators.evolve import Change, Kind, diff


def schema_of(spark: SparkSession, table: str, publish: list[str] | None = None) -> StructType:
    """The table's schema, restricted to the published columns."""
    s = spark.table(table).schema
    return StructType([f for f in s if publish is None or f.name in publish])


def published(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """The published columns only; the scan reads no others."""
    return df if columns is None else df.select(*[c for c in df.columns if c in columns])


def include(relations: list[tuple[str, str, str]], schemas: list[str] | None = None, tables: list[str] | None = None) -> list[tuple[str, str]]:
    """(schema, table) of the relations (schema, table, kind) that a snapshot takes: base tables of the listed schemas or tables.

    A partitioned parent that is asked for by name is refused.
    """
    out = []
    for schema, table, kind in sorted(relations):
        named = tables is not None and f"{schema}.{table}" in tables
        if not (named or (tables is None and (schemas is None or schema in schemas))):
            continue
        if kind == "partitioned":
            if named:
                raise ValueError(f"{schema}.{table} is partitioned")
            continue
        if kind == "table":
            out.append((schema, table))
    return out


@dataclass
class Poller:
    """Schemas by poll: every change makes a new version and a plan, pending or approved at once."""

    auto_approve: bool = False

    def __post_init__(self) -> None:
        self.last: dict[str, tuple[int, StructType]] = {}

    def poll(self, schemas: dict[str, StructType]) -> list[tuple[str, int, str, list[Change]]]:
        """(table, version, state, plan) of the tables that changed since the last poll."""
        out = []
        for table, schema in sorted(schemas.items()):
            version, old = self.last.get(table, (0, None))
            plan = [Change(Kind.CREATE_TABLE, table, columns=tuple((f.name, f.dataType.simpleString()) for f in schema))] if old is None else diff(table, old, schema)
            if plan:
                self.last[table] = (version + 1, schema)
                out.append((table, version + 1, "approved" if self.auto_approve else "pending", plan))
        for table in sorted(set(self.last) - set(schemas)):
            version, _ = self.last.pop(table)
            out.append((table, version + 1, "approved" if self.auto_approve else "pending", [Change(Kind.DROP_TABLE, table)]))
        return out


def match_fields(current: dict[int, StructField], desired: dict[int, StructField]) -> list[Change]:
    """Changes between two sets of fields by stable id: a field of another name is renamed, never dropped and added."""
    out = []
    for i, f in sorted(desired.items()):
        if i not in current:
            out.append(Change(Kind.ADD_COLUMN, "", f.name, type=f.dataType.simpleString(), nullable=f.nullable))
            continue
        if current[i].name != f.name:
            out.append(Change(Kind.RENAME_COLUMN, "", current[i].name, to=f.name))
        if current[i].dataType != f.dataType:
            out.append(Change(Kind.ALTER_TYPE, "", f.name, type=f.dataType.simpleString()))
    return out + [Change(Kind.DROP_COLUMN, "", current[i].name) for i in sorted(set(current) - set(desired))]


def index_signatures(columns: DataFrame, index: str) -> DataFrame:
    """Per index its columns in order, joined, and whether it is unique. columns: index, column, ordinal, is_unique."""
    ordered = F.array_sort(F.collect_set(F.struct("ordinal", "column")))
    return columns.groupBy(index).agg(F.array_join(F.transform(ordered, lambda c: c["column"]), ",").alias("columns"), F.bool_or("is_unique").alias("is_unique"))


def index_columns(indexes: DataFrame, index: str, columns: str) -> DataFrame:
    """One row per key column of every index, with its place from 0."""
    return indexes.select(index, F.posexplode(columns).alias("ordinal", "column"))


def type_chain(types: DataFrame, name: str, base: str) -> DataFrame:
    """(name, node): every type and what it is based on, down to the end, each once; a cycle ends where it closes.

    Jumps double from round to round on written tables, so a chain of n types takes log2(n) rounds.
    """
    met = written(types.select(F.col(name), F.col(name).alias("node")).union(types.where(F.col(base).isNotNull()).select(name, F.col(base))).distinct())
    n = met.count()
    while True:
        further = written(met.union(met.alias("a").join(met.select(F.col(name).alias("node"), F.col("node").alias("further")), "node").select(name, "further")).distinct())
        forget(met)
        met, grown = further, further.count()
        if grown == n:
            return met
        n = grown
