"""Declarative table mappings: which tables and columns a target gets, under which names, appended or upserted.

The mapping is compiled on the driver into select lists; rows never see it.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns that an append target gets beside its own.
APPEND_COLUMNS = ("_op", "_deleted", "_pos")
#: Columns of the envelope.
ENVELOPE = ("_op", "_ts", "_version", "_table", "_namespace", "_key", "_before")


class MappingError(ValueError):
    """The mapping is not valid, or does not fit the schema."""


_PLACE = re.compile(r"\{\{\s*\.(Schema|Table|Column)\s*\}\}")


@dataclass(frozen=True)
class Template:
    """A name pattern with exactly one of {{ .Schema }}, {{ .Table }}, {{ .Column }}: prefix, variable, suffix."""

    prefix: str
    variable: str
    suffix: str

    @classmethod
    def parse(cls, text: str) -> Template:
        found = _PLACE.findall(text)
        rest = _PLACE.sub("", text)
        if len(found) != 1 or "{{" in rest or "}}" in rest:
            raise MappingError(f"template {text!r} needs exactly one placeholder")
        m = _PLACE.search(text)
        return cls(text[: m.start()], m.group(1), text[m.end() :])

    def apply(self, name: str) -> str:
        return f"{self.prefix}{name}{self.suffix}"

    def inverse(self, target: str) -> str | None:
        """The one name that gives the target, or None."""
        inner = target[len(self.prefix) : len(target) - len(self.suffix)]
        return inner if inner and self.apply(inner) == target else None


@dataclass(frozen=True)
class WritePolicy:
    mode: str = "append"
    keys: tuple[str, ...] = ()
    watermark: str | None = None


@dataclass(frozen=True)
class TableMapping:
    schema: str
    table: str
    target_schema: str | None = None
    target_table: str | None = None
    include: bool = True
    columns: dict[str, str | None] = field(default_factory=dict)  # source -> target; None excludes
    future_columns: str | None = "{{ .Column }}"  # template for unlisted columns; None excludes them
    policy: WritePolicy = WritePolicy()

    def target_of(self, column: str) -> str | None:
        if column in self.columns:
            return self.columns[column]
        return Template.parse(self.future_columns).apply(column) if self.future_columns else None


@dataclass(frozen=True)
class Mappings:
    tables: tuple[TableMapping, ...]
    future_tables: str | None = None  # template for unlisted tables; None excludes them
    future_policy: WritePolicy = WritePolicy()

    def find(self, schema: str, table: str) -> TableMapping | None:
        for t in self.tables:
            if (t.schema, t.table) == (schema, table):
                return t if t.include else None
        if self.future_tables is None:
            return None
        return TableMapping(schema, table, target_table=Template.parse(self.future_tables).apply(table), policy=self.future_policy)


def validate(m: Mappings) -> None:
    """No source or target twice, no column target that a future rule can also give, and policies that make sense."""
    sources = [(t.schema, t.table) for t in m.tables]
    targets = [(t.target_schema or t.schema, t.target_table or t.table) for t in m.tables if t.include]
    for what, names in (("source", sources), ("target", targets)):
        if len(set(names)) != len(names):
            raise MappingError(f"a {what} table appears twice")
    if m.future_tables:
        rule = Template.parse(m.future_tables)
        for t in m.tables:
            clash = rule.inverse(t.target_table or t.table)
            if t.include and clash and (t.schema, clash) not in sources:
                raise MappingError(f"future table {clash} would also be written to {t.target_table or t.table}")
    for t in m.tables:
        named = [c for c in t.columns.values() if c is not None]
        if len(set(named)) != len(named):
            raise MappingError(f"{t.table}: two columns have one target")
        if t.future_columns:
            rule = Template.parse(t.future_columns)
            for source, target in t.columns.items():
                clash = rule.inverse(target) if target else None
                if clash and clash not in t.columns and clash != source:
                    raise MappingError(f"{t.table}: future column {clash} would also be written to {target}")
        check_policy(t.policy, t.table)


def check_policy(p: WritePolicy, table: str) -> None:
    if p.mode not in ("append", "upsert"):
        raise MappingError(f"{table}: unknown mode {p.mode}")
    if p.mode == "append" and (p.keys or p.watermark):
        raise MappingError(f"{table}: append takes no keys and no watermark")
    if p.mode == "upsert" and not p.keys:
        raise MappingError(f"{table}: upsert needs keys")


def fingerprint(m: Mappings) -> str:
    """SHA-256 of the mapping's canonical JSON: tables in any order give the same."""
    tables = sorted((asdict(t) for t in m.tables), key=lambda t: (t["schema"], t["table"]))
    return hashlib.sha256(json.dumps({"tables": tables, "future": m.future_tables, "policy": asdict(m.future_policy)}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def is_identity(t: TableMapping, schema: StructType) -> bool:
    return t.include and (t.target_table or t.table) == t.table and (t.target_schema or t.schema) == t.schema and all(t.target_of(c) == c for c in schema.names)


def generate(schemas: dict[tuple[str, str], StructType], keys: dict[tuple[str, str], list[str]], watermarks: dict[tuple[str, str], str] | None = None) -> Mappings:
    """The default mapping of a catalog: tables with a primary key are upserted on it, others appended."""
    out = []
    for (schema, table), _ in sorted(schemas.items()):
        k = tuple(keys.get((schema, table), ()))
        w = (watermarks or {}).get((schema, table))
        out.append(TableMapping(schema, table, policy=WritePolicy("upsert", k, w) if k else WritePolicy()))
    return Mappings(tuple(out))


def projection(t: TableMapping, schema: StructType) -> list[tuple[str, str]]:
    """(source, target) of the columns kept. Refuses targets that meet, reserved names, and generated columns whose inputs change."""
    kept = [(c, to) for c in schema.names if (to := t.target_of(c)) is not None]
    names = [to for _, to in kept]
    if len(set(names)) != len(names):
        raise MappingError(f"{t.table}: two columns have one target")
    if t.policy.mode == "append" and (clash := set(names) & set(APPEND_COLUMNS)):
        raise MappingError(f"{t.table}: reserved column name {sorted(clash)[0]}")
    changed = len(kept) != len(schema.names) or any(a != b for a, b in kept)
    if changed and any(f.metadata.get("generated") for f in schema if t.target_of(f.name) is not None):
        raise MappingError(f"{t.table}: a generated column cannot be kept once the shape changes")
    missing = [k for k in t.policy.keys if k not in schema.names or t.target_of(k) is None]
    if missing:
        raise MappingError(f"{t.table}: key column {missing[0]} is not kept")
    if t.policy.watermark and t.policy.watermark not in schema.names:
        raise MappingError(f"{t.table}: no watermark column {t.policy.watermark}")
    return kept


def project(df: DataFrame, t: TableMapping) -> DataFrame:
    """Renamed and pruned to what the target gets; Catalyst carries the pruning into the scan."""
    return df.select(*[F.col(f"`{a}`").alias(b) for a, b in projection(t, df.schema)])


def project_image(image: Column, t: TableMapping, schema: StructType) -> Column:
    """The same for a before or after image held in a struct; a null image stays null."""
    return F.when(image.isNotNull(), F.struct(*[image[a].alias(b) for a, b in projection(t, schema)]))


def project_unchanged(names: Column, t: TableMapping, schema: StructType) -> Column:
    """A list of column names renamed; names of excluded columns go."""
    to = F.create_map(*[F.lit(x) for pair in projection(t, schema) for x in pair])
    return F.filter(F.transform(names, lambda n: to[n]), lambda n: n.isNotNull())


def keep_tables(df: DataFrame, m: Mappings, schema_col: str = "schema", table_col: str = "tbl") -> DataFrame:
    """Rows of included tables: listed ones by their rule, all others by the future rule."""
    key = F.struct(F.col(schema_col), F.col(table_col))
    listed = [F.struct(F.lit(t.schema), F.lit(t.table)) for t in m.tables]
    included = [F.struct(F.lit(t.schema), F.lit(t.table)) for t in m.tables if t.include]
    keep = key.isin(*included) if included else F.lit(False)
    if m.future_tables is not None:
        keep = keep | ~(key.isin(*listed) if listed else F.lit(False))
    return df.where(keep)


def append_rows(df: DataFrame, columns: list[str], op: str = "op", pos: str = "pos", before: str = "before_") -> DataFrame:
    """Every change as an insert with its operation, deleted flag and position; a delete shows its before image."""
    image = [F.when(F.col(op) == "delete", F.col(f"{before}{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return df.select(*image, F.col(op).alias("_op"), (F.col(op) == "delete").alias("_deleted"), F.col(pos).alias("_pos"))


def resolved_key(after: Column, before: Column, key: Column) -> Column:
    return F.coalesce(after, before, key)


def envelope(df: DataFrame, columns: list[str], table: str, namespace: str, key: Column, before: Column, op: str = "op", ts: str = "ts", version: int = 1) -> DataFrame:
    """The wire envelope: metadata columns, then the row's; a delete carries no after image."""
    if clash := set(columns) & set(ENVELOPE):
        raise MappingError(f"column {sorted(clash)[0]} collides with the envelope")
    meta = [F.col(op).alias("_op"), F.col(ts).alias("_ts"), F.lit(version).cast("long").alias("_version"), F.lit(table).alias("_table"), F.lit(namespace).alias("_namespace"), key.alias("_key"), before.alias("_before")]
    return df.select(*meta, *[F.when(F.col(op) != "delete", F.col(c)).alias(c) for c in columns])


def renumbered(df: DataFrame, txn: str, fragment: str, keep: Column) -> DataFrame:
    """Fragments left after a filter, numbered 0..n-1 in each transaction."""
    from pyspark.sql import Window

    return df.where(keep).withColumn(fragment, (F.dense_rank().over(Window.partitionBy(txn).orderBy(fragment)) - 1).cast("long"))


def parse_type_rules(rules: dict[str, str]) -> dict[str, str]:
    """Keys without case and surplus blanks."""
    return {" ".join(k.lower().split()): v for k, v in rules.items()}


def merge_type_rules(base: dict[str, str], override: dict[str, str]) -> dict[str, str]:
    return parse_type_rules(base) | parse_type_rules(override)


def mapped_type(source: str, rules: dict[str, str]) -> str:
    """The target type by the most specific rule: the whole type, without modifiers, its array form, without schema."""
    full = " ".join(source.lower().split())
    bare = re.sub(r"\s*\([^)]*\)", "", full).strip()
    array = bare.endswith("[]") or bare.startswith("_")
    element = bare.removesuffix("[]").removeprefix("_")
    last = element.rpartition(".")[2]
    candidates = [full, bare, *([f"{element}[]", f"{last}[]"] if array else [element, last])]
    for c in candidates:
        if c in rules:
            return rules[c]
    return f"array<{rules[last]}>" if array and last in rules else source


# Source type names and the Spark types that hold their values.
SPARK_TYPES = {
    "bool": "boolean", "boolean": "boolean", "int2": "smallint", "smallint": "smallint", "int4": "int", "integer": "int", "serial": "int",
    "int8": "bigint", "bigint": "bigint", "bigserial": "bigint", "float4": "float", "real": "float", "float8": "double", "double precision": "double",
    "numeric": "decimal(38,9)", "decimal": "decimal(38,9)", "money": "decimal(38,9)", "text": "string", "varchar": "string", "char": "string", "bpchar": "string",
    "character varying": "string", "uuid": "string", "bytea": "binary", "json": "string", "jsonb": "string", "timestamp": "timestamp_ntz", "timestamptz": "timestamp",
    "timestamp without time zone": "timestamp_ntz", "timestamp with time zone": "timestamp", "date": "date", "time": "string", "timetz": "string", "interval": "string",
    "inet": "string", "cidr": "string", "hstore": "map<string,string>", "vector": "array<float>", "geometry": "binary", "geography": "binary",
}


def spark_type(source: str) -> str:
    """The Spark type of a source type name; NUMERIC(p,s) keeps its precision; an unknown extension type is binary."""
    m = re.match(r"^\s*(?:numeric|decimal)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)", source, re.I)
    if m and int(m.group(1)) <= 38:
        return f"decimal({m.group(1)},{m.group(2) or 0})"
    to = mapped_type(source, SPARK_TYPES)
    return to if to != source or source in SPARK_TYPES.values() else "binary" if "." in source else "string"


#: Spellings of one source type.
ALIASES = {
    "boolean": "bool", "smallint": "int2", "int": "int4", "integer": "int4", "serial": "int4", "bigint": "int8", "bigserial": "int8", "real": "float4", "double precision": "float8",
    "decimal": "numeric", "money": "numeric", "character varying": "varchar", "character": "varchar", "bpchar": "varchar", "char": "varchar", "jsonb": "json", "timetz": "time",
    "timestamp without time zone": "timestamp", "timestamp with time zone": "timestamptz",
}
# The types of the targets for each source type: ClickHouse, DuckDB, Snowflake.
TARGET_TYPES = {
    "bool": ("UInt8", "BOOLEAN", "BOOLEAN"),
    "int2": ("Int16", "SMALLINT", "SMALLINT"),
    "int4": ("Int32", "INTEGER", "INTEGER"),
    "int8": ("Int64", "BIGINT", "BIGINT"),
    "float4": ("Float32", "REAL", "FLOAT"),
    "float8": ("Float64", "DOUBLE", "DOUBLE"),
    "numeric": ("Decimal", "DECIMAL", "NUMBER"),
    "uuid": ("String", "UUID", "STRING"),
    "text": ("String", "TEXT", "STRING"),
    "varchar": ("String", "VARCHAR", "STRING"),
    "json": ("String", "JSON", "VARIANT"),
    "bytea": ("String", "BLOB", "BINARY"),
    "date": ("Date", "DATE", "DATE"),
    "time": ("String", "TIME", "TIME"),
    "timestamp": ("DateTime64(6)", "TIMESTAMP", "TIMESTAMP_NTZ"),
    "timestamptz": ("DateTime64(6)", "TIMESTAMPTZ", "TIMESTAMP_TZ"),
    "inet": ("String", "VARCHAR", "STRING"),
    "cidr": ("String", "VARCHAR", "STRING"),
    "citext": ("String", "VARCHAR", "STRING"),
    "ltree": ("String", "VARCHAR", "STRING"),
    "hstore": ("String", "JSON", "OBJECT"),
    "vector": ("Array(Float32)", "FLOAT[]", "ARRAY"),
    "geometry": ("String", "VARCHAR", "STRING"),
    "geography": ("String", "VARCHAR", "STRING"),
}
TARGETS = ("clickhouse", "duckdb", "snowflake")


def target_type(source: str, target: str, nullable: bool = False, rules: dict[str, str] | None = None) -> str:
    """The target's type for a source type: by the user's rules first, then by the table; numbers keep their precision.

    Schemas and extension prefixes don't matter to the table. A type that it lacks is text. ClickHouse marks what may be null.
    """
    asked = parse_type_rules(rules) if rules else {}
    made = mapped_type(source, asked)
    if made == source:
        bare = re.sub(r"\s*\([^)]*\)", "", " ".join(source.lower().split())).strip().rpartition(".")[2].removeprefix("ext:")
        column = TARGETS.index(target)
        kind = ALIASES.get(bare, bare)
        made = TARGET_TYPES.get(kind, TARGET_TYPES["text"])[column]
        if kind == "numeric" and (m := re.search(r"\(\s*\d+\s*(?:,\s*\d+\s*)?\)", source)):
            made += re.sub(r"\s", "", m.group())
    return f"Nullable({made})" if nullable and target == "clickhouse" and not made.startswith(("Nullable(", "Array(")) else made


def unkeyed(df: DataFrame, key: Column) -> DataFrame:
    """Rows that an upsert must refuse, since neither image nor record gives their key."""
    return df.where(key.isNull())


def cast_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast by try_cast to their Spark types; what doesn't cast is null."""
    return df.select(*[F.col(c).try_cast(spark_type(types[c])).alias(c) if c in types else F.col(c) for c in df.columns])


def rename_target(t: TableMapping, **changes: object) -> TableMapping:
    return replace(t, **changes)


def record_json(columns: list[str]) -> Column:
    """A record as one JSON object, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def batch_json(df: DataFrame, batch: str, order: str, columns: list[str]) -> DataFrame:
    """Per batch one JSON object with its records in order. A batch is bounded by its transaction."""
    records = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), record_json(columns).alias("r"))))
    body = F.concat(F.lit('{"records":['), F.array_join(F.transform(records, lambda x: x["r"]), ","), F.lit("]}"))
    return df.groupBy(batch).agg(body.alias("body"))
