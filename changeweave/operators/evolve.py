"""Schema evolution: what changed between two schemas, as a plan, and DDL text read and written."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from changeweave.functions.scalars import quote_identifier
from changeweave.operators.mapping import TARGETS, TableMapping, mapped_type, parse_type_rules, spark_type, target_type


class Kind(Enum):
    CREATE_SCHEMA = "create_schema"
    DROP_SCHEMA = "drop_schema"
    CREATE_TABLE = "create_table"
    DROP_TABLE = "drop_table"
    RENAME_TABLE = "rename_table"
    TRUNCATE = "truncate"
    ADD_COLUMN = "add_column"
    DROP_COLUMN = "drop_column"
    RENAME_COLUMN = "rename_column"
    ALTER_TYPE = "alter_type"
    ALTER_NULLABLE = "alter_nullable"
    ALTER_GENERATED = "alter_generated"
    SET_KEY = "set_key"
    CREATE_INDEX = "create_index"
    DROP_INDEX = "drop_index"
    ALTER_FOREIGN_KEY = "alter_foreign_key"
    ALTER_CONSTRAINTS = "alter_constraints"


@dataclass(frozen=True)
class Change:
    kind: Kind
    table: str
    column: str | None = None
    to: str | None = None
    type: str | None = None
    nullable: bool | None = None
    columns: tuple[tuple[str, str], ...] = ()
    key: tuple[str, ...] = ()


class UnsupportedChange(ValueError):
    """The target can't make this change."""


def diff(table: str, old: StructType, new: StructType) -> list[Change]:
    """Adds, alterations and drops, in the order of the new schema and then of the old. A rename shows as add and drop."""
    was, out = {f.name: f for f in old}, []
    for f in new:
        if f.name not in was:
            out.append(Change(Kind.ADD_COLUMN, table, f.name, type=f.dataType.simpleString(), nullable=f.nullable))
            continue
        out += _altered(table, was[f.name], f, True)
    now = set(new.names)
    return out + [Change(Kind.DROP_COLUMN, table, f.name) for f in old if f.name not in now]


def diff_shape(table: str, old: StructType, new: StructType) -> list[Change]:
    """As ``diff`` for a shape seen on a stream: columns it lacks are not dropped, unknown facts are not compared."""
    was, out = {f.name: f for f in old}, []
    for f in new:
        if f.name in was:
            out += _altered(table, was[f.name], f, f.metadata.get("nullability_known", True))
        else:
            out.append(Change(Kind.ADD_COLUMN, table, f.name, type=f.dataType.simpleString(), nullable=True))
    return out


def _altered(table: str, a: StructField, b: StructField, nullability: bool) -> list[Change]:
    out = []
    if a.dataType != b.dataType:
        out.append(Change(Kind.ALTER_TYPE, table, b.name, type=b.dataType.simpleString()))
    if nullability and a.nullable != b.nullable:
        out.append(Change(Kind.ALTER_NULLABLE, table, b.name, nullable=b.nullable))
    if b.metadata.get("generated_known", True) and a.metadata.get("generated") != b.metadata.get("generated"):
        out.append(Change(Kind.ALTER_GENERATED, table, b.name, to=b.metadata.get("generated")))
    return out


def apply(schema: StructType, changes: list[Change]) -> StructType:
    """The schema after the changes."""
    fields = list(schema)
    from pyspark.sql.types import DataType

    parse = lambda t: StructType.fromDDL(f"c {t}")[0].dataType
    at = lambda name: next(i for i, f in enumerate(fields) if f.name == name)
    for c in changes:
        if c.kind is Kind.ADD_COLUMN:
            t: DataType = parse(c.type)
            fields.append(StructField(c.column, t, c.nullable is not False))
        elif c.kind is Kind.DROP_COLUMN:
            fields.pop(at(c.column))
        else:
            f = fields[at(c.column)]
            if c.kind is Kind.RENAME_COLUMN:
                fields[at(c.column)] = StructField(c.to, f.dataType, f.nullable, f.metadata)
            elif c.kind is Kind.ALTER_TYPE:
                fields[at(c.column)] = StructField(f.name, parse(c.type), f.nullable, f.metadata)
            elif c.kind is Kind.ALTER_NULLABLE:
                fields[at(c.column)] = StructField(f.name, f.dataType, bool(c.nullable), f.metadata)
            elif c.kind is Kind.ALTER_GENERATED:
                fields[at(c.column)] = StructField(f.name, f.dataType, f.nullable, {k: v for k, v in f.metadata.items() if k != "generated"} | ({"generated": c.to} if c.to else {}))
            else:
                raise UnsupportedChange(c.kind.value)
    return StructType(fields)


QUOTES = {"spark": "`", "clickhouse": "`", "postgres": '"', "snowflake": '"', "duckdb": '"'}
_NO_NULLABLE = ("clickhouse",)


def render(c: Change, dialect: str = "spark", types: dict[str, str] | None = None, translate: bool = False) -> str:
    """One statement of the dialect. What it can't say raises. ``translate`` gives warehouse targets their own types."""
    q = QUOTES[dialect]
    name = lambda n: ".".join(quote_identifier(p, q) for p in n.split("."))
    kind = lambda t, null=False: target_type(t, dialect, null, types) if translate and dialect in TARGETS else mapped_type(t, parse_type_rules(types)) if types else spark_type(t) if dialect == "spark" else t
    t, col = name(c.table), quote_identifier(c.column, q) if c.column else ""
    if c.kind is Kind.CREATE_SCHEMA:
        return f"CREATE SCHEMA IF NOT EXISTS {t}"
    if c.kind is Kind.DROP_SCHEMA:
        return f"DROP SCHEMA IF EXISTS {t}"
    if c.kind is Kind.CREATE_TABLE:
        return f"CREATE TABLE IF NOT EXISTS {t} ({', '.join(f'{quote_identifier(n, q)} {kind(k)}' for n, k in c.columns)})"
    if c.kind is Kind.DROP_TABLE:
        return f"DROP TABLE IF EXISTS {t}"
    if c.kind is Kind.RENAME_TABLE:
        return f"RENAME TABLE {t} TO {name(c.to)}" if dialect == "clickhouse" else f"ALTER TABLE {t} RENAME TO {name(c.to)}"
    if c.kind is Kind.TRUNCATE:
        return f"TRUNCATE TABLE {t}"
    if c.kind is Kind.ADD_COLUMN:
        return f"ALTER TABLE {t} ADD COLUMN {col} {kind(c.type, bool(c.nullable))}"
    if c.kind is Kind.DROP_COLUMN:
        return f"ALTER TABLE {t} DROP COLUMN {col}"
    if c.kind is Kind.RENAME_COLUMN:
        return f"ALTER TABLE {t} RENAME COLUMN {col} TO {quote_identifier(c.to, q)}"
    if c.kind is Kind.ALTER_TYPE:
        verb = {"spark": "ALTER COLUMN {} TYPE {}", "clickhouse": "MODIFY COLUMN {} {}", "postgres": "ALTER COLUMN {} TYPE {}", "snowflake": "ALTER COLUMN {} SET DATA TYPE {}", "duckdb": "ALTER COLUMN {} SET DATA TYPE {}"}[dialect]
        return f"ALTER TABLE {t} " + verb.format(col, kind(c.type))
    if c.kind is Kind.ALTER_NULLABLE and dialect not in _NO_NULLABLE:
        return f"ALTER TABLE {t} ALTER COLUMN {col} {'DROP' if c.nullable else 'SET'} NOT NULL"
    listed = ", ".join(quote_identifier(n, q) for n, _ in c.columns)
    if c.kind is Kind.CREATE_INDEX and dialect in ("postgres", "duckdb"):
        return f"CREATE {'UNIQUE ' if c.type == 'unique' else ''}INDEX {quote_identifier(c.to, q)} ON {t} ({listed})"
    if c.kind is Kind.DROP_INDEX and dialect in ("postgres", "duckdb"):
        return f"DROP INDEX {name(c.to)}"
    if c.kind is Kind.SET_KEY and dialect in ("postgres", "duckdb", "snowflake"):
        return f"ALTER TABLE {t} ADD PRIMARY KEY ({', '.join(quote_identifier(n, q) for n in c.key)})"
    raise UnsupportedChange(f"{dialect} has no {c.kind.value}")


_IDENT = r'(?:"(?:[^"]|"")+"|`(?:[^`]|``)+`|[A-Za-z_][\w$]*)'
_NAME = rf"({_IDENT}(?:\s*\.\s*{_IDENT})*)"


def _plain(name: str) -> str:
    return ".".join(p[1:-1].replace(p[0] * 2, p[0]) if p[0] in "\"`" else p for p in re.findall(_IDENT, name))


def _split(text: str) -> list[str]:
    """At commas outside brackets and quotes."""
    out, depth, mark, at = [], 0, "", 0
    for i, c in enumerate(text):
        if mark:
            mark = "" if c == mark else mark
        elif c in "\"'`":
            mark = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*out, text[at:]] if p.strip()]


def parse(sql: str) -> list[Change]:
    """CREATE, ALTER, RENAME, DROP and TRUNCATE statements as changes; anything else raises."""
    # quoted text stays as it is, comments outside of it go
    s = re.sub(r"""('(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`)|--[^\n]*|/\*.*?\*/""", lambda m: m[1] or " ", sql, flags=re.S).strip().rstrip(";").strip()
    take = lambda pattern: re.match(pattern + r"\s*$", s, re.I | re.S)
    if m := take(rf"CREATE\s+SCHEMA\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}"):
        return [Change(Kind.CREATE_SCHEMA, _plain(m[1]))]
    if m := take(rf"DROP\s+SCHEMA\s+(?:IF\s+EXISTS\s+)?{_NAME}(?:\s+CASCADE|\s+RESTRICT)?"):
        return [Change(Kind.DROP_SCHEMA, _plain(m[1]))]
    if m := take(rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*\((.*)\)"):
        columns, keys = [], []
        for part in _split(m[2]):
            if k := re.match(r"(?:CONSTRAINT\s+\S+\s+)?PRIMARY\s+KEY\s*\((.*)\)\s*$", part, re.I | re.S):
                keys += [_plain(n) for n in _split(k[1])]
                continue
            if re.match(r"(?:PRIMARY|UNIQUE|FOREIGN|CONSTRAINT|CHECK|EXCLUDE)\b", part, re.I):
                continue
            c = re.match(rf"({_IDENT})\s+(.+)$", part, re.S)
            if not c:
                raise UnsupportedChange(part)
            columns.append((_plain(c[1]), _type_of(c[2])))
            if re.search(r"\bPRIMARY\s+KEY\b", c[2], re.I):
                keys.append(_plain(c[1]))
        return [Change(Kind.CREATE_TABLE, _plain(m[1]), columns=tuple(columns), key=tuple(dict.fromkeys(keys)))]
    if m := take(rf"RENAME\s+TABLE\s+{_NAME}\s+TO\s+{_NAME}"):
        return [Change(Kind.RENAME_TABLE, _plain(m[1]), to=_plain(m[2]))]
    if m := take(rf"CREATE\s+(UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+NOT\s+EXISTS\s+)?({_IDENT})\s+ON\s+(?:ONLY\s+)?{_NAME}\s*(?:USING\s+\w+\s*)?\((.*)\)"):
        return [Change(Kind.CREATE_INDEX, _plain(m[3]), to=_plain(m[2]), type="unique" if m[1] else None, columns=tuple((_plain(c), "") for c in _split(m[4])))]
    if m := take(rf"DROP\s+INDEX\s+(?:CONCURRENTLY\s+)?(?:IF\s+EXISTS\s+)?{_NAME}(?:\s+CASCADE|\s+RESTRICT)?"):
        return [Change(Kind.DROP_INDEX, "", to=_plain(m[1]))]
    if m := take(rf"DROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?{_NAME}(?:\s+CASCADE|\s+RESTRICT)?"):
        return [Change(Kind.DROP_TABLE, _plain(m[1]))]
    if m := take(rf"TRUNCATE\s+(?:TABLE\s+)?{_NAME}"):
        return [Change(Kind.TRUNCATE, _plain(m[1]))]
    if m := take(rf"ALTER\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?{_NAME}\s+(.*)"):
        table = _plain(m[1])
        return [_alteration(table, part) for part in _split(m[2])]
    raise UnsupportedChange(sql)


def _type_of(text: str) -> str:
    return re.split(r"\s+(?=(?:NOT\s+NULL|NULL|DEFAULT|PRIMARY|UNIQUE|REFERENCES|CHECK|GENERATED|COLLATE|CONSTRAINT)\b)", text.strip(), maxsplit=1, flags=re.I)[0].strip()


def _alteration(table: str, part: str) -> Change:
    take = lambda pattern: re.match(pattern + r"\s*$", part, re.I | re.S)
    if m := take(rf"RENAME\s+TO\s+{_NAME}"):
        return Change(Kind.RENAME_TABLE, table, to=_plain(m[1]))
    if m := take(rf"RENAME\s+(?:COLUMN\s+)?({_IDENT})\s+TO\s+({_IDENT})"):
        return Change(Kind.RENAME_COLUMN, table, _plain(m[1]), to=_plain(m[2]))
    if m := take(r"ADD\s+(?:CONSTRAINT\s+\S+\s+)?PRIMARY\s+KEY\s*\((.*)\)"):
        return Change(Kind.SET_KEY, table, key=tuple(_plain(n) for n in _split(m[1])))
    if m := take(rf"ADD\s+(?:CONSTRAINT\s+({_IDENT})\s+)?FOREIGN\s+KEY\s*\((.*?)\)\s*REFERENCES\s+{_NAME}.*"):
        return Change(Kind.ALTER_FOREIGN_KEY, table, to=_plain(m[3]), columns=tuple((_plain(n), "") for n in _split(m[2])))
    if m := take(rf"(?:ADD\s+CONSTRAINT\s+({_IDENT})\s+.*|ADD\s+(?:CHECK|UNIQUE)\b.*|DROP\s+CONSTRAINT\s+(?:IF\s+EXISTS\s+)?({_IDENT})(?:\s+CASCADE|\s+RESTRICT)?)"):
        return Change(Kind.ALTER_CONSTRAINTS, table, to=_plain(m[1] or m[2]) if m[1] or m[2] else None)
    if m := take(rf"DROP\s+(?:COLUMN\s+)?(?:IF\s+EXISTS\s+)?({_IDENT})(?:\s+CASCADE|\s+RESTRICT)?"):
        return Change(Kind.DROP_COLUMN, table, _plain(m[1]))
    if m := take(rf"ALTER\s+(?:COLUMN\s+)?({_IDENT})\s+(?:SET\s+DATA\s+)?TYPE\s+(.+)"):
        return Change(Kind.ALTER_TYPE, table, _plain(m[1]), type=re.split(r"\s+USING\b", m[2], flags=re.I)[0].strip())
    if m := take(rf"ALTER\s+(?:COLUMN\s+)?({_IDENT})\s+(SET|DROP)\s+NOT\s+NULL"):
        return Change(Kind.ALTER_NULLABLE, table, _plain(m[1]), nullable=m[2].upper() == "DROP")
    if m := take(rf"ADD\s+(?:COLUMN\s+)?(?:IF\s+NOT\s+EXISTS\s+)?({_IDENT})\s+(.+)"):
        return Change(Kind.ADD_COLUMN, table, _plain(m[1]), type=_type_of(m[2]), nullable=not re.search(r"\bNOT\s+NULL\b", m[2], re.I))
    raise UnsupportedChange(part)


def project_changes(changes: list[Change], t: TableMapping) -> list[Change]:
    """The plan with the mapping's names; changes of excluded columns go."""
    out = []
    for c in changes:
        if c.column and t.target_of(c.column) is None:
            continue
        out.append(Change(c.kind, f"{t.target_schema or t.schema}.{t.target_table or t.table}", t.target_of(c.column) if c.column else None, t.target_of(c.to) if c.kind is Kind.RENAME_COLUMN else c.to, c.type, c.nullable, tuple((t.target_of(n), k) for n, k in c.columns if t.target_of(n) is not None), tuple(t.target_of(n) for n in c.key if t.target_of(n) is not None)))
    return out


def additive_only(changes: list[Change]) -> None:
    """A table format without rewrites takes nullable adds and renames only."""
    for c in changes:
        if not (c.kind is Kind.RENAME_COLUMN or (c.kind is Kind.ADD_COLUMN and c.nullable)):
            raise UnsupportedChange(c.kind.value)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Rows in the shape of the schema: missing columns null, others cast, surplus ones gone."""
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def reconcile(changes: list[Change], catalog: StructType) -> str:
    """After an attempt of unknown outcome: applied, not applied, or indeterminate, by what the target's catalog shows."""
    seen = {f.name: f for f in catalog}
    states = set()
    for c in changes:
        if c.kind is Kind.ADD_COLUMN:
            states.add(c.column in seen)
        elif c.kind is Kind.DROP_COLUMN:
            states.add(c.column not in seen)
        elif c.kind is Kind.RENAME_COLUMN:
            states.add(c.to in seen and c.column not in seen)
        elif c.kind is Kind.ALTER_TYPE and c.column in seen:
            states.add(seen[c.column].dataType.simpleString() == c.type)
        else:
            return "indeterminate"
    return "indeterminate" if len(states) != 1 else "applied" if states.pop() else "not applied"
