"""Schemas and messages of binary wire formats: Avro record schemas and batches as Protocol Buffers, without a jar."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The Avro type that readers of each source type expect.
AVRO = {
    "smallint": "long", "int": "long", "bigint": "long",
    "float": "double", "double": "double",
    "boolean": "boolean",
    "binary": "bytes", "struct": "bytes", "map": "bytes", "array": "bytes",
    "timestamp": "long", "timestamp_ntz": "long", "date": "long",
}
#: What every record has before its columns.
ENVELOPE = (("__op", "string"), ("__ts", "long"), ("__schema_version", "long"), ("__table", "string"), ("__namespace", "string"), ("__key", ["null", "bytes"]), ("__before_json", "string"))


def avro_type(kind: str, nullable: bool) -> str | list[str]:
    """Avro's type of a Spark type, in a union with null if it may be null; types without one are text."""
    base = AVRO.get(kind.split("(")[0].split("<")[0], "string")
    return ["null", base] if nullable else base


def avro_schema(schema: StructType, name: str = "record") -> str:
    fields = [{"name": n, "type": t} for n, t in ENVELOPE] + [{"name": f.name, "type": avro_type(f.dataType.simpleString(), f.nullable)} for f in schema]
    return json.dumps({"type": "record", "name": name, "fields": fields}, separators=(",", ":"))


def avro_value(c: Column, kind: str) -> Column:
    """A column as its Avro type holds it: times in milliseconds, dates as days in them, nested values as JSON bytes."""
    base = kind.split("(")[0].split("<")[0]
    if base in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_millis(c.cast("timestamp"))
    if base in ("struct", "map", "array"):
        return F.to_json(c).cast("binary")
    made = AVRO.get(base, "string")
    return c.cast({"long": "bigint", "bytes": "binary"}.get(made, made))


def avro_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose columns have the values of their Avro types, for a writer of ``avro_schema``."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*[avro_value(F.col(c), kinds[c]).alias(c) if c in columns else F.col(c) for c in df.columns])


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value: str | bytes | int | None) -> bytes:
    """A field of a message: numbers as varints, the rest by length; what is empty, 0 or null is left out."""
    if not value:
        return b""
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


#: Field numbers of a record, in order.
RECORD = ("table", "op", "key", "before_json", "after_json", "ts_millis", "schema_version")


def proto_batches(df: DataFrame, batch: str, order: str) -> DataFrame:
    """(batch, n_records, payload): one message per batch, whose repeated field 1 holds its records in order.

    df: the columns of RECORD beside batch and order. A batch is bounded by its transaction.
    """
    rows = df.groupBy(F.col(batch).alias("batch")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *RECORD))).alias("records"))
    key = rows.schema["batch"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [b"".join(field(1, b"".join(field(i, r[c]) for i, c in enumerate(RECORD, 1)) or b"\x00") for r in records) for records in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(r) for r in b.column(1).to_pylist()], pa.int64()), pa.array(made, pa.binary())], names=["batch", "n_records", "payload"])

    return rows.mapInArrow(run, f"batch {key}, n_records long, payload binary")


def read_proto(payload: bytes) -> list[dict[int, bytes | int]]:
    """The records of a message, by field number."""

    def fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
        at = 0

        def number() -> int:
            nonlocal at
            n = shift = 0
            while True:
                byte = raw[at]
                at += 1
                n |= (byte & 0x7F) << shift
                shift += 7
                if byte < 0x80:
                    return n

        while at < len(raw):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            else:
                size = number()
                yield tag >> 3, raw[at : at + size]
                at += size

    return [dict(fields(r)) for _, r in fields(payload)]
