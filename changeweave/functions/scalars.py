"""Scalar expressions of the engine: value normalisation, digests, tokens, buckets, backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"
# The spellings of booleans that the sources use.
TRUE, FALSE = ("t", "true", "1", "y", "yes"), ("f", "false", "0", "n", "no")
NULL_PARTITION = "__null__"


def framed(*parts: Column) -> Column:
    """The parts as one text that tells them apart: length, colon and text of each, n for a null."""
    one = lambda p: F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("n"))
    return F.concat(*[one(p.cast("string")) for p in parts])


def sha(*parts: Column) -> Column:
    """SHA-256 of the framed parts: different tuples have different digests, and null is no empty text."""
    return F.sha2(framed(*parts).cast("binary"), 256)


def as_bool(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*TRUE), F.lit(True)).when(t.isin(*FALSE), F.lit(False))


def as_int(text: Column) -> Column:
    """Null for empty and for what isn't an integer of 64 bits; ``invalid`` tells the two apart."""
    return F.when(F.trim(text).rlike(INTEGER), F.trim(text).try_cast("bigint"))


def as_number(text: Column) -> Column:
    """Lossless decimal text: kept if it is a number of JSON's grammar, else null."""
    return F.when(text.rlike(NUMBER), text)


def as_uuid(text: Column) -> Column:
    return F.when(text.rlike(UUID), F.lower(text))


def invalid(text: Column, value: Column) -> Column:
    """Whether a non-empty text lost its value in normalisation."""
    return text.isNotNull() & (F.trim(text) != "") & value.isNull()


def as_vector(text: Column) -> Column:
    """``[1,2]`` or ``{1,2}`` as array<float>; null for anything else, an element that is no number included."""
    inner = F.regexp_extract(F.trim(text), r"^[\[{](.*)[\]}]$", 1)
    values = F.transform(F.split(inner, ","), lambda v: F.trim(v).try_cast("float"))
    return F.when(F.trim(text).rlike(r"^[\[{].*[\]}]$"), F.when(F.trim(inner) == "", F.array().cast("array<float>")).when(~F.exists(values, lambda v: v.isNull()), values))


def as_hstore(text: Column) -> Column:
    """``"a"=>"1", "b"=>NULL`` as map<string,string>: backslashes escape the next character, of a repeated key the last counts."""
    quoted = r'"((?:[^"\\]|\\.)*)"'
    pairs = F.regexp_extract_all(text, F.lit(quoted.replace("((", "(?:(", 1) + r"\s*=>\s*(?:" + quoted.replace("((", "(?:(", 1) + "|NULL)"), F.lit(0))
    plain = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
    key = lambda p: plain(F.regexp_extract(p, "^" + quoted, 1))
    value = lambda p: F.when(p.rlike(r"=>\s*NULL$"), F.lit(None).cast("string")).otherwise(plain(F.regexp_extract(p, r"=>\s*" + quoted + "$", 1)))
    entries = F.transform(pairs, lambda p: F.struct(key(p).alias("key"), value(p).alias("value")))
    # an entry stays unless a later one has its key
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def path_token(text: Column) -> Column:
    """A reversible token safe in object keys: v1- and unpadded base64url."""
    return F.concat(F.lit("v1-"), F.rtrim(F.translate(F.base64(text.cast("binary")), "+/\r\n", "-_"), F.lit("=")))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def field_id(*parts: Column) -> Column:
    """Stable positive 31-bit id from the head of a digest."""
    path = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.sha2(path.cast("binary"), 256), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))).cast("long")


def path_escape(text: Column) -> Column:
    """Percent-encoded, so that it is one part of an object key."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def as_inet(text: Column) -> Column:
    """An IPv4 address, with its prefix length if it has one, without leading zeros; else null."""
    t = F.trim(text)
    octets = F.transform(F.split(F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+){3})(?:/[0-9]+)?$", 1), r"\."), lambda o: o.try_cast("int"))
    mask = F.regexp_extract(t, r"/([0-9]+)$", 1).try_cast("int")
    fits = (F.size(octets) == 4) & ~F.exists(octets, lambda o: o.isNull() | (o > 255)) & (mask.isNull() | (mask <= 32))
    return F.when(fits, F.concat_ws("/", F.array_join(F.transform(octets, lambda o: o.cast("string")), "."), mask.cast("string")))


def as_json(text: Column) -> Column:
    """The JSON value without blanks around its parts; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))


# Names of the time buckets.
FORMATS = {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH"}


def time_bucket(ts: Column, bucket: str) -> Column:
    """UTC bucket name of a time; an unknown bucket gives the whole time."""
    return F.date_format(ts, FORMATS.get(bucket, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def partition_value(value: Column, ingest: Column | None = None) -> Column:
    """Text of a partition value: the null marker, or the typed text; a missing event time falls back on the ingest time."""
    return F.coalesce(value.cast("string"), ingest.cast("string") if ingest is not None else F.lit(None).cast("string"), F.lit(NULL_PARTITION))


# The layouts of times that the sources write, those with an offset first.
LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def parse_time(text: Column) -> Column:
    """The first of the layouts that fits, as UTC; null if none does. The session's time zone is UTC."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in LAYOUTS]).cast("timestamp_ntz")


def backoff(attempt: Column, base_ms: int, cap_ms: int) -> Column:
    return F.least(F.lit(cap_ms).cast("long"), F.lit(base_ms).cast("long") * F.pow(F.lit(2.0), F.least(attempt, F.lit(40))).cast("long"))


def fits_decimal(text: Column, precision: int, scale: int) -> Column:
    """Whether the number is exactly representable as DECIMAL(precision, scale)."""
    part = lambda i: F.regexp_extract(F.trim(text), r"^[+-]?([0-9]*)\.?([0-9]*)(?:[eE]([+-]?[0-9]+))?$", i)
    digits = F.regexp_replace(F.concat(part(1), part(2)), "^0+", "")
    tail = F.length(digits) - F.length(F.regexp_replace(digits, "0+$", ""))
    places = F.length(part(2)) - F.coalesce(part(3).try_cast("int"), F.lit(0)) - tail  # decimal places that it needs
    before = F.length(digits) - tail - places  # digits before the point
    is_number = F.trim(text).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.coalesce(is_number, F.lit(False)) & ((digits == "") | ((places <= scale) & (before <= precision - scale)))


def quote_identifier(name: str, quote: str = "`") -> str:
    return quote + name.replace(quote, quote * 2) + quote
