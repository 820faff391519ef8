"""Which value a generated field gets: tables of rules over name, type and width, read by one interpreter.

A table is a sequence of `Rule`; the first that fits names the maker of the value. Columns, unique keys, JSON fields and
document fields each have a table of their own and share the makers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.hashing import digit, int_div, keyed_hash, pick, subkey
from veilframe.functions.synthetic import ANCHOR, hash_uuid, provide

ANCHOR_TIME = "2025-01-01 00:00:00"
# Fixed values.
COUNTRY_CODES = ["US", "GB", "DE", "FR", "IN", "CA", "AU", "JP", "SG", "NL", "CH", "ES", "IT", "SE", "AE", "BR", "MX",
                 "ZA", "NZ", "IE"]
STATE_CODES = ["NY", "CA", "TX", "FL", "IL", "PA", "OH", "GA", "NC", "MI", "NJ", "VA", "WA", "AZ", "MA", "TN", "IN",
               "MO", "MD", "WI"]
STATUSES = ["ACTIVE", "PENDING", "COMPLETED", "APPROVED"]
JSON_STATUSES = ["ACTIVE", "APPROVED", "PENDING", "COMPLETED"]
DOC_STATUSES = ["ACTIVE", "COMPLETED", "INACTIVE", "PENDING"]
DEPARTMENTS = ["FINANCE", "RISK", "ENGINEERING", "OPERATIONS", "COMPLIANCE"]
RATINGS = ["G", "PG", "PG-13", "R", "NC-17"]
FEATURES = ["Trailers", "Commentaries", "Deleted Scenes", "Behind the Scenes"]
INT_KEYS, SMALL_KEYS, TINY_KEYS = 1_000_000, 32_000, 120

KINDS = {
    "long": ["bigint", "int8", "long", "bigserial"],
    "int": ["int", "integer", "int4", "serial"],
    "short": ["smallint", "int2", "short"],
    "byte": ["tinyint", "byte"],
    "decimal": ["numeric", "decimal", "money"],
    "double": ["double", "float8", "double precision", "real", "float", "float4"],
    "bool": ["boolean", "bool", "bit"],
    "date": ["date"],
    "uuid": ["uuid"],
    "binary": ["bytea", "binary", "varbinary", "blob"],
}


@dataclass(frozen=True)
class GenColumn:
    """One column of a table to generate."""

    name: str
    type: str = "varchar"
    size: int = 0
    precision: int = 0
    scale: int = 0
    nullable: bool = True
    primary: bool = False
    unique: bool = False
    foreign: tuple[str, str] | None = None


def kind_of(type_name: str) -> str:
    base = type_name.lower().split("(")[0].strip()
    for kind, names in KINDS.items():
        if base in names:
            return kind
    if "timestamp" in base or base.startswith("time"):
        return "timestamp"
    if base.startswith("_") or base.endswith("[]") or base == "array":
        return "array"
    if any(h in base for h in ("char", "text", "string")):
        return "text"
    return "other"


def spark_type(col: GenColumn) -> T.DataType:
    kind = kind_of(col.type)
    if kind == "decimal":
        return T.DecimalType(col.precision or 10, col.scale)
    return {
        "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "byte": T.ByteType(),
        "double": T.DoubleType(), "bool": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampNTZType(),
        "binary": T.BinaryType(), "array": T.ArrayType(T.StringType()),
    }.get(kind, T.StringType())


def short_code(seq: Column, length: int) -> Column:
    """Codes of one letter, letter and base-36 digit, or base-36 digits; wraps at the end of the domain."""
    s = F.greatest(seq - 1, F.lit(0).cast("long"))
    letter = F.char(s % 26 + 65)
    if length <= 1:
        return letter
    if length == 2:
        return F.concat(letter, F.conv((int_div(s, 26) % 36).cast("string"), 10, 36))
    return F.lpad(F.conv((s % 36**length).cast("string"), 10, 36), length, "0")


def cyclic_code(seq: Column, codes: list[str]) -> Column:
    return pick(codes, F.greatest(seq - 1, F.lit(0).cast("long")))


# ---------------------------------------------------------------- rules


@dataclass(frozen=True)
class Rule:
    """Fits a field by any of name (searched in lower case), kind or type; without them, every field.

    `upto` asks for a known width of at most so many characters as well, `only` for one of these kinds.
    """

    maker: str
    name: str = ""
    kinds: str = ""
    types: str = ""
    upto: int = 0
    only: str = ""

    def fits(self, field: Field) -> bool:
        if self.upto and not 0 < field.width <= self.upto:
            return False
        if self.only and field.kind not in self.only.split():
            return False
        if not (self.name or self.kinds or self.types):
            return True
        return bool(
            self.name and re.search(self.name, field.name)
            or field.kind in self.kinds.split()
            or self.types and re.search(self.types, field.column.type.lower())
        )


@dataclass(frozen=True)
class Field:
    """A field to fill: its column, the sequence number of the row, and the label of its draws."""

    seq: Column
    column: GenColumn
    key: str
    label: str
    width: int  # longest text, 0 if unknown

    @property
    def name(self) -> str:
        return self.column.name.lower()

    @property
    def kind(self) -> str:
        return kind_of(self.column.type)

    def draw(self, n: int | None = None) -> Column:
        h = keyed_hash(self.seq, self.key, self.label)
        return h if n is None else digit(h, n)

    def text(self, provider: str) -> Column:
        return provide(provider, self.seq, self.key, self.label)

    def numbered(self, before: str, after: str = "") -> Column:
        return F.concat(F.lit(before), self.seq.cast("string"), F.lit(after))

    def wrapped(self, n: int, name: str) -> Column:
        return (self.seq % n + 1).cast(name)

    def back(self, amount: Column, unit: str) -> Column:
        return F.lit(ANCHOR_TIME).cast("timestamp_ntz") - F.make_dt_interval(**{unit: amount})


def _money(f: Field) -> Column:
    """At least 10, within precision and scale and seven whole digits."""
    scale, precision = max(0, f.column.scale), f.column.precision or 10
    top = 10 ** max(1, min(precision - scale, 7)) - 1
    low = 10 if top > 10 else 1
    unit = 10 ** min(scale, 6)
    cents = f.draw((top - low) * unit) + low * unit
    value = cents.cast("decimal(20,0)") / F.lit(unit)
    return value.cast(T.DecimalType(precision, scale) if f.kind == "decimal" else T.DoubleType())


def _reference(f: Field) -> Column:
    """A key of no declared parent, in the column's own width."""
    if f.kind == "long":
        return f.seq
    return f.wrapped(*{"short": (1000, "smallint"), "byte": (TINY_KEYS, "tinyint")}.get(f.kind, (50_000, "int")))


#: Makers beside the providers of synthetic text.
MAKERS: dict[str, Callable[[Field], Column]] = {
    "lexemes": lambda f: f.text("sentence"),
    "bytes": lambda f: F.unhex(F.sha2(F.concat(F.lit(subkey(f.key, f.name)), f.seq.cast("string")), 256)),
    "labels": lambda f: F.array(pick(FEATURES, f.draw())) if "feature" in f.name else F.array(F.lit("item1"), F.lit("item2")),
    "rating": lambda f: pick(RATINGS, f.draw()),
    "year": lambda f: (f.seq % 35 + 1990).cast("int"),
    "uuid": lambda f: hash_uuid(f.seq, f.key, f.label),
    "json": lambda f: F.to_json(F.struct(F.lit("ok").alias("status"), f.seq.alias("seq"))),
    "reference": _reference,
    "country_code": lambda f: cyclic_code(f.seq, COUNTRY_CODES),
    "country_of_three": lambda f: F.lit("USA"),
    "state_code": lambda f: cyclic_code(f.seq, STATE_CODES),
    "money": _money,
    "cents_to_5100": lambda f: (f.draw(500_000) + 10_000) / F.lit(100.0),
    "cents_to_20000": lambda f: (f.draw(1_500_000) + 500_000) / F.lit(100.0),
    "day_of_two_years": lambda f: F.date_sub(F.lit(ANCHOR), f.draw(730).cast("int")),
    "day_as_text": lambda f: F.date_sub(F.lit(ANCHOR), f.draw(365).cast("int")).cast("string"),
    "day_of_keys": lambda f: F.date_sub(F.lit(ANCHOR), f.seq.cast("int")),
    "hour_of_a_year": lambda f: f.back(f.draw(8760).cast("int"), "hours"),
    "moment_of_a_year": lambda f: f.back(f.draw(365).cast("int"), "days"),
    "moment_of_keys": lambda f: f.back((f.seq * 300).cast("decimal(18,6)"), "secs"),
    "flag": lambda f: f.draw(2) == 1,
    "age": lambda f: (f.draw(50) + 20).cast("int"),
    "below_100": lambda f: (f.seq % 100).cast("int"),
    "number": lambda f: f.seq,
    "number_of_type": lambda f: f.seq.cast(spark_type(f.column)),
    "next_int": lambda f: (f.seq + 1).cast("int"),
    "wrapped_int": lambda f: f.wrapped(INT_KEYS, "int"),
    "wrapped_short": lambda f: f.wrapped(SMALL_KEYS, "smallint"),
    "wrapped_byte": lambda f: f.wrapped(TINY_KEYS, "tinyint"),
    "code": lambda f: short_code(f.seq, f.width),
    "code_of_two": lambda f: short_code(f.seq, 2),
    "user_address": lambda f: f.numbered("user", "@example.com"),
    "named_number": lambda f: f.numbered(f.column.name.upper() + "_"),
}
#: Makers of texts that are cut to the field, as the providers' texts are.
CUT_MAKERS: dict[str, Callable[[Field], Column]] = {
    "numbered_email": lambda f: F.concat(f.numbered("u", "_"), f.text("email")),
    "dialled": lambda f: F.regexp_replace(f.text("phone"), "[^0-9+]", ""),
    "status": lambda f: pick(STATUSES, f.draw()),
    "json_status": lambda f: pick(JSON_STATUSES, f.draw()),
    "doc_status": lambda f: cyclic_code(f.seq, DOC_STATUSES),
    "department": lambda f: pick(DEPARTMENTS, f.draw()),
}

# Fragments of names, in the order in which they are tried.
COLUMN_RULES = (
    Rule("lexemes", types="tsvector"),
    Rule("bytes", "picture|avatar|image|photo|blob", kinds="binary"),
    Rule("labels", "features|tags", kinds="array"),
    Rule("rating", "rating", types="rating|mpaa"),
    Rule("year", "year", types="year"),
    Rule("uuid", kinds="uuid"),
    Rule("json", types="json"),
    Rule("reference", "id$"),
    Rule("numbered_email", "mail"),
    Rule("first_name", "^(first_name|fname)$"),
    Rule("last_name", "^(last_name|lname|surname)$"),
    Rule("full_name", "name"),
    Rule("dialled", "phone|mobile|tel"),
    Rule("street", "address|street"),
    Rule("city", "city"),
    Rule("zip", "zip|postal"),
    Rule("country_code", "country", upto=2),
    Rule("country_of_three", "country", upto=3),
    Rule("country", "country"),
    Rule("state_code", "state|province", upto=2),
    Rule("state", "state|province"),
    Rule("company", "company|dept|department"),
    Rule("status", "status"),
    Rule("ssn", "ssn|tax"),
    Rule("card", "card|credit"),
    Rule("money", "amount|salary|price|balance|cost|rate", kinds="decimal double"),
    Rule("day_of_two_years", "_date$|^date$", kinds="date"),
    Rule("hour_of_a_year", "time|last_update|created_at|updated_at", kinds="timestamp"),
    Rule("wrapped_byte", kinds="byte"),
    Rule("wrapped_short", kinds="short"),
    Rule("wrapped_int", kinds="int"),
    Rule("number", kinds="long"),
    Rule("flag", kinds="bool"),
    Rule("code", upto=5),
    Rule("word"),
)
KEY_RULES = (
    Rule("day_of_keys", kinds="date"),
    Rule("moment_of_keys", kinds="timestamp"),
    Rule("moment_of_keys", "date|time", only="text other"),
    Rule("number", kinds="long"),
    Rule("wrapped_short", kinds="short"),
    Rule("wrapped_byte", kinds="byte"),
    Rule("next_int", kinds="int"),
    Rule("number_of_type", kinds="decimal double"),
    Rule("uuid", kinds="uuid"),
    Rule("code", upto=5),
    Rule("user_address", "email"),
    Rule("named_number"),
)
JSON_RULES = (
    Rule("number", "id$"),
    Rule("email", "email"),
    Rule("full_name", "name"),
    Rule("phone", "phone"),
    Rule("street", "address"),
    Rule("city", "city"),
    Rule("country", "country"),
    Rule("department", "dept|department"),
    Rule("json_status", "status"),
    Rule("cents_to_20000", "amount|salary|price"),
    Rule("day_as_text", "date|created"),
    Rule("flag", "active|enabled"),
    Rule("word"),
)
DOC_RULES = (
    Rule("code", upto=1),
    Rule("code_of_two", "country_code|state_code|^(st|cc)$"),
    Rule("code", upto=5),
    Rule("email", "email"),
    Rule("full_name", "name"),
    Rule("phone", "phone"),
    Rule("street", "address"),
    Rule("city", "city"),
    Rule("country", "country"),
    Rule("state", "state|province"),
    Rule("company", "company"),
    Rule("doc_status", "status"),
    Rule("cents_to_5100", "amount|price|salary|balance"),
    Rule("moment_of_a_year", "date|created|updated"),
    Rule("age", "age"),
    Rule("below_100", "count|num"),
    Rule("flag", "active|enabled"),
    Rule("word"),
)


def value_by(rules: Sequence[Rule], field: Field) -> Column:
    """The value of the first rule that fits; generated texts are cut to the field's width."""
    maker = next(r.maker for r in rules if r.fits(field))
    if maker in MAKERS:
        return MAKERS[maker](field)
    value = CUT_MAKERS[maker](field) if maker in CUT_MAKERS else field.text(maker)
    return F.substring(value, 1, field.width) if field.width else value
