"""Synthetic replacements: invented people, places and numbers picked by keyed hash."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.hashing import digit, int_div, keyed_hash, padded, pick, random_chars, subkey

# Invented word lists, free to change.
FIRST_NAMES = [
    "Ada", "Alan", "Amara", "Anton", "Bela", "Bruno", "Carla", "Cyril", "Dana", "Diego", "Edith", "Elias",
    "Farah", "Felix", "Greta", "Hugo", "Ines", "Ivan", "Jana", "Jonas", "Karim", "Lena", "Luca", "Maren",
    "Milo", "Nadia", "Nils", "Olga", "Oscar", "Petra", "Quentin", "Rosa", "Samir", "Selma", "Tariq", "Thea",
    "Uma", "Viktor", "Wanda", "Yusuf", "Zora",
]
LAST_NAMES = [
    "Abbott", "Alvarez", "Bauer", "Becker", "Brandt", "Castillo", "Conti", "Dahl", "Dubois", "Eriksen", "Fischer",
    "Garnier", "Grant", "Haas", "Ibarra", "Jansen", "Keller", "Kovacs", "Larsen", "Leroy", "Maier", "Moreno",
    "Novak", "Okafor", "Olsen", "Pereira", "Quinn", "Rahman", "Rossi", "Sato", "Schmidt", "Silva", "Takeda",
    "Ullman", "Vargas", "Weber", "Xavier", "Yilmaz", "Zeman",
]
STREETS = [
    "Ash Lane", "Birch Road", "Cedar Avenue", "Dock Street", "Elm Court", "Forge Way", "Garden Row", "Harbor Drive",
    "Iris Close", "Juniper Street", "Kiln Road", "Linden Avenue", "Mill Lane",
]
CITIES = [
    "Aldham", "Brackwell", "Corvale", "Dunmere", "Eastholm", "Fairwick", "Glenport", "Hartford Bay", "Ivybridge",
    "Kingsmoor", "Lakemont", "Marlow Heath", "Northgate", "Oakhaven", "Portsea", "Ravenna Hills", "Stonefield",
]
STATES = ["Arden", "Borland", "Calder", "Denholm", "Estmark", "Fenwick", "Galen", "Hadley", "Inver", "Jura", "Kent"]
COUNTRIES = [
    "Argentina", "Australia", "Brazil", "Canada", "Denmark", "France", "Germany", "India", "Italy", "Japan", "Kenya",
    "Mexico", "Norway", "Poland", "Spain", "Sweden", "Turkey", "United States", "Vietnam",
]
COMPANIES = ["Acorn", "Bluefin", "Cobalt", "Driftwood", "Ember", "Fathom", "Granite", "Horizon", "Indigo", "Juniper"]
COMPANY_FORMS = ["Group", "Holdings", "Industries", "Labs", "Logistics", "Partners", "Trading"]
SKILLS = ["budgeting", "carpentry", "drafting", "editing", "forecasting", "logistics", "negotiation", "teaching"]
JOB_GRADES = ["Junior", "Senior", "Lead", "Regional", "Chief"]
JOBS = ["Accountant", "Analyst", "Architect", "Buyer", "Clerk", "Designer", "Engineer", "Planner", "Surveyor"]
WORDS = [
    "amber", "basil", "canyon", "delta", "ember", "fjord", "grove", "harbor", "island", "jasmine", "kelp", "lagoon",
    "meadow", "nectar", "orchid", "pebble", "quartz", "river", "summit", "thicket", "umber", "valley", "willow",
]

# day counts are taken back from this date, never from the clock, so that reruns agree
ANCHOR = dt.date(2025, 1, 1)

# Which name fragment selects which provider, first match wins.
PROVIDERS: dict[str, list[tuple[tuple[str, ...], str]]] = {
    "table": [
        (("email",), "email"),
        (("first_name", "firstname"), "first_name"),
        (("last_name", "lastname"), "last_name"),
        (("name",), "full_name"),
        (("phone",), "phone"),
        (("address",), "full_address"),
        (("city",), "city"),
        (("country",), "country"),
        (("zip", "postal"), "zip"),
        (("card",), "card"),
        (("ssn",), "ssn"),
        (("",), "letters"),
    ],
    "sql_export": [
        (("email",), "email"),
        (("first_name", "firstname"), "first_name"),
        (("last_name", "lastname"), "last_name"),
        (("name",), "full_name"),
        (("phone",), "phone"),
        (("address",), "street"),
        (("city",), "city"),
        (("country",), "country"),
        (("zip", "postal"), "zip"),
        (("district",), "state"),
        (("",), "word"),
    ],
    "json": [
        (("name",), "full_name"),
        (("email",), "email"),
        (("phone",), "phone"),
        (("city",), "city"),
        (("address",), "full_address"),
        (("company",), "company"),
        (("country",), "country"),
        (("zip", "postal"), "zip"),
        (("tag", "skill"), "skill"),
        (("role", "title"), "job"),
        (("",), "word"),
    ],
    "json_export": [
        (("name", "user"), "full_name"),
        (("email",), "email"),
        (("phone", "mobile"), "phone"),
        (("city",), "city"),
        (("street", "address"), "full_address"),
        (("country",), "country"),
        (("zip", "postal"), "zip"),
        (("company",), "company"),
        (("",), "word"),
    ],
    "csv": [
        (("email",), "email"),
        (("name",), "full_name"),
        (("phone",), "phone"),
        (("address",), "street"),
        (("city",), "city"),
        (("zip", "postal"), "zip"),
        (("country",), "country"),
        (("company",), "company"),
        (("",), "word"),
    ],
}
# Half-open integer ranges per type and profile.
NUMBER_RANGES = {
    "table": {"short": (1, 32767), "byte": (1, 127), "long": (1, 1_000_000_000), "int": (1, 100_000)},
    "sql_export": {"short": (1, 30_000), "byte": (1, 127), "long": (1, 1_000_000), "int": (1, 100_000)},
    "json": {"short": (1, 1000), "byte": (1, 127), "long": (1, 1000), "int": (1, 1000)},
    "json_array": {"short": (10, 9999), "byte": (10, 127), "long": (1000, 999_999), "int": (10, 9999)},
    "json_export": {"short": (1000, 32_767), "byte": (1, 127), "long": (1000, 99_999), "int": (1000, 99_999)},
    "csv": {"short": (1, 32767), "byte": (1, 127), "long": (1, 1_000_000_000), "int": (1, 100_000)},
}
# Half-open ranges of two-decimal numbers for float and double columns.
FLOAT_RANGES = {"sql_export": (10, 10_000), "json": (1, 1000), "json_array": (10, 9999), "json_export": (1000, 99_999)}


def _joined(sep: str, *parts: Column) -> Column:
    """Like concat_ws, but null when a part is null."""
    out = [parts[0]]
    for part in parts[1:]:
        out += [F.lit(sep), part]
    return F.concat(*out)


def provider_for(name: str, profile: str = "table") -> str:
    lower = name.lower()
    for fragments, provider in PROVIDERS[profile]:
        if any(f in lower for f in fragments):
            return provider
    return "word"


def provide(provider: str, c: Column, key: str, label: str, seed: Column | None = None) -> Column:
    """The text of one provider for each value of `c`."""
    h = keyed_hash(c, key, f"{label}.{provider}", seed)
    first, last, n_first, n_last = FIRST_NAMES, LAST_NAMES, len(FIRST_NAMES), len(LAST_NAMES)
    if provider == "first_name":
        return pick(first, h)
    if provider == "last_name":
        return pick(last, h)
    if provider == "full_name":
        return _joined(" ", pick(first, h), pick(last, h, n_first))
    if provider == "email":
        number = digit(h, 100_000, n_first * n_last).cast("string")
        name = F.concat(F.lower(pick(first, h)), F.lit("."), F.lower(pick(last, h, n_first)))
        return F.concat(name, number, F.lit("@example.com"))
    if provider == "phone":
        return F.concat(F.lit("+1-555-"), padded(digit(h, 1000), 3), F.lit("-"), padded(digit(h, 10_000, 1000), 4))
    if provider == "street":
        return _joined(" ", (digit(h, 9999) + 1).cast("string"), pick(STREETS, h, 9999))
    if provider == "full_address":
        div = 9999 * len(STREETS)
        place = F.concat(F.lit(", "), pick(CITIES, h, div), F.lit(" "), padded(digit(h, 100_000, div * len(CITIES)), 5))
        return F.concat((digit(h, 9999) + 1).cast("string"), F.lit(" "), pick(STREETS, h, 9999), place)
    if provider == "city":
        return pick(CITIES, h)
    if provider == "state":
        return pick(STATES, h)
    if provider == "country":
        return pick(COUNTRIES, h)
    if provider == "zip":
        return padded(digit(h, 100_000), 5)
    if provider == "card":
        return _card(h)
    if provider == "ssn":
        area, group, serial = digit(h, 665) + 1, digit(h, 99, 665) + 1, digit(h, 9999, 665 * 99) + 1
        return _joined("-", padded(area, 3), padded(group, 2), padded(serial, 4))
    if provider == "company":
        return _joined(" ", pick(COMPANIES, h), pick(COMPANY_FORMS, h, len(COMPANIES)))
    if provider == "skill":
        return pick(SKILLS, h)
    if provider == "job":
        return _joined(" ", pick(JOB_GRADES, h), pick(JOBS, h, len(JOB_GRADES)))
    if provider == "word":
        return pick(WORDS, h)
    if provider == "sentence":
        size = len(WORDS)
        return _joined(" ", *[pick(WORDS, h, size**i) for i in range(5)])
    if provider == "letters":
        return F.lower(random_chars(c, 10, "alpha", key, f"{label}.letters", seed))
    raise ValueError(f"unknown provider {provider}")


def _card(h: Column) -> Column:
    """A 16-digit card number starting with 51-55 whose check digit is right."""
    body = F.lit(5).cast("long") * 10**14 + (digit(h, 5) + 1) * 10**13 + digit(h, 10**13, 5)
    total = F.lit(0).cast("long")
    for i in range(15):
        d = digit(body, 10, 10**i)
        if i % 2 == 0:
            d = d * 2 - F.when(d > 4, 9).otherwise(0)
        total = total + d
    text = F.concat(body.cast("string"), ((F.lit(10) - total % 10) % 10).cast("string"))
    return _joined("-", *[F.substring(text, at, 4) for at in (1, 5, 9, 13)])


def integer_between(h: Column, lo: int, hi: int) -> Column:
    """Half-open range [lo, hi)."""
    return digit(h, hi - lo) + lo


def synthetic(
    c: Column,
    dtype: T.DataType,
    name: str,
    key: str,
    label: str,
    profile: str = "table",
    max_length: int | None = None,
    logical: str | None = None,
    seed: Column | None = None,
) -> Column:
    """A replacement that fits the column: by name for text, by range for numbers, by anchor date for dates."""
    h = keyed_hash(c, key, f"{label}.value", seed)
    ranges = NUMBER_RANGES[profile]
    if logical == "uuid":
        return hash_uuid(c, key, label)
    if isinstance(dtype, T.BinaryType):
        return F.lit(bytearray(b"MASKED_BLOB"))
    if isinstance(dtype, T.BooleanType):
        return digit(h, 2) == 1
    if isinstance(dtype, T.ShortType):
        return integer_between(h, *ranges["short"]).cast(dtype)
    if isinstance(dtype, T.ByteType):
        return integer_between(h, *ranges["byte"]).cast(dtype)
    if isinstance(dtype, T.LongType):
        return integer_between(h, *ranges["long"]).cast(dtype)
    if isinstance(dtype, T.IntegerType):
        return integer_between(h, *ranges["int"]).cast(dtype)
    if isinstance(dtype, (T.DecimalType, T.FractionalType)):
        return _synthetic_fraction(h, dtype, profile)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _synthetic_date(h, dtype, profile)
    text = provide(provider_for(name, "json" if profile == "json_array" else profile), c, key, label, seed)
    return F.substring(text, 1, max_length) if max_length else text


def _synthetic_fraction(h: Column, dtype: T.DataType, profile: str) -> Column:
    if isinstance(dtype, T.DecimalType):
        precision, scale = dtype.precision, dtype.scale
    else:
        precision, scale = 10, 2
    if profile in FLOAT_RANGES:
        lo, hi = FLOAT_RANGES[profile]
        hi = min(hi, 10 ** max(1, precision - scale))
        return ((digit(h, (hi - lo) * 100) + lo * 100).cast("decimal(20,0)") / F.lit(100)).cast(dtype)
    whole_digits = max(1, min(precision - scale, 9))
    whole = integer_between(h, 1, max(2, 10**whole_digits - 1))
    unit = 10 ** min(scale, 8)
    if scale == 0:
        return whole.cast(dtype)
    cents = digit(int_div(h, 10**9), unit - 1)
    return ((whole * unit + cents).cast("decimal(20,0)") / F.lit(unit)).cast(dtype)


def _synthetic_date(h: Column, dtype: T.DataType, profile: str) -> Column:
    """A birthday at age 20 to 50, or for SQL exports a day within the past year."""
    if profile == "sql_export":
        day = F.date_sub(F.lit(ANCHOR), digit(h, 365).cast("int"))
    else:
        day = F.date_sub(F.lit(ANCHOR), (digit(h, 10958) + 7305).cast("int"))
    return day.cast(dtype)


def hash_uuid(c: Column, key: str, label: str) -> Column:
    """A version-3 style UUID text from the keyed hash."""
    return uuid_layout(F.md5(F.concat(F.lit(subkey(key, f"{label}.uuid")), c.cast("string"))))


def uuid_layout(md5_hex: Column) -> Column:
    """32 hex digits laid out as a UUID with the version and variant nibbles set."""
    variant = F.element_at(
        F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(md5_hex, 17, 1), 16, 10).cast("int") % 4) + 1
    )
    return F.concat(
        F.substring(md5_hex, 1, 8), F.lit("-"), F.substring(md5_hex, 9, 4), F.lit("-3"),
        F.substring(md5_hex, 14, 3), F.lit("-"), variant, F.substring(md5_hex, 18, 3), F.lit("-"),
        F.substring(md5_hex, 21, 12),
    )
