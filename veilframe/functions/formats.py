"""The custom format language: dates, text templates, patterns and numbers.

A rule is read once on the driver and becomes a built-in column expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.hashing import digit, int_div, keyed_hash, pick, random_chars
from veilframe.functions.regextext import read_regex

# ---------------------------------------------------------------- dates

_MONTH, _DAY = r"(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])"
# local date-time with an optional zone, which is dropped (the local clock time is what gets printed)
_ISO_TEXT = (
    rf"^(\d{{4}}-{_MONTH}-){_DAY}(?:[T ](\d{{2}}:\d{{2}}(?::\d{{2}}(?:\.\d{{1,6}})?)?)\d{{0,3}}"
    r"(?:Z|[+-]\d{2}(?::?\d{2})?)?(?:\[[^\]]*\])?)?$"
)
# The other accepted day forms with their year-month-day order, tried from the first.
_DAY_FORMS = [
    (rf"^{_DAY}/{_MONTH}/(\d{{4}})$", "$3-$2-$1"),
    (rf"^{_MONTH}/{_DAY}/(\d{{4}})$", "$3-$1-$2"),
    (rf"^(\d{{4}})/{_MONTH}/{_DAY}$", "$1-$2-$3"),
    (rf"^{_DAY}-{_MONTH}-(\d{{4}})$", "$3-$2-$1"),
    (rf"^(\d{{4}}){_MONTH}{_DAY}$", "$1-$2-$3"),
]
_PATTERN_LETTERS = set("GyuMLdEaHkKhmsSVzOXxZQqDF")


def parse_date_text(c: Column) -> Column:
    """Timestamp (no zone) of a text in any accepted form, NULL when none fits.

    A day beyond the end of its month (31 April) counts as the last day of that month.
    """
    text = F.trim(c.cast("string"))
    iso = text
    for pattern, order in reversed(_DAY_FORMS):
        iso = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, order)).otherwise(iso)
    month = F.regexp_extract(iso, _ISO_TEXT, 1)
    first = F.when(month != "", F.concat(month, F.lit("01"))).try_cast("date")
    day = F.regexp_extract(iso, _ISO_TEXT, 3).try_cast("int")
    date = F.date_add(first, F.least(day, F.day(F.last_day(first))) - 1)
    time = F.regexp_extract(iso, _ISO_TEXT, 4)
    return F.concat(date.cast("string"), F.when(time != "", F.concat(F.lit(" "), time)).otherwise("")).try_cast("timestamp_ntz")


@dataclass(frozen=True)
class DateRule:
    pattern: str = "yyyy-MM-dd"
    shift: tuple[int, int] | None = None


def parse_date_rule(rule: str) -> DateRule:
    """`DATE:<pattern>[:SHIFT(lo,hi)]`; an unusable pattern falls back to yyyy-MM-dd."""
    body = rule.split(":", 1)[1].strip() if ":" in rule else rule.strip()
    shift = None
    found = re.search(r"shift\(\s*(-?\d+)\s*,\s*(-?\d+)[^)]*\)", body, re.I)
    if found:
        lo, hi = int(found[1]), int(found[2])
        if lo > hi:
            raise ValueError(f"empty shift range in {rule!r}")
        shift = (lo, hi)
        cut = body.rfind(":", 0, found.start())
        body = body[:cut].strip() if cut > 0 else ""
    return DateRule(body if _usable_pattern(body) else "yyyy-MM-dd", shift)


def _usable_pattern(pattern: str) -> bool:
    if not pattern or pattern.count("'") % 2:
        return False
    return all(ch in _PATTERN_LETTERS for ch in re.sub(r"'[^']*'", "", pattern) if ch.isalpha())


def format_date(c: Column, dtype: T.DataType, rule: DateRule, key: str, label: str, seed: Column | None) -> Column:
    """Print a date with the rule's pattern; date and timestamp columns keep their type."""
    temporal = isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))
    moment = c.cast("timestamp_ntz") if temporal else parse_date_text(c)
    h = keyed_hash(c, key, f"{label}.date", seed)
    spread = [44, 12, 28, 24, 60, 60]  # year from 1980, month, day, hour, minute, second
    parts, div = [], 1
    for below in spread:
        parts.append(digit(h, below, div).cast("int"))
        div *= below
    random_moment = F.make_timestamp_ntz(
        parts[0] + 1980, parts[1] + 1, parts[2] + 1, parts[3], parts[4], parts[5].cast("decimal(8,6)")
    )
    moment = F.coalesce(moment, random_moment)
    if rule.shift:
        lo, hi = rule.shift
        days = (F.lit(lo) + digit(keyed_hash(c, key, f"{label}.shift", seed), hi - lo + 1)).cast("int")
        moment = moment + F.make_dt_interval(days)
    return moment.cast(dtype) if temporal else F.date_format(moment, rule.pattern)


# ---------------------------------------------------------------- text

_TOKEN = re.compile(r"\{rand(?:_(alpha|num|digit))?:(\d+)\}", re.I)
_KIND = {None: "alnum", "alpha": "alpha", "num": "digit", "digit": "digit"}


def text_template(c: Column, template: str, key: str, label: str, seed: Column | None = None) -> Column:
    """`ORD-{rand_alpha:3}-{rand_num:4}` and the like; text outside the braces is kept."""
    pieces, at = [], 0
    for i, m in enumerate(_TOKEN.finditer(template)):
        if m.start() > at:
            pieces.append(F.lit(template[at : m.start()]))
        kind = _KIND[m[1].lower() if m[1] else None]
        pieces.append(random_chars(c, int(m[2]), kind, key, f"{label}.text{i}", seed))
        at = m.end()
    if at < len(template):
        pieces.append(F.lit(template[at:]))
    return F.concat(*pieces) if pieces else F.lit("")


def char_pattern(c: Column, pattern: str, key: str, label: str, seed: Column | None = None) -> Column:
    """`##-XX`: each # is a digit, each X a capital letter, anything else stays."""
    pieces = []
    for i, m in enumerate(re.finditer(r"#+|X+|[^#X]+", pattern)):
        run = m[0]
        if run[0] in "#X":
            kind = "digit" if run[0] == "#" else "alpha"
            pieces.append(random_chars(c, len(run), kind, key, f"{label}.mark{i}", seed))
        else:
            pieces.append(F.lit(run))
    return F.concat(*pieces) if pieces else F.lit("")


_OPEN_ENDED = 4  # extra repeats tried for + and *


def text_from_regex(c: Column, regex: str, key: str, label: str, seed: Column | None = None) -> Column:
    """A text that matches `regex` (literals, classes, groups, alternation, repeats), by built-in functions alone.

    A regex outside that subset gives `VAL-` and four digits. Where texts must differ, `regextext.unique_text` numbers them.
    """
    try:
        return _regex_piece(c, read_regex(regex), key, f"{label}.re", seed)
    except ValueError:
        h = keyed_hash(c, key, f"{label}.re", seed)
        return F.concat(F.lit("VAL-"), (digit(h, 8999) + 1000).cast("string"))


def _regex_piece(c, node, key, label, seed) -> Column:
    if node[0] == "chars":
        return F.lit(node[1]) if len(node[1]) == 1 else pick(list(node[1]), keyed_hash(c, key, label, seed))
    if node[0] == "cat":
        out = [_regex_piece(c, part, key, f"{label}.{i}", seed) for i, part in enumerate(node[1])]
        return F.concat(*out) if out else F.lit("")
    if node[0] == "alt":
        options = [_regex_piece(c, option, key, f"{label}.b{i}", seed) for i, option in enumerate(node[1])]
        choice = digit(keyed_hash(c, key, f"{label}.choice", seed), len(options)) + 1
        return F.element_at(F.array(*options), choice.cast("int"))
    _, low, high, body = node
    high = low + _OPEN_ENDED if high is None else high
    copies = [_regex_piece(c, body, key, f"{label}.r{i}", seed) for i in range(high)]
    if low == high:
        return F.concat(*copies) if copies else F.lit("")
    count = digit(keyed_hash(c, key, f"{label}.count", seed), high - low + 1) + low
    return F.array_join(F.slice(F.array(*copies), F.lit(1), count.cast("int")), "")


# ---------------------------------------------------------------- numbers


@dataclass(frozen=True)
class NumberRule:
    sign: int = 0
    whole: bool = False
    scale: int | None = None
    low: float | None = None
    high: float | None = None


def parse_number_rule(rule: str) -> NumberRule:
    body = rule.split(":", 1)[1] if ":" in rule else rule
    sign, whole, scale, low, high = 0, False, None, None, None
    for token in (t.strip().upper() for t in body.split(":")):
        if token in ("POSITIVE", "POS", "ABS"):
            sign = 1
        elif token in ("NEGATIVE", "NEG"):
            sign = sign or -1
        elif token in ("INTEGER", "WHOLE"):
            whole, scale = True, 0
        elif m := re.fullmatch(r"SCALE\(\s*(\d+)\s*\)", token):
            scale = int(m[1])
        elif m := re.fullmatch(r"RANGE\(\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*\)", token):
            low, high = float(m[1]), float(m[2])
    return NumberRule(sign, whole, scale, low, high)


_WIDE = "decimal(38,10)"
_BOUNDS = {
    T.ByteType: (-(2**7), 2**7 - 1),
    T.ShortType: (-(2**15), 2**15 - 1),
    T.IntegerType: (-(2**31), 2**31 - 1),
    T.LongType: (-(2**63), 2**63 - 1),
}


def format_number(c: Column, dtype: T.DataType, rule: NumberRule, key: str, label: str, seed: Column | None) -> Column:
    """Clamp to the range, set the sign, round half up; the result keeps the column's type.

    Floats and doubles are computed as such, other numbers as decimals that hold the column's type. A readable text
    that needs more than 38 digits is an error.
    """
    numeric, floating = isinstance(dtype, T.NumericType), isinstance(dtype, (T.FloatType, T.DoubleType))
    wide = dtype.simpleString() if floating else _wide(dtype, rule)
    low = 10.0 if rule.low is None else rule.low
    high = 10000.0 if rule.high is None else rule.high
    step = digit(keyed_hash(c, key, f"{label}.num", seed), 1_000_000)
    spread = F.lit(repr(high - low)).cast("decimal(18,4)") * step / F.lit(1_000_000)
    drawn = (F.lit(repr(low)).cast("decimal(18,4)") + spread).cast(_WIDE).cast(wide)
    if floating:
        value = F.when(~F.isnan(c), c)
    elif numeric:
        value = c.cast(wide)
    else:
        text = F.regexp_replace(c.cast("string"), "[^0-9.-]", "")
        value = text.try_cast(wide)
        places = F.lit(0)
        if rule.scale is None:  # with a scale, what goes beyond it is rounded
            places = F.length(F.regexp_extract(text, r"\.(\d*?)0*$", 1))
        readable = text.rlike(r"^-?(\d+\.?\d*|\.\d+)$")
        error = F.raise_error(F.lit(f"{label}: a number in a text does not fit into {wide}")).cast(wide)
        value = F.when(readable & (value.isNull() | (places > int(wide[:-1].split(",")[1]))), error).otherwise(value)
    value = F.coalesce(value, drawn)
    if rule.low is not None:
        value = F.greatest(value, F.lit(repr(rule.low)).cast(wide))
    if rule.high is not None:
        value = F.least(value, F.lit(repr(rule.high)).cast(wide))
    if rule.sign:
        value = F.abs(value) if rule.sign > 0 else -F.abs(value)
    if rule.scale is not None:
        value = F.round(value, rule.scale)
    if isinstance(dtype, T.IntegralType):
        lo, hi = _BOUNDS[type(dtype)]
        return F.greatest(F.least(value, F.lit(str(hi)).cast(_WIDE)), F.lit(str(lo)).cast(_WIDE)).cast(dtype)
    if numeric:
        return value.try_cast(dtype)
    if rule.whole:
        return value.cast("decimal(38,0)").cast("string")
    if rule.scale is not None:
        return value.cast(f"decimal(38,{rule.scale})").cast("string")
    return F.regexp_replace(value.cast("string"), r"\.?0+$", "")


def _wide(dtype: T.DataType, rule: NumberRule) -> str:
    """A decimal type that holds the column's type, with ten digits of fraction (or as many as the rule asks) where there is room."""
    scale = max(10, rule.scale or 0)
    if isinstance(dtype, T.DecimalType):
        scale = max(dtype.scale, min(scale, 38 - (dtype.precision - dtype.scale)))
    elif isinstance(dtype, T.StringType) and rule.whole:
        scale = 0
    return f"decimal(38,{min(scale, 38)})"


# ---------------------------------------------------------------- dispatch


def apply_format(
    c: Column, dtype: T.DataType, rule: str, key: str, label: str, seed: Column | None = None
) -> Column:
    """Choose date, text or number by the rule's prefix, else by what the rule looks like and the column's type."""
    rule = rule.strip()
    head = rule.upper()
    if head.startswith(("DATE:", "DATE_PATTERN:", "DATE_SHIFT:")):
        return format_date(c, dtype, parse_date_rule(rule), key, label, seed)
    if head.startswith("REGEX:"):
        return text_from_regex(c, rule[6:].strip(), key, label, seed)
    if head.startswith("TEXT:"):
        return text_template(c, rule[5:].strip(), key, label, seed)
    if head.startswith("TEMPLATE:"):
        return text_template(c, rule[9:].strip(), key, label, seed)
    if head.startswith(("NUM:", "NUMBER:")):
        return format_number(c, dtype, parse_number_rule(rule), key, label, seed)
    if any(mark in rule for mark in ("yyyy", "MM", "dd")):
        return format_date(c, dtype, parse_date_rule("DATE:" + rule), key, label, seed)
    if "{rand" in rule.lower():
        return text_template(c, rule, key, label, seed)
    if isinstance(dtype, T.NumericType):
        return format_number(c, dtype, parse_number_rule("NUM:" + rule), key, label, seed)
    return text_template(c, rule, key, label, seed)


def numeric_variance(c: Column, dtype: T.DataType, percent: float, key: str, label: str) -> Column:
    """Noise of at most `percent` either way, drawn from the value and the key."""
    unit = (digit(keyed_hash(c, key, f"{label}.var"), 2_000_001) - 1_000_000) / F.lit(1_000_000.0)
    return (c.cast("double") * (F.lit(1.0) + F.lit(percent / 100.0) * unit)).cast(dtype)


__all__ = [
    "apply_format", "char_pattern", "format_date", "format_number", "int_div", "numeric_variance",
    "parse_date_rule", "parse_date_text", "parse_number_rule", "text_from_regex", "text_template",
]
