"""Fixed replacements and partial masks."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nullify(dtype: T.DataType, as_text: bool = False) -> Column:
    """NULL of the column's type, or the empty text in comma-separated files."""
    return F.lit("") if as_text else F.lit(None).cast(dtype)


def default_value(value: str | None, dtype: T.DataType) -> Column:
    """A constant of the column's type; the word null gives NULL.

    The literal is checked while the plan is built. Text that does not fit the type stays text, so the column
    becomes a string column, as a text default in a numeric column does in the source data.
    """
    if value is None or value.strip().lower() == "null":
        return F.lit(None).cast(dtype)
    text = value.strip()
    try:
        if isinstance(dtype, T.IntegralType):
            bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}[type(dtype)]
            number = int(text)
            if not -(2 ** (bits - 1)) <= number < 2 ** (bits - 1):
                raise ValueError(text)
            return F.lit(number).cast(dtype)
        if isinstance(dtype, T.DecimalType):
            number = Decimal(text)
            if abs(number) >= Decimal(10) ** (dtype.precision - dtype.scale):
                raise ValueError(text)
            return F.lit(text).cast(dtype)
        if isinstance(dtype, T.FractionalType):
            return F.lit(float(text)).cast(dtype)
        if isinstance(dtype, T.BooleanType):
            return F.lit(text.lower() == "true")
        if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(dt.datetime.fromisoformat(text).replace(tzinfo=None).isoformat(" ")).cast(dtype)
    except (ValueError, InvalidOperation):
        return F.lit(value)
    return F.lit(value)


def keep_last4(c: Column, fill: str = "X", mask_short: bool = False) -> Column:
    """All but the last four characters replaced; short values stay, or are filled with `mask_short`."""
    n = F.length(c)
    short = F.repeat(F.lit(fill), n) if mask_short else c
    return F.when(n <= 4, short).otherwise(F.concat(F.repeat(F.lit(fill), n - 4), F.right(c, F.lit(4))))


def fixed_prefix(c: Column) -> Column:
    """Four stars and the last four characters, or four stars alone; hides the length."""
    return F.when(c.isNull(), F.lit(None).cast("string")).when(F.length(c) <= 4, "****").otherwise(
        F.concat(F.lit("****"), F.right(c, F.lit(4)))
    )


def keep_ends(c: Column) -> Column:
    """Keeps up to two characters at each end (a quarter of the length), all stars up to length three."""
    n = F.length(c)
    keep = F.least(F.lit(2), F.shiftright(n, 2))
    return F.when(n <= 3, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(c, F.lit(1), keep), F.repeat(F.lit("*"), n - keep * 2), F.right(c, keep))
    )


def redact(c: Column, rule: str) -> Column:
    """The preview's "before" text: a fixed mark where a rule applies, N/A for an unruled null."""
    if rule != "NONE":
        return F.lit(f"•••••••• [{rule} PROTECTED]")
    return F.coalesce(c.cast("string"), F.lit("N/A"))
