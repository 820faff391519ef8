"""Keyed, repeatable replacement for randomness.

Every value that the masking language calls random is drawn from a keyed SHA-256 of the input value. A recomputed
partition therefore gives the same output, equal inputs get equal replacements, and plain SQL can check the result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE26_DIGITS = "0123456789ABCDEFGHIJKLMNOP"
# characters one 60-bit hash can supply, by radix
_BLOCK = {10: 15, 26: 12, 36: 11}


def require_key(key: str | None) -> str:
    """There is no default key: a missing one is an error, never a silent constant."""
    if key is None or not key.strip():
        raise ValueError("a masking key is required")
    return key.strip()


def subkey(key: str, label: str) -> str:
    """What stands in a plan for the key: plans are printed and logged, so the key itself never enters one."""
    return hashlib.sha256(f"{key}|{label}".encode()).hexdigest()[:32] + "|"


def keyed_hash(value: Column, key: str, label: str, seed: Column | None = None) -> Column:
    """60-bit non-negative hash of `value` under `key`.

    Without a seed a null gives null, which keeps nulls through every function built on it; with one the seed (and
    at last the empty text) stands in, so that a format can fill a null.
    """
    text = value.cast("string")
    if seed is not None:
        text = F.coalesce(text, seed.cast("string"), F.lit(""))
    text = F.concat(F.lit(subkey(key, label)), text)
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def int_div(a: Column, b: int | Column) -> Column:
    """Exact integer division (the `/` operator would go through double)."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def digit(h: Column, below: int, divisor: int = 1) -> Column:
    """The mixed-radix digit of `h` in [0, below) after dropping a factor `divisor`."""
    return (h if divisor == 1 else int_div(h, divisor)) % F.lit(below).cast("long")


def pick(words: list[str], h: Column, divisor: int = 1) -> Column:
    """One word of a literal list (the list folds into a constant in the plan)."""
    quoted = ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return F.get(F.expr(f"array({quoted})"), digit(h, len(words), divisor).cast("int"))


def padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def random_chars(value: Column, n: int, kind: str, key: str, label: str, seed: Column | None = None) -> Column:
    """`n` characters: kind `digit` (0-9), `alpha` (A-Z) or `alnum` (0-9A-Z)."""
    radix = {"digit": 10, "alpha": 26, "alnum": 36}[kind]
    pieces, block = [], 0
    while n > 0:
        width = min(n, _BLOCK[radix])
        h = keyed_hash(value, key, f"{label}.{block}", seed) % F.lit(radix**width).cast("long")
        text = h.cast("string") if radix == 10 else F.conv(h.cast("string"), 10, radix)
        text = F.lpad(text, width, "0")
        pieces.append(F.translate(text, _BASE26_DIGITS, ALPHA) if kind == "alpha" else text)
        n, block = n - width, block + 1
    return F.concat(*pieces) if pieces else F.lit("")


class Bindings:
    """Named intermediate columns computed in projections below the final one.

    An expression used many times inside another would be copied into it each time; bound to a column it is computed
    once per row, within the same generated stage.
    """

    def __init__(self) -> None:
        self.steps: list[dict[str, Column]] = []
        self._count = 0

    def name(self) -> str:
        self._count += 1
        return f"__vf{self._count}"

    def at(self, level: int, name: str, expr: Column) -> Column:
        while len(self.steps) <= level:
            self.steps.append({})
        self.steps[level][name] = expr
        return F.col(name)

    def apply(self, df):
        for step in self.steps:
            df = df.withColumns(step)
        return df
