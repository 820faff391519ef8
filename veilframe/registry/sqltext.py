"""SQL text builders for the checks: the same definitions, written for DuckDB."""

from __future__ import annotations

from veilframe.functions import synthetic as syn
from veilframe.functions.fpe import PRIMES, feistel_int, round_constants, split_domain
from veilframe.functions.hashing import subkey

KEY = "registry-key-001"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "[" + ", ".join(quote(w) for w in items) + "]"


def khash(x: str, label: str, key: str = KEY) -> str:
    return f"('0x' || substr(sha256({quote(subkey(key, label))} || CAST({x} AS VARCHAR)), 1, 15))::BIGINT"


def digit(h: str, below: int, divisor: int = 1) -> str:
    return f"(({h}) // {divisor} % {below})" if divisor != 1 else f"(({h}) % {below})"


def pick(items, h: str, divisor: int = 1) -> str:
    return f"{words(items)}[{digit(h, len(items), divisor)} + 1]"


def pad(x: str, n: int) -> str:
    return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"


def chars(x: str, n: int, kind: str, label: str, key: str = KEY) -> str:
    """`n` characters, at most one hash block."""
    radix = {"digit": 10, "alpha": 26, "alnum": 36}[kind]
    h = f"({khash(x, f'{label}.0', key)} % {radix ** n})"
    text = f"lpad(to_base({h}, {radix}), {n}, '0')"
    if kind == "alpha":
        return f"translate({text}, '0123456789ABCDEFGHIJKLMNOP', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
    return text


def provider(name: str, x: str, label: str, key: str = KEY) -> str:
    h = khash(x, f"{label}.{name}", key)
    nf, nl = len(syn.FIRST_NAMES), len(syn.LAST_NAMES)
    if name == "first_name":
        return pick(syn.FIRST_NAMES, h)
    if name == "last_name":
        return pick(syn.LAST_NAMES, h)
    if name == "full_name":
        return f"{pick(syn.FIRST_NAMES, h)} || ' ' || {pick(syn.LAST_NAMES, h, nf)}"
    if name == "email":
        return (
            f"lower({pick(syn.FIRST_NAMES, h)}) || '.' || lower({pick(syn.LAST_NAMES, h, nf)}) || "
            f"CAST({digit(h, 100000, nf * nl)} AS VARCHAR) || '@example.com'"
        )
    if name == "phone":
        return f"'+1-555-' || {pad(digit(h, 1000), 3)} || '-' || {pad(digit(h, 10000, 1000), 4)}"
    if name == "street":
        return f"CAST({digit(h, 9999)} + 1 AS VARCHAR) || ' ' || {pick(syn.STREETS, h, 9999)}"
    if name == "full_address":
        div = 9999 * len(syn.STREETS)
        return (
            f"CAST({digit(h, 9999)} + 1 AS VARCHAR) || ' ' || {pick(syn.STREETS, h, 9999)} || ', ' || "
            f"{pick(syn.CITIES, h, div)} || ' ' || {pad(digit(h, 100000, div * len(syn.CITIES)), 5)}"
        )
    if name == "zip":
        return pad(digit(h, 100000), 5)
    if name == "ssn":
        return (
            f"{pad(digit(h, 665) + ' + 1', 3)} || '-' || {pad(digit(h, 99, 665) + ' + 1', 2)} || '-' || "
            f"{pad(digit(h, 9999, 665 * 99) + ' + 1', 4)}"
        )
    if name == "company":
        return f"{pick(syn.COMPANIES, h)} || ' ' || {pick(syn.COMPANY_FORMS, h, len(syn.COMPANIES))}"
    if name == "job":
        return f"{pick(syn.JOB_GRADES, h)} || ' ' || {pick(syn.JOBS, h, len(syn.JOB_GRADES))}"
    if name == "letters":
        return f"lower({chars(x, 10, 'alpha', f'{label}.letters', key)})"
    lists = {
        "city": syn.CITIES, "state": syn.STATES, "country": syn.COUNTRIES, "skill": syn.SKILLS, "word": syn.WORDS,
    }
    return pick(lists[name], h)


def uuid_from_md5(md5: str) -> str:
    nibble = f"['8','9','a','b'][(('0x' || substr(m, 17, 1))::BIGINT % 4) + 1]"
    body = (
        "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-3' || substr(m, 14, 3) || '-' || "
        f"{nibble} || substr(m, 18, 3) || '-' || substr(m, 21, 12)"
    )
    return body.replace("(m,", f"({md5},")


def hash_uuid(x: str, label: str, key: str = KEY) -> str:
    return uuid_from_md5(f"md5({quote(subkey(key, label + '.uuid'))} || CAST({x} AS VARCHAR))")


def feistel(source: str, value: str, lo: int, hi: int, label: str, out: str, key: str = KEY) -> str:
    """A subquery that adds `out`, the permuted `value`, to the rows of `source`."""
    size = hi - lo + 1
    index = f"CASE WHEN {value} BETWEEN {lo} AND {hi} THEN {value} - {lo} ELSE {khash(value, label + '.outside', key)} % {size} END"
    return permuted(source, f"CAST({index} AS BIGINT)", size, label, out, key, lo)


def permuted(source: str, index: str, size: int, label: str, out: str, key: str = KEY, lo: int = 0) -> str:
    constants = round_constants(key, label)
    a, b = split_domain(size)
    q = f"(SELECT *, {index} AS zi FROM {source})"
    q = f"(SELECT *, zi // {b} AS zl, zi % {b} AS zr FROM {q})"
    for i, c in enumerate(constants):
        x = "zr" if i % 2 == 0 else "zl"
        for j in range(3):
            x = f"(({x} * {c[j]} + {c[3 + j]}) % {PRIMES[j]})"
        target, below = ("zl", a) if i % 2 == 0 else ("zr", b)
        q = f"(SELECT * REPLACE (({target} + {x}) % {below} AS {target}) FROM {q})"
    raw = f"(zl * {b} + zr)"
    surplus = [feistel_int(p, size, constants) for p in range(size, a * b)]
    if surplus:
        listed = "[" + ", ".join(f"{w}::BIGINT" for w in surplus) + "]"
        raw = f"CASE WHEN {raw} >= {size} THEN {listed}[{raw} - {size} + 1] ELSE {raw} END"
    return f"(SELECT * EXCLUDE (zi, zl, zr), {raw} + {lo} AS {out} FROM {q})"
