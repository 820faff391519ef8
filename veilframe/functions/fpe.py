"""Format-preserving encryption.

Numbers: a keyed generalised Feistel network over Z_a x Z_b with a*b equal to, or just above, the size of the domain.
It is written as built-in arithmetic, so it stays inside whole-stage code generation, and because the domain is met
almost exactly no open-ended cycle walk is needed: the few surplus points are resolved on the driver into a literal.

Text: the same network over the two halves of the string, adding digit by digit modulo each position's alphabet size.
No built-in can do that, so it runs as one vectorised Arrow function.

Promises: same key and value give the same result, distinct values of one domain stay distinct, length and character
class are kept, a null stays null, and a value that cannot be handled is an error rather than passed through.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.hashing import Bindings, digit, int_div, keyed_hash, require_key, subkey
from veilframe.functions.synthetic import uuid_layout

HALF_ROUNDS = 6
# three primes below 2^31, so that every product fits a signed 64-bit integer
PRIMES = (2147483647, 2147483629, 2147483587)

# Inclusive bounds per integer type.
DOMAINS = {
    "byte": (1, 127),
    "short": (1, 32767),
    "int": (1, 2147483647),
    "long": (1, 9223372036854775806),
}


def round_constants(key: str, label: str) -> list[tuple[int, ...]]:
    """Three multipliers and three offsets per half round, from SHA-256 of the key."""
    out = []
    for i in range(HALF_ROUNDS):
        raw = hashlib.sha256(f"veil.feistel|{label}|{i}|{key}".encode()).digest()
        words = [int.from_bytes(raw[4 * j : 4 * j + 4], "big") for j in range(6)]
        out.append(tuple(1 + w % (2**30 - 1) for w in words))
    return out


@lru_cache(maxsize=512)
def split_domain(size: int) -> tuple[int, int]:
    """Factors (a, b), a <= b, whose product is the smallest found that is not below `size`."""
    root = math.isqrt(size)
    low = max(1, root // 4)
    if root - low > 2_000_000:
        low = root - 2_000_000
    candidates = np.arange(low, root + 1, dtype=np.int64)
    special = [2**31 - 1] if low > 2**31 - 1 or root > 2**31 else []
    surplus = (-size) % candidates if size < 2**63 else None
    best = int(candidates[::-1][int(np.argmin(surplus[::-1]))])
    for a in special:
        if (-size) % a < (-size) % best:
            best = a
    return best, -(-size // best)


def mix(x, c):
    """Round function; works on columns and on Python integers alike. Only needs x < 2^33."""
    x = (x * c[0] + c[3]) % PRIMES[0]
    x = (x * c[1] + c[4]) % PRIMES[1]
    return (x * c[2] + c[5]) % PRIMES[2]


def feistel_int(value: int, size: int, constants) -> int:
    """The permutation of [0, size) on the driver, surplus points walked; used for literals and tests."""
    a, b = split_domain(size)
    while True:
        left, right = value // b, value % b
        for i, c in enumerate(constants):
            if i % 2 == 0:
                left = (left + mix(right, c)) % a
            else:
                right = (right + mix(left, c)) % b
        value = left * b + right
        if value < size:
            return value


def _walk_surplus(size: int, constants) -> list[int]:
    a, b = split_domain(size)
    return [feistel_int(point, size, constants) for point in range(size, a * b)]


def walk_table(out: Column, size: int, constants) -> Column:
    """Resolve the surplus points of the network, whose images are known when the plan is built."""
    walked = _walk_surplus(size, constants)
    if not walked:
        return out
    if len(walked) == 1:
        return F.when(out >= size, F.lit(walked[0]).cast("long")).otherwise(out)
    table = F.array(*[F.lit(w).cast("long") for w in walked])
    return F.when(out >= size, F.element_at(table, (out - size + 1).cast("int"))).otherwise(out)


def permute(index: Column, size: int, key: str, label: str = "") -> Column:
    """A keyed bijection of [0, size) as a plain column expression; `index` must be a long in that range."""
    if size < 1:
        raise ValueError("empty domain")
    if size == 1:
        return F.when(index.isNotNull(), F.lit(0).cast("long"))
    constants = round_constants(key, label)
    a, b = split_domain(size)
    left, right = int_div(index, b), index % F.lit(b).cast("long")
    for i, c in enumerate(constants):
        if i % 2 == 0:
            left = (left + mix(right, [F.lit(x).cast("long") for x in c])) % F.lit(a).cast("long")
        else:
            right = (right + mix(left, [F.lit(x).cast("long") for x in c])) % F.lit(b).cast("long")
    out = left * F.lit(b).cast("long") + right
    return walk_table(out, size, constants)


def _index(c: Column, lo: int, hi: int, key: str, label: str) -> Column:
    """Zero-based position in [lo, hi]; a value outside is first hashed into the range."""
    size = hi - lo + 1
    value = c.cast("long")
    outside = keyed_hash(value, key, f"{label}.outside") % F.lit(size).cast("long")
    return F.when(value.between(lo, hi), value - lo).otherwise(outside)


def permute_range(c: Column, lo: int, hi: int, key: str, label: str = "") -> Column:
    """Bijection of [lo, hi] as one expression, for use inside any plan."""
    return permute(_index(c, lo, hi, key, label), hi - lo + 1, key, label) + F.lit(lo).cast("long")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once; for use inside array functions, where columns cannot be bound."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def permute_element(c: Column, lo: int, hi: int, key: str, label: str = "") -> Column:
    """The same bijection for elements of an array: each half round is bound by a one-element array."""
    size = hi - lo + 1
    if size == 1:
        return F.when(c.isNotNull(), F.lit(lo).cast("long"))
    constants = round_constants(key, label)
    a, b = (F.lit(x).cast("long") for x in split_domain(size))

    def step(i: int, s: Column) -> Column:
        left, right = s.getField("l"), s.getField("r")
        if i == HALF_ROUNDS:
            return let(left * b + right, lambda out: walk_table(out, size, constants) + F.lit(lo))
        c6 = [F.lit(x).cast("long") for x in constants[i]]
        if i % 2 == 0:
            left = (left + mix(right, c6)) % a
        else:
            right = (right + mix(left, c6)) % b
        return let(F.struct(left.alias("l"), right.alias("r")), lambda t: step(i + 1, t))

    def halves(i: Column) -> Column:
        return let(F.struct(int_div(i, b).alias("l"), (i % b).alias("r")), lambda t: step(0, t))

    return let(_index(c, lo, hi, key, label), halves)


class BoundPermuter:
    """The same bijection with one bound column per half round, so plans with many keys stay small."""

    def __init__(self, bindings: Bindings) -> None:
        self.bindings = bindings

    def __call__(self, c: Column, lo: int, hi: int, key: str, label: str = "") -> Column:
        size, name, bind = hi - lo + 1, self.bindings.name(), self.bindings.at
        if size == 1:
            return F.when(c.isNotNull(), F.lit(lo).cast("long"))
        constants = round_constants(key, label)
        a, b = split_domain(size)
        index = f"{name}i"
        bind(0, index, _index(c, lo, hi, key, label))
        left, right = f"({index} div {b}L)", f"({index} % {b}L)"
        for i, c6 in enumerate(constants):
            at, source, below = (left, right, a) if i % 2 == 0 else (right, left, b)
            new = f"{name}h{i}"
            bind(1 + i, new, F.expr(f"({at} + {_mix_sql(source, c6)}) % {below}L"))
            left, right = (new, right) if i % 2 == 0 else (left, new)
        out = bind(1 + HALF_ROUNDS, f"{name}o", F.expr(f"{left} * {b}L + {right}"))
        return walk_table(out, size, constants) + F.lit(lo)


    def spans(self, c: Column, spans: tuple[tuple[int, int], ...], key: str, label: str) -> Column:
        """`permute_spans` with one bound column per half round."""
        name, bind = self.bindings.name(), self.bindings.at
        constants = round_constants(key, label)
        for part, value in span_parts(c, spans).items():
            bind(0, f"{name}{part}", value)
        left, right = f"({name}i div {name}b)", f"({name}i % {name}b)"
        for i, c6 in enumerate(constants):
            at, source, below = (left, right, "a") if i % 2 == 0 else (right, left, "b")
            new = f"{name}h{i}"
            bind(1 + i, new, F.expr(f"({at} + {_mix_sql(source, c6)}) % {name}{below}"))
            left, right = (new, right) if i % 2 == 0 else (left, new)
        out = bind(1 + HALF_ROUNDS, f"{name}o", F.expr(f"{left} * {name}b + {right}"))
        return place_in_span(c, spans, out, F.col(f"{name}lo"), constants)


def _mix_sql(x: str, c: tuple[int, ...]) -> str:
    x = f"(({x} * {c[0]}L + {c[3]}L) % {PRIMES[0]}L)"
    x = f"(({x} * {c[1]}L + {c[4]}L) % {PRIMES[1]}L)"
    return f"(({x} * {c[2]}L + {c[5]}L) % {PRIMES[2]}L)"


# ---------------------------------------------------------------- keys of a whole type

_BITS = {"byte": 8, "short": 16, "int": 32, "long": 64}


def key_spans(own: str, domain: str) -> tuple[tuple[int, int], ...]:
    """Ranges that each map onto themselves: the domain, its negatives, and shells up to the column's own type.

    A column of a wider type has the spans of a narrower one and more, so both encrypt what both can hold alike. Only zero,
    and the largest long where the domain is long, lie in no span.
    """
    widths = list(_BITS)
    top, low = DOMAINS[domain][1], -(2 ** (_BITS[domain] - 1))
    out = [(1, top), (low, -1)]
    for wider in widths[widths.index(domain) + 1 : widths.index(own) + 1]:
        end = 2 ** (_BITS[wider] - 1)
        out += [(top + 1, end - 1), (-end, low - 1)]
        top, low = end - 1, -end
    return tuple(out)


def split_span(size: int) -> tuple[int, int]:
    """`split_domain`, for sizes up to 2^63; the large spans of `key_spans` are multiples of 2^31."""
    return (2**31, size // 2**31) if size >= 2**62 and size % 2**31 == 0 else split_domain(size)


def span_parts(c: Column, spans: tuple[tuple[int, int], ...]) -> dict[str, Column]:
    """Of the span a value lies in: its place there (`i`), the factors of its size (`a`, `b`) and its start (`lo`)."""
    value = c.cast("long")

    def choose(of) -> Column:
        out = None
        for lo, hi in spans:
            inside, this = value.between(lo, hi), of(lo, hi)
            out = F.when(inside, this) if out is None else out.when(inside, this)
        return out

    def whole(n: int) -> Column:
        return F.lit(n).cast("long")

    return {
        "i": choose(lambda lo, hi: value - whole(lo)), "lo": choose(lambda lo, hi: whole(lo)),
        "a": choose(lambda lo, hi: whole(split_span(hi - lo + 1)[0])), "b": choose(lambda lo, hi: whole(split_span(hi - lo + 1)[1])),
    }


def place_in_span(c: Column, spans: tuple[tuple[int, int], ...], out: Column, start: Column, constants) -> Column:
    """The network's result as a value of the span again; a value of no span stays."""
    at = None
    for lo, hi in spans:
        size = hi - lo + 1
        a, b = split_span(size)
        if a * b > size:
            walked = walk_table(out, size, constants)
            at = F.when(start == lo, walked) if at is None else at.when(start == lo, walked)
    at = out if at is None else at.otherwise(out)
    return F.when(start.isNull(), c.cast("long")).otherwise(at + start)


def permute_spans(c: Column, spans: tuple[tuple[int, int], ...], key: str, label: str) -> Column:
    """A keyed permutation within each span as one expression, for array elements and plain expressions."""
    constants = round_constants(key, label)

    def step(i: int, s: Column) -> Column:
        left, right, a, b = (s.getField(n) for n in ("l", "r", "a", "b"))
        if i == HALF_ROUNDS:
            return let(left * b + right, lambda out: place_in_span(c, spans, out, s.getField("lo"), constants))
        c6 = [F.lit(x).cast("long") for x in constants[i]]
        if i % 2 == 0:
            left = (left + mix(right, c6)) % a
        else:
            right = (right + mix(left, c6)) % b
        state = F.struct(left.alias("l"), right.alias("r"), a.alias("a"), b.alias("b"), s.getField("lo").alias("lo"))
        return let(state, lambda t: step(i + 1, t))

    def halves(s: Column) -> Column:
        i, b = s.getField("i"), s.getField("b")
        parts = [F.call_function("div", i, b).alias("l"), (i % b).alias("r"), *[s.getField(n).alias(n) for n in ("a", "b", "lo")]]
        return let(F.struct(*parts), lambda t: step(0, t))

    return let(F.struct(*[v.alias(n) for n, v in span_parts(c, spans).items()]), halves)


def fpe_key(c: Column, own: str, domain: str, key: str, permuter=permute_range) -> Column:
    """Integers of the type `own`, one to one over the whole type.

    Values of `domain` are encrypted as by `fpe_int`; negatives and values beyond the domain within spans of their own, so
    they never meet a value of the domain. Zero stays zero. Columns that join must be given the same domain.
    """
    spans, label = key_spans(own, domain), f"int.{domain}"
    permuted = permuter.spans if isinstance(permuter, BoundPermuter) else permute_spans
    return permuted(c, spans, require_key(key), label)


def fpe_int(c: Column, domain: str, key: str, permuter=permute_range) -> Column:
    """Integer columns. Columns that join must be given the same domain."""
    lo, hi = DOMAINS[domain]
    return permuter(c, lo, hi, require_key(key), f"int.{domain}")


def fpe_fraction(c: Column, dtype: T.DataType, key: str, permuter=permute_range) -> Column:
    """Float and double: whole part permuted, fraction from the keyed hash; always positive. Not injective."""
    key = require_key(key)
    narrow = isinstance(dtype, T.FloatType)
    top, unit = (10**6, 1000) if narrow else (10**9, 10_000)
    size = F.abs(c.cast("double"))
    whole = F.greatest(F.least(size, F.lit(2.0**62)), F.lit(1.0)).cast("long")
    whole = F.when(c.isNotNull(), whole)
    fraction = digit(keyed_hash(c, key, "fraction"), unit) / F.lit(float(unit))
    return (permuter(whole, 1, top, key, "float" if narrow else "double") + fraction).cast(dtype)


def fpe_decimal(c: Column, precision: int, scale: int, key: str, permuter=permute_range, exact: bool = False) -> Column:
    """Decimals keep precision and scale: whole part permuted in [1, 10^9-1] or, above, in [10^9, 10^(p-s)-1], fraction
    shifted by a keyed hash.

    The shift depends on the whole part alone, so the pair (whole, fraction) maps one to one for whole parts from one
    on; the sign and a whole part of zero are folded into the positive range, unless `exact` asks for a mapping that is one
    to one over all values: then the sign stays, as do zero and a whole part of zero, whose fraction moves among the
    fractions above zero. A whole part of more than 18 digits and a scale of more than 17 are errors.
    """
    key = require_key(key)
    if scale > 17:
        raise ValueError(f"decimal({precision},{scale}) cannot be encrypted: more than 17 digits of fraction")
    digits = max(1, precision - scale)
    near, far = min(digits, 9), min(digits, 18)
    top = 10**near - 1
    size = F.abs(c.cast(T.DecimalType(38, scale)))
    floor = F.floor(size)
    if digits > far:
        error = F.raise_error(F.lit(f"a decimal with more than {far} whole digits cannot be encrypted")).cast(T.LongType())
        whole = F.when(floor >= F.lit(str(10**far)).cast("decimal(38,0)"), error).otherwise(floor.cast("long"))
    else:
        whole = floor.cast("long")
    small = whole == 0
    whole = F.when(c.isNotNull(), F.greatest(whole, F.lit(1).cast("long")))
    masked = permuter(F.least(whole, F.lit(top).cast("long")) if far > near else whole, 1, top, key, f"decimal.{near}")
    if far > near:
        large = permuter(F.when(whole > top, whole), top + 1, 10**far - 1, key, f"decimal.{far}.large")
        masked = F.when(whole > top, large).otherwise(masked)
    if exact:
        masked = F.when(small, F.lit(0).cast("long")).otherwise(masked)
    dtype = T.DecimalType(precision, scale)
    if scale == 0:
        return (F.when(c < 0, -masked).otherwise(masked) if exact else masked).cast(dtype)
    unit = 10**scale
    part = ((size % F.lit(1).cast("decimal(1,0)")) * F.lit(unit).cast(T.DecimalType(scale + 1, 0))).cast("long")
    shift = keyed_hash(whole, key, "decimal.fraction")
    shifted = (part + shift % unit) % unit
    if exact:
        above_zero = (part - 1 + shift % (unit - 1)) % (unit - 1) + 1
        shifted = F.when(~small, shifted).otherwise(F.when(part > 0, above_zero).otherwise(part))
    text = F.concat(masked.cast("string"), F.lit("."), F.lpad(shifted.cast("string"), scale, "0"))
    return (F.concat(F.when(c < 0, "-").otherwise(""), text) if exact else text).cast(dtype)


def fpe_uuid(c: Column, key: str) -> Column:
    """One way: the name-based UUID of SHA-256(value + salt)."""
    return uuid_layout(F.md5(F.unhex(F.sha2(F.concat(c.cast("string"), F.lit(subkey(require_key(key), "uuid"))), 256))))


def fpe_bool(c: Column, key: str) -> Column:
    """Flipped or not, by the key: two values stay two values."""
    flip = hashlib.sha256(f"veil.bool|{require_key(key)}".encode()).digest()[0] % 2 == 1
    return c != F.lit(flip)


def hash_token(c: Column, key: str) -> Column:
    """`ENC_` and sixteen hex digits, for values that have no format to keep."""
    return F.concat(
        F.lit("ENC_"), F.substring(F.sha2(F.concat(F.lit(subkey(require_key(key), "token")), c.cast("string")), 256), 1, 16)
    )


# ---------------------------------------------------------------- text

_DIGITS = (48, 57)
_ROUNDS = 8
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LONG_ROW = 48
# characters encrypted per batch of equal-length strings, bounds the work arrays
_CHUNK = 1 << 16

# Alphabets, each a sequence of character ranges in digit order.
ALPHABETS = {
    "digits": ["09"],
    "hex_lower": ["09", "af"],
    "hex_upper": ["09", "AF"],
    "upper_digits": ["09", "AZ"],
    "lower_digits": ["09", "az"],
    "letters": ["AZ", "az"],
    "alphanumeric": ["09", "AZ", "az"],
    "printable": [" ~"],
}
_LISTS = {
    name: np.concatenate([np.arange(ord(lo), ord(hi) + 1) for lo, hi in ranges]).astype(np.uint32)
    for name, ranges in ALPHABETS.items()
}
# Blocks of other scripts, permuted among themselves (first code point, size).
_BLOCKS = [(0xA0, 0x60), (0x4E00, 0x5200), (0xAC00, 0x2B80)]


def _uint64_mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def _round_keys(key: str) -> list[bytes]:
    return [hashlib.sha256(f"veil.text|{i}|{key}".encode()).digest() for i in range(_ROUNDS)]


def _row_states(source: np.ndarray, key: bytes) -> np.ndarray:
    """A 64-bit number per row that depends on every digit and on the key.

    Long rows are hashed one by one, short ones all together with key-dependent odd weights.
    """
    if source.shape[1] >= _LONG_ROW:
        rows = np.ascontiguousarray(source)
        digests = b"".join(hashlib.blake2b(row, digest_size=8, key=key).digest() for row in rows)
        return np.frombuffer(digests, dtype="<u8")
    k = np.uint64(int.from_bytes(key[:8], "big"))
    places = _uint64_mix(np.arange(1, source.shape[1] + 1, dtype=np.uint64) * _M2 + k) | np.uint64(1)
    return (source.astype(np.uint64) + np.uint64(1)) @ places ^ k


def _draw(source: np.ndarray, radix: np.ndarray, key: bytes) -> np.ndarray:
    """One digit per cell of `radix`, from the states of the rows of `source`."""
    width = radix.shape[1]
    words = np.arange(1, (width + 1) // 2 + 1, dtype=np.uint64) * _M1
    halves = _uint64_mix(_row_states(source, key)[:, None] + words).view(np.uint32)[:, :width]
    scaled = np.multiply(halves, radix, dtype=np.uint64)
    return (scaled >> np.uint64(32)).astype(np.uint32)


def _add(digits: np.ndarray, draw: np.ndarray, radix: np.ndarray) -> np.ndarray:
    # unsigned: where the sum is below the radix, the difference wraps around and the minimum keeps the sum
    draw += digits
    return np.minimum(draw, draw - radix)


# Classes of text, the first that fits counts; `hex` needs exactly 24 characters.
_CLASSES = ("digits", "hex_lower", "hex_upper", "upper_digits", "lower_digits", "letters", "alphanumeric")


def _class_ids(codes: np.ndarray) -> np.ndarray:
    """Position of each row's class in `_CLASSES`, or its length for any other text."""
    is_digit = (codes >= 48) & (codes <= 57)
    is_upper = (codes >= 65) & (codes <= 90)
    is_lower = (codes >= 97) & (codes <= 122)
    is_letter = is_upper | is_lower
    fits = {
        "digits": is_digit, "upper_digits": is_digit | is_upper, "lower_digits": is_digit | is_lower,
        "letters": is_letter, "alphanumeric": is_digit | is_letter,
    }
    if codes.shape[1] == 24:
        fits["hex_lower"] = is_digit | ((codes >= 97) & (codes <= 102))
        fits["hex_upper"] = is_digit | ((codes >= 65) & (codes <= 70))
    ids = np.full(len(codes), len(_CLASSES))
    for i in range(len(_CLASSES) - 1, -1, -1):
        if _CLASSES[i] in fits:
            ids[fits[_CLASSES[i]].all(axis=1)] = i
    return ids


def _digits_and_radix(codes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Per character: its digit, the size of its alphabet, and how to turn digits back into characters."""
    value = np.zeros(codes.shape, dtype=np.uint32)
    radix = np.ones(codes.shape, dtype=np.uint32)
    decoders = []
    for i in np.unique(classes):
        rows = classes == i
        if i < len(_CLASSES):
            letters = _LISTS[_CLASSES[i]]
            value[rows] = np.searchsorted(letters, codes[rows])
            radix[rows] = len(letters)
            decoders.append((np.broadcast_to(rows[:, None], codes.shape), letters, None))
            continue
        open_cells = rows[:, None] & (codes >= 32) & (codes != 127)
        for first, size in [(32, 95)] + _BLOCKS:
            cells = open_cells & (codes >= first) & (codes < first + size)
            if cells.any():
                value[cells] = codes[cells] - np.uint32(first)
                radix[cells] = size
                decoders.append((cells, None, first))
                open_cells &= ~cells
        # any other script: pages of 64 code points; control characters (alphabet of one) keep their place
        cells = open_cells & (codes >= 256)
        if cells.any():
            value[cells] = codes[cells] & np.uint32(63)
            radix[cells] = 64
            decoders.append((cells, None, codes & ~np.uint32(63)))
    return value, radix, decoders


def encrypt_codes(codes: np.ndarray, key: str, round_keys: list[bytes]) -> np.ndarray:
    """Encrypt equal-length strings given as a (rows, length) array of code points.

    The alphabets overlap, so a result may look like another class; such a row is encrypted again until it has its
    class back. That walk along the permutation's cycle keeps all texts apart, not just those of one class.
    """
    classes = _class_ids(codes)
    out = _permute_codes(codes, classes, key, round_keys)
    astray = np.flatnonzero(_class_ids(out) != classes)
    while len(astray):
        out[astray] = _permute_codes(out[astray], classes[astray], key, round_keys)
        astray = astray[_class_ids(out[astray]) != classes[astray]]
    return out


def _permute_codes(codes: np.ndarray, classes: np.ndarray, key: str, round_keys: list[bytes]) -> np.ndarray:
    value, radix, decoders = _digits_and_radix(codes, classes)
    width = codes.shape[1]
    if width == 1:
        # a one-character string: a keyed permutation of its alphabet
        shuffled = np.zeros_like(value)
        for r in np.unique(radix):
            cells = radix == r
            shuffled[cells] = _small_table(int(r), key)[value[cells].astype(np.int64)]
        value = shuffled
    else:
        cut = width // 2
        left, right = value[:, :cut], value[:, cut:]
        radix_left, radix_right = radix[:, :cut], radix[:, cut:]
        for i, k in enumerate(round_keys):
            if i % 2 == 0:
                left = _add(left, _draw(right, radix_left, k), radix_left)
            else:
                right = _add(right, _draw(left, radix_right, k), radix_right)
        value = np.concatenate([left, right], axis=1)
    out = codes.copy()
    for cells, letters, base in decoders:
        digits = value[cells]
        if letters is not None:
            out[cells] = letters[digits]
        elif isinstance(base, int):
            out[cells] = digits + np.uint32(base)
        else:
            out[cells] = base[cells] + digits
    return out


def _small_table(radix: int, key: str) -> np.ndarray:
    draws = [hashlib.sha256(f"veil.char|{radix}|{i}|{key}".encode()).digest() for i in range(radix)]
    return np.argsort(np.array([int.from_bytes(d[:7], "big") for d in draws])).astype(np.uint32)


def encrypt_texts(values: list, key: str) -> list:
    """Encrypt a list of texts (None and '' pass through), grouped by length."""
    out, round_keys = list(values), _round_keys(key)
    lengths = np.fromiter((len(v) if v else 0 for v in values), dtype=np.int64, count=len(values))
    order = np.argsort(lengths, kind="stable")
    at = int(np.searchsorted(lengths[order], 1))
    while at < len(order):
        width = int(lengths[order[at]])
        end = int(np.searchsorted(lengths[order], width, side="right"))
        end = min(end, at + max(1, _CHUNK // width))
        rows = order[at:end]
        joined = "".join(values[r] for r in rows)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).reshape(len(rows), width)
        text = encrypt_codes(codes, key, round_keys).astype("<u4").tobytes().decode("utf-32-le")
        for i, r in enumerate(rows):
            out[r] = text[i * width : (i + 1) * width]
        at = end
    return out


def _text_function(key: str, depth: int):
    """The Arrow function for text nested in `depth` arrays."""
    dtype: T.DataType = T.StringType()
    for _ in range(depth):
        dtype = T.ArrayType(dtype)

    @F.arrow_udf(returnType=dtype)
    def encrypt(column: pa.Array) -> pa.Array:
        return _rebuild(column, key, depth)

    return encrypt


def _rebuild(column: pa.Array, key: str, depth: int) -> pa.Array:
    if depth == 0:
        if pa.types.is_null(column.type):
            return pa.nulls(len(column), pa.string())
        packed = column.dictionary_encode()
        words = pa.array(encrypt_texts(packed.dictionary.to_pylist(), key), type=pa.string())
        return pa.DictionaryArray.from_arrays(packed.indices, words).cast(pa.string())
    inner = _rebuild(column.flatten(), key, depth - 1)
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), type=pa.int32())
    return pa.ListArray.from_arrays(offsets, inner, mask=column.is_null())


def fpe_text(c: Column, key: str, max_length: int | None = None, depth: int = 0) -> Column:
    """Text: length and character class are kept. `depth` counts the arrays the text is nested in.

    A text longer than `max_length` is an error, since cut texts would meet.
    """
    masked = _text_function(require_key(key), depth)(c)
    if not max_length:
        return masked
    error = F.raise_error(F.lit(f"a text longer than its column ({max_length}) cannot be encrypted")).cast("string")
    return F.when(F.length(c) > max_length, error).otherwise(masked)


# SQL type names that select each family.
_TYPE_NAMES = {
    "int": ["integer", "int", "int4", "serial"],
    "long": ["long", "bigint", "int8", "bigserial"],
    "short": ["short", "smallint", "int2", "smallserial"],
    "byte": ["byte", "tinyint"],
    "float": ["float", "real", "float4"],
    "double": ["double", "float8", "double precision"],
    "decimal": ["numeric", "decimal", "money"],
    "uuid": ["uuid"],
    "boolean": ["boolean", "bool"],
}
_TEXT_HINTS = ("char", "text", "str", "varying", "varry")


def family_of(type_name: str) -> tuple[str, int | None]:
    """Family and optional length of an SQL type name such as `varchar(20)`."""
    base, _, rest = type_name.lower().strip().partition("(")
    base = base.strip()
    length = rest.split(")")[0].strip()
    for family, names in _TYPE_NAMES.items():
        if base in names:
            return family, None
    if any(h in base for h in _TEXT_HINTS):
        return "text", int(length) if length.isdigit() and int(length) > 0 else None
    return "other", None


def fpe(
    c: Column, type_name: str, key: str, precision: int | None = None, scale: int | None = None, permuter=permute_range
) -> Column:
    """Encrypt by SQL type name. Dates, times and binary have no domain and are an error; an unknown type is left as it is."""
    family, length = family_of(type_name)
    if family in DOMAINS:
        spark_type = {"byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint"}[family]
        return fpe_int(c, family, key, permuter).cast(spark_type)
    if family in ("float", "double"):
        return fpe_fraction(c, T.FloatType() if family == "float" else T.DoubleType(), key, permuter)
    if family == "decimal":
        return fpe_decimal(c, precision or 10, 0 if scale is None else scale, key, permuter)
    if family == "uuid":
        return fpe_uuid(c, key)
    if family == "boolean":
        return fpe_bool(c, key)
    if family == "text":
        return fpe_text(c.cast("string"), key, length)
    if type_name.strip().lower().startswith(("date", "time", "binary", "varbinary", "bytea", "blob", "longblob")):
        raise ValueError(f"values of type {type_name} cannot be encrypted; use a format or default rule for the column")
    return c


def _null_with(c: Column, masked: Column, dtype: T.DataType) -> Column:
    """`masked` where `c` is present.

    Said this way, a not-null test on the masked column (every join on it adds one) reduces to a not-null test on `c`,
    which the scan can take, instead of a copy of the whole network.
    """
    return F.when(c.isNotNull(), F.coalesce(masked, F.lit(1).cast(dtype)))


def fpe_column(
    c: Column,
    dtype: T.DataType,
    key: str,
    domain: str | None = None,
    logical: str | None = None,
    max_length: int | None = None,
    permuter=permute_range,
) -> Column:
    """Encrypt by Spark type; `domain` overrides the integer domain for columns that join to narrower ones.

    A column with a domain (`decimal` for decimals) is a declared key: it is encrypted one to one over all values of its type.
    """
    if logical == "uuid":
        return fpe_uuid(c, key)
    if isinstance(dtype, T.IntegralType):
        own = {T.ByteType: "byte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long"}[type(dtype)]
        number = fpe_key(c, own, domain, key, permuter) if domain else fpe_int(c, own, key, permuter)
        return _null_with(c, number.cast(dtype), dtype)
    if isinstance(dtype, T.DecimalType):
        return _null_with(c, fpe_decimal(c, dtype.precision, dtype.scale, key, permuter, domain is not None), dtype)
    if isinstance(dtype, T.FractionalType):
        return _null_with(c, fpe_fraction(c, dtype, key, permuter), dtype)
    if isinstance(dtype, T.BooleanType):
        return fpe_bool(c, key)
    if isinstance(dtype, T.StringType):
        return fpe_text(c, key, max_length)
    raise ValueError(f"values of type {dtype.simpleString()} cannot be encrypted; use a format or default rule for the column")
