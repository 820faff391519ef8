"""Reversible tokens and key strings."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.fpe import HALF_ROUNDS, mix, round_constants, split_domain
from veilframe.functions.hashing import int_div, require_key

# inverse-friendly domain of numeric tokens: an exact product of the two halves, so nothing is walked
NUMBER_SPAN = 2**62


def _aes_parts(key: str, salt: str) -> tuple[Column, Column]:
    key_bytes = hashlib.sha256(require_key(key).encode()).digest()
    iv = hashlib.md5(salt.encode()).digest()
    return F.lit(bytearray(key_bytes)), F.lit(bytearray(iv))


def tokenize(c: Column, key: str, salt: str) -> Column:
    """Base64 of AES-CBC with a fixed initialisation vector per salt: equal values give equal tokens."""
    secret, iv = _aes_parts(key, salt)
    return F.base64(F.aes_encrypt(F.encode(c.cast("string"), "utf-8"), secret, F.lit("CBC"), F.lit("PKCS"), iv))


def detokenize(c: Column, key: str, salt: str) -> Column:
    """The original text; NULL where the key is wrong or the token is damaged."""
    secret, _ = _aes_parts(key, salt)
    plain = F.try_aes_decrypt(F.unbase64(c), secret, F.lit("CBC"), F.lit("PKCS"))
    return F.decode(plain, "utf-8")


def tokenize_number(c: Column, key: str, salt: str) -> Column:
    """Reversible token of a long in [-2^61, 2^61)."""
    a, b = split_domain(NUMBER_SPAN)
    value = c.cast("long") + 2**61
    left, right = int_div(value, b), value % F.lit(b).cast("long")
    for i, constants in enumerate(round_constants(require_key(key), f"token.{salt}")):
        c6 = [F.lit(x).cast("long") for x in constants]
        if i % 2 == 0:
            left = (left + mix(right, c6)) % F.lit(a).cast("long")
        else:
            right = (right + mix(left, c6)) % F.lit(b).cast("long")
    return left * F.lit(b).cast("long") + right


def detokenize_number(c: Column, key: str, salt: str) -> Column:
    """The same network run backwards."""
    a, b = split_domain(NUMBER_SPAN)
    left, right = int_div(c.cast("long"), b), c.cast("long") % F.lit(b).cast("long")
    rounds = round_constants(require_key(key), f"token.{salt}")
    for i in reversed(range(HALF_ROUNDS)):
        c6 = [F.lit(x).cast("long") for x in rounds[i]]
        if i % 2 == 0:
            left = F.pmod(left - mix(right, c6), F.lit(a).cast("long"))
        else:
            right = F.pmod(right - mix(left, c6), F.lit(b).cast("long"))
    return left * F.lit(b).cast("long") + right - 2**61


def random_salt(length: int = 8) -> str:
    """Hex characters for a new salt."""
    import secrets

    return secrets.token_hex((length + 1) // 2)[:length]


def is_valid_key(key: str | None) -> bool:
    """The service accepts a new masking key only at a length of sixteen."""
    return key is not None and len(key.strip()) == 16
