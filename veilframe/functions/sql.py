"""The masking functions under SQL names, for sessions that are driven by SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veilframe.functions.fpe import DOMAINS, _mix_sql, _text_function, _walk_surplus, round_constants, split_domain
from veilframe.functions.hashing import require_key, subkey

_INTEGERS = {"tinyint": "byte", "smallint": "short", "int": "int", "bigint": "long"}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash_sql(x: str, key: str, label: str) -> str:
    text = f"concat({_quoted(subkey(key, label))}, CAST({x} AS STRING))"
    return f"CAST(conv(substring(sha2({text}, 256), 1, 15), 16, 10) AS BIGINT)"


def _integer_sql(x: str, domain: str, key: str) -> str:
    """The integer permutation, one nested select per half round; equals what the column functions compute."""
    lo, hi = DOMAINS[domain]
    size, label = hi - lo + 1, f"int.{domain}"
    a, b = split_domain(size)
    constants = round_constants(key, label)
    outside = f"{_hash_sql(x, key, f'{label}.outside')} % {size}L"
    index = f"CASE WHEN {x} BETWEEN {lo}L AND {hi}L THEN {x} - {lo}L ELSE {outside} END"
    text = f"(SELECT i div {b}L AS l, i % {b}L AS r FROM (SELECT {index} AS i))"
    for n, c in enumerate(constants):
        if n % 2 == 0:
            text = f"(SELECT (l + {_mix_sql('r', c)}) % {a}L AS l, r FROM {text})"
        else:
            text = f"(SELECT l, (r + {_mix_sql('l', c)}) % {b}L AS r FROM {text})"
    text = f"(SELECT l * {b}L + r AS o FROM {text})"
    surplus = ", ".join(f"{w}L" for w in _walk_surplus(size, constants))
    value = f"CASE WHEN o >= {size}L THEN element_at(array({surplus}), CAST(o - {size - 1}L AS INT)) ELSE o END"
    return f"(SELECT {value if surplus else 'o'} + {lo}L FROM {text})"


def register_functions(spark: SparkSession, key: str, prefix: str = "mask_") -> list[str]:
    """Create temporary SQL functions bound to `key`; returns their names.

    `text` is the Arrow function, the others are SQL functions that the optimizer inlines into the query.
    """
    key = require_key(key)
    spark.udf.register(f"{prefix}text", _text_function(key, 0))
    last4 = "CASE WHEN length(v) <= 4 THEN v ELSE concat(repeat('X', length(v) - 4), right(v, 4)) END"
    token = f"concat('ENC_', substring(sha2(concat({_quoted(subkey(key, 'token'))}, v), 256), 1, 16))"
    bodies = {"last4": ("STRING", last4), "token": ("STRING", token)}
    for name, domain in _INTEGERS.items():
        bodies[name] = (name.upper(), f"CAST({_integer_sql('CAST(v AS BIGINT)', domain, key)} AS {name})")
    for name, (kind, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(v {kind}) RETURNS {kind} RETURN {body}")
    return [f"{prefix}text", *[f"{prefix}{name}" for name in bodies]]
