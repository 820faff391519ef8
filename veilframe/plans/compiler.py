"""Rules to one projection per table."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.formats import apply_format, char_pattern
from veilframe.functions.fpe import BoundPermuter, fpe_column, fpe_text, permute_range
from veilframe.functions.hashing import Bindings, require_key
from veilframe.functions.partial import default_value, fixed_prefix, keep_ends, keep_last4, nullify
from veilframe.functions.synthetic import synthetic
from veilframe.plans.rules import CMF, DEFAULT, FPH, NULL, PMD, SFD, RuleSet, simple_name


@dataclass(frozen=True)
class Profile:
    """What differs between the kinds of job: order of rules, null handling, partial form, replacement names."""

    order: tuple[str, ...]
    partial: Callable[[Column], Column]
    names: str
    how: str = "scoped"
    null_first: bool = False
    as_text: bool = False
    fill_arrays: bool = False
    null_items: bool = False
    all_rules: bool = False


def _stars(c: Column) -> Column:
    return keep_last4(c, "*", mask_short=True)


_LATE_FPH = (NULL, DEFAULT, CMF, SFD, PMD, FPH)
PROFILES = {
    "table": Profile((NULL, DEFAULT, CMF, FPH, SFD, PMD), keep_last4, "table"),
    "sql_export": Profile(_LATE_FPH, _stars, "sql_export", null_first=True),
    "csv": Profile((NULL, DEFAULT, CMF, PMD, FPH, SFD), keep_ends, "csv", "file", null_first=True, as_text=True),
    "json": Profile(_LATE_FPH, _stars, "json", "suffix", fill_arrays=True, null_items=True),
    "json_export": Profile(_LATE_FPH, fixed_prefix, "json_export", "file", null_items=True),
    "doc_export": Profile((SFD, PMD, FPH, NULL, DEFAULT, CMF), fixed_prefix, "table", all_rules=True),
}


def max_length_of(field: T.StructField) -> int | None:
    """Declared text length: varchar(n)/char(n), also as Spark notes it on a table's column, or `max_length` metadata."""
    if isinstance(field.dataType, (T.VarcharType, T.CharType)):
        return field.dataType.length
    meta = field.metadata or {}
    noted = re.search(r"\((\d+)\)", meta.get("__CHAR_VARCHAR_TYPE_STRING", ""))
    value = noted[1] if noted else meta.get("max_length")
    return int(value) if value else None


@dataclass
class FieldPlan:
    """Everything needed to mask one scalar."""

    rules: RuleSet
    profile: Profile
    table: str
    path: str
    dtype: T.DataType
    max_length: int | None = None
    logical: str | None = None
    domain: str | None = None
    seed: Column | None = None
    permuter: Callable = permute_range
    names: str | None = None
    # inside arrays text is encrypted over the whole extracted field, since no Python function runs per element
    root: Column | None = None
    index: tuple[Column, ...] = ()
    bindings: Bindings | None = None

    @property
    def label(self) -> str:
        """Draws depend on the field name only, so equal columns of two tables get equal replacements."""
        return self.path.lower()

    def text(self, c: Column) -> Column:
        return c if isinstance(self.dtype, T.StringType) else c.cast("string")

    def cut(self, c: Column) -> Column:
        return F.substring(c, 1, self.max_length) if self.max_length else c

    def apply(self, c: Column, kind: str, argument) -> Column:
        profile, key = self.profile, self.rules.key
        if kind == NULL:
            return nullify(self.dtype, profile.as_text)
        if kind == DEFAULT:
            return F.lit(argument) if profile.as_text else default_value(argument, self.dtype)
        if kind == PMD:
            return self.cut(profile.partial(self.text(c)))
        if kind == FPH or (kind == SFD and profile.all_rules):
            return self.encrypt(c, require_key(key))
        key = require_key(key)
        if kind == SFD:
            return synthetic(
                c, self.dtype, self.path, key, self.label, self.names or profile.names, self.max_length, self.logical
            )
        if profile.as_text:
            return char_pattern(c, argument, key, self.label, self.seed)
        return apply_format(c, self.dtype, argument, key, self.label, self.seed)

    def encrypt(self, c: Column, key: str) -> Column:
        if isinstance(self.dtype, T.StringType) and self.logical != "uuid":
            return fpe_text(c, key, self.max_length)
        return fpe_column(c, self.dtype, key, self.domain, self.logical, self.max_length, self.permuter)

    def hits(self) -> list[tuple]:
        profile = self.profile
        if not profile.all_rules:
            hit = self.rules.action(self.table, self.path, profile.order, profile.how)
            return [hit] if hit else []
        hits = self.rules.actions(self.table, self.path, profile.order, profile.how)
        constant = [i for i, (kind, _) in enumerate(hits) if kind in (NULL, DEFAULT)]
        return hits[constant[-1] if constant else 0 :]

    def mask(self, c: Column) -> Column:
        """The masked column, or `c` itself when no rule acts on it."""
        hits = self.hits()
        if self.root is not None and isinstance(self.dtype, T.StringType) and any(self.encrypts(k) for k, _ in hits):
            return self.mask_over_arrays(hits)
        for kind, argument in hits:
            out = self.apply(c, kind, argument)
            keep_null = self.profile.null_first and kind in (DEFAULT, CMF, NULL)
            c = F.when(c.isNotNull(), out) if keep_null else out
        return c

    def encrypts(self, kind: str) -> bool:
        return kind == FPH or (kind == SFD and self.profile.all_rules)

    def mask_over_arrays(self, hits) -> Column:
        depth, c = len(self.index), self.root
        for level, (kind, argument) in enumerate(hits):
            if self.encrypts(kind):
                masked = fpe_text(c, require_key(self.rules.key), depth=depth)
                c = self.bindings.at(level, self.bindings.name(), masked)
            else:
                c = map_levels(c, depth, lambda v, k=kind, a=argument: self.apply(v, k, a))
        for i in self.index:
            c = F.get(c, i)
        return c


def map_levels(c: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    """Apply `f` to the elements `depth` arrays down."""
    return f(c) if depth == 0 else F.transform(c, lambda v: map_levels(v, depth - 1, f))


def mask_table(
    df: DataFrame,
    table: str,
    rules: RuleSet,
    profile: str = "table",
    domains: Mapping[str, str] | None = None,
) -> DataFrame:
    """Mask the flat columns of `df`; nested columns are left to `mask_docs` and `mask_json`.

    One narrow projection: no shuffle, the column order is kept, unruled columns are passed through untouched.
    `domains` (see `unify_key_types`) makes joined keys mask alike.
    """
    spec, bindings = PROFILES[profile], Bindings()
    permuter = BoundPermuter(bindings)
    seed = F.col(_quoted(df.columns[0])) if df.columns else None
    out = []
    for f in df.schema.fields:
        c = F.col(_quoted(f.name))
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(mask_container(c, f, rules, spec, table))
            continue
        plan = FieldPlan(
            rules, spec, table, f.name, f.dataType, max_length_of(f), (f.metadata or {}).get("logical"),
            (domains or {}).get(f"{simple_name(table)}.{f.name.lower()}"), seed, permuter,
        )
        masked = plan.mask(c)
        out.append(c if masked is c else masked.alias(f.name, metadata=f.metadata or {}))
    return bindings.apply(df).select(*out)


def mask_container(c: Column, field: T.StructField, rules: RuleSet, profile: Profile, table: str, path: str | None = None) -> Column:
    """A whole struct, array or map can be set to null; any other rule on it is refused rather than skipped."""
    hit = rules.action(table, path or field.name, profile.order, profile.how)
    if hit is None:
        return c
    if hit[0] == NULL:
        return F.lit(None).cast(field.dataType).alias(field.name)
    raise ValueError(f"a {hit[0]} rule cannot act on {path or field.name} of type {field.dataType.simpleString()}")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def active_rule(rules: RuleSet, table: str, column: str, profile: str = "table") -> str | None:
    """The rule kind that `mask_table` would apply to a column."""
    spec = PROFILES[profile]
    hit = rules.action(table, column, spec.order, spec.how)
    return hit[0] if hit else None
