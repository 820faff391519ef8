"""Masking of documents: structs, arrays of structs and arrays of scalars at any depth.

The schema is walked once on the driver. Structs are rewritten with `withField`, arrays with `transform`, so the whole
document stays one expression. Text encryption is the one step that needs Python: it runs on the extracted (nested)
array of the field and the elements are put back by position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.fpe import BoundPermuter, permute_element
from veilframe.functions.hashing import Bindings
from veilframe.plans.compiler import PROFILES, FieldPlan, Profile, _quoted, map_levels, mask_container, max_length_of
from veilframe.plans.rules import CMF, DEFAULT, NULL, SFD, RuleSet




class _Walker:
    def __init__(self, rules: RuleSet, profile: Profile, table: str) -> None:
        self.rules, self.profile, self.table, self.bindings = rules, profile, table, Bindings()
        self.permuter = BoundPermuter(self.bindings)

    def value(self, c: Column, dtype: T.DataType, path: str, root: Column, index: tuple[Column, ...], field) -> Column:
        """Masked form of `c`; returns `c` itself where nothing changes.

        `root` is the field extracted over all enclosing arrays and `index` the position inside it.
        """
        if isinstance(dtype, (T.StructType, T.MapType)) or (isinstance(dtype, T.ArrayType) and not self.profile.null_items):
            if self.rules.action(self.table, path, (NULL,), self.profile.how):
                return F.lit(None).cast(dtype)
        if isinstance(dtype, T.StructType):
            return self.struct(c, dtype, path, root, index)
        if isinstance(dtype, T.ArrayType):
            return self.array(c, dtype, path, root, index, field)
        if isinstance(dtype, T.MapType):
            return mask_container(c, T.StructField(path, dtype), self.rules, self.profile, self.table, path)
        return self.plan(path, dtype, root, index, field).mask(c)

    def plan(self, path, dtype, root, index, field) -> FieldPlan:
        names = "json_array" if index and self.profile.names == "json" else None
        return FieldPlan(
            self.rules, self.profile, self.table, path, dtype, max_length_of(field) if field else None,
            (field.metadata or {}).get("logical") if field else None, seed=F.lit(path), names=names,
            root=root if index else None, index=index, bindings=self.bindings,
            permuter=permute_element if index else self.permuter,
        )

    def struct(self, c, dtype, path, root, index) -> Column:
        depth, out = len(index), c
        for f in dtype.fields:
            child = c.getField(f.name)
            sub = map_levels(root, depth, lambda v, name=f.name: v.getField(name))
            masked = self.value(child, f.dataType, f"{path}.{f.name}" if path else f.name, sub, index, f)
            if masked is not child:
                out = out.withField(_quoted(f.name), masked)
        return out

    def array(self, c, dtype, path, root, index, field) -> Column:
        leaf, levels = dtype, 0
        while isinstance(leaf, T.ArrayType):
            leaf, levels = leaf.elementType, levels + 1
        if not isinstance(leaf, T.StructType):
            plan = self.plan(path, leaf, root, (*index, None), field)
            if self.rules.action(self.table, path, self.profile.order, self.profile.how) is None:
                return c
            out = self.elements(c, dtype, path, root, index, field)
            return self.filled(out, c, plan, path, levels) if self.profile.fill_arrays else out
        return self.elements(c, dtype, path, root, index, field)

    def elements(self, c, dtype, path, root, index, field) -> Column:
        changed = []

        def one(v: Column, i: Column) -> Column:
            masked = self.value_in_array(v, dtype.elementType, path, root, (*index, i), field)
            changed.append(masked is not v)
            return masked

        out = F.transform(c, one)
        return out if any(changed) else c

    def value_in_array(self, v, dtype, path, root, index, field) -> Column:
        if isinstance(dtype, T.ArrayType):
            return self.elements(v, dtype, path, root, index, field)
        return self.value(v, dtype, path, root, index, field)

    def filled(self, out, c, plan: FieldPlan, path: str, levels: int) -> Column:
        """An empty array under a replacing rule gets two values, or two times two where it is nested."""
        hit = self.rules.action(self.table, path, self.profile.order, self.profile.how)
        if hit[0] not in (NULL, DEFAULT, CMF, SFD):
            return out
        sample = F.lit("SAMPLE")
        if hit[0] == CMF:
            upper = hit[1].strip().upper()
            sample = F.lit("100") if upper.startswith("NUM:") else sample
            sample = F.lit("2026-01-01") if upper.startswith("DATE:") else sample
        values = []
        for i in range(2 ** min(levels, 2)):
            plan.seed = F.lit(f"{path}.{i}")
            seeded = F.concat(sample, F.lit("" if hit[0] == CMF else str(i)))
            v = plan.apply(seeded if isinstance(plan.dtype, T.StringType) else seeded.try_cast(plan.dtype), *hit)
            if hit[0] == SFD and not isinstance(plan.dtype, T.StringType):
                v = plan.apply(F.lit(i + 1).cast(plan.dtype), *hit)
            values.append(v)
        if levels == 1:
            fill = F.array(*values)
        else:
            fill = F.array(F.array(*values[:2]), F.array(*values[2:4]))
            for _ in range(levels - 2):
                fill = F.array(fill)
        return F.when(F.size(c) == 0, fill).otherwise(out)


def mask_nested(df: DataFrame, name: str, rules: RuleSet, profile: Profile) -> DataFrame:
    walker, out = _Walker(rules, profile, name), []
    for f in df.schema.fields:
        c = F.col(_quoted(f.name))
        masked = walker.value(c, f.dataType, f.name, c, (), f)
        out.append(c if masked is c else masked.alias(f.name))
    return walker.bindings.apply(df).select(*out)


def mask_docs(df: DataFrame, collection: str, rules: RuleSet, profile: str = "table") -> DataFrame:
    """Documents: dotted paths at any depth; arrays of documents are entered.

    A rule on an array of scalars acts on its elements (null on the whole array), so that no value slips through.

    `profile="doc_export"` applies all matching rules in sequence instead of the first.
    """
    return mask_nested(df, collection, rules, PROFILES[profile])


def mask_json(df: DataFrame, name: str, rules: RuleSet, profile: str = "json") -> DataFrame:
    """JSON files: as documents, but null acts on array elements too (and `json` fills empty arrays)."""
    return mask_nested(df, name, rules, PROFILES[profile])


def mask_array(df: DataFrame, column: str, rules: RuleSet, profile: str = "json") -> DataFrame:
    """One array column: every scalar leaf gets the rule, the depth is kept, empty arrays are filled."""
    keep = [F.col(_quoted(c)) for c in df.columns if c != column]
    masked = mask_nested(df.select(_quoted(column), *[k.alias("__k" + str(i)) for i, k in enumerate(keep)]), "", rules,
                         PROFILES[profile])
    names = {f"__k{i}": c for i, c in enumerate(c for c in df.columns if c != column)}
    return masked.withColumnsRenamed(names).select(*[_quoted(c) for c in df.columns])
