"""Masking rules: how they are written, how they are matched to columns, how they spread along keys.

All of this is metadata work on the driver; the result is captured in the plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

NULL, DEFAULT, CMF, SFD, PMD, FPH = "NULL", "DEFAULT", "CMF", "SFD", "PMD", "FPH"


def _clean(name: str) -> str:
    """Lower case, trimmed, array marks dropped: `Users.Tags[*]` and `users.tags` are the same path."""
    return re.sub(r"\[\*?\]", "", name).strip().lower()


def simple_name(table: str) -> str:
    return table.rsplit(".", 1)[-1].lower()


@dataclass(frozen=True)
class RuleSet:
    """Seven parts of a masking configuration.

    Columns are written `schema.table.column`, `table.column` or `column`; a nested field takes its dotted path in
    place of the column. `wildcard=True` lets a rule on one table's column act on that column in every table.
    """

    masking: tuple[str, ...] = ()
    constraint: tuple[str, ...] = ()
    partial: tuple[str, ...] = ()
    nullify: tuple[str, ...] = ()
    defaults: Mapping[str, str | None] = field(default_factory=dict)
    formats: Mapping[str, str] = field(default_factory=dict)
    key: str | None = None
    targets: tuple[str, ...] = ()
    # per-file lists of the file formats: file (or "*") -> fields
    masking_fields: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    partial_fields: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    wildcard: bool = False

    @staticmethod
    def parse(config: Mapping) -> RuleSet:
        """Read the configuration names of the job files (`maskingColumns`, `constraintColumns`, ...)."""

        def names(*keys: str) -> tuple[str, ...]:
            out: list[str] = []
            for k in keys:
                out += [r for r in (config.get(k) or []) if r and r.strip()]
            return tuple(dict.fromkeys(r.strip() for r in out))

        return RuleSet(
            masking=names("maskingColumns"),
            constraint=names("constraintColumns", "constraintFields"),
            partial=names("partialMaskingColumns"),
            nullify=names("nullifyColumns"),
            defaults=dict(config.get("defaultValues") or {}),
            formats=dict(config.get("customFormats") or {}),
            key=config.get("maskingKey"),
            targets=names("targetTables", "targetFiles", "targetCollections"),
            masking_fields={k: tuple(v) for k, v in (config.get("maskingFields") or {}).items()},
            partial_fields={k: tuple(v) for k, v in (config.get("partialMaskingFields") or {}).items()},
            wildcard=bool(config.get("wildcard", False)),
        )

    def scopes(self, kind: str) -> dict[str, set[str]]:
        """Scope -> columns of one rule list; `*` holds the unscoped ones (all of them under `wildcard`)."""
        out: dict[str, set[str]] = {}
        for rule in self._list(kind):
            parts = _clean(rule).split(".")
            column = parts[-1]
            if len(parts) >= 2:
                out.setdefault(parts[-2], set()).add(column)
            if len(parts) >= 3:
                out.setdefault(".".join(parts[:-1]), set()).add(column)
            if len(parts) == 1 or self.wildcard:
                out.setdefault("*", set()).add(column)
        return out

    def _list(self, kind: str) -> tuple[str, ...]:
        return {SFD: self.masking, FPH: self.constraint, PMD: self.partial, NULL: self.nullify}[kind]

    def has(self, kind: str, table: str, path: str, how: str = "scoped") -> bool:
        """Whether a list rule of `kind` acts on `path` of `table`."""
        if any(self._names(rule, table, path, how) for rule in self._list(kind)):
            return True
        per_file = {SFD: self.masking_fields, PMD: self.partial_fields}.get(kind)
        if not per_file:
            return False
        names = [table, re.sub(r"(?i)\.(json|csv)$", "", table), "*"]
        return any(path in per_file.get(n, ()) for n in names)

    def match_value(self, values: Mapping, table: str, path: str, how: str = "scoped"):
        """(found, value) of the first key of a value map that names the field."""
        for name, value in values.items():
            if name is not None and self._names(name, table, path, how):
                return True, value
        return False, None

    def _names(self, rule: str, table: str, path: str, how: str) -> bool:
        r, t, p = _clean(rule), table.strip().lower(), _clean(path)
        if how == "suffix":
            return r == p or r.endswith("." + p) or p.endswith("." + r)
        stems = {t, simple_name(t)} if how == "scoped" else {t, re.sub(r"\.(json|csv)$", "", t)}
        if r == p or r == "*." + p or any(r == f"{s}.{p}" or r.endswith(f".{s}.{p}") for s in stems):
            return True
        return self.wildcard and how == "scoped" and r.endswith("." + p)

    def action(self, table: str, path: str, order: Iterable[str], how: str = "scoped"):
        """The first rule in `order` that acts on the field: (kind, argument) or None."""
        for kind in order:
            if kind in (DEFAULT, CMF):
                found, value = self.match_value(self.defaults if kind == DEFAULT else self.formats, table, path, how)
                if found and (kind == DEFAULT or (value and value.strip())):
                    return kind, value
            elif self.has(kind, table, path, how):
                return kind, None
        return None

    def actions(self, table: str, path: str, order: Iterable[str], how: str = "scoped") -> list[tuple]:
        """Every rule that acts on the field, in `order`."""
        hits = [self.action(table, path, [kind], how) for kind in order]
        return [h for h in hits if h]


def select_targets(names: Iterable[str], targets: Iterable[str]) -> list[str]:
    """Only the listed tables, files or collections; an empty list means all."""
    wanted = {t.strip().lower() for t in targets}
    return [n for n in names if not wanted or n.lower() in wanted or simple_name(n) in wanted]


# ---------------------------------------------------------------- keys


@dataclass(frozen=True)
class ForeignKey:
    """One declared relation; composite keys list their columns in order."""

    child: str
    child_columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    name: str | None = None


def virtual_relationships(pairs: Iterable[Mapping[str, str]]) -> list[ForeignKey]:
    """Relations declared in the job file as `parent: table.column`, `child: table.column`."""
    out = []
    for pair in pairs:
        (pt, pc), (ct, cc) = pair["parent"].rsplit(".", 1), pair["child"].rsplit(".", 1)
        out.append(ForeignKey(ct, (cc,), pt, (pc,)))
    return out


def key_components(keys: Iterable[ForeignKey]) -> dict[str, frozenset[str]]:
    """`table.column` -> all columns connected to it through foreign keys."""
    group: dict[str, set[str]] = {}
    for fk in keys:
        for cc, pc in zip(fk.child_columns, fk.parent_columns, strict=True):
            child, parent = f"{simple_name(fk.child)}.{cc.lower()}", f"{simple_name(fk.parent)}.{pc.lower()}"
            merged = group.get(child, {child}) | group.get(parent, {parent})
            for member in merged:
                group[member] = merged
    return {member: frozenset(members) for member, members in group.items()}


def propagate_rules(rules: RuleSet, components: Mapping[str, frozenset[str]]) -> RuleSet:
    """A rule on one key column acts on every connected column."""

    def spread(kind: str) -> tuple[str, ...]:
        out = list(rules._list(kind))
        for member in sorted(components):
            for other in components[member]:
                table, column = other.rsplit(".", 1)
                if rules.has(kind, table, column):
                    out.append(member)
                    break
        return tuple(dict.fromkeys(out))

    return replace(rules, masking=spread(SFD), constraint=spread(FPH), partial=spread(PMD), nullify=spread(NULL))


_WIDTH = ["byte", "short", "int", "long"]
_DOMAIN_OF = {
    "tinyint": "byte", "byte": "byte", "smallint": "short", "short": "short", "int2": "short", "smallserial": "short",
    "int": "int", "integer": "int", "int4": "int", "serial": "int",
    "bigint": "long", "long": "long", "int8": "long", "bigserial": "long",
}


def unify_key_types(
    components: Mapping[str, frozenset[str]], types: Mapping[str, str]
) -> dict[str, str]:
    """`table.column` -> the narrowest integer domain of its component, so that joined keys mask alike.

    `types` maps `table.column` to a type name. A component of one decimal type gets `decimal`, others with a non-integer
    member are left alone. Columns with a domain are encrypted one to one over their whole type (`fpe.fpe_key`).
    """
    out = {}
    for member, members in components.items():
        domains = [_DOMAIN_OF.get(types.get(m, "").lower()) for m in members if m in types]
        if domains and all(domains):
            out[member] = min(domains, key=_WIDTH.index)
        elif types.get(member, "").startswith("decimal") and len({types[m] for m in members if m in types}) == 1:
            out[member] = "decimal"
    return out
