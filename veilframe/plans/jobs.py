"""Whole jobs, put together from readers, masks, checks, bundles and writers.

A job names its tables on the driver and submits one write per table from a small thread pool, so that the stages of
several tables overlap. Each table is recorded in the run ledger; one table failing does not stop the others.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.hashing import subkey
from veilframe.operators import bundle, classify, generate, integrity, sqldump
from veilframe.operators.catalog import describe_columns
from veilframe.operators.keystore import KeyStore
from veilframe.operators.ledger import Ledger, observe_counts
from veilframe.plans.compiler import mask_table
from veilframe.plans.nested import mask_docs, mask_json
from veilframe.plans.rules import (
    ForeignKey, RuleSet, key_components, propagate_rules, select_targets, simple_name, unify_key_types,
)
from veilframe.session import stage
from veilframe.sources import readers, writers
from veilframe.sources.committed import has_manifest

PARALLEL_TABLES = 5


@dataclass
class JobResult:
    ledger: Ledger
    completed: list[str]
    failed: list[str]
    checks: dict[str, DataFrame] = field(default_factory=dict)


def _run_all(ledger: Ledger, names: list[str], step: Callable[[str], tuple[Callable, object]]) -> JobResult:
    """Run one step per name; building a plan may fail as well as running it."""

    def one(name: str) -> bool:
        holder: dict = {}

        def action():
            run, holder["observation"] = step(name)
            run()

        class _Late:
            @property
            def get(self):
                observed = holder.get("observation")
                return observed.get if observed else {}

        return ledger.run(name, action, _Late())

    with ThreadPoolExecutor(max_workers=PARALLEL_TABLES) as pool:
        done = dict(zip(names, pool.map(one, names), strict=True))
    return JobResult(ledger, [n for n in names if done[n]], [n for n in names if not done[n]])


def key_plan(tables: Mapping[str, DataFrame], rules: RuleSet, keys: list[ForeignKey]) -> tuple[RuleSet, dict[str, str]]:
    """Rules spread along the keys, and the domain each key column is encrypted in, one to one over its whole type."""
    components = key_components(keys)
    types = {
        f"{simple_name(t)}.{f.name.lower()}": f.dataType.simpleString()
        for t, df in tables.items()
        for f in df.schema.fields
    }
    return propagate_rules(rules, components), unify_key_types(components, types)


def migrate_tables(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    target: str,
    rules: RuleSet,
    ledger: Ledger,
    keys: list[ForeignKey] = (),
    unique: Mapping[str, list[list[str]]] | None = None,
    form: str = "parquet",
    not_null: Mapping[str, list[str]] | None = None,
    store: KeyStore | None = None,
    append: bool = False,
) -> JobResult:
    """Mask and write every selected table, then run the key checks on what was written.

    Each check is a step of the ledger: `read_rows` holds the rows or keys that violate it, which lie below
    `target/_violations`; a check that finds any is FAILED. With a `store` the keys of this load are compared with those
    of earlier loads and then added, and with `append` the tables grow by it: no earlier row is read again.
    """
    names = select_targets(tables, rules.targets)
    spread, domains = key_plan(tables, rules, list(keys))

    def masked_of(name: str) -> DataFrame:
        return mask_table(tables[name], name, spread, "table", domains)

    def step(name: str):
        masked, seen = observe_counts(masked_of(name))
        mode = "append" if append else "overwrite"
        return lambda: masked.write.mode(mode).format(form).save(f"{target}/{simple_name(name)}"), seen

    result = _run_all(ledger, names, step)
    written = {n: spark.read.format(form).load(f"{target}/{simple_name(n)}") for n in result.completed}
    load = {n: masked_of(n) for n in written} if store and append else written
    checks = constraint_checks(load, list(keys), unique or {}, not_null or {}, store)
    for label, check in checks.items():
        result.checks[label] = _record_check(spark, ledger, label, check, f"{target}/_violations/{ledger.run_id}")
    if not append:
        result.checks["row counts"] = integrity.reconcile({n: tables[n] for n in written}, written)
    return result


def constraint_checks(
    tables: Mapping[str, DataFrame], keys: list[ForeignKey], unique: Mapping[str, list[list[str]]],
    not_null: Mapping[str, list[str]], store: KeyStore | None = None,
) -> dict[str, DataFrame]:
    """Not-null, unique and foreign-key checks by label; with a store their keys are added to it first.

    Keys are added before any check runs: a unique check leaves its own load out, a foreign key may point into it.
    """
    named = {simple_name(n): df for n, df in tables.items()}

    def given(by_table: Mapping):
        return [(simple_name(n), v) for n, v in by_table.items() if simple_name(n) in named]

    checks = {f"not null {n}({', '.join(c)})": integrity.check_not_null(named[n], c) for n, c in given(not_null)}
    kept: set[tuple[str, tuple[str, ...]]] = {(n, tuple(c)) for n, lists in given(unique) for c in lists}
    kept |= {(simple_name(k.parent), tuple(k.parent_columns)) for k in keys if simple_name(k.parent) in named}
    if store:
        for name, columns in sorted(kept):
            store.add(name, list(columns), named[name])
    for name, lists in given(unique):
        for columns in lists:
            found = store.repeated(name, columns, named[name]) if store else integrity.check_unique(named[name], columns)
            checks[f"unique {name}({', '.join(columns)})"] = found
    for k in keys:
        child, parent = simple_name(k.child), simple_name(k.parent)
        if child not in named or not (store or parent in named):
            continue
        mine, theirs = list(k.child_columns), list(k.parent_columns)
        checks[f"foreign key {child}({', '.join(mine)})"] = (
            store.orphans(named[child], mine, parent, theirs) if store
            else integrity.check_foreign_key(named[child], mine, named[parent], theirs)
        )
    return checks


def _record_check(spark: SparkSession, ledger: Ledger, label: str, check: DataFrame, folder: str) -> DataFrame:
    """Run one check, write the violating keys, and enter their number in the ledger; returns the written keys."""
    path = f"{folder}/" + re.sub(r"[^A-Za-z0-9_.-]+", "_", label).strip("_")
    started = dt.datetime.now(dt.timezone.utc)
    try:
        check.write.mode("overwrite").parquet(path)
        violations = spark.read.schema(check.schema).parquet(path)
        found = violations.count()  # from the footers of the files
    except Exception as e:  # noqa: BLE001 - the ledger is where job errors go
        ledger.append(f"check {label}", "FAILED", started, error=str(e))
        return check
    error = f"{found} violations, see {path}" if found else None
    ledger.append(f"check {label}", "FAILED" if found else "COMPLETED", started, found, 0, error)
    return violations


def migrate_docs(
    collections: Mapping[str, DataFrame], target: str, rules: RuleSet, ledger: Ledger, drop: bool = True
) -> JobResult:
    """Mask document collections and write them as JSON lines."""

    def step(name: str):
        masked, seen = observe_counts(mask_docs(collections[name], name, rules))
        return lambda: writers.write_docs(masked, f"{target}/{name}", drop), seen

    return _run_all(ledger, select_targets(collections, rules.targets), step)


def migrate_json(
    spark: SparkSession, folder: str, files: list[str], target: str, rules: RuleSet, ledger: Ledger
) -> JobResult:
    """Mask JSON files, one output per source file."""

    def step(name: str):
        masked, seen = observe_counts(mask_json(readers.scan_json(spark, f"{folder}/{name}"), name, rules))
        return lambda: writers.write_json(masked, f"{target}/{name}"), seen

    return _run_all(ledger, select_targets(files, rules.targets), step)


def migrate_csv(
    spark: SparkSession, folder: str, files: list[str], target: str, rules: RuleSet, ledger: Ledger
) -> JobResult:
    """Mask delimited files, one output per source file."""

    def step(name: str):
        masked, seen = observe_counts(mask_table(readers.scan_csv(spark, f"{folder}/{name}"), name, rules, "csv"))
        return lambda: writers.write_csv(masked, f"{target}/{name}"), seen

    return _run_all(ledger, select_targets(files, rules.targets), step)


# ---------------------------------------------------------------- secure export and import

_EXPORT_MASKS: dict[str, Callable[[DataFrame, str, RuleSet], DataFrame]] = {
    "csv": lambda df, name, rules: mask_table(df, name, rules, "csv"),
    "json": lambda df, name, rules: mask_json(df, name, rules, "json_export"),
    "docs": lambda df, name, rules: mask_docs(df, name, rules, "doc_export"),
    "tables": lambda df, name, rules: mask_table(df, name, rules, "sql_export"),
}


def masked_for_export(kind: str, tables: Mapping[str, DataFrame], rules: RuleSet) -> dict[str, DataFrame]:
    mask = _EXPORT_MASKS[kind]
    return {n: mask(tables[n], n, rules) for n in select_targets(tables, rules.targets)}


def secure_export(
    kind: str, tables: Mapping[str, DataFrame], rules: RuleSet, folder: str, key: str,
    base: str = "export", max_bytes: int | str = bundle.DEFAULT_PART_BYTES,
) -> DataFrame:
    """Mask, cut into parts, encrypt and write part files; returns their names and sizes."""
    masked = masked_for_export(kind, tables, rules)
    parts = bundle.export_bundle(masked, base, max_bytes, key, greedy=True, indexed=True)
    return bundle.save_parts(parts, folder, base)


def secure_export_tables(
    tables: Mapping[str, DataFrame], rules: RuleSet, folder: str, key: str, base: str = "export",
    max_bytes: int | str = bundle.DEFAULT_PART_BYTES, primary_keys: Mapping[str, list[str]] | None = None,
    keys: list[ForeignKey] = (),
) -> DataFrame:
    """Mask tables and write them as encrypted SQL text parts, foreign keys last."""
    masked, spark, text = masked_for_export("tables", tables, rules), None, None
    for name, df in masked.items():
        spark = df.sparkSession
        one = sqldump.to_sql_dump(df, name, (primary_keys or {}).get(name, ())).withColumn("table", F.lit(name))
        text = one if text is None else text.unionByName(one)
    ddl = sqldump.foreign_key_ddl(keys)
    if ddl:
        text = text.unionByName(spark.createDataFrame([(d, None) for d in ddl], "value string, table string"))
    parts = bundle.encrypt_parts(bundle.pack_parts(text, text["value"], max_bytes, base, ".sql", greedy=True, of="table"), key)
    return bundle.save_parts(parts, folder, base)


def open_parts(spark: SparkSession, folder: str, key: str, base: str | None = None) -> DataFrame:
    """Part files of the backup `base` of a folder (of all backups in it without one), after the key was checked.

    The first part is found by the names alone, and only its file is read for the check.
    """
    parts = bundle.read_part_files(spark, folder, base=base)
    first = parts.select("part_no", "name").orderBy("part_no", "name").limit(1).head()
    if first is None or not bundle.validate_key(bundle.read_part_files(spark, folder, names=[first.name]), key):
        raise ValueError("the key does not open this backup")
    return parts


def parts_by_table(
    spark: SparkSession, folder: str, key: str, tables: list[str], base: str | None = None
) -> dict[str, DataFrame]:
    """The parts that each table needs, after the key was checked: those that the manifest of `base` names for it.

    So a part that holds one table is decrypted once, however many tables are restored. Without `base`, or from a backup whose
    manifest holds no contents, every table needs all parts, as does a table that the manifest does not name. A part that
    is gone is an error, as is one that does not open.
    """
    every = open_parts(spark, folder, key, base)
    if base is None or not has_manifest(spark, folder, base):
        return dict.fromkeys(tables, every)
    held = F.lower("file")
    wanted = F.col("lines").isNull() | held.isin([n.lower() for n in tables])
    named: dict[str, set[str]] = {}
    for r in bundle.part_index(spark, folder, key, base).where(wanted).select("name", "lines", held.alias("held")).collect():
        if r.lines is None:
            return dict.fromkeys(tables, every)
        named.setdefault(r.held, set()).add(r.name)
    return {
        n: bundle.read_part_files(spark, folder, names=sorted(named[n.lower()])) if n.lower() in named else every for n in tables
    }


def secure_import(
    spark: SparkSession, folder: str, key: str, schemas: Mapping[str, T.StructType],
    rules: RuleSet | None = None, kind: str = "csv", base: str | None = None,
) -> dict[str, DataFrame]:
    """Restore tables of a bundle; a second rule set can mask them on the way in, limited to its targets.

    `base` names the backup where the folder holds several. With it, a table opens only the parts that its manifest names for it.
    """
    parts = parts_by_table(spark, folder, key, list(schemas), base)
    out = {n: bundle.restore_table(bundle.scan_bundle(parts[n], key), n, s) for n, s in schemas.items()}
    if rules is None:
        return out
    mask = _EXPORT_MASKS[kind]
    return {n: mask(out[n], n, rules) for n in select_targets(out, rules.targets)}


def secure_import_tables(
    spark: SparkSession, folder: str, key: str, schemas: Mapping[str, T.StructType], base: str | None = None,
) -> sqldump.DumpTables:
    """Restore SQL text parts: per table the typed rows and the rejected ones. `base` as in `secure_import`.

    `rejects` of the result holds the statements that gave no rows, such as the key constraints at the end of a backup.
    """

    def lines(parts):
        opened = bundle.decrypt_parts(parts, key)
        rows = opened.select(F.explode(F.split(F.decode("content", "utf-8"), "\n")).alias("value"))
        return rows.where(~F.col("value").startswith(bundle.MAGIC))

    out = sqldump.DumpTables()
    for name, parts in parts_by_table(spark, folder, key, list(schemas), base).items():
        statements = sqldump.parse_inserts(lines(parts))
        out[name] = writers.split_rejects(sqldump.table_of(statements, name, schemas[name]), schemas[name])
    out.rejects = sqldump.unread_statements(lines(open_parts(spark, folder, key, base)))
    return out


# ---------------------------------------------------------------- classification and generation


def classify_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> tuple[DataFrame, RuleSet]:
    """Classified columns of the tables, and the rules they suggest."""
    found = classify.classify_columns(describe_columns(spark, tables).select("table", "column"))
    return found, classify.rules_from_classification(found)


def generate_dataset(
    spark: SparkSession, specs: list[generate.TableSpec], target: str, key: str, ledger: Ledger, restart: bool = False
) -> dict[str, DataFrame]:
    """Generate tables, parents before children, and write them.

    With `restart` the ledger's steps carry a fingerprint of the table (its spec, the key and the parents it was made from),
    and a table whose last entry is COMPLETED under the same one is kept; what was RUNNING, FAILED or made otherwise is made
    again.
    """
    by_name = {s.name: s for s in specs}
    keys = [ForeignKey(s.name, (c.name,), c.foreign[0], (c.foreign[1],)) for s in specs for c in s.columns if c.foreign]
    parents: dict[tuple[str, str], tuple[DataFrame, int]] = {}
    out: dict[str, DataFrame] = {}
    prints: dict[str, str] = {}
    last = _last_steps(ledger) if restart else {}
    for name in generate.topo_order(by_name, keys):
        spec = by_name[name]
        rows = generate.generate(generate.sequence(spark, spec.rows), spec, key, parents)
        path, step = f"{target}/{simple_name(name)}", name
        if restart:
            made_of = repr((subkey(key, "dataset"), path, spec, sorted(prints.items())))
            step = f"{name}#{hashlib.sha256(made_of.encode()).hexdigest()[:32]}"
        if last.get(name) != (step, "COMPLETED"):
            seen_rows, seen = observe_counts(rows)
            if not ledger.run(step, lambda d=seen_rows, p=path: d.write.mode("overwrite").parquet(p), seen):
                continue
        prints[name] = step
        out[name] = spark.read.schema(rows.schema).parquet(path)
        wanted = {fk.parent_columns[0] for fk in keys if simple_name(fk.parent) == simple_name(name)}
        wanted |= {c.name for c in spec.columns if c.primary}
        for column in wanted:
            table = generate.indexed_keys(out[name], column)
            parents[(name, column)] = (table, table.count())
    return out


def _last_steps(ledger: Ledger) -> dict[str, tuple[str, str]]:
    """Table -> (step, status) of its newest entry of all runs: one row per generated table."""
    ledger.append("restart", "COMPLETED", dt.datetime.now(dt.timezone.utc))  # so there is a ledger to read
    entries = ledger.entries().where(F.col("step").contains("#"))
    order = F.struct(F.coalesce("ended", "started"), F.col("status") != "RUNNING")
    newest = entries.groupBy(F.substring_index("step", "#", 1).alias("name")).agg(F.max_by(F.struct("step", "status"), order).alias("s"))
    return {r.name: (r.s.step, r.s.status) for r in newest.collect()}
