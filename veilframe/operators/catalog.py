"""Discovery: tables, columns, keys, field paths, counts, profiles."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.plans.compiler import max_length_of
from veilframe.plans.rules import select_targets
from veilframe.session import stage

_COLUMN_SCHEMA = "table string, column string, type string, nullable boolean, max_length int, precision int, scale int, pos int"


def discover_tables(
    spark: SparkSession, exclude_prefix: str = "batch_", targets: Iterable[str] = (), database: str | None = None
) -> list[str]:
    """Tables of the session catalog by name, without the job runner's own."""
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
    names = [n for n in names if not n.lower().startswith(exclude_prefix.lower())]
    return select_targets(names, targets)


def describe_schema(table: str, schema: T.StructType) -> list[tuple]:
    out = []
    for pos, f in enumerate(schema.fields, 1):
        dec = isinstance(f.dataType, T.DecimalType)
        out.append((table, f.name, f.dataType.simpleString(), f.nullable, max_length_of(f),
                    f.dataType.precision if dec else None, f.dataType.scale if dec else None, pos))
    return out


def describe_columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column; metadata only, no table is read."""
    rows = [r for name, df in tables.items() for r in describe_schema(name, df.schema)]
    return spark.createDataFrame(rows, _COLUMN_SCHEMA)


def column_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, nulls and the widest text per column: one pass and one small aggregate per table."""
    out = None
    for name, df in tables.items():
        stats = []
        for i, f in enumerate(df.schema.fields, 1):
            c = F.col(f"`{f.name}`")
            text = isinstance(f.dataType, T.StringType)
            stats.append(
                F.struct(
                    F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                    F.lit(i).alias("pos"), F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_null"),
                    (F.max(F.length(c)) if text else F.lit(None).cast("int")).alias("max_length"),
                )
            )
        one = df.agg(F.array(*stats).alias("s")).select(F.lit(name).alias("table"), F.explode("s").alias("s"))
        one = one.select("table", "s.*")
        out = one if out is None else out.unionByName(one)
    return out


def row_counts(tables: Mapping[str, DataFrame], total: bool = False) -> DataFrame:
    """COUNT(*) per table, with the grand total as an extra row on request."""
    counts = reduce(
        DataFrame.unionByName,
        [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n, df in tables.items()],
    )
    if not total:
        return counts
    return counts.unionByName(counts.agg(F.sum("n_rows").alias("n_rows")).select(F.lit("*").alias("table"), "n_rows"))


def sample_rows(df: DataFrame, n: int, key: str | None = None) -> DataFrame:
    """Between one and ten rows, the first by key so that the sample is stable."""
    return df.orderBy(key or df.columns[0]).limit(min(max(n, 1), 10))


# ---------------------------------------------------------------- keys


def discover_foreign_keys(
    constraints: DataFrame, key_usage: DataFrame, references: DataFrame, declared: DataFrame | None = None
) -> DataFrame:
    """Foreign key columns from the three catalog views, plus declared relations.

    The views have `constraint_name, constraint_type, table_name`; `constraint_name, column_name, ordinal_position`;
    and `constraint_name, table_name, column_name`. Where the last also has `ordinal_position`, the place of the
    referenced column in the key, composite keys are paired by position; without it a key of k columns gives all pairs.
    """
    fk = constraints.filter(F.col("constraint_type") == "FOREIGN KEY").select("constraint_name", "table_name")
    placed = "ordinal_position" in references.columns
    ref = references.select(
        "constraint_name", F.col("table_name").alias("foreign_table"), F.col("column_name").alias("foreign_column"),
        *(["ordinal_position"] if placed else []),
    )
    rows = (
        fk.join(key_usage.select("constraint_name", "column_name", "ordinal_position"), "constraint_name")
        .join(ref, ["constraint_name", "ordinal_position"] if placed else ["constraint_name"], "left")
        .select("constraint_name", "table_name", "column_name", "foreign_table", "foreign_column", "ordinal_position")
    )
    return rows if declared is None else rows.unionByName(declared, allowMissingColumns=True)


def discover_constraints(constraints: DataFrame, key_usage: DataFrame, references: DataFrame) -> DataFrame:
    """Primary, foreign and unique keys, composite columns folded in ordinal order without repeats.

    Referenced columns follow `ordinal_position` of `references` where it has one, else their names.
    """
    kinds = ["PRIMARY KEY", "FOREIGN KEY", "UNIQUE"]
    base = constraints.filter(F.col("constraint_type").isin(kinds)).select(
        "constraint_name", "constraint_type", "table_name"
    )
    own = key_usage.groupBy("constraint_name", "column_name").agg(F.min("ordinal_position").alias("ordinal_position"))
    own = own.groupBy("constraint_name").agg(F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name"))).alias("k"))
    place = F.col("ordinal_position").cast("int") if "ordinal_position" in references.columns else F.lit(0)
    ref = references.groupBy("constraint_name", "column_name").agg(F.min("table_name").alias("table_name"), F.min(place).alias("place"))
    ref = ref.groupBy("constraint_name").agg(
        F.min("table_name").alias("foreign_table"), F.sort_array(F.collect_list(F.struct("place", "column_name"))).getField("column_name").alias("foreign_columns"),
    )
    return (
        base.join(own, "constraint_name")
        .join(ref, "constraint_name", "left")
        .select(
            "constraint_name", "constraint_type", "table_name",
            F.array_join(F.transform("k", lambda x: x["column_name"]), ", ").alias("column_name"),
            "foreign_table", F.array_join("foreign_columns", ", ").alias("foreign_column"),
        )
    )


# ---------------------------------------------------------------- field paths


def field_paths(schema: T.DataType, containers: bool = False, prefix: str = "") -> list[str]:
    """Dotted leaf paths through structs and arrays, sorted.

    `containers` is the document form: container paths are listed too, and an array of documents is entered as
    `path[]`.
    """
    return sorted(set(_paths(schema, prefix, containers)))


def _paths(dtype: T.DataType, path: str, containers: bool) -> Iterable[str]:
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType
        if not containers:
            yield from _paths(inner, path, containers)
        elif isinstance(inner, T.StructType):
            yield from _paths(inner, path + "[]", containers)
        return
    if not isinstance(dtype, T.StructType):
        if path and not containers:
            yield path
        return
    for f in dtype.fields:
        full = f"{path}.{f.name}" if path else f.name
        if containers:
            yield full
        yield from _paths(f.dataType, full, containers)


def json_schema(df: DataFrame, column: str) -> T.StructType:
    """One agreed schema of a JSON text column over all rows (a combinable aggregate, nothing is sampled)."""
    ddl = df.agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).head().s
    return T.DataType.fromDDL(ddl.replace("OBJECT<", "STRUCT<")) if ddl else T.StructType()


def json_field_counts(df: DataFrame, column: str) -> DataFrame:
    """Top-level keys of a JSON text column and in how many rows each occurs."""
    keys = df.select(F.explode(F.json_object_keys(column)).alias("path"))
    return keys.groupBy("path").agg(F.count(F.lit(1)).alias("n_rows"))


def json_leaf_counts(df: DataFrame, column: str) -> DataFrame:
    """`(path, n_values)`: dotted paths of a JSON text column's values at any depth, and how many values each has.

    Arrays are entered without a mark, as by `field_paths`; a JSON null is a value, an empty object or array has none. Unreadable
    and null texts count nothing. One level is opened at a time, without a shuffle, and counted before the next.
    """
    spark, found = df.sparkSession, None
    level = df.select(F.lit("").alias("path"), F.try_parse_json(column).alias("value")).where("value IS NOT NULL")
    while True:
        kind = F.schema_of_variant("value")
        nested = stage(level.withColumn("nested", kind.startswith("OBJECT") | kind.startswith("ARRAY")), "json-level")
        counts = nested.where("NOT nested").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        found = counts if found is None else found.unionByName(counts)
        containers = nested.where("nested")
        if containers.isEmpty():
            return found.groupBy("path").agg(F.sum("n").alias("n_values"))
        below = F.when(F.col("key").isNull(), F.col("path")).when(F.col("path") == "", F.col("key"))
        inner = containers.select("path", F.col("value").alias("container")).lateralJoin(
            spark.tvf.variant_explode(F.col("container").outer())
        )
        level = inner.select(below.otherwise(F.concat_ws(".", "path", "key")).alias("path"), "value")


# ---------------------------------------------------------------- profile


def profile_dataset(tables: Mapping[str, DataFrame], keys: Mapping[str, list[str]] | None = None, kind: str = "sql") -> DataFrame:
    """Per table, file or collection: current count, columns and key columns.

    Without declared keys `id` is taken for files and `_id` for documents.
    """
    assumed = {"json": ["id"], "csv": ["id"], "docs": ["_id"]}.get(kind, [])
    out = []
    for name, df in tables.items():
        key = (keys or {}).get(name) or [c for c in assumed if c in df.columns]
        out.append(
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("table"), "n_rows", F.lit(", ".join(df.columns)).alias("columns"),
                F.lit(len(df.columns)).alias("n_columns"), F.lit(", ".join(key)).alias("key_columns"),
            )
        )
    return reduce(DataFrame.unionByName, out)


def parent_keys(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """Distinct keys, the newest first where a limit is asked for (a bounded top-k, not a full sort)."""
    keys = df.select(*columns).dropna().distinct()
    return keys.orderBy(*[F.desc(c) for c in columns]).limit(limit) if limit else keys


def indexed(df: DataFrame, order_by: list[str], name: str = "idx") -> DataFrame:
    """Rows numbered 0, 1, ... in order, without moving all rows to one task."""
    from veilframe.operators.bundle import with_offsets

    return with_offsets(df, F.lit(1), order_by).drop("__start", "__last_start").withColumnRenamed("__row", name)


def pair_by_number(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Join the n-th row of one table with the n-th row of another."""
    a, b = indexed(left, left_order, "__n"), indexed(right, right_order, "__n")
    return a.join(b, "__n").drop("__n")


def running_total(df: DataFrame, column: str, order_by: list[str], out: str) -> DataFrame:
    """Sum of `column` over all earlier rows (the row itself not counted)."""
    from veilframe.operators.bundle import with_offsets

    return with_offsets(df, F.col(column), order_by).withColumnRenamed("__start", out).drop("__row", "__last_start")


def key_column_count(columns: DataFrame) -> DataFrame:
    """Adds the number of `_id` columns of each row's table.

    A combinable count joined back: unlike a window it never gathers one table's rows in a task.
    """
    ids = columns.groupBy("table").agg(F.count_if(F.lower("column").endswith("_id")).alias("n_id_columns"))
    return columns.join(ids, "table")
