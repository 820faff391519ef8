"""Writers: databases, delimited files, JSON, documents, mirrored trees."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.plans.compiler import max_length_of
from veilframe.sources.committed import NAME, plain_json, save_lines, save_named

# SQL type name -> type in the created table; names not listed pass through.
TYPE_MAP = {
    "integer": "INTEGER", "int4": "INTEGER", "bigint": "BIGINT", "int8": "BIGINT", "smallint": "SMALLINT",
    "int2": "SMALLINT", "timestamp without time zone": "TIMESTAMP", "timestamp": "TIMESTAMP",
    "timestamp with time zone": "TIMESTAMPTZ", "timestamptz": "TIMESTAMPTZ", "date": "DATE", "boolean": "BOOLEAN",
    "bool": "BOOLEAN", "text": "TEXT", "double precision": "DOUBLE PRECISION", "float8": "DOUBLE PRECISION",
    "real": "REAL", "float4": "REAL", "uuid": "UUID", "bytea": "BYTEA", "json": "JSONB", "jsonb": "JSONB",
}
_SPARK_NAMES = {
    T.ByteType: "smallint", T.ShortType: "smallint", T.IntegerType: "integer", T.LongType: "bigint",
    T.FloatType: "real", T.DoubleType: "double precision", T.BooleanType: "boolean", T.DateType: "date",
    T.TimestampType: "timestamptz", T.TimestampNTZType: "timestamp", T.BinaryType: "bytea",
}


def map_type_name(name: str, length: int | None = None, precision: int | None = None, scale: int | None = None) -> str:
    """Column type of the created table for a catalog type name."""
    name = name.lower()
    if name in ("character varying", "varchar"):
        return f"VARCHAR({length})" if length else "TEXT"
    if name in ("character", "char"):
        return f"CHAR({length or 1})"
    if name in ("numeric", "decimal"):
        return f"NUMERIC({precision},{scale})" if precision is not None and scale is not None else "NUMERIC"
    return TYPE_MAP.get(name, name)


def map_type(field: T.StructField) -> str:
    """Column type of the created table for a Spark field."""
    meta = field.metadata or {}
    if isinstance(field.dataType, T.DecimalType):
        return map_type_name("numeric", precision=field.dataType.precision, scale=field.dataType.scale)
    if isinstance(field.dataType, T.CharType):
        return map_type_name("char", field.dataType.length)
    if isinstance(field.dataType, (T.StringType, T.VarcharType)):
        return "UUID" if meta.get("logical") == "uuid" else map_type_name("varchar", max_length_of(field))
    if isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return "JSONB"
    return map_type_name(_SPARK_NAMES.get(type(field.dataType), field.dataType.simpleString()))


def prepare_table(spark: SparkSession, schema: T.StructType, path: str, form: str = "parquet") -> None:
    """Drop and create: an empty table with the schema; keys are checked after the load instead."""
    spark.createDataFrame([], schema).write.mode("overwrite").format(form).save(path)


def write_jdbc(df: DataFrame, url: str, table: str, batchsize: int = 1000, mode: str = "append", **connection) -> None:
    types = ", ".join(f"{f.name} {map_type(f)}" for f in df.schema.fields if map_type(f) not in ("JSONB", "UUID"))
    df.write.option("createTableColumnTypes", types).jdbc(
        url, table, mode=mode, properties={"batchsize": str(batchsize), **connection}
    )


def new_rows(df: DataFrame, target: DataFrame, keys: list[str], order_by: list[str] | None = None) -> DataFrame:
    """Rows an insert that ignores conflicts would add: first of each key, and no key already in the target.

    `order_by` says which row of a repeated key comes first (all columns otherwise); the choice is a combinable
    aggregate, so a hot key is reduced before the shuffle. Rows with a null in the key never conflict.
    """
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    order = F.struct(*(order_by or df.columns))
    first = df.filter(complete).groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("__row"))
    held = target.select(*keys).distinct()  # shares the join's shuffle and shrinks a hot key
    first = first.select("__row.*").join(held, keys, "left_anti").select(*df.columns)
    return first.unionByName(df.filter(~complete))


def write_ignore_conflicts(df: DataFrame, path: str, keys: list[str], form: str = "parquet") -> None:
    """Append the rows whose keys the table at `path` does not hold yet."""
    target = df.sparkSession.read.format(form).load(path)
    new_rows(df, target, keys).write.mode("append").format(form).save(path)


def write_docs(df: DataFrame, path: str, drop: bool = True) -> None:
    """A collection as JSON lines; `drop` clears it first."""
    df.write.mode("overwrite" if drop else "append").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, quotes only where needed, quotes doubled, empty text for null, blanks around a value kept.

    In a table of one column an empty value is written as two quotes, since readers skip empty lines.
    """
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    text.na.fill("").write.mode(mode).csv(
        path, header=True, quote='"', escape='"', emptyValue='""' if len(df.columns) == 1 else "", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def with_relative_path(df: DataFrame, base: str) -> DataFrame:
    """The source file's path relative to `base` as column `rel`; must follow the scan directly."""
    root = re.escape(base.split("://")[-1].rstrip("/"))
    return df.withColumn("rel", F.regexp_replace(F.col("_metadata.file_path"), r"^.*?" + root + "/", ""))


def write_mirrored(df: DataFrame, path: str, form: str = "csv", rel: str = "rel") -> None:
    """One folder per source file, named by its relative path.

    No repartition by file: each task writes the files it has read, so one huge source file stays spread.
    """
    writer = df.write.mode("overwrite").partitionBy(rel)
    (writer.option("header", "true").option("escape", '"') if form == "csv" else writer).format(form).save(path)


def save_mirrored(df: DataFrame, folder: str, form: str = "csv", rel: str = "rel", base: str = "mirror") -> list[str]:
    """The source tree again: rows go to a file at the path in column `rel` below `folder`, all put in place by one commit.

    A file that several tasks have read is written in several parts, `<stem>-part1.csv` and so on.
    """

    def write(writer, path):
        (writer.option("header", "true").option("escape", '"') if form == "csv" else writer).format(form).save(path)

    return save_named(df.withColumnRenamed(rel, NAME), folder, base, write)


def record_name(base: str, seq: Column, count: int) -> Column:
    """`<base>_<seq>.json`, or `<base>.json` for a single record; a trailing `_12` or `-12` of the base is dropped."""
    stem = re.sub(r"(?i)\.json$", "", base)
    stem = re.sub(r"^(.*?)[-_]\d+$", r"\1", stem)
    return F.lit(f"{stem}.json") if count == 1 else F.concat(F.lit(f"{stem}_"), seq.cast("string"), F.lit(".json"))


def write_one_per_record(df: DataFrame, path: str) -> None:
    """One JSON file per record."""
    df.write.mode("overwrite").option("maxRecordsPerFile", 1).option("ignoreNullFields", "false").json(path)


def save_one_per_record(df: DataFrame, folder: str, name: Column, base: str = "records") -> list[str]:
    """One JSON file per record, called by `name` (see `record_name`), all put in place by one commit. Names must differ."""
    rows = df.select(plain_json(df).alias("value"), name.alias(NAME))
    return save_lines(rows, folder, base)


def split_rejects(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Text rows to typed rows: (good, rejected). A row is rejected when any present value does not fit its type.

    This replaces retrying a failed batch row by row.
    """
    typed = df.select("*", *[F.col(f.name).try_cast(f.dataType).alias(f"__{f.name}") for f in schema.fields])
    bad = reduce(
        lambda a, b: a | b, [F.col(f.name).isNotNull() & F.col(f"__{f.name}").isNull() for f in schema.fields]
    )
    good = typed.filter(~bad).select(*[F.col(f"__{f.name}").alias(f.name) for f in schema.fields])
    return good, typed.filter(bad).select(*df.columns)
