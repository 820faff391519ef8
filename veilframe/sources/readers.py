"""Readers: databases, delimited files, JSON, documents, file listings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jdbc_options(
    url: str,
    table: str,
    columns: Iterable[str] = (),
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 16,
    fetchsize: int = 2500,
    **connection: str,
) -> dict[str, str]:
    """Options of one partitioned read: a numeric key with bounds splits the table into ranges.

    Range splits replace paging by the first column, which loses rows at page borders when that column repeats.
    """
    columns = list(columns)
    source = f"(SELECT {', '.join(columns)} FROM {table}) src" if columns else table
    options = {"url": url, "dbtable": source, "fetchsize": str(fetchsize), **connection}
    if key and bounds:
        options |= {
            "partitionColumn": key,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def scan_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **options)).load()


def _trimmed(c: Column) -> Column:
    return F.coalesce(F.btrim(c, F.lit(" \t\r\n")), F.lit(""))


def scan_csv(spark: SparkSession, path, multiline: bool = False, ragged: str | None = None) -> DataFrame:
    """Delimited text with a header: every column is text, fields are trimmed, an absent field is the empty text.

    Files of one path must have the same header; a file whose header differs is an error, not a shifted column.
    `ragged="col_"` keeps surplus fields as columns `col_<position>`; it costs one pass to find the widest line.
    """
    header = csv_headers(spark, path, multiline)
    names = list(header)
    if ragged:
        names += [f"{ragged}{i}" for i in range(len(header), _widest_line(spark, path))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).csv(
        path, header=True, quote='"', escape='"', multiLine=multiline, encoding="UTF-8", enforceSchema=bool(ragged),
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
    )
    return rows.select(*[_trimmed(F.col(f"`{n}`")).alias(n) for n in names])


def csv_headers(spark: SparkSession, path, multiline: bool = False) -> list[str]:
    """Header names of the first file, trimmed."""
    return [
        c.strip()
        for c in spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multiline, enforceSchema=True).columns
    ]


def count_rows_csv(spark: SparkSession, path, multiline: bool = False) -> int:
    """Data rows without the header and without blank lines."""
    return scan_csv(spark, path, multiline).count()


def _widest_line(spark: SparkSession, path) -> int:
    bare = F.regexp_replace("value", r'"[^"]*+(?:""[^"]*+)*+"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    return spark.read.text(path).agg(F.max(fields)).head()[0] or 0


def scan_json(spark: SparkSession, path, schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """JSON files holding one object or one array each; array elements become rows."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=not lines)


def scan_docs(spark: SparkSession, path, schema: T.StructType | None = None, form: str = "json") -> DataFrame:
    """A collection stored as JSON lines (or any columnar form Spark reads), nested fields kept."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.format(form).load(path)


# What a file's extension says about it.
_KINDS = [(r"\.csv(\.enc)?$", "CSV"), (r"\.jsonl?(\.enc)?$", "JSON"), (r"\.sql(\.enc)?$", "SQL"),
          (r"\.bson(\.enc)?$", "DOCUMENTS"), (r"\.parquet$", "PARQUET")]


def list_files(spark: SparkSession, path: str, extensions: Iterable[str] = (), depth: int = 1) -> DataFrame:
    """Files below `path` (local or object store) with size, kind and whether they are encrypted.

    Only names and sizes are read; the content column is pruned.
    """
    rows = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true" if depth > 1 else "false")
        .load(path)
        .select("path", "length", "modificationTime")
    )
    rows = rows.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    if depth > 1:
        root = path.split("://")[-1].rstrip("/")
        below = F.regexp_replace(F.col("path"), r"^.*?" + _escaped(root) + "/", "")
        rows = rows.filter(F.size(F.split(below, "/")) <= depth)
    lower = F.lower("name")
    wanted = [lower.endswith(e.lower()) for e in extensions]
    if wanted:
        keep = wanted[0]
        for w in wanted[1:]:
            keep = keep | w
        rows = rows.filter(keep)
    kind = F.lit("OTHER")
    for pattern, name in reversed(_KINDS):
        kind = F.when(lower.rlike(pattern), name).otherwise(kind)
    return rows.withColumns({"encrypted": lower.endswith(".enc"), "kind": kind})


def _escaped(text: str) -> str:
    import re

    return re.escape(text)
