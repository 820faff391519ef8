"""Preview: what a rule set would do, shown without the protected values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.partial import redact
from veilframe.operators.catalog import sample_rows
from veilframe.operators.classify import classify_columns
from veilframe.plans.compiler import active_rule, mask_table
from veilframe.plans.rules import RuleSet


@dataclass(frozen=True)
class Preview:
    labels: dict[str, str]
    before: DataFrame
    after: DataFrame
    masked_columns: int


def column_labels(spark: SparkSession, table: str, columns: list[str], rules: RuleSet, profile: str = "table") -> dict[str, str]:
    """Rule kind per column; an unruled column whose name looks sensitive is labelled by classification."""
    labels = {c: active_rule(rules, table, c, profile) for c in columns}
    open_columns = [c for c, kind in labels.items() if kind is None]
    if open_columns:
        catalog = spark.createDataFrame([(table, c) for c in open_columns], "table string, column string")
        guessed = {r.column: r.rule for r in classify_columns(catalog, alone=True).collect()}
        labels |= {c: guessed.get(c, "NONE") for c in open_columns}
    return labels


def preview(df: DataFrame, table: str, rules: RuleSet, n: int = 5, profile: str = "table", key: str | None = None) -> Preview:
    """Labels, redacted rows, masked rows; at most ten rows, or stand-in rows for an empty table."""
    spark = df.sparkSession
    labels = column_labels(spark, table, df.columns, rules, profile)
    rows = sample_rows(df, n, key)
    if df.isEmpty():
        rows = stand_in_rows(spark, df.columns, min(max(n, 1), 10))
    before = rows.select(*[redact(F.col(f"`{c}`"), labels[c]).alias(c) for c in df.columns])
    masked = mask_table(rows, table, rules, profile)
    after = masked.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")).alias(c) for c in df.columns])
    return Preview(labels, before, after, sum(kind != "NONE" for kind in labels.values()))


def stand_in_value(name: str, i: Column) -> tuple[Column, T.DataType]:
    """A plausible value for a column name and a row number (from 1)."""
    c, text = name.lower(), i.cast("string")
    fixed: list[tuple[tuple[str, ...], Column]] = [
        (("email",), F.concat(F.lit("user"), text, F.lit("@example.com"))),
        (("first_name", "fname"), F.lit("John")),
        (("last_name", "lname"), F.lit("Doe")),
        (("name",), F.concat(F.lit("User "), text)),
        (("phone",), F.concat(F.lit("+1-555-019"), text)),
        (("address", "street"), F.concat((i + 100).cast("string"), F.lit(" Main Boulevard"))),
        (("city",), F.lit("New York")),
        (("zip", "postal"), F.concat(F.lit("1000"), text)),
        (("country",), F.lit("United States")),
        (("card", "pan"), F.concat(F.lit("4111-2222-3333-444"), text)),
        (("ssn",), F.concat(F.lit("987-65-432"), text)),
    ]
    if c == "id" or c.endswith("_id"):
        return (i + 1000).cast("int"), T.IntegerType()
    for fragments, value in fixed:
        if any(f in c for f in fragments):
            return value, T.StringType()
    if any(f in c for f in ("salary", "amount", "balance")):
        return (i * 250 + 5000).cast("double"), T.DoubleType()
    if "dob" in c or "birth" in c:
        day = F.make_date((i % 15 + 1985).cast("int"), (i % 12 + 1).cast("int"), (i % 28 + 1).cast("int"))
        return day.cast("string"), T.StringType()
    if "status" in c:
        return F.lit("ACTIVE"), T.StringType()
    if "active" in c or c.startswith("is_"):
        return F.lit(True), T.BooleanType()
    return F.concat(F.lit(f"Sample {name} "), text), T.StringType()


def stand_in_rows(spark: SparkSession, columns: list[str], n: int) -> DataFrame:
    """Rows for the preview of an empty table."""
    ids = spark.range(1, n + 1)
    return ids.select(*[stand_in_value(c, F.col("id"))[0].alias(c) for c in columns])
