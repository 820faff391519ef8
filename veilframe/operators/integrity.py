"""Key constraints as checks: each returns the violating rows, so an empty result means the constraint holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.operators.catalog import row_counts


def check_unique(df: DataFrame, columns: list[str], primary: bool = False) -> DataFrame:
    """Keys that occur more than once; a primary key may not hold nulls either (a unique key may)."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    rows = df.select(*columns)
    repeated = rows.filter(complete).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")
    if not primary:
        return repeated
    return repeated.unionByName(rows.filter(~complete).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")))


def check_foreign_key(child: DataFrame, child_columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Child keys without a parent, with how many rows carry each.

    Both sides are reduced to distinct keys before the join, so one hot key is a single row there; the reduction uses
    the shuffle the join needs anyway.
    """
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in child_columns])
    keys = child.filter(complete).groupBy(*child_columns).agg(F.count(F.lit(1)).alias("n_rows"))
    parents = parent.select(*[F.col(p).alias(c) for c, p in zip(child_columns, parent_columns, strict=True)])
    return keys.join(parents.distinct(), child_columns, "left_anti")


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null counts of the columns that have any."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.unpivot([], columns, "column", "n_null")
    return long.filter("n_null > 0")


def check_injective(df: DataFrame, before: str, after: str) -> DataFrame:
    """Distinct values before and after masking in one row; equal when no two values were merged.

    Both columns come from one plan, so the pairs are counted as well.
    """
    pairs = df.select(F.col(before).alias("b"), F.col(after).alias("a")).dropna(subset=["b"]).distinct()
    per_after = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    return per_after.agg(F.sum("n").alias("distinct_in"), F.count(F.lit(1)).alias("distinct_out"))


def check_domain(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    """Distinct keys that lie outside an integer domain, where encryption would no longer be one to one."""
    outside = df.filter(~F.col(column).between(low, high))
    return outside.groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def check_fk_preserved(
    child: DataFrame, child_columns: list[str], parent: DataFrame, parent_columns: list[str],
    masked_child: DataFrame, masked_parent: DataFrame,
) -> DataFrame:
    """Orphan rows before and after masking, in one row; masking keeps joins when they are equal."""

    def orphans(c: DataFrame, p: DataFrame, name: str) -> DataFrame:
        return check_foreign_key(c, child_columns, p, parent_columns).agg(
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n")
        ).select(F.lit(name).alias("side"), "n")

    both = orphans(child, parent, "before").unionByName(orphans(masked_child, masked_parent, "after"))
    return both.agg(
        F.max(F.when(F.col("side") == "before", F.col("n"))).alias("orphans_before"),
        F.max(F.when(F.col("side") == "after", F.col("n"))).alias("orphans_after"),
    )


def reconcile(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> DataFrame:
    """Row counts per table on both sides and whether they agree."""
    a = row_counts(source).withColumnRenamed("n_rows", "source_rows")
    b = row_counts(target).withColumnRenamed("n_rows", "target_rows")
    return a.join(b, "table", "full_outer").withColumn(
        "matches", F.col("source_rows").eqNullSafe(F.col("target_rows"))
    )
