"""Sharding by sampled splitters: ranges of equal weight from a size-weighted sample, subdivided where overfull."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.common import column
from veilframe.session import stage

RANGE_BYTES = 256 << 20
MIN_RANGES = 256
SAMPLES_PER_RANGE = 16


def _eight(number: Column) -> Column:
    """A 64-bit number as eight bytes."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def _range_of(splitters: np.ndarray):
    @F.pandas_udf("int")
    def find(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, np.array(key.tolist(), "S24"), "right").astype(np.int32))

    return find


def _quantiles(keys: np.ndarray, weights: np.ndarray, parts: int) -> np.ndarray:
    """Keys that cut a weighted sample into `parts` of about equal weight."""
    order = np.argsort(keys, kind="stable")
    total = np.cumsum(weights[order])
    if not len(total) or parts < 2:
        return np.zeros(0, "S24")
    at = np.searchsorted(total, total[-1] * np.arange(1, parts) / parts)
    return np.unique(keys[order][np.minimum(at, len(total) - 1)])


def _sample(df: DataFrame, total: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """About `wanted` keys, each drawn with a chance in proportion to its size, and the weights they stand for."""
    chance = F.least(F.lit(1.0), F.col("size") * (wanted / max(total, 1)))
    draw = F.shiftrightunsigned(F.xxhash64("key", F.lit(7)), 11) / F.lit(float(1 << 53))
    rows = df.where(draw < chance).select("key", (F.col("size") / chance).alias("w")).collect()
    return np.array([bytes(r.key) for r in rows], "S24"), np.array([r.w for r in rows], float)


def shard_records(
    df: DataFrame, size: Column, group: Column, shards: int, range_bytes: int = RANGE_BYTES, min_ranges: int = MIN_RANGES,
) -> DataFrame:
    """All rows of `df` with `shard` (0 to shards-1), `slot` (0, 1, ... within the shard) and `size`.

    Records are ordered by a digest of `group`, then by a hash of the whole row, so records of one group lie together
    and no source, id or length decides the order. A sample in which a record's chance is in proportion to its size
    gives quantile splitters; ranges that the exact counts show to be overfull (over twice the mean, their largest record aside) are cut again by a
    denser sample of their own until none is left or a cut no longer helps. Within a range records are numbered and their
    bytes summed; with the exact sums of the ranges before it every record knows its first byte's place in the whole
    order, and shard s takes those that begin in the s-th of `shards` equal stretches. So the bytes of two shards differ
    by less than twice the largest record, whatever the sample was like, and a group of any size is simply cut where
    a stretch ends.

    Null sizes count as 1 and sizes below 1 as 1, so that every record has a place of its own. Records equal in every
    column are told apart by their place in the staged input. Columns of `df` named shard, slot or size are replaced.
    The driver holds one small row per range and about 16 sampled keys per range; there is a range per `range_bytes`,
    at least `min_ranges`. `df` is staged: select the columns to be sharded first.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot", "size")]
    rows = stage(
        df.select(
            *[column(c).alias(f"c_{i}") for i, c in enumerate(keep)],
            F.greatest(F.coalesce(size, F.lit(1)), F.lit(1)).cast("long").alias("size"),
            F.concat(
                _eight(F.xxhash64(group.isNull(), group)), _eight(F.xxhash64(*[x for c in keep for x in (column(c).isNull(), column(c).cast("string"))])),
                _eight(F.monotonically_increasing_id()),
            ).alias("key"),
        ),
        "sharding",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = max(min_ranges, -(-total // range_bytes))
    splitters = _quantiles(*_sample(rows, total, ranges * SAMPLES_PER_RANGE), ranges)
    counts: dict[int, tuple[int, int, int]] = {}
    while True:
        found = rows.withColumn("range", _range_of(splitters)("key"))
        sums = found.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("largest"))
        counts = {r["range"]: (r["bytes"], r["n"], r["largest"]) for r in sums.collect()}
        goal = max(1, total // ranges)
        over = [r for r, (b, _, largest) in counts.items() if b - largest > 2 * goal]
        inside = sum(counts[r][0] for r in over)
        if not over:
            break
        keys, weights = _sample(found.where(F.col("range").isin(over)), inside, -(-inside // goal) * SAMPLES_PER_RANGE)
        where = np.searchsorted(splitters, keys, "right")
        more = [_quantiles(keys[where == r], weights[where == r], -(-2 * counts[r][0] // goal)) for r in over]
        finer = np.unique(np.concatenate([splitters, *more]))
        if len(finer) == len(splitters):
            break
        splitters = finer

    n = len(splitters) + 1
    bytes_before, rows_before = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    for r, (b, c, _) in counts.items():
        bytes_before[r + 1], rows_before[r + 1] = b, c
    bytes_before, rows_before = np.cumsum(bytes_before), np.cumsum(rows_before)

    @F.pandas_udf("struct<first_byte:long, first_row:long>")
    def begin(number: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"first_byte": bytes_before[number.to_numpy()], "first_row": rows_before[number.to_numpy()]})

    inside = Window.partitionBy("range").orderBy("key")
    placed = (
        rows.withColumn("range", _range_of(splitters)("key"))
        .withColumn("nth", F.row_number().over(inside) - 1)
        .withColumn("bytes", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("start", begin("range"))
        .select("*", (F.col("start.first_byte") + F.col("bytes")).alias("at"), (F.col("start.first_row") + F.col("nth")).alias("row"))
        .withColumn("shard", F.expr(f"cast(cast(at as decimal(38,0)) * {shards} div {max(total, 1)} as int)"))
    )
    # The first row of each shard: ranges are whole in a shard but for those in which a stretch begins.
    firsts = {r.shard: r.row for r in placed.groupBy("shard").agg(F.min("row").alias("row")).collect()}
    first = F.element_at(F.array(*[F.lit(int(firsts.get(s, 0))) for s in range(shards)]), F.col("shard") + 1)
    return placed.select(
        *[F.col(f"c_{i}").alias(c) for i, c in enumerate(keep)], "size", "shard", (F.col("row") - first).alias("slot"),
    )


def write_shards(df: DataFrame, path: str, size: Column, group: Column, shards: int) -> None:
    """Write every shard below `path` as `shard=<s>`, in the order of the slots."""
    sharded = shard_records(df, size, group, shards)
    sharded.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(os.fspath(path))
