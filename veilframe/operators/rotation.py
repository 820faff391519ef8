"""Parts filled greedily: a part is closed before the row that would bring it to the limit.

Where a part ends depends on where it began, so on all rows before it. No row is walked one after the other, though: what a
chunk of rows does to an open part is a step function (offset at which the part began -> cuts made, offset at which the
last part began), and such functions compose. Chunks give their functions, groups of functions are composed in rounds,
and the way back down tells every chunk which part is open when it begins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.bundle import parse_size, with_offsets
from veilframe.session import stage

CHUNK_ROWS = 2**18
FAN = 8  # functions composed by one task
_FUNCTION = "chunk long, first long, bound array<long>, cuts array<long>, last array<long>"
_ENTRY = "chunk long, open long, part long"


def _next_cuts(start: np.ndarray, end: np.ndarray, begun: np.ndarray, limit: int) -> np.ndarray:
    """Number of the row that closes a part begun at each offset: it reaches the limit, and the part is not empty."""
    return np.maximum(np.searchsorted(end, begun + limit, "left"), np.searchsorted(start, begun, "right"))


def _shortened(bound, cuts, last, first: int):
    """Steps that an offset from 0 to `first` can fall on, neighbours of one value as one step."""
    keep = bound >= 0
    bound, cuts, last = bound[keep], cuts[keep], last[keep]
    top = int(np.searchsorted(bound, first, "left")) + 1
    bound, cuts, last = bound[:top], cuts[:top], last[:top]
    if len(bound) > 1:
        ends = np.append((cuts[1:] != cuts[:-1]) | (last[1:] != last[:-1]), True)
        bound, cuts, last = bound[ends], cuts[ends], last[ends]
    return bound, cuts, last


def chunk_function(start: np.ndarray, end: np.ndarray, limit: int):
    """The steps of one chunk: an offset up to `bound` is cut `cuts` times, and the last part begins at `last`; an offset
    beyond all bounds stays open."""
    n = len(start)
    following = np.append(_next_cuts(start, end, start, limit), n)
    cuts = np.append(np.ones(n, np.int64), 0)
    last = np.append(start, 0)
    live = np.flatnonzero(following[:n] < n)
    while len(live):  # pointer jumping: twice the cuts each time
        on = following[live]
        cuts[live], last[live], jumped = cuts[live] + cuts[on], last[on], following[on]
        following[live] = jumped
        live = live[jumped < n]
    bound = np.minimum(end - limit, start - 1)
    # of rows with one bound the first cuts
    fresh = np.append(True, bound[1:] != bound[:-1])
    return _shortened(bound[fresh], cuts[:n][fresh], last[:n][fresh], int(start[0]))


def composed(one, two, first: int):
    """The function of two neighbours: what the first leaves open goes into the second."""
    (bound, cuts, last), (bound2, cuts2, last2) = one, two
    at = np.searchsorted(bound2, last, "left")
    hit = at < len(bound2)
    cuts, last = cuts.copy(), last.copy()
    cuts[hit] += cuts2[at[hit]]
    last[hit] = last2[at[hit]]
    beyond = bound2 > (bound[-1] if len(bound) else -1)
    joined = [np.concatenate(pair) for pair in ((bound, bound2[beyond]), (cuts, cuts2[beyond]), (last, last2[beyond]))]
    return _shortened(*joined, first)


def _steps(row):
    return tuple(np.asarray(x, dtype=np.int64) for x in (row.bound, row.cuts, row.last))


def _function_row(chunk: int, first: int, steps) -> pd.DataFrame:
    bound, cuts, last = steps
    return pd.DataFrame({"chunk": [chunk], "first": [first], "bound": [bound], "cuts": [cuts], "last": [last]})


def greedy_parts(
    df: DataFrame, size_col: str | Column, max_bytes: int | str, base: str = "export", order_by: list[str] | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Part number (from 1) and part name of each row, parts filled one after the other.

    A row that would bring a part that holds bytes to `max_bytes` or beyond begins the next part; a row of the limit or
    more is a part of its own. A null size counts as none. Without rows there are no parts. A task holds the sizes of
    `chunk_rows` rows, or `FAN` functions of at most that many steps (steps of a group: the rows of one part).
    """
    limit = max(1, parse_size(max_bytes))
    size = F.col(size_col) if isinstance(size_col, str) else size_col
    sized = df.withColumn("__length", F.coalesce(size.cast("long"), F.lit(0).cast("long")))
    rows = with_offsets(sized, F.col("__length"), order_by).drop("__last_start")
    offsets = rows.select(
        F.call_function("div", F.col("__row"), F.lit(chunk_rows).cast("long")).alias("chunk"),
        F.col("__row").alias("row"),
        F.col("__start").alias("start"),
        (F.col("__start") + F.col("__length")).alias("end"),
    )

    def functions(key, group):
        group = group.sort_values("row")
        start, end = group["start"].to_numpy(), group["end"].to_numpy()
        return _function_row(key[0], int(start[0]), chunk_function(start, end, limit))

    def compose(key, group):
        group = group.sort_values("chunk")
        first = int(group["first"].iloc[0])
        steps = None
        for row in group.itertuples():
            steps = _steps(row) if steps is None else composed(steps, _steps(row), first)
        return _function_row(key[0], first, steps)

    levels = [stage(offsets.groupBy("chunk").applyInPandas(functions, _FUNCTION), "part-functions")]
    top = levels[0].agg(F.max("chunk").alias("top")).head().top
    parent = F.call_function("div", F.col("chunk"), F.lit(FAN).cast("long")).alias("parent")
    while top:
        levels.append(stage(levels[-1].groupBy(parent).applyInPandas(compose, _FUNCTION), "part-functions"))
        top //= FAN

    def enter(key, group, entry):
        at, part, out = int(entry["open"].iloc[0]), int(entry["part"].iloc[0]), []
        for row in group.sort_values("chunk").itertuples():
            out.append((row.chunk, at, part))
            bound, cuts, last = _steps(row)
            step = int(np.searchsorted(bound, at, "left"))
            if step < len(bound):
                at, part = int(last[step]), part + int(cuts[step])
        return pd.DataFrame(out, columns=["chunk", "open", "part"])

    spark = df.sparkSession
    entries = spark.createDataFrame([(0, 0, 1)], _ENTRY)
    for level in reversed(levels[:-1]):
        entries = level.groupBy(parent).cogroup(entries.groupBy("chunk")).applyInPandas(enter, _ENTRY)
        entries = stage(entries, "part-entries")

    def number(key, group, entry):
        group = group.sort_values("row")
        start, end = group["start"].to_numpy(), group["end"].to_numpy()
        begun = int(entry["open"].iloc[0])
        following = _next_cuts(start, end, start, limit).tolist()
        at, begins = int(_next_cuts(start, end, np.array([begun]), limit)[0]), np.zeros(len(start), np.int64)
        while at < len(start):
            begins[at] = 1
            at = following[at]
        return pd.DataFrame({"__row": group["row"].to_numpy(), "part_no": int(entry["part"].iloc[0]) + np.cumsum(begins)})

    numbered = offsets.groupBy("chunk").cogroup(entries.groupBy("chunk")).applyInPandas(number, "__row long, part_no int")
    whole = levels[-1].select((F.size("cuts") > 0).alias("cut")).head()
    name = F.concat(F.lit(f"{base}-part"), F.col("part_no").cast("string")) if whole and whole.cut else F.lit(base)
    return rows.drop("__length").join(numbered, "__row").withColumn("part_name", name)
