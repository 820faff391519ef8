"""Greedy parts against a walk over the rows."""

import random

import numpy as np
import pytest

from veilframe.operators import bundle, rotation


def walked(sizes, limit):
    out, part, held = [], 1, 0
    for size in sizes:
        if held > 0 and held + size >= limit:
            part, held = part + 1, 0
        held += size
        out.append(part)
    return out


def sizes_of(kind, n, seed=3):
    draw = random.Random(seed)
    return {
        "even": lambda: [7] * n,
        "mixed": lambda: [draw.randrange(60) for _ in range(n)],
        "empty rows": lambda: [draw.choice([0, 0, 0, 5, 130]) for _ in range(n)],
        "large rows": lambda: [draw.choice([1, 100, 101, 250]) for _ in range(n)],
        "all empty": lambda: [0] * n,
    }[kind]()


KINDS = ["even", "mixed", "empty rows", "large rows", "all empty"]


@pytest.mark.parametrize("kind", KINDS)
def test_functions_of_chunks_compose(kind):
    for seed in range(40):
        n, limit, width = 90, 100, 1 + seed % 13
        sizes = np.array(sizes_of(kind, n, seed))
        end = np.cumsum(sizes)
        start = end - sizes
        steps = None
        for at in range(0, n, width):
            one = rotation.chunk_function(start[at : at + width], end[at : at + width], limit)
            steps = one if steps is None else rotation.composed(steps, one, 0)
        total = 1 + (int(steps[1][0]) if len(steps[0]) else 0)
        assert total == walked(sizes, limit)[-1]


@pytest.mark.parametrize("kind", KINDS)
def test_parts_as_a_walk_cuts_them(spark, kind):
    sizes = sizes_of(kind, 700)
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, size long").repartition(7)
    got = rotation.greedy_parts(df, "size", 100, "b", ["k"], chunk_rows=40).orderBy("k").collect()
    want = walked(sizes, 100)
    assert [r.part_no for r in got] == want
    assert {r.part_name for r in got} == ({f"b-part{p}" for p in want} if want[-1] > 1 else {"b"})


def test_no_rows_null_sizes_and_one_row(spark):
    empty = spark.createDataFrame([], "k long, size long")
    assert rotation.greedy_parts(empty, "size", 100, "b", ["k"]).collect() == []
    df = spark.createDataFrame([(1, None), (2, 500), (3, None), (4, 1)], "k long, size long")
    got = rotation.greedy_parts(df, "size", 100, "b", ["k"]).orderBy("k").collect()
    assert [r.part_no for r in got] == [1, 1, 2, 2]
    one = rotation.greedy_parts(df.where("k = 2"), "size", 100, "b").collect()
    assert [(r.part_no, r.part_name) for r in one] == [(1, "b")]


def test_greedy_backup_stays_below_its_limit(spark):
    df = spark.range(900).selectExpr("id", "repeat('x', int(id % 40)) AS t")
    parts = bundle.export_bundle({"t": df}, "e", 2000, greedy=True)
    head = len(bundle.MAGIC) + 1
    rows = parts.collect()
    # the limit counts a line break after every line, the last of a part has none
    assert len(rows) > 5 and all(len(r.content) - head + 1 < 2000 for r in rows)
    assert bundle.restore_table(bundle.scan_bundle(parts), "t", df.schema).count() == 900
