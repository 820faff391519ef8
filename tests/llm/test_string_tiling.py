import random

import numpy as np
import plain
from pyspark.sql import functions as F

from veilframe.llm.queries import QUERIES
from veilframe.llm.string_tiling import benchmark_blocks, is_contaminated, tile_coverage, tiles

SMALL = "/root/testdata/sf0.001"


def test_against_all_places():
    draw = random.Random(1)
    for _ in range(300):
        text = [draw.randrange(6) for _ in range(draw.randrange(60))]
        item = [draw.randrange(6) for _ in range(draw.randrange(1, 30))]
        if len(text) > 20 and draw.random() < 0.7:
            a = draw.randrange(len(text) - 10)
            item[3:3] = text[a : a + draw.randrange(3, 25)]
        least = draw.choice([2, 3, 5])
        got, want = tiles(np.array(text, np.uint64), np.array(item, np.uint64), least), plain.tiling(text, item, least)
        for i, j, n in got:
            assert text[i : i + n] == item[j : j + n]
        assert sorted(x[2] for x in got)[-1:] == sorted(x[2] for x in want)[-1:]
        for side in (0, 1):  # no place is used twice
            places = [p for x in got for p in range(x[side], x[side] + x[2])]
            assert len(places) == len(set(places))
        free_t, free_i = [True] * len(text), [True] * len(item)
        for i, j, n in got:
            free_t[i : i + n] = free_i[j : j + n] = [False] * n
        left = [([v if f else -1 - k for k, (v, f) in enumerate(zip(text, free_t, strict=True))]), ([v if f else -1000 - k for k, (v, f) in enumerate(zip(item, free_i, strict=True))])]
        assert len(item) < least or not plain.tiling(*left, least)  # nothing long enough is left


def test_reordered_and_edited_passages(spark):
    draw = random.Random(2)
    words = [f"word{i}" for i in range(400)]
    item = [draw.choice(words) for _ in range(40)]
    other = lambda n: [draw.choice(words) + "x" for _ in range(n)]
    turned = item[20:] + other(7) + item[:20]
    edited = [w if i % 13 else "changed" for i, w in enumerate(item)]
    docs = [(1, " ".join(other(50) + item + other(50))), (2, " ".join(other(9) + turned)), (3, ", ".join(edited).upper()), (4, " ".join(other(99) + item[:15])),
            (5, " ".join(other(100))), (6, None), (7, ""), (8, "three short words"), (8, "THREE short, words!"), (None, " ".join(item)), (9, " ".join(item * 900))]
    bench = [(1, " ".join(item)), (2, "Three short words"), (3, ""), (4, None), (5, "..."), (None, " ".join(item))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for size in (250, 1 << 20):  # several blocks, one block
        rows = tile_coverage(d, b, block_bytes=size).collect()
        got = sorted((r.doc_id or 0, r.item_id or 0) for r in rows)
        long = [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (9, 0), (9, 1)]
        assert got == sorted([*long, (8, 2), (8, 2)])
        hit = d.withColumn("hit", is_contaminated(F.col("text"), list(benchmark_blocks(b, block_bytes=size)))).collect()
        assert sorted(r.doc_id or 0 for r in hit if r.hit) == [0, 1, 2, 3, 8, 8, 9]
    assert {r.n_tiles for r in rows if r.doc_id == 2} == {2} and {r.coverage for r in rows if r.doc_id == 2} == {1.0}


def test_query_finds_whole_passages(spark, documents):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = {(i, j) for i, t in documents for j, b in bench if b in (t or "")}
    rows = QUERIES["op5_string_tiling"].run(spark, SMALL).collect()
    assert want and {(r.doc_id, r.item_id) for r in rows if r.coverage == 1} >= want
    assert {r.doc_id for r in rows} == {i for i, _ in want}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "hot copy of one text that a third of all rows hold", 0)], "item_id long, text string, coverage int")
    assert tile_coverage(odd, bench).count() == 12
    assert tile_coverage(none, bench).count() == 0 == tile_coverage(odd, bench.limit(0)).count()
    assert odd.where(is_contaminated(F.col("text"), list(benchmark_blocks(bench.limit(0))))).count() == 0
