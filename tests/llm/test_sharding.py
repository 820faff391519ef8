import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veilframe.llm.queries import QUERIES
from veilframe.llm.sharding import shard_records

SMALL = "/root/testdata/sf0.001"


def check(rows, sizes, shards):
    by = defaultdict(list)
    for shard, slot, size in rows:
        by[shard].append((slot, size))
    assert set(by) <= set(range(shards))
    assert all(sorted(s for s, _ in x) == list(range(len(x))) for x in by.values())
    total = [sum(z for _, z in by.get(s, [])) for s in range(shards)]
    assert sum(total) == sum(sizes) and max(total) - min(total) < 2 * max(sizes)


def test_query(spark, documents):
    got = QUERIES["op1_sampled_splitters"].run(spark, SMALL).collect()
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in documents}
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and len(got) == len(documents)
    check([(r.shard, r.slot, r.size) for r in got], [r.size for r in got], 8)
    place = {r.doc_id: (r.shard, r.slot) for r in got}
    copies = defaultdict(list)
    for i, t in documents:
        copies[t].append(place[i])
    for places in copies.values():  # copies lie side by side
        places.sort()
        assert all(b[0] == a[0] and b[1] == a[1] + 1 or b[0] == a[0] + 1 and b[1] == 0 for a, b in zip(places, places[1:], strict=False))


def test_odd_rows_and_hot_group(spark, odd):
    got = shard_records(odd, F.octet_length("text"), F.col("text"), 3).collect()
    assert Counter((r.doc_id, r.text, r.score) for r in got) == Counter((r.doc_id, r.text, r.score) for r in odd.collect())
    check([(r.shard, r.slot, r.size) for r in got], [r.size for r in got], 3)


def test_one_repeated_row_is_split(spark):
    rows = spark.range(0, 4000).select(F.lit("same").alias("text"), F.lit(None).cast("long").alias("doc_id"))
    got = shard_records(rows, F.lit(10), F.col("text"), 4, min_ranges=8).collect()
    check([(r.shard, r.slot, r["size"]) for r in got], [10] * 4000, 4)


def test_overfull_ranges_are_cut(spark):
    rows = spark.range(0, 3000).select("id", F.when(F.col("id") % 50 == 0, 100_000).otherwise(1).alias("bytes"))
    got = shard_records(rows, F.col("bytes"), F.col("id"), 5, min_ranges=40).collect()
    check([(r.shard, r.slot, r["size"]) for r in got], [r["size"] for r in got], 5)


def test_empty(none):
    assert shard_records(none, F.octet_length("text"), F.col("text"), 4).count() == 0
