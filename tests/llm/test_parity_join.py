import random

import numpy as np
import plain
import pytest

from veilframe.llm.components import components
from veilframe.llm.parity_join import Bands, near_copies, parity_sketch, signatures, similar_pairs
from veilframe.llm.queries import QUERIES
from veilframe.llm.words import mix

SMALL = "/root/testdata/sf0.001"


def texts(seed, families, copies, length):
    """Families of texts, each with copies that differ in more and more words."""
    draw, out = random.Random(seed), []
    for f in range(families):
        first = [f"w{draw.randrange(3000)}" for _ in range(draw.randrange(*length))]
        for c in range(copies):
            now = list(first)
            for _ in range(c // 2):
                now[draw.randrange(len(now))] = f"x{draw.randrange(10**6)}"
            out.append(" ".join(now))
    draw.shuffle(out)
    return list(enumerate(out, 1))


@pytest.mark.parametrize(("num", "den", "width"), [(85, 100, 4), (80, 100, 5), (60, 100, 2), (100, 100, 2)])
def test_against_all_pairs(spark, num, den, width):
    docs = texts(3, 14, 9, (3, 160)) + [(1000, "a"), (1001, "A"), (1002, "b a"), (1003, ""), (1004, " \n"), (1005, None), (1006, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_copies(df, num, den, width, partition_signatures=500).collect()}
    assert got == plain.components(docs, num, den, width)


def test_query(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_parity_sketch_join"].run(spark, SMALL).collect()}
    assert got == plain.components(documents, 85, 100, 4)


def test_large_buckets_are_tiled(spark, monkeypatch):
    from veilframe.llm import parity_join

    monkeypatch.setattr(parity_join, "TILE", 4)
    docs = texts(5, 3, 30, (80, 120))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_copies(df, 80, 100, 3).collect()}
    assert got == plain.components(docs, 80, 100, 3)


def test_texts_fetched_by_shuffle(spark, monkeypatch):
    from veilframe.llm import parity_join

    monkeypatch.setattr(parity_join, "BROADCAST_ROWS", 0)
    docs = texts(6, 5, 6, (30, 60))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_copies(spark.createDataFrame(docs, "doc_id long, text string"), 80, 100, 3).collect()}
    assert got == plain.components(docs, 80, 100, 3)


@pytest.mark.parametrize("tile", [512, 4])
def test_every_link_is_counted_and_returned(spark, monkeypatch, tile):
    from veilframe.llm import parity_join

    monkeypatch.setattr(parity_join, "TILE", tile)
    docs = texts(7, 6, 12, (40, 160))
    docs += [(i + 2000, t) for i, t in docs[:20]] + [(3000, ""), (3001, None), (3002, "b a")]
    sets = {i: plain.shingles(t, 3) for i, t in docs}
    want = {(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_links for r in near_copies(df, 80, 100, 3, links=True).collect()}
    assert got == {i: sum(i in pair for pair in want) for i in sets}

    pairs, members = similar_pairs(df, 80, 100, 3)
    rows, of = {}, {r.doc_id: r["class"] for r in members.collect()}
    for i, c in of.items():
        rows.setdefault(c, []).append(i)
    found = [(i, j) for c, ids in rows.items() if c for i in ids for j in ids if i < j]
    for r in pairs.collect():
        a, b = sets[r.a_id], sets[r.b_id]
        assert r.a_id == min(rows[r.a]) and (r.a_shingles, r.b_shingles, r.common) == (len(a), len(b), len(a & b))
        found += [(min(i, j), max(i, j)) for i in rows[r.a] for j in rows[r.b]]
    assert len(found) == len(set(found)) and set(found) == want


def test_rows_without_or_with_one_id_are_fetched_by_their_text(spark):
    docs = [(None if i % 2 else 7, n, t) for n, (i, t) in enumerate(texts(11, 5, 10, (40, 120)))]
    docs += [(None, 500 + 15 * n + m, t) for n in range(3) for _, m, t in docs[:15]] + [(None, 900 + n, None) for n in range(20)]
    sets = {n: plain.shingles(t, 3) for _, n, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, row long, text string").repartition(5)
    got = {r["row"]: r.n_links for r in near_copies(df, 80, 100, 3, carry=("row",), links=True).collect()}

    def linked(a, b):
        return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)

    assert got == {n: sum(linked(s, o) for m, o in sets.items() if m != n) for n, s in sets.items()}


def test_similar_sets_share_a_signature():
    bands, draw = Bands(80, 100), np.random.default_rng(1)
    for n in [1, 2, 3, 5, 6, 7, 8, 9, 13, 20, 40, 100, 700, 3000]:
        for _ in range(20):
            whole = np.unique(mix(draw.integers(0, 1 << 62, n, dtype=np.int64).astype(np.uint64)))
            for change in range(1, len(whole) // 4 + 1, max(1, len(whole) // 12)):
                other = np.unique(np.concatenate([whole[change // 2 :], mix(draw.integers(0, 1 << 62, change - change // 2, dtype=np.int64).astype(np.uint64))]))
                common = len(np.intersect1d(whole, other))
                differ = len(whole) + len(other) - 2 * common
                if 100 * common >= 80 * (common + differ) and differ:
                    assert len(np.intersect1d(signatures(whole, bands), signatures(other, bands))), (n, change)
                a, b = parity_sketch(whole), parity_sketch(other)
                if len(a) == len(b):
                    assert int(np.bitwise_count(a ^ b).sum()) <= differ


def test_odd_rows(odd, none):
    rows = near_copies(odd, 85, 100, 4, carry=("shard",)).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.shard): (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert by[1, "a"] == (7, 1, True) and by[2, None] == (7, 1, False) and by[None, "b"] == (7, 1, False)
    assert by[3, "c"] == (0, 3, True) and by[4, "c"] == (0, 4, True) and by[6, "e"] == (1, 6, True)
    assert by[100, None][1:] == (100, True) and by[111, None][1:] == (100, False)
    assert near_copies(none).count() == 0


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 560)] + [(900, i) for i in range(901, 950)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
