from collections import defaultdict

import pytest

from veilframe.llm.exact_dedup import drop_duplicates, duplicate_groups


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups(spark, documents, keep):
    df = spark.createDataFrame(documents, "doc_id long, text string").repartition(37)
    got = {r.doc_id: r for r in duplicate_groups(df, keep=keep, fan_in=3).collect()}
    groups = defaultdict(list)
    for i, t in documents:
        groups[t or ""].append(i)
    best = min if keep == "smallest" else max
    for ids in groups.values():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (best(ids), len(ids), i == best(ids))
    assert len(got) == len(documents)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_odd_rows(odd, keep):
    rows = duplicate_groups(odd.repartition(5), keep=keep).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r.text_sha256].append(r)
    assert all(sum(r.kept for r in g) == 1 and all(r.group_size == len(g) for r in g) for g in by.values())
    known = [g for g in by.values() if any(r.doc_id is not None for r in g)]
    best = min if keep == "smallest" else max
    assert all(r.keep_id == best(x.doc_id for x in g if x.doc_id is not None) for g in known for r in g)


def test_rows_that_stay(odd):
    got = drop_duplicates(odd, keep="largest")
    assert got.columns == odd.columns
    rows = got.collect()
    assert len(rows) == len({r.text or "" for r in odd.collect()}) == len({r.text or "" for r in rows})
    assert {r.doc_id for r in rows} == {2, 4, 5, 6, 7, 8, 9, 111}


def test_empty_and_errors(none):
    assert duplicate_groups(none).count() == 0
    assert drop_duplicates(none).count() == 0
    with pytest.raises(ValueError):
        duplicate_groups(none, keep="first")
