import math

import plain
import pytest
from pyspark.sql import functions as F

from veilframe.llm import kneser_ney
from veilframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def same(rows, model, texts):
    for r in rows:
        n, known, base, score = model.score(texts[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, known)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9), r.doc_id


def test_query(spark, documents):
    rows = QUERIES["op8_kneser_ney"].run(spark, SMALL).collect()
    model = plain.Bigrams([t for i, t in documents if not plain.held(i, 7, 2)])
    assert len(rows) == len(documents) and {r.train_tokens for r in rows} == {model.n}
    assert all(r.held_out == plain.held(r.doc_id, 7, 2) for r in rows)
    same(rows, model, dict(documents))


def test_probabilities_sum_to_one():
    model = plain.Bigrams(["a b a c", "b a", "c c d a b"])
    for before in ("start", "a", b"a", b"unmet"):
        total = sum(model.probability(before, w) for w in model.count) + model.probability(before, b"unknown")
        assert math.isclose(total, 1)


def test_odd_rows(spark, odd, monkeypatch):
    monkeypatch.setattr(kneser_ney, "HELD_KEYS", 50)
    _, scores = kneser_ney.train_and_score(odd.repartition(4), F.col("doc_id").isNotNull())
    assert scores.columns == ["doc_id", "shard", "run", "n_tokens", "n_known", "base_score", "score", "perplexity"]
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    model, rows = plain.Bigrams([t for i, t in texts if i is not None]), scores.collect()
    assert len(rows) == len(texts)
    same([r for r in rows if r.doc_id is not None], model, dict(texts))


def test_nothing_to_learn_from(odd, none):
    _, scores = kneser_ney.train_and_score(odd, F.lit(False))
    rows = {r.doc_id: r for r in scores.collect()}
    assert rows[3].score == 0.0 == rows[3].base_score and rows[3].n_tokens == 1 and rows[3].n_known == 0
    assert kneser_ney.train_and_score(none, F.lit(True))[1].count() == 0


def test_folder_must_be_mounted():
    assert kneser_ney.mounted("file:///a/b") == "/a/b" == kneser_ney.mounted("/a/b")
    with pytest.raises(ValueError):
        kneser_ney.mounted("hdfs://name/a")
