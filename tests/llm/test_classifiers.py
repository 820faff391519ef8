import itertools
import random

import numpy as np
import plain
from pyspark.sql import functions as F

from veilframe.llm.common import sampled_text
from veilframe.llm.compression_quality import QualityModel, fit_quality, quality_score
from veilframe.llm.language import LanguageModel, fit_languages, identify, labelled, language_of, viterbi, words_of
from veilframe.llm.queries import QUERIES

SMALL, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_quality_of_held_out_documents(spark):
    rows = QUERIES["op3_compression_classifier"].run(spark, MORE).join(spark.read.parquet(f"{MORE}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == plain.held(r.doc_id, 5, 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert len(good) > 20 and len(bad) > 3
    above = sum(g > b for g, b in itertools.product(good, bad)) / (len(good) * len(bad))
    assert above > 0.95 and sum(s >= 0.3 for s in good) / len(good) > 0.95


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (8, 0), (8, 1), (9, None), (None, 1), (777, 0), (5, 7)], "doc_id long, quality int")
    model = fit_quality(odd, labels)
    rows = odd.select("*", quality_score(F.col("text"), model).alias("q")).collect()
    assert len(rows) == odd.count() and all(0 <= r.q <= 1 for r in rows)
    assert fit_quality(none, labels).good == b"" == fit_quality(odd, labels.limit(0)).good
    assert odd.select(quality_score(F.col("text"), fit_quality(odd, labels.limit(0))).alias("q")).distinct().collect()[0].q == 0.5
    assert none.select(quality_score(F.col("text"), QualityModel(b"", b"", 0.0, 0.0)).alias("q")).count() == 0


def test_learning_is_repeatable(spark):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    assert fit_quality(docs, labels) == fit_quality(docs.repartition(7), labels.repartition(3))


def test_samples_come_from_whole_texts(spark):
    text = "".join(f"{i:05d}" for i in range(20_000))
    row = spark.createDataFrame([(text,), ("short",), ("",), (None,)], "text string").select(sampled_text(F.col("text"), 1000, 100).alias("s"), "text").collect()
    blocks = row[0].s.split("\n")
    places = [text.index(b) for b in blocks]
    assert len(blocks) == 10 == len(set(places)) and places == sorted(places) and all(p % 100 == 0 and len(b) == 100 for p, b in zip(places, blocks, strict=True))
    assert places[-1] > 50_000 and [r.s for r in row[1:]] == ["short", "", None]


def test_samples_are_bounded_whatever_the_ids(spark):
    """Repeated and missing ids share no draw; equal rows count once."""
    rows = [(None, f"ab{i}c de{i}f", "x") for i in range(300)] + [(5, f"uv{i}w xy{i}z", "y") for i in range(300)] + [(5, "same text", "y")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert fit_languages(docs, sample_per_language=10).languages == ("x", "y")
    labels = spark.createDataFrame([(5, 1), (6, 0), (7, 0)], "doc_id long, quality int")
    more = docs.unionAll(spark.createDataFrame([(6, "bad one", "z"), (7, "bad two", "z")], docs.schema))
    assert fit_quality(more, labels, sample_per_class=20) == fit_quality(more.repartition(5), labels, sample_per_class=20)


def best_path(scores, switch):
    n = scores.shape[1]
    value = lambda p: sum(scores[t, s] for t, s in enumerate(p)) - switch * sum(a != b for a, b in zip(p, p[1:], strict=False))
    return max(value(p) for p in itertools.product(range(n), repeat=len(scores))), value


def test_viterbi_against_all_paths():
    draw = np.random.default_rng(3)
    texts = [draw.normal(size=(draw.integers(0, 7), 3)) * 3 for _ in range(40)]
    for scores, path in zip(texts, viterbi(texts, 2.0), strict=True):
        if len(scores):
            best, value = best_path(scores, 2.0)
            assert abs(value(path.tolist()) - best) < 1e-9


def test_shortcut_gives_the_same_labels():
    draw = np.random.default_rng(4)
    for _ in range(300):
        parts = [draw.normal(size=(draw.integers(0, 6), 3)) * draw.choice([0.3, 1, 3]) + draw.normal(size=3) for _ in range(5)]
        scores = np.concatenate(parts)
        words = words_of(["a"])
        words.rows = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        got = labelled(words, scores, 2.0)
        for i, p in enumerate(parts):
            if len(p):
                best, value = best_path(p, 2.0)
                assert abs(value(got[words.rows[i] : words.rows[i + 1]].tolist()) - best) < 1e-9


def test_languages_of_held_out_documents(spark):
    rows = QUERIES["op6_language_spans"].run(spark, MORE).join(spark.read.parquet(f"{MORE}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 10_000 and all(r.held_out == plain.held(r.doc_id, 5, 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98


def test_mixed_text_and_scripts(spark):
    draw = random.Random(7)
    en, ru = ["the", "and", "house", "water", "green", "with", "some"], ["это", "дом", "вода", "зелёный", "человек"]
    de = ["das", "und", "haus", "wasser", "grün", "schön", "mit", "ein"]
    say = lambda words, n: " ".join(draw.choice(words) for _ in range(n))
    docs = [(i, say(w, 60), k) for i, (w, k) in enumerate([(en, "en"), (ru, "ru"), (de, "de")] * 8)] + [(90, None, "xx"), (91, "text", None)]
    model = fit_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert model.languages == ("de", "en", "ru")
    a, b, c = say(en, 30), say(ru, 30), say(de, 30)
    (pred, score, spans), = identify([f"{a}\n{b} {c}"], model)
    text = f"{a}\n{b} {c}"
    assert [s[2] for s in spans] == ["en", "ru", "de"] and [text[x:y] for x, y, _ in spans] == [a, b, c] and 0 < score < 1
    assert list(identify(["", "12 !?", "中文"], model))[:2] == [("und", 0.0, [])] * 2
    assert list(identify(["a"], LanguageModel((), model.trigrams[:, :0], model.scripts[:, :0], 20.0))) == [("und", 0.0, [])]


def test_languages_of_odd_rows(spark, odd, none):
    model = fit_languages(spark.read.parquet(f"{SMALL}/documents.parquet"))
    rows = odd.select("text", language_of(F.col("text"), model).alias("l")).collect()
    assert len(rows) == odd.count()
    assert all((r.l.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)
    assert none.select(language_of(F.col("text"), model).alias("l")).count() == 0
    empty = fit_languages(none.withColumn("lang", F.lit("en")))
    assert odd.select(language_of(F.col("text"), empty).alias("l")).where("l.lang_pred <> 'und'").count() == 0
