"""Texts of a regular expression, against all texts over a small alphabet."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.functions import formats, regextext
from veilframe.functions.regextext import TextsOf

KEY = "0123456789abcdef"


@pytest.mark.parametrize("regex", [
    "abc", "a|b|ab", "(a|ab)(c|bc)", "[a-c]{1,3}", "a?b?c?", "(?:ab|c){2}", "a{2}[bc]|b", "(a|b)(a|b)?c{0,2}", "a||b", "[ab]{2,3}?c", "^a(b|)$",
    "(?P<x>a|b)c", "[^ab]{0}a", "(ab?){1,3}",
])
def test_every_text_once(regex):
    texts = TextsOf(regex)
    made = texts.texts(np.arange(texts.size))
    every = ("".join(t) for n in range(9) for t in itertools.product("abc", repeat=n))
    want = {t for t in every if re.fullmatch(regex, t)}
    assert len(made) == len(set(made)) == texts.size and set(made) == want
    assert [len(t) for t in made] == sorted(len(t) for t in made)


def test_open_ends_stop_at_a_length():
    texts = TextsOf("a(bc?)*", longest=5)
    want = {t for n in range(6) for t in map("".join, itertools.product("abc", repeat=n)) if re.fullmatch("a(bc?)*", t)}
    assert set(texts.texts(np.arange(texts.size))) == want
    assert max(map(len, TextsOf("x+").texts(np.arange(13)))) == 13 and TextsOf("x+").size == 13


def test_classes_and_escapes():
    for regex in (r"\d\w\s\.", r"[\d_-]", r"[]a]", r"[^\w]", r"\D\S", r"\t\n\\", r"a{x}", "[a\\-z]", "."):
        texts = TextsOf(regex)
        made = texts.texts(np.linspace(0, texts.size - 1, 200).astype(np.int64))
        assert all(re.fullmatch(regex, t) for t in made), regex


@pytest.mark.parametrize("regex", ["(a", "a)", "*a", "a**", "a{3,1}", "[b-a]", r"(a)\1", "(?=a)", "[a", "a\\", "a{2}{3}"])
def test_unknown_forms(regex):
    with pytest.raises(ValueError):
        TextsOf(regex)


def test_more_texts_than_a_long_holds(spark):
    texts = TextsOf("[A-Z]{20}")
    assert texts.size == 26**20
    assert texts.texts(np.array([0, texts.size - 1], dtype=object)) == ["A" * 20, "Z" * 20]
    made = spark.range(3000).select(regextext.unique_text(F.col("id"), "[A-Z]{20}", KEY).alias("v"))
    values = [r.v for r in made.collect()]
    assert len(set(values)) == 3000 and all(re.fullmatch("[A-Z]{20}", v) for v in values)
    assert len({v[0] for v in values}) == 26


def test_all_texts_of_a_pattern_and_no_more(spark):
    regex = "[ab](x|yz)[0-9]"
    made = spark.range(40).select(regextext.unique_text(F.col("id"), regex, KEY).alias("v")).collect()
    assert len({r.v for r in made}) == 40 == TextsOf(regex).size and [r.v for r in made] != sorted(r.v for r in made)
    assert spark.sql("SELECT cast(null AS int) AS n").select(regextext.unique_text(F.col("n"), regex, KEY).alias("v")).head().v is None
    assert spark.range(0).select(regextext.unique_text(F.col("id"), regex, KEY).alias("v")).collect() == []
    for n in (-1, 40):
        with pytest.raises(Exception, match="has 40 texts"):
            spark.sql(f"SELECT {n} AS n").select(regextext.unique_text(F.col("n"), regex, KEY)).collect()


def test_format_rules_use_the_same_reading(spark):
    for regex in (r"[A-F]{2}(north|south)-\d{3,5}[xyz]?", r"a+b*", "^x|y$"):
        made = spark.range(200).select(formats.text_from_regex(F.col("id"), regex, KEY, "t").alias("v")).collect()
        assert all(re.fullmatch(regex.strip("^$"), r.v) for r in made)
    odd = spark.range(5).select(formats.text_from_regex(F.col("id"), r"(a)\1", KEY, "t").alias("v")).collect()
    assert all(re.fullmatch(r"VAL-\d{4}", r.v) for r in odd)
