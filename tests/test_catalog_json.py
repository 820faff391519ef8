"""Leaf paths of JSON texts, against a walk over each text."""

import collections
import json

from veilframe.operators import catalog

TEXTS = [
    '{"a": 1, "b": {"c": null, "d": [1, 2, {"e": "x"}]}, "f": []}', '{"a": {"g": true}}', "[1, [2, 3], {\"a\": 4}]", "7", "null", "{}", "",
    "not json {", None, '{"b": [{"d": {"e": 1.5}}, {"d": {"e": "y"}}]}', '{"x y": {"": 1}}',
]


def walk(value, path, out):
    if isinstance(value, dict):
        for k, v in value.items():
            walk(v, f"{path}.{k}" if path else k, out)
    elif isinstance(value, list):
        for v in value:
            walk(v, path, out)
    else:
        out[path] += 1


def test_leaf_counts(spark):
    want = collections.Counter()
    for text in TEXTS:
        try:
            walk(json.loads(text), "", want)
        except (TypeError, ValueError):
            pass
    df = spark.createDataFrame([(t,) for t in TEXTS], "doc string").repartition(3)
    got = {r.path: r.n_values for r in catalog.json_leaf_counts(df, "doc").collect()}
    assert got == dict(want)
    assert catalog.json_leaf_counts(df.where("doc IS NULL"), "doc").collect() == []
