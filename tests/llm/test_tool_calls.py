import json
import random

import compare
import pytest

from veilframe.llm.queries import QUERIES
from veilframe.llm.tool_calls import link_tool_calls, topological_levels

SMALL = "/root/testdata/sf0.001"
CALL = "conv_id long, call_id string, position int, name string, arguments string, depends_on array<string>, level string"
RESULT = "conv_id long, call_id string, position int, content string, errors int"
TOOL = "name string, param string, type string, required boolean"
TOOLS = [("f", "a", "integer", True), ("f", "b", "string", False), ("f", "c", "number", None), ("f", "d", "array", False), ("f", "e", "object", False), ("f", "g", "boolean", False),
         ("f", "h", "null", False), ("f", "a", "integer", False), ("g", "x", "string", True), (None, "x", "string", True)]


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op10_tool_call_linking"])
def test_against_sql(spark, name):
    assert compare.compare(spark, compare.connect(SMALL), QUERIES[name], SMALL) is None


def linked(spark, calls, results, tools=TOOLS):
    rows = link_tool_calls(
        spark.createDataFrame([(*c, "x") for c in calls], CALL), spark.createDataFrame([(*r, 0) for r in results], RESULT), spark.createDataFrame(tools, TOOL),
    ).collect()
    return [(r, json.loads(r.json)) for r in rows]


def test_arguments(spark):
    cases = {
        '{"a":1}': [], '{"b":"x","a":1}': [], '{"a":1,"c":1.5,"d":[1],"e":{},"g":true,"h":null}': [], "{}": ["missing a"], '{"a":"1"}': ["no integer: a"],
        '{"a":1.5,"b":2,"z":0,"y":0}': ["unknown y", "unknown z", "no integer: a", "no string: b"], "[1]": ["arguments are no object"], "oops": ["arguments are no object"],
        None: ["arguments are no object"], '{"a":1,"a":2}': ["arguments are no object"], '{"c":"x","d":{},"e":[],"g":0,"h":1}': ["missing a", "no number: c", "no array: d", "no object: e", "no boolean: g", "no null: h"],
    }
    calls = [(1, f"c{i}", i, "f", a, None) for i, a in enumerate(cases)]
    got = {r.call_id: m for r, m in linked(spark, calls, [(1, f"c{i}", 50 + i, "done") for i in range(len(cases))])}
    assert [got[f"c{i}"]["errors"] for i in range(len(cases))] == list(cases.values())
    assert all(m["result"] == "done" for m in got.values())


def test_order_and_links(spark):
    ok = '{"x":"y"}'
    calls = [
        (1, "a", 9, "g", ok, ["b", "c"]), (1, "b", 5, "g", ok, ["c", "c"]), (1, "c", 7, "g", ok, []), (1, "p", 1, "g", ok, ["q"]), (1, "q", 2, "g", ok, ["p"]), (1, "r", 3, "g", ok, ["p"]),
        (1, "s", 4, "g", ok, ["gone", "c"]), (2, "a", 1, "g", ok, None), (2, "a", 3, "g", ok, None), (2, "a", 3, "g", ok, None), (None, "a", 1, "g", ok, None), (3, None, 1, "g", ok, ["a"]),
        (3, "self", 2, "g", ok, ["self"]),
    ]
    results = [(1, "a", 10, '{"z":1, "b":[ 2.0 ]}'), (1, "b", 11, "later"), (1, "b", 10, "first"), (2, "a", 2, None), (1, "none", 4, "[1 ,2]"), (None, "a", 4, "x"), (3, None, 4, "x")]
    rows = linked(spark, calls, results)
    by = {}
    for r, m in rows:
        by.setdefault((r.conv_id, r.call_id), []).append((r.level, m["errors"], m["result"]))
    assert by[1, "c"] == [(0, ["no result"], None)] and by[1, "b"] == [(1, ["2 results"], "first")] and by[1, "a"] == [(2, [], {"b": [2], "z": 1})]
    assert [by[1, x][0][0] for x in "pqr"] == [None] * 3 and all("in or above a cycle" in by[1, x][0][1] for x in "pqr") and by[3, "self"][0][0] is None
    assert by[1, "s"] == [(1, ["no result", "needs unknown gone"], None)]
    assert sorted(by[2, "a"], key=str) == sorted([(0, [], None), (None, ["repeated identifier"], None), (None, ["repeated identifier"], None)], key=str)
    assert sorted(len(m[1]) for m in by[None, "a"]) == [1, 1] and {m[1][0] for m in by[3, None]} == {"no identifier", "no call"}
    assert by[1, "none"] == [(None, ["no call"], [1, 2])] and len(rows) == len(calls) + 3
    text = next(r.json for r, _ in rows if (r.conv_id, r.call_id) == (1, "b"))
    assert text == '{"arguments":{"x":"y"},"call_id":"b","errors":["2 results"],"level":1,"name":"g","result":"first"}'


def test_long_chain_and_hot_conversation(spark):
    calls = [(7, f"c{i}", i, "g", '{"x":"y"}', [f"c{i - 1}"] if i % 30 else []) for i in range(240)]
    rows = linked(spark, calls, [(7, f"c{i}", 500, "r" * 1000) for i in range(240)])
    assert {r.call_id: r.level for r, _ in rows} == {f"c{i}": i % 30 for i in range(240)} and not any(m["errors"] for _, m in rows)


def test_levels_of_random_needs(spark):
    draw, edges = random.Random(8), set()
    for conv in range(12):
        n = draw.randrange(2, 40)
        for i in range(1, n):
            for j in draw.sample(range(i), min(i, draw.choice([0, 1, 1, 1, 2, 3]))):
                edges.add((conv, f"c{i}", f"c{j}"))
        if conv % 3 == 0:
            edges.add((conv, f"c{draw.randrange(n)}", f"c{draw.randrange(n)}"))
    needs = {}
    for c, x, d in edges:
        needs.setdefault((c, x), set()).add((c, d))

    def level(x, above=()):
        if x in above:
            return None
        below = [level(d, (*above, x)) for d in needs.get(x, ())]
        return None if None in below else 1 + max(below, default=-1)

    got = {(r.conv_id, r.call_id): r.level for r in topological_levels(spark.createDataFrame(sorted(edges), "conv_id long, call_id string, dep string")).collect()}
    assert got == {x: level(x) for x in needs}


def test_empty(spark):
    assert linked(spark, [], []) == []
    assert [m["errors"] for _, m in linked(spark, [(1, "a", 1, "f", "{}", None)], [], [])] == [["unknown tool", "no result"]]
