"""Documents and JSON arrays."""

import pytest

from veilframe.plans.compiler import mask_table
from veilframe.plans.nested import mask_docs, mask_json
from veilframe.plans.rules import RuleSet

KEY = "0123456789abcdef"
SCHEMA = (
    "id int, primitive_array array<string>, nested_array array<array<string>>, num_array array<int>, text_array array<string>,"
    " null_array array<string>, fixed_array array<string>, nested_null array<array<string>>, empty_array array<string>"
)


@pytest.fixture
def arrays(spark):
    return spark.createDataFrame(
        [(1, ["a", "b", "c"], [["x"], ["y", "z"]], [5, 900], ["p", "q"], ["s"], ["t", "u"], [["v"], []], [])], SCHEMA
    )


def test_array_rules(arrays):
    rules = RuleSet(
        key=KEY, masking=("primitive_array", "nested_array", "empty_array"), nullify=("null_array", "nested_null"),
        defaults={"fixed_array": "ANONYMIZED"}, formats={"num_array": "NUM:RANGE(100,500)", "text_array": "TEXT:SEC-{rand_num:3}"},
    )
    row = mask_json(arrays, "f.json", rules).head()
    assert len(row.primitive_array) == 3 and not set(row.primitive_array) & {"a", "b", "c"}
    assert [len(x) for x in row.nested_array] == [1, 2]
    assert row.num_array == [100, 500] and all(t.startswith("SEC-") and len(t) == 7 for t in row.text_array)
    assert row.null_array == [None] and row.fixed_array == ["ANONYMIZED"] * 2
    assert row.nested_null == [[None], []] and len(row.empty_array) == 2 and row.id == 1


def test_partial_and_encryption_in_arrays(arrays):
    row = mask_json(arrays, "f.json", RuleSet(key=KEY, partial=("primitive_array",), constraint=("nested_array", "num_array"))).head()
    assert row.primitive_array == ["*", "*", "*"]
    assert [len(x) for x in row.nested_array] == [1, 2] and row.nested_array != [["x"], ["y", "z"]]
    assert all(v > 0 for v in row.num_array) and row.num_array != [5, 900]


def test_nested_document(spark):
    df = spark.createDataFrame([(1, "Ann", ("Main St", "Oslo"))], "customer_id int, name string, address struct<street:string,city:string>")
    row = mask_docs(df, "customers", RuleSet(key=KEY, masking=("customers.name",), partial=("customers.address.street",))).head()
    assert row.name != "Ann" and row.address.street == "XXXn St" and row.address.city == "Oslo"


def test_arrays_of_documents_two_levels_deep(spark):
    df = spark.createDataFrame(
        [(1, [([("k1", 1), ("k2", 2)], "a"), ([], "b"), (None, None)]), (2, None)],
        "id int, groups array<struct<items:array<struct<code:string,n:int>>,label:string>>",
    )
    rules = RuleSet(key=KEY, constraint=("groups.items.code", "groups.label"), defaults={"groups.items.n": "9"})
    rows = {r.id: r.groups for r in mask_docs(df, "c", rules).collect()}
    codes = [i.code for g in rows[1] if g["items"] for i in g["items"]]
    assert len(codes) == 2 and all(len(c) == 2 for c in codes) and codes != ["k1", "k2"]
    assert [i.n for i in rows[1][0]["items"]] == [9, 9] and rows[1][2]["items"] is None and rows[2] is None
    same = mask_docs(spark.createDataFrame([("k1",)], "code string"), "c", RuleSet(key=KEY, constraint=("code",))).head().code
    assert codes[0] == same


def test_default_word_is_the_value_in_json_exports(spark):
    df = spark.createDataFrame([("9876543210", "x")], "phone string, note string")
    row = mask_json(df, "accounts.json", RuleSet(key=KEY, partial=("accounts.phone",), defaults={"note": "N/A"}), "json_export").head()
    assert row.phone == "****3210" and row.note == "N/A"


def test_sequence_of_rules_in_document_exports(spark):
    df = spark.createDataFrame([("abcdef", "x", 3)], "a string, b string, n int")
    rules = RuleSet(key=KEY, masking=("c.a", "c.n"), partial=("c.a",), nullify=("c.b",), defaults={"c.b": "z"})
    row = mask_docs(df, "c", rules, "doc_export").head()
    assert row.a.startswith("****") and not row.a.endswith("cdef") and len(row.a) == 8
    assert row.b == "z" and row.n > 0


def test_whole_containers(spark):
    df = spark.createDataFrame([(1, ("a",), ["x"], {"k": "v"})], "id int, s struct<a:string>, l array<string>, m map<string,string>")
    row = mask_docs(df, "c", RuleSet(key=KEY, nullify=("c.s", "l", "m"))).head()
    assert row == (1, None, None, None)
    with pytest.raises(ValueError):
        mask_docs(df, "c", RuleSet(key=KEY, partial=("m",)))
    with pytest.raises(ValueError):
        mask_table(df, "c", RuleSet(key=KEY, masking=("c.l",)))
    assert mask_table(df, "c", RuleSet(key=KEY, nullify=("c.l",))).head().l is None
