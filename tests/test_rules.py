"""Rules on flat tables: matching, precedence, keys; values as in the fixtures."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from veilframe.functions.formats import parse_date_text
from veilframe.plans.compiler import mask_table
from veilframe.plans.jobs import key_plan
from veilframe.plans.rules import (
    ForeignKey, RuleSet, key_components, propagate_rules, select_targets, unify_key_types, virtual_relationships,
)

KEY = "0123456789abcdef"


def one(df, table, **rules):
    return mask_table(df, table, RuleSet(key=KEY, **rules)).head()


def test_customer_row(spark):
    df = spark.createDataFrame(
        [(1001, "John Doe", "john.doe@example.com", "123-45-6789", "4532-1234-5678-9012", "+1-555-123-4567", None)],
        "customer_id int, name string, email string, ssn string, credit_card string, phone string, notes string",
    )
    row = one(
        df, "customers", masking=("customers.name", "customers.email"), partial=("customers.credit_card", "customers.phone"),
        constraint=("customers.customer_id", "customers.ssn"),
    )
    assert row.customer_id > 0 and row.customer_id != 1001
    assert row.name != "John Doe" and "@" in row.email
    assert row.credit_card == "X" * 15 + "9012" and row.phone.endswith("4567")
    assert len(row.ssn) == 11 and row.ssn != "123-45-6789" and row.notes is None


def test_schema_qualified_rules(spark):
    df = spark.createDataFrame([(5, "Ann Lee", "12345678")], "customer_id int, name string, phone string")
    row = one(df, "customers", constraint=("public.customers.customer_id",), masking=("public.customers.name",),
              partial=("public.customers.phone",))
    assert row.customer_id > 0 and row.name != "Ann Lee" and row.phone == "XXXX5678"


def test_types_are_kept(spark):
    df = spark.createDataFrame(
        [(17592, 341, 2, Decimal("4.99"))], "payment_id int, customer_id smallint, staff_id smallint, amount decimal(5,2)"
    )
    out = mask_table(df, "payment", RuleSet(key=KEY, constraint=("payment_id", "customer_id"), masking=("staff_id", "amount")))
    assert out.dtypes == df.dtypes
    assert Decimal(0) < out.head().amount < Decimal(1000)


def test_joined_keys_of_different_width(spark):
    parent = spark.createDataFrame([(341,), (7,)], "customer_id int")
    child = spark.createDataFrame([(1, 341)], "payment_id int, customer_id smallint")
    keys = [ForeignKey("payment", ("customer_id",), "public.customer", ("customer_id",))]
    rules, domains = key_plan({"customer": parent, "payment": child}, RuleSet(key=KEY, constraint=("customer.customer_id",)), keys)
    assert domains == {"customer.customer_id": "short", "payment.customer_id": "short"}
    a = mask_table(parent, "customer", rules, domains=domains).head().customer_id
    b = mask_table(child, "payment", rules, domains=domains).head().customer_id
    assert a == b and a != 341


def test_date_formats(spark):
    df = spark.createDataFrame([("2024-03-15", "2024-03-15 14:30:00", dt.datetime(2024, 3, 15, 14, 30))], "a string, b string, c timestamp")
    row = one(df, "o", formats={"a": "DATE:dd/MM/yyyy", "b": "DATE:yyyy-MM-dd hh:mm a", "c": "DATE:yyyy"})
    assert row.a == "15/03/2024" and row.b == "2024-03-15 02:30 PM" and row.c == dt.datetime(2024, 3, 15, 14, 30)


def test_text_and_number_formats(spark):
    df = spark.createDataFrame([("x", -142.368, 55.4)], "code string, balance double, penalty double")
    out = mask_table(
        df, "accounts",
        RuleSet(key=KEY, formats={"code": "TEXT:ORD-{rand_alpha:3}-{rand_num:4}-CONST", "balance": "NUM:POSITIVE:SCALE(2)",
                                  "penalty": "NUM:NEGATIVE:INTEGER"}),
    )
    assert out.filter(F.col("code").rlike(r"^ORD-[A-Z]{3}-\d{4}-CONST$")).count() == 1
    assert out.head().balance == 142.37 and out.head().penalty == -55.0


def test_unusable_date_pattern_falls_back(spark):
    df = spark.createDataFrame([("2024-03-15",)], "a string")
    assert one(df, "o", formats={"a": "DATE:yyyy-bb-'"}).a == "2024-03-15"


def test_long_templates_use_several_blocks(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("a"))
    rows = mask_table(df, "t", RuleSet(key=KEY, formats={"a": "{rand:40}{rand_alpha:30}"})).collect()
    assert all(len(r.a) == 70 and r.a[40:].isalpha() for r in rows) and len({r.a for r in rows}) == 3


def test_strict_scope_and_wildcard():
    assert not RuleSet(masking=("users.email",)).has("SFD", "orders", "email")
    assert RuleSet(masking=("users.email",), wildcard=True).has("SFD", "orders", "email")
    assert RuleSet(masking=("email",)).has("SFD", "orders", "Email")
    assert RuleSet(masking=("db.users.email",)).has("SFD", "users", "email")
    assert RuleSet(masking=("users.email",)).scopes("SFD") == {"users": {"email"}}
    assert RuleSet(masking=("a.users.email",), wildcard=True).scopes("SFD") == {"users": {"email"}, "a.users": {"email"}, "*": {"email"}}


def test_path_matching():
    rules = RuleSet(nullify=("Tags[*]", "profile.address"))
    assert rules.has("NULL", "f.json", "tags", "suffix")
    assert rules.has("NULL", "f.json", "user.profile.address", "suffix")
    assert not rules.has("NULL", "f.json", "user.address2", "suffix")
    assert RuleSet(nullify=("users.name",)).has("NULL", "users.json", "name", "file")


def test_config_names():
    rules = RuleSet.parse(
        {"maskingColumns": [" users.email ", ""], "constraintFields": ["id"], "defaultValues": {"a": "1"}, "maskingKey": KEY,
         "targetTables": ["Users"], "partialMaskingFields": {"*": ["name"]}}
    )
    assert rules.masking == ("users.email",) and rules.constraint == ("id",) and rules.has("PMD", "x.csv", "name", "file")
    assert select_targets(["users", "orders"], rules.targets) == ["users"] and select_targets(["a"], []) == ["a"]


def test_key_graph():
    keys = virtual_relationships(
        [{"parent": "customer.id", "child": "orders.customer_id"}, {"parent": "orders.customer_id", "child": "audit.who"}]
    )
    components = key_components(keys)
    assert components["audit.who"] == {"customer.id", "orders.customer_id", "audit.who"}
    spread = propagate_rules(RuleSet(constraint=("customer.id",)), components)
    assert spread.has("FPH", "audit", "who") and spread.has("FPH", "orders", "customer_id")
    assert unify_key_types(components, {"customer.id": "bigint", "audit.who": "int"})["customer.id"] == "int"
    assert unify_key_types(components, {"customer.id": "string"}) == {}


def test_default_values(spark):
    df = spark.createDataFrame([(1, "a", True)], "n int, s string, b boolean")
    row = one(df, "t", defaults={"n": "42", "t.s": "null", "*.b": "false"})
    assert row == (42, None, False)
    assert one(df, "t", defaults={"n": "many"}).n == "many"


def test_every_spelling_of_a_date(spark):
    spelled = {
        "2024-03-15": "2024-03-15 00:00:00", "2024-03-15T10:20": "2024-03-15 10:20:00", "2024-03-15T10:20:30.123456789Z": "2024-03-15 10:20:30",
        "2024-03-15T10:20:30+02:00[Europe/Paris]": "2024-03-15 10:20:30", "2024-03-15 10:20:30.5": "2024-03-15 10:20:30",
        "2024-03-15 10:20:30+02": "2024-03-15 10:20:30", "15/03/2024": "2024-03-15 00:00:00", "03/15/2024": "2024-03-15 00:00:00",
        "04/03/2024": "2024-03-04 00:00:00", "2024/03/15": "2024-03-15 00:00:00", "15-03-2024": "2024-03-15 00:00:00",
        "20240315": "2024-03-15 00:00:00", "31/04/2024": "2024-04-30 00:00:00", "2023-02-30": "2023-02-28 00:00:00",
        " 2024-03-15 ": "2024-03-15 00:00:00", "2024-13-15": None, "2024": None, "soon": None, "2024-03-15 25:00:00": None,
    }
    df = spark.createDataFrame(list(spelled.items()), "text string, want string")
    got = df.select("text", "want", F.date_format(parse_date_text(F.col("text")), "yyyy-MM-dd HH:mm:ss").alias("got")).collect()
    assert {r.text: r.got for r in got} == spelled


def test_texts_made_from_patterns(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("a"))
    patterns = [r"[^a-z]{5}", r"\w{3}-\d?[AB]+", r"^(ab|c(d|e){2})\.x*$", "[A-C'\\\\]{4}", r"(?:GB|DE)\d{2}[ ]?\d{4}"]
    for pattern in patterns:
        out = mask_table(df, "t", RuleSet(key=KEY, formats={"a": "REGEX:" + pattern}))
        assert out.filter(F.col("a").rlike(f"^(?:{pattern})$")).count() == 200, pattern
        assert out.distinct().count() > 1
    odd = mask_table(df, "t", RuleSet(key=KEY, formats={"a": r"REGEX:(?=x)[0-9"}))
    assert odd.filter(F.col("a").rlike(r"^VAL-\d{4}$")).count() == 200


def test_null_gets_a_format_from_the_row(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None)], "id int, code string, amount double")
    rows = mask_table(df, "t", RuleSet(key=KEY, formats={"code": "TEXT:{rand:12}", "amount": "NUM:RANGE(5,10):SCALE(2)"})).collect()
    assert rows[0].code != rows[1].code and all(5 <= r.amount <= 10 for r in rows)


def test_export_profiles_pass_nulls_through(spark):
    df = spark.createDataFrame([(1, None)], "id int, code string")
    rules = RuleSet(key=KEY, formats={"code": "TEXT:x"}, defaults={"note": "y"})
    assert mask_table(df, "t", rules, "sql_export").head().code is None
    assert mask_table(df, "t", RuleSet(key=KEY, defaults={"code": "y"}), "sql_export").head().code is None
    assert mask_table(df, "t", RuleSet(key=KEY, defaults={"code": "y"})).head().code == "y"


def test_wide_numbers_keep_their_value(spark):
    from pyspark.sql import types as T

    from veilframe.functions.formats import apply_format

    digits = "-" + "123456789" * 3 + "123"
    df = spark.createDataFrame([(digits,)], "s string").select(F.col("s").cast("decimal(38,0)").alias("d"), F.lit(1e30).alias("f"), F.lit("1.123456789012").alias("t"))
    made = df.select(
        apply_format(F.col("d"), T.DecimalType(38, 0), "NUM:POSITIVE", "0123456789abcdef", "d").alias("d"),
        apply_format(F.col("d"), T.DecimalType(38, 0), "NUM:SCALE(0)", "0123456789abcdef", "d").alias("e"),
        apply_format(F.col("f"), T.DoubleType(), "NUM:NEGATIVE:SCALE(2)", "0123456789abcdef", "f").alias("f"),
        apply_format(F.col("t"), T.StringType(), "NUM:SCALE(12)", "0123456789abcdef", "t").alias("t"),
        apply_format(F.col("t"), T.StringType(), "NUM:INTEGER", "0123456789abcdef", "t").alias("u"),
    ).head()
    assert (made.d, made.e, made.f, made.t, made.u) == (Decimal(digits[1:]), Decimal(digits), -1e30, "1.123456789012", "1")
