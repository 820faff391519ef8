"""What the plans look like, and that a hot key changes nothing."""

import collections
import hashlib
import random

from pyspark.sql import functions as F

from veilframe.functions import fpe, tokens
from veilframe.operators import bundle, catalog, classify, integrity
from veilframe.plans.compiler import mask_table
from veilframe.plans.rules import RuleSet
from veilframe.sources import writers

KEY = "0123456789abcdef"
ORDERS = "/root/testdata/sf0.001/orders.parquet"


def plan_of(df):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def test_masking_is_one_narrow_stage(spark):
    rules = RuleSet(key=KEY, constraint=("o_orderkey", "o_custkey"), masking=("o_orderpriority",), formats={"o_orderdate": "DATE:yyyy:SHIFT(1,9)"})
    plan = plan_of(mask_table(spark.read.parquet(ORDERS), "orders", rules))
    assert "Exchange" not in plan and "Python" not in plan and "codegen id : 1" in plan and "codegen id : 2" not in plan


def test_the_key_never_shows_in_a_plan(spark):
    rules = RuleSet(
        key=KEY, constraint=("o_orderkey", "o_orderstatus"), masking=("o_orderpriority", "o_totalprice"), formats={"o_orderdate": "DATE:yyyy:SHIFT(1,9)"}
    )
    masked = mask_table(spark.read.parquet(ORDERS), "orders", rules)
    parts = bundle.encrypt_parts(spark.createDataFrame([("a", b"x")], "name string, content binary"), KEY)
    assert KEY not in plan_of(masked) and KEY not in plan_of(parts)
    secret = hashlib.sha256(KEY.encode()).hexdigest()
    sealed = spark.createDataFrame([("a",)], "v string").select(tokens.tokenize(F.col("v"), KEY, "salt").alias("v"))
    for plan in (plan_of(parts), plan_of(sealed)):
        assert secret not in plan.lower() and "redacted" in plan


def test_only_needed_columns_are_read(spark):
    rules = RuleSet(key=KEY, constraint=("o_custkey",), masking=("o_orderpriority",))
    plan = plan_of(mask_table(spark.read.parquet(ORDERS), "orders", rules).select("o_custkey"))
    assert "ReadSchema: struct<o_custkey:bigint>" in plan


def test_a_null_test_on_a_masked_key_reaches_the_scan(spark):
    masked = mask_table(spark.read.parquet(ORDERS), "orders", RuleSet(key=KEY, constraint=("o_custkey",)))
    plan = plan_of(masked.filter("o_custkey IS NOT NULL AND o_totalprice > 1000"))
    pushed = next(line for line in plan.split("\n") if line.startswith("PushedFilters"))
    condition = next(line for line in plan.split("\n") if line.startswith("Condition"))
    assert "IsNotNull(o_custkey)" in pushed and "GreaterThan(o_totalprice,1000.0)" in pushed and "%" not in condition


def hot_rows(n=9000):
    rng = random.Random(7)
    return [(1 if i % 3 == 0 else rng.randrange(2, 4000), i) for i in range(n)]


def test_checks_with_a_hot_key(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k long, v long").repartition(8)
    parents = spark.createDataFrame([(k,) for k in range(2, 3000)] * 2, "id long")
    want = collections.Counter(k for k, _ in rows if not 2 <= k < 3000)
    got = integrity.check_foreign_key(df, ["k"], parents, ["id"]).collect()
    assert {r.k: r.n_rows for r in got} == want and want[1] == 3000
    want = {k: n for k, n in collections.Counter(k for k, _ in rows).items() if n > 1}
    assert {r.k: r.n_rows for r in integrity.check_unique(df, ["k"]).collect()} == want


def test_conflict_free_insert_with_a_hot_key(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k long, v long").repartition(8)
    target = spark.createDataFrame([(k, 0) for k in range(0, 2000, 2)] * 3, "k long, v long")
    want = {}
    for k, v in rows:
        if not (k < 2000 and k % 2 == 0):
            want[k] = min(v, want.get(k, v))
    got = writers.new_rows(df, target, ["k"], ["v"]).collect()
    assert {r.k: r.v for r in got} == want and len(got) == len(want)


def test_parts_with_equal_order_values(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k long, v long").repartition(8)
    got = bundle.assign_parts(df, F.lit(10), 1000, "b", ["k", "v"]).collect()
    for i, r in enumerate(sorted(got, key=lambda r: (r.k, r.v))):
        assert r.part_no == i * 10 // 1000 + 1
    assert len(got) == len(rows)


def test_text_in_hot_and_rare_values(spark):
    rows = [(f"name {k}",) for k, _ in hot_rows()]
    df = spark.createDataFrame(rows, "s string").repartition(8)
    out = df.select("s", fpe.fpe_text(F.col("s"), KEY).alias("m")).groupBy("s").agg(F.countDistinct("m").alias("n"), F.first("m").alias("m"))
    values = out.collect()
    assert all(r.n == 1 for r in values) and len({r.m for r in values}) == len({r.s for r in values})


def test_classification_of_a_catalog_with_one_hot_name(spark):
    rows = [(f"t{i}", "customer_id" if i % 3 else f"c{i}_name") for i in range(600)] + [("customers", "id")]
    got = classify.classify_columns(spark.createDataFrame(rows, "table string, column string"))
    counts = {r.category: r["count"] for r in got.groupBy("category").count().collect()}
    assert counts == {"FOREIGN_KEY": 400, "NAME_GENERIC": 200, "PRIMARY_KEY": 1}
    assert got.filter("category = 'FOREIGN_KEY' AND target_table = 'customers'").count() == 400


def test_numbering_covers_every_row_once(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(8)
    rows = catalog.indexed(df, ["k", "v"]).collect()
    assert sorted(r.idx for r in rows) == list(range(5000))
    assert [r.v for r in sorted(rows, key=lambda r: r.idx)] == sorted(range(5000), key=lambda v: (v % 3, v))


def test_tables_of_the_session_catalog(spark, tmp_path):
    for name in ("veil_users", "batch_step", "veil_orders"):
        spark.sql(f"CREATE TABLE {name} (id INT) USING parquet LOCATION '{tmp_path}/{name}'")
    try:
        assert catalog.discover_tables(spark) == ["veil_orders", "veil_users"]
        assert catalog.discover_tables(spark, targets=["Veil_Users"]) == ["veil_users"]
    finally:
        for name in ("veil_users", "batch_step", "veil_orders"):
            spark.sql(f"DROP TABLE {name}")
