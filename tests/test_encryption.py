"""Properties of format-preserving encryption: length, class, range, key dependence, no two values merged."""

import itertools
import string
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import fpe
from veilframe.plans.compiler import mask_table
from veilframe.plans.rules import RuleSet

KEY = "0123456789abcdef"


def distinct_after(spark, column, dtype, n=10_000, start=1):
    df = spark.range(start, start + n).select(F.col("id").cast(dtype).alias(column))
    out = mask_table(df, "t", RuleSet(key=KEY, constraint=(column,)))
    return out.agg(F.countDistinct(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).head()


@pytest.mark.parametrize("dtype, top", [("int", 2**31 - 1), ("bigint", 2**63 - 2), ("smallint", 32767)])
def test_integers_stay_positive_and_distinct(spark, dtype, top):
    row = distinct_after(spark, "k", dtype)
    assert row.n == 10_000 and row.lo >= 1 and row.hi <= top


def test_smallint_and_tinyint_are_permutations_of_their_domain(spark):
    for dtype, top in (("smallint", 32767), ("tinyint", 127)):
        row = distinct_after(spark, "k", dtype, top)
        assert (row.n, row.lo, row.hi) == (top, 1, top)


def test_later_range_of_ints(spark):
    assert distinct_after(spark, "k", "int", 20_000, 10_000).n == 20_000


@pytest.mark.parametrize("value", [1, 2, 45678, 100000, 0, -50, -99999])
def test_any_sign_gives_a_positive_value(spark, value):
    df = spark.createDataFrame([(value,)], "k int")
    assert mask_table(df, "t", RuleSet(key=KEY, constraint=("k",))).head().k > 0


def test_null_stays_null_and_missing_key_is_an_error(spark):
    df = spark.createDataFrame([(None, None)], "k int, s string")
    rules = RuleSet(key=KEY, constraint=("k", "s"))
    assert mask_table(df, "t", rules).head() == (None, None)
    with pytest.raises(ValueError):
        mask_table(df, "t", RuleSet(constraint=("k",)))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100, 127, 1000, 32767, 99_991])
def test_permutation_of_any_domain(spark, size):
    df = spark.range(size).select(fpe.permute(F.col("id"), size, KEY, "x").alias("p"))
    row = df.agg(F.countDistinct("p").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).head()
    assert (row.n, row.lo, row.hi) == (size, 0, size - 1)


def test_bound_and_plain_forms_agree(spark):
    df = spark.range(-3, 2000).select(F.col("id").alias("k"), F.col("id").alias("raw"))
    out = mask_table(df, "t", RuleSet(key=KEY, constraint=("k",)))
    out = out.select("k", fpe.fpe_int(F.col("raw"), "long", KEY).alias("p"))
    assert out.filter("k <> p").count() == 0


def texts(n, f):
    return list(dict.fromkeys(f(i) for i in range(n)))


@pytest.mark.parametrize(
    "values, allowed",
    [
        (texts(99_999, lambda i: f"{i + 1:05d}"), string.digits),
        (texts(10_000, lambda i: f"A{i:04d}"), string.digits + string.ascii_uppercase),
        (["".join(p) for p in itertools.islice(itertools.product(string.ascii_lowercase, repeat=5), 20_000)],
         string.digits + string.ascii_lowercase),
        (["".join(p) for p in itertools.product(string.ascii_uppercase, repeat=2)], string.digits + string.ascii_uppercase),
        (["HelloWorld123"], string.digits + string.ascii_letters),
        ([f"{i:024x}" for i in range(0xABC, 0xABC + 500)], "0123456789abcdef"),
    ],
)
def test_text_keeps_length_and_class(values, allowed):
    out = fpe.encrypt_texts(values, KEY)
    assert len(set(out)) == len(values)
    assert all(len(a) == len(b) for a, b in zip(values, out, strict=True))
    assert set("".join(out)) <= set(allowed)


def test_all_short_printable_texts_are_permuted_among_themselves():
    chars = [chr(i) for i in range(32, 127)]
    values = chars + [a + b for a in chars for b in chars]
    assert set(fpe.encrypt_texts(values, KEY)) == set(values)


def test_other_scripts_stay_apart():
    values = [f"Zoë-{a}{b}" for a in "äöüßéèœ北京市서울Ж" for b in "éèñ東ДЖ1"]
    out = fpe.encrypt_texts(values, KEY)
    assert len(set(out)) == len(values) and not set(out) & set(values)


def test_text_depends_on_the_key_and_repeats():
    assert fpe.encrypt_texts(["ConfidentialData"], "a") == fpe.encrypt_texts(["ConfidentialData"], "a")
    assert fpe.encrypt_texts(["ConfidentialData"], "a") != fpe.encrypt_texts(["ConfidentialData"], "b")


def test_type_names(spark):
    df = spark.createDataFrame([("NY", "12.50", "true")], "s string, d string, b string")
    for name in ("varchar(2)", "character varying(2)", "bpchar", "nvarchar(2)", "VARCHAR2(2)"):
        assert len(df.select(fpe.fpe(F.col("s"), name, KEY).alias("v")).head().v) == 2
    row = df.select(fpe.fpe(F.col("d").cast("decimal(5,2)"), "numeric", KEY, 5, 2).alias("v")).head()
    assert 0 < row.v < 1000 and row.v.as_tuple().exponent == -2
    assert df.select(fpe.fpe(F.col("s"), "interval", KEY).alias("v")).head().v == "NY"


def test_uuid_and_bool(spark):
    import uuid

    df = spark.createDataFrame([("6f1c1b3e-9f0a-4b58-9d0b-0d9f1c2d3e4f", True), ("x", False)], "u string, b boolean")
    rows = df.select(fpe.fpe(F.col("u"), "uuid", KEY).alias("u"), fpe.fpe_bool(F.col("b"), KEY).alias("b")).collect()
    assert all(str(uuid.UUID(r.u)) == r.u for r in rows)
    assert rows[0].b != rows[1].b


def test_decimal_pairs_stay_distinct(spark):
    df = spark.range(100, 30_000).select((F.col("id").cast("decimal(12,0)") / 100).cast("decimal(7,2)").alias("d"))
    out = mask_table(df, "t", RuleSet(key=KEY, constraint=("d",)))
    assert isinstance(out.schema["d"].dataType, T.DecimalType)
    assert out.distinct().count() == 29_900


def test_sql_names_agree_with_columns(spark):
    from veilframe.functions.sql import register_functions

    assert "mask_text" in register_functions(spark, KEY)
    spark.createDataFrame([("Ann", 5), (None, None)], "s string, n smallint").createOrReplaceTempView("sql_names")
    df = spark.sql("SELECT s, n, mask_text(s) AS t, mask_smallint(n) AS m FROM sql_names")
    same = df.select("t", "m", fpe.fpe_text(F.col("s"), KEY).alias("t2"), fpe.fpe_int(F.col("n"), "short", KEY).alias("m2"))
    assert same.filter("t <=> t2 AND m <=> m2").count() == 2


def test_array_elements_encrypt_like_columns(spark):
    from veilframe.plans.nested import mask_json

    df = spark.range(1, 400).select(F.col("id").cast("int").alias("k"), F.array(F.col("id").cast("int"), F.lit(None).cast("int")).alias("a"))
    out = mask_json(df, "t", RuleSet(key=KEY, constraint=("k", "a")))
    assert out.filter("a[0] <> k OR a[1] IS NOT NULL OR size(a) <> 2").count() == 0


def test_types_without_a_domain_are_refused(spark):
    df = spark.sql("SELECT DATE '2024-01-02' AS d, TIMESTAMP '2024-01-02 03:04:05' AS t, X'01' AS b")
    for name in df.columns:
        with pytest.raises(ValueError, match="cannot be encrypted"):
            fpe.fpe_column(F.col(name), df.schema[name].dataType, KEY)
    for name in ("date", "timestamp", "bytea"):
        with pytest.raises(ValueError, match="cannot be encrypted"):
            fpe.fpe(F.col("d"), name, KEY)


@pytest.mark.parametrize(("precision", "scale"), [(12, 2), (18, 2), (18, 0), (22, 11), (30, 12), (38, 2)])
def test_decimals_above_nine_digits_stay_distinct(spark, precision, scale):
    whole = 10 ** min(precision - scale, 18) - 1
    values = [f"{w}.{f}"[: None if scale else -3] for w in (whole, whole - 1, 1000000001, 2000000001, 999999999, 1000000000) for f in ("10", "11")]
    values = sorted({Decimal(v) + (Decimal(1).scaleb(-scale) if scale > 9 and v.endswith("11") else 0) for v in values})
    dtype = f"decimal({precision},{scale})"
    df = spark.createDataFrame([(str(v),) for v in values], "v string").select(F.col("v").cast(dtype).alias("v"))
    got = [r.v for r in df.select(fpe.fpe(F.col("v"), "decimal", KEY, precision, scale).alias("v")).collect()]
    assert len(set(got)) == len(values) and None not in got
    small = [(int(a), int(b)) for a, b in zip([r.v for r in df.collect()], got, strict=True)]
    assert all((a < 10**9) == (b < 10**9) for a, b in small)


def test_decimals_and_texts_that_do_not_fit_are_errors(spark):
    wide = spark.createDataFrame([("1" * 19,)], "v string").select(F.col("v").cast("decimal(38,0)").alias("v"))
    with pytest.raises(Exception, match="18 whole digits"):
        wide.select(fpe.fpe(F.col("v"), "decimal", KEY, 38, 0)).collect()
    texts = spark.createDataFrame([("abcde",), (None,), ("abc",)], "v string")
    assert [r.v and len(r.v) for r in texts.select(fpe.fpe(F.col("v"), "varchar(5)", KEY).alias("v")).collect()] == [5, None, 3]
    with pytest.raises(Exception, match="longer than its column"):
        texts.select(fpe.fpe(F.col("v"), "varchar(4)", KEY)).collect()


def keys_after(spark, values, dtype, domain):
    df = spark.createDataFrame([(v,) for v in values], f"k {dtype}")
    out = mask_table(df, "t", RuleSet(key=KEY, constraint=("t.k",)), domains={"t.k": domain})
    plain = df.select(fpe.fpe_key(F.col("k"), {"smallint": "short", "int": "int", "bigint": "long"}[dtype], domain, KEY).alias("k"))
    got = [r.k for r in out.collect()]
    assert got == [r.k for r in plain.collect()]
    return got


def test_keys_are_one_to_one_over_their_whole_type(spark):
    every = list(range(-32768, 32768))
    assert sorted(keys_after(spark, every, "smallint", "short")) == every
    assert sorted(keys_after(spark, every, "smallint", "byte")) == every
    edges = [s * (2**p + d) for p in (7, 15, 31, 62) for d in range(-50, 50) for s in (-1, 1)] + [2**63 - 1, -(2**63), 2**63 - 2, 0]
    for domain in ("byte", "int", "long"):
        assert len(set(keys_after(spark, edges, "bigint", domain))) == len(set(edges))


def test_keys_of_different_width_still_join(spark):
    shared = [-(2**31), -70_000, -129, -128, -5, 0, 1, 127, 128, 32_767, 32_768, 99_999, 2**31 - 1]
    for domain in ("byte", "short", "int"):
        assert keys_after(spark, shared, "int", domain) == keys_after(spark, shared, "bigint", domain)


def test_decimal_keys_are_one_to_one_over_signs_and_zero(spark):
    values = [Decimal(i) / 100 for i in range(-30_000, 30_001)]
    df = spark.createDataFrame([(v,) for v in values], "k decimal(12,2)")
    out = mask_table(df, "t", RuleSet(key=KEY, constraint=("t.k",)), domains={"t.k": "decimal"})
    assert out.distinct().count() == len(values)
    joined = {r.k for r in out.collect()}
    assert Decimal(0) in joined and min(joined) < 0 < max(joined)
