"""Classification, preview, checks, generation, ledger, stream."""




import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import tokens
from veilframe.operators import catalog, classify, generate, integrity, ledger, preview
from veilframe.operators.generate import GenColumn, TableSpec
from veilframe.plans import jobs
from veilframe.plans.rules import ForeignKey, RuleSet
from veilframe.streaming import masking

KEY = "0123456789abcdef"

CATALOG = {
    "customer": "customer_id first_name last_name email active dob ssn",
    "address": "address_id address district city_id postal_code phone",
    "staff": "staff_id first_name last_name email store_id username salary",
    "payment": "payment_id customer_id staff_id rental_id amount card_number payment_date",
    "users": "id username password_hash api_key client_ip gender",
    "orders": "order_id customer_id tenant_id total_amount",
    "payments": "payment_id card_number cvv card_exp iban swift",
    "user_roles": "user_id role_id",
    "patients": "id mrn diagnosis",
}


@pytest.fixture(scope="module")
def classified(spark):
    rows = [(t, c) for t, cols in CATALOG.items() for c in cols.split()]
    found = classify.classify_columns(spark.createDataFrame(rows, "table string, column string"))
    return {f"{r.table}.{r.column}": r for r in found.collect()}, found


def test_sensitive_columns(classified):
    got, _ = classified
    want = {
        "customer.first_name": ("FIRST_NAME", "SFD"), "customer.email": ("EMAIL", "SFD"), "customer.dob": ("DATE_OF_BIRTH", "PMD"),
        "customer.ssn": ("SSN_NATIONAL_ID", "FPH"), "address.district": ("CITY", "SFD"), "address.phone": ("PHONE", "SFD"),
        "staff.username": ("FULL_NAME", "SFD"), "staff.salary": ("SALARY_AMOUNT", "SFD"), "payment.card_number": ("CREDIT_CARD", "SFD"),
        "users.password_hash": ("PASSWORD_SECRET", "SFD"), "users.api_key": ("API_TOKEN", "SFD"), "users.client_ip": ("IP_ADDRESS", "SFD"),
        "users.gender": ("DEMOGRAPHIC", "SFD"), "payments.cvv": ("CARD_SECURITY", "SFD"), "payments.card_exp": ("CARD_EXPIRATION", "PMD"),
        "payments.iban": ("BANK_ACCOUNT", "SFD"), "patients.mrn": ("PHI_HEALTH_DATA", "FPH"), "patients.diagnosis": ("PHI_HEALTH_DATA", "FPH"),
    }
    assert {k: (got[k].category, got[k].rule) for k in want} == want
    assert "customer.active" not in got and "payment.payment_date" not in got


def test_key_columns(classified):
    got, _ = classified
    assert got["customer.customer_id"].category == "PRIMARY_KEY" and got["orders.order_id"].category == "PRIMARY_KEY"
    assert got["payment.customer_id"].category == "FOREIGN_KEY" and got["payment.customer_id"].target_table == "customer"
    assert got["orders.tenant_id"].category == "TABLE_MAPPING" and got["user_roles.user_id"].category == "TABLE_MAPPING"
    assert got["user_roles.user_id"].target_table == "users" and got["user_roles.user_id"].target_column == "id"
    assert got["staff.username"].key_type == "UNIQUE_KEY" and got["payment.rental_id"].target_table == "rental"


def test_summary_and_rules(classified):
    _, found = classified
    groups = {r.group: r for r in classify.classification_summary(found).collect()}
    assert groups["key:TABLE_MAPPING"].n_columns == 3 and "user_roles.role_id" in groups["key:TABLE_MAPPING"].columns
    assert groups["total:columns"].n_columns == found.count()
    rules = classify.rules_from_classification(found)
    assert "customer.dob" in rules.partial and "customer.email" in rules.masking and "payment.customer_id" in rules.constraint


def test_singular(spark):
    names = ["cities", "classes", "boxes", "dishes", "churches", "users", "glass", "gas", "addresses"]
    got = [r.s for r in spark.createDataFrame([(n,) for n in names], "n string").select(classify.singular(F.col("n")).alias("s")).collect()]
    assert got == ["city", "class", "box", "dish", "church", "user", "glass", "gas", "address"]


def test_model_reply(spark):
    reply = '```json\n{"detectedEntities": {"users.email": {"category": "EMAIL", "ruleType": "sfd", "confidence": 0.5}, "x": {}}}\n```'
    rows = {r.name: r for r in classify.parse_model_labels(spark.createDataFrame([(reply,), ("no json",), (None,)], "r string"), "r").collect()}
    assert rows["users.email"].table == "users" and rows["users.email"].rule == "SFD" and rows["users.email"].confidence == 0.5
    assert rows["x"].category == "PII" and rows["x"].column == "x" and rows["x"].table == ""


def test_preview_never_shows_protected_values(spark):
    df = spark.createDataFrame([(1, "Ann Lee", "ann@x.org", "HR"), (2, "Bo Ek", "bo@y.org", None)], "emp_id int, full_name string, email_addr string, department string")
    shown = preview.preview(df, "employees", RuleSet(key=KEY, masking=("full_name",), partial=("email_addr",)), 5)
    assert shown.labels == {"emp_id": "FPH", "full_name": "SFD", "email_addr": "PMD", "department": "NONE"} and shown.masked_columns == 3
    before = shown.before.collect()
    assert "Ann" not in str(before) and "ann@" not in str(before) and [r.department for r in before] == ["HR", "N/A"]
    assert shown.after.head().email_addr == "XXXXX.org"


def test_preview_judges_columns_alone(spark):
    names = ["order_id", "shop_id", "qty"]
    assert preview.column_labels(spark, "order_shop", names, RuleSet(key=KEY)) == {"order_id": "FPH", "shop_id": "FPH", "qty": "NONE"}
    catalog_rows = spark.createDataFrame([("order_shop", n) for n in names], "table string, column string")
    assert {r.category for r in classify.classify_columns(catalog_rows).collect()} == {"TABLE_MAPPING"}
    assert {r.category for r in classify.classify_columns(catalog_rows, alone=True).collect()} == {"FOREIGN_KEY"}


def test_preview_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id int, email string, first_name string, notes string")
    shown = preview.preview(df, "t", RuleSet(key=KEY), 20)
    rows = shown.after.collect()
    assert len(rows) == 10 and rows[0].id == "1001" and rows[0].email == "user1@example.com" and rows[0].notes == "Sample notes 1"


def test_checks_find_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "k int, v string")
    assert [tuple(r) for r in integrity.check_unique(df, ["k"]).collect()] == [(1, 2)]
    assert integrity.check_unique(df, ["k"], primary=True).count() == 2
    assert [tuple(r) for r in integrity.check_not_null(df, ["k", "v"]).orderBy("column").collect()] == [("k", 1), ("v", 1)]
    parent = spark.createDataFrame([(1,)], "id int")
    assert [tuple(r) for r in integrity.check_foreign_key(df, ["k"], parent, ["id"]).collect()] == [(2, 1)]


def test_field_paths(spark):
    schema = T.StructType.fromDDL("userId int, profile struct<address:string>, items array<struct<k:string>>, tags array<string>")
    assert catalog.field_paths(schema) == ["items.k", "profile.address", "tags", "userId"]
    assert catalog.field_paths(schema, True) == ["items", "items[].k", "profile", "profile.address", "tags", "userId"]
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": 2, "b": {"c": [1]}}',)], "j string")
    assert catalog.field_paths(catalog.json_schema(df, "j")) == ["a", "b.c"]


def test_described_columns(spark):
    df = spark.createDataFrame([], "id int, price decimal(10,2)")
    rows = catalog.describe_columns(spark, {"t": df}).orderBy("pos").collect()
    assert [(r.column, r.precision, r.scale) for r in rows] == [("id", None, None), ("price", 10, 2)]


def test_table_order():
    keys = [ForeignKey("c", ("b",), "b", ("id",)), ForeignKey("b", ("a",), "a", ("id",)), ForeignKey("a", ("a",), "a", ("id",))]
    assert generate.topo_order(["c", "b", "a"], keys) == ["a", "b", "c"]
    ring = [ForeignKey("x", ("y",), "y", ("id",)), ForeignKey("y", ("x",), "x", ("id",))]
    assert generate.topo_order(["x", "y", "z"], ring) == ["z", "x", "y"]


def test_small_domains_raise_instead_of_repeating(spark):
    with pytest.raises(ValueError):
        generate.gen_key(F.lit(1), GenColumn("k", "tinyint"), 121)
    with pytest.raises(ValueError):
        generate.gen_key(F.lit(1), GenColumn("k", "char", 1), 27)
    codes = generate.sequence(spark, 936).select(generate.gen_key(F.col("seq"), GenColumn("k", "char", 2), 936).alias("k"))
    assert codes.distinct().count() == 936


def test_generated_dataset(spark, tmp_path):
    specs = [
        TableSpec("orders", (GenColumn("order_id", "bigint", primary=True), GenColumn("user_id", "int", foreign=("users", "id")),
                             GenColumn("status", "varchar", 20)), 200),
        TableSpec("users", (GenColumn("id", "int", primary=True), GenColumn("email", "varchar", 60, unique=True)), 50),
        TableSpec("links", (GenColumn("user_id", "int", primary=True, foreign=("users", "id")),
                            GenColumn("order_id", "bigint", primary=True, foreign=("orders", "order_id"))), 3000),
    ]
    book = ledger.Ledger(spark, str(tmp_path / "ledger"), "generate")
    out = jobs.generate_dataset(spark, specs, str(tmp_path / "data"), KEY, book)
    assert {n: d.count() for n, d in out.items()} == {"users": 50, "orders": 200, "links": 3000}
    assert integrity.check_foreign_key(out["orders"], ["user_id"], out["users"], ["id"]).count() == 0
    assert integrity.check_unique(out["links"], ["user_id", "order_id"], primary=True).count() == 0
    assert ledger.status(book.entries()).head().percent == 100


def test_json_and_csv_generation(spark):
    rows = generate.sequence(spark, 25)
    table = generate.gen_csv(rows, KEY, ["txn_id", "account_id", "amount", "status", "notes"])
    ids = [r.txn_id for r in table.collect()]
    assert ids[0] == "1" and ids[-1] == "25" and table.columns == ["txn_id", "account_id", "amount", "status", "notes"]
    made = generate.gen_json(rows, KEY, template={"id": 1, "profile": {"fullName": "x", "email": "y"}, "status": "z"}).collect()
    assert made[4].id == 5 and "@" in made[4].profile.email
    assert generate.gen_json(rows, KEY).columns == generate.DEFAULT_FIELDS
    assert generate.parse_doc_fields(["name:string(20)", "st", "_id", "code(3)"]) == {"name": 20, "st": None, "code": 3}


def test_ledger_goes_on_after_an_error(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "l"), "sql")

    def broken():
        raise RuntimeError("no such table")

    assert book.run("a", lambda: None) and not book.run("b", broken)
    row = ledger.status(book.entries()).head()
    assert (row.steps, row.completed, row.failed, row.percent, row.status) == (2, 1, 1, 50, "FAILED")
    assert row.first_error == "no such table"


def test_history_order(spark):
    runs = spark.createDataFrame([("9", 1), ("10", 1), ("x", 1), ("1", 2)], "run_id string, t int")
    runs = runs.withColumn("started", F.timestamp_seconds("t"))
    assert [r.run_id for r in ledger.history(runs).collect()] == ["1", "10", "9", "x"]


def test_tokens(spark):
    df = spark.createDataFrame([("secret", 42), ("", -7), (None, None)], "s string, n long")
    made = df.select("s", "n", tokens.tokenize(F.col("s"), KEY, "a").alias("t"), tokens.tokenize_number(F.col("n"), KEY, "a").alias("m"))
    back = made.select("s", "n", tokens.detokenize(F.col("t"), KEY, "a").alias("s2"), tokens.detokenize_number(F.col("m"), KEY, "a").alias("n2"))
    assert back.filter("s <=> s2 AND n <=> n2").count() == 3
    assert len(tokens.random_salt()) == 8 and tokens.is_valid_key(KEY) and not tokens.is_valid_key("short")


def test_stream_picks_up_new_files(spark, tmp_path):
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    df = spark.createDataFrame([(1, "Ann Lee")], "id int, name string")
    rules = RuleSet(key=KEY, partial=("t.name",))
    for i in range(2):
        df.withColumn("id", F.lit(i)).write.mode("append").parquet(source)
        stream = masking.read_file_stream(spark, source, df.schema)
        masking.start_masking(masking.mask_stream(stream, "t", rules), out, mark).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 2 and {r.name for r in rows} == {"XXX Lee"}




def test_composite_keys_pair_by_position(spark):
    kinds = spark.createDataFrame([("k", "FOREIGN KEY", "child")], "constraint_name string, constraint_type string, table_name string")
    usage = spark.createDataFrame([("k", "x", 1), ("k", "y", 2)], "constraint_name string, column_name string, ordinal_position int")
    refs = spark.createDataFrame([("k", "parent", "b", 1), ("k", "parent", "a", 2)], "constraint_name string, table_name string, column_name string, ordinal_position int")
    pairs = catalog.discover_foreign_keys(kinds, usage, refs).select("column_name", "foreign_column").collect()
    assert {tuple(r) for r in pairs} == {("x", "b"), ("y", "a")}
    row = catalog.discover_constraints(kinds, usage, refs).head()
    assert (row.column_name, row.foreign_column) == ("x, y", "b, a")


def test_unique_parents_past_the_last(spark):
    parents = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "idx long, key string")
    rows = generate.gen_unique_fk(spark.range(1, 101).select(F.col("id").alias("seq")), "parent", parents, 7, "k" * 16).collect()
    used = [r.parent for r in rows if r.parent]
    assert len(rows) == 100 and len(used) == len(set(used)) == 7 and all(r.parent is None for r in rows if r.seq > 7)


@pytest.mark.parametrize("n", [7_400, 33_000])
def test_generated_keys_are_distinct(spark, tmp_path, n):
    from veilframe.registry import QUERIES

    spark.range(n).select(F.col("id").alias("c_custkey")).write.parquet(str(tmp_path / "customer.parquet"))
    made = QUERIES["gen_keys"].run(spark, str(tmp_path))
    counts = made.agg(*[F.countDistinct(c).alias(c) for c in made.columns]).head().asDict()
    assert counts == dict.fromkeys(made.columns, n)


def test_date_keys_go_on_before_the_year_one(spark):
    n, day = 900_000, GenColumn("g", "date")
    rows = spark.range(1, n + 1).select(F.col("id").alias("seq"))
    made = rows.select("seq", generate.gen_key(F.col("seq"), day, n).alias("g"))
    one = made.agg(F.countDistinct("g").alias("keys"), F.count_if(F.datediff(F.lit("2025-01-01"), F.col("g")) == F.col("seq")).alias("right"), F.min("g").cast("string").alias("first")).head()
    assert (one.keys, one.right, one.first) == (n, n, "-0440-11-20")
    with pytest.raises(ValueError):
        generate.gen_key(F.lit(1), day, 2**31)


def test_int_key_is_the_same_at_every_size(spark):
    one = spark.range(1).select(*[generate.gen_key(F.lit(7), GenColumn("k", "int"), n).alias(f"k{n}") for n in (10, 1_000_000, 1_000_001)]).head()
    assert len(set(one)) == 1
    with pytest.raises(ValueError):
        generate.gen_key(F.lit(1), GenColumn("k", "int"), 2**31)
