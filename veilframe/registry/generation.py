"""Queries over the generators: sequence numbers and parent keys come from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilframe.operators import generate, integrity, values
from veilframe.operators.catalog import row_counts
from veilframe.operators.generate import GenColumn, TableSpec
from veilframe.operators.ledger import Ledger
from veilframe.plans import jobs
from veilframe.plans.rules import ForeignKey
from veilframe.registry import sqltext as s
from veilframe.registry.base import query, table
from veilframe.registry.sqltext import KEY
from veilframe.session import fresh_path


def _seq(spark, sf, name="customer", column="c_custkey"):
    """Sequence numbers 1, 2, ... as the keys of a given table."""
    return table(spark, sf, name).select((F.col(column) + 1).alias("seq"))


_SEQ = "(SELECT c_custkey + 1 AS seq FROM customer)"


@query(
    "gen_keys",
    "SELECT seq, seq AS a, CAST(seq + 1 AS INTEGER) AS b, CAST(seq + 1 AS INTEGER) AS c, 'CODE_' || seq AS d, "
    "'user' || seq || '@example.com' AS e, lpad(to_base(seq - 1, 36), 5, '0') AS f, DATE '2025-01-01' - CAST(seq AS INTEGER) AS g, "
    f"TIMESTAMP '2025-01-01' - to_seconds(seq * 300) AS h, CAST(seq AS DECIMAL(12,2)) AS i, {s.hash_uuid('seq', 'j')} AS j FROM {_SEQ}",
)
def gen_keys(spark, sf):
    """Every column holds as many distinct keys as there are rows, in types that do not depend on how many there are."""
    rows = _seq(spark, sf)
    n = rows.count()
    kinds = {
        "a": GenColumn("a", "bigint"), "b": GenColumn("b", "int"), "c": GenColumn("c", "integer"), "d": GenColumn("code", "varchar", 50),
        "e": GenColumn("email", "varchar", 50), "f": GenColumn("f", "varchar", 5), "g": GenColumn("g", "date"), "h": GenColumn("h", "timestamp"),
        "i": GenColumn("i", "decimal", precision=12, scale=2), "j": GenColumn("j", "uuid"),
    }
    return rows.select("seq", *[generate.gen_key(F.col("seq"), col, n, KEY).alias(name) for name, col in kinds.items()])


@query(
    "gen_codes",
    "SELECT seq, chr(CAST(65 + (seq - 1) % 26 AS INTEGER)) AS one, chr(CAST(65 + (seq - 1) % 26 AS INTEGER)) || to_base((seq - 1) // 26 % 36, 36) AS two, "
    f"lpad(to_base((seq - 1) % 46656, 36), 3, '0') AS three, {s.words(values.COUNTRY_CODES)}[(seq - 1) % 20 + 1] AS country, "
    f"{s.words(values.STATE_CODES)}[(seq - 1) % 20 + 1] AS state FROM {_SEQ}",
)
def gen_codes(spark, sf):
    q = F.col("seq")
    return _seq(spark, sf).select(
        "seq", values.short_code(q, 1).alias("one"), values.short_code(q, 2).alias("two"), values.short_code(q, 3).alias("three"),
        values.cyclic_code(q, values.COUNTRY_CODES).alias("country"), values.cyclic_code(q, values.STATE_CODES).alias("state"),
    )


@query(
    "gen_foreign_keys",
    f"SELECT seq, key AS supplier_id FROM (SELECT seq, {s.khash('seq', 'fk.supplier_id.')} % (SELECT count(*) FROM supplier) AS i FROM {_SEQ}) "
    "JOIN (SELECT s_suppkey AS key, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) USING (i)",
)
def gen_foreign_keys(spark, sf):
    parents = generate.indexed_keys(table(spark, sf, "supplier"), "s_suppkey")
    return generate.gen_fk(_seq(spark, sf), "supplier_id", parents, parents.count(), KEY)


@query(
    "gen_unique_foreign_keys",
    "SELECT count(*) AS n_rows, (SELECT count(*) FROM supplier) AS n_keys, (SELECT count(*) FROM supplier) AS n_distinct, "
    "count(*) - (SELECT count(*) FROM supplier) AS n_null FROM customer",
)
def gen_unique_foreign_keys(spark, sf):
    """Each parent key once; rows beyond them get null."""
    parents = generate.indexed_keys(table(spark, sf, "supplier"), "s_suppkey")
    made = generate.gen_unique_fk(_seq(spark, sf), "supplier_id", parents, parents.count(), KEY)
    return made.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("supplier_id").alias("n_keys"), F.countDistinct("supplier_id").alias("n_distinct"),
        F.count_if(F.col("supplier_id").isNull()).alias("n_null"),
    )


@query(
    "gen_composite_keys",
    "SELECT count(*) AS n_rows, count(*) AS n_distinct, 0::BIGINT AS n_null FROM customer",
)
def gen_composite_keys(spark, sf):
    """Every row gets its own pair of parent keys."""
    suppliers = generate.indexed_keys(table(spark, sf, "supplier"), "s_suppkey")
    parts = generate.indexed_keys(table(spark, sf, "part"), "p_partkey")
    rows = _seq(spark, sf)
    parents = {"supplier_id": (suppliers, suppliers.count()), "part_id": (parts, parts.count())}
    made = generate.gen_composite_key(rows, parents, KEY, rows.count())
    return made.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("supplier_id", "part_id").alias("n_distinct"),
        F.count_if(F.col("supplier_id").isNull() | F.col("part_id").isNull()).alias("n_null"),
    )


@query(
    "gen_unused_combinations",
    "SELECT least(count(*), 500) AS n_rows, 0::BIGINT AS n_used FROM orders WHERE NOT EXISTS "
    "(SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 7 + 1)",
)
def gen_unused_combinations(spark, sf):
    """New line items whose (order, line) pair the table does not hold."""
    existing = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").cast("long").alias("n"))
    candidates = table(spark, sf, "orders").select(
        (F.col("o_orderkey") + 1).alias("seq"), F.col("o_orderkey").alias("o"), (F.col("o_orderkey") % 7 + 1).alias("n")
    )
    made = generate.unused_combinations(candidates, existing, ["o", "n"], 500)
    used = made.join(existing.distinct().withColumn("used", F.lit(1)), ["o", "n"], "left")
    return used.agg(F.count(F.lit(1)).alias("n_rows"), F.count("used").alias("n_used"))


_H = {n: s.khash("seq", f"gen.{n}") for n in ("status", "pay_date", "seen_at", "done", "price", "rating")}


@query(
    "gen_values_by_name",
    "SELECT seq, " + ", ".join(
        [
            f"left('u' || seq || '_' || {s.provider('email', 'seq', 'gen.email')}, 60) AS email",
            s.provider("first_name", "seq", "gen.first_name") + " AS first_name",
            s.provider("last_name", "seq", "gen.surname") + " AS surname",
            f"left({s.provider('full_name', 'seq', 'gen.nick_name')}, 8) AS nick_name",
            f"regexp_replace({s.provider('phone', 'seq', 'gen.mobile')}, '[^0-9+]', '', 'g') AS mobile",
            s.provider("street", "seq", "gen.street") + " AS street",
            s.provider("city", "seq", "gen.city") + " AS city",
            s.provider("zip", "seq", "gen.zip") + " AS zip",
            s.words(values.COUNTRY_CODES) + "[(seq - 1) % 20 + 1] AS country",
            s.provider("state", "seq", "gen.state") + " AS state",
            s.provider("company", "seq", "gen.department") + " AS department",
            s.pick(values.STATUSES, _H["status"]) + " AS status",
            s.provider("ssn", "seq", "gen.ssn") + " AS ssn",
        ]
    ) + f" FROM {_SEQ}",
)
def gen_values_by_name(spark, sf):
    sizes = {"email": 60, "nick_name": 8, "country": 2}
    names = ["email", "first_name", "surname", "nick_name", "mobile", "street", "city", "zip", "country", "state", "department", "status", "ssn"]
    return _seq(spark, sf).select(
        "seq", *[generate.gen_value(F.col("seq"), GenColumn(n, "varchar", sizes.get(n, 0)), KEY).alias(n) for n in names]
    )


@query(
    "gen_values_by_type",
    f"SELECT seq, CAST(CAST(({_H['price']} % 98900 + 1000) AS DECIMAL(20,0)) / 100 AS DECIMAL(5,2)) AS price, "
    f"DATE '2025-01-01' - CAST({_H['pay_date']} % 730 AS INTEGER) AS pay_date, TIMESTAMP '2025-01-01' - to_hours(CAST({_H['seen_at']} % 8760 AS INTEGER)) AS seen_at, "
    f"{_H['done']} % 2 = 1 AS done, CAST(seq % 35 + 1990 AS INTEGER) AS release_year, {s.pick(values.RATINGS, _H['rating'])} AS rating, "
    "'{\"status\":\"ok\",\"seq\":' || seq || '}' AS extra, ['item1', 'item2'] AS tags, CAST(seq % 32000 + 1 AS SMALLINT) AS small, "
    f"{s.hash_uuid('seq', 'gen.token')} AS token, CAST(seq % 50000 + 1 AS INTEGER) AS shop_id, lpad(to_base((seq - 1) % 1679616, 36), 4, '0') AS grade FROM {_SEQ}",
)
def gen_values_by_type(spark, sf):
    columns = [
        GenColumn("price", "decimal", precision=5, scale=2), GenColumn("pay_date", "date"), GenColumn("seen_at", "timestamp"),
        GenColumn("done", "boolean"), GenColumn("release_year", "int"), GenColumn("rating", "varchar", 10), GenColumn("extra", "jsonb"),
        GenColumn("tags", "text[]"), GenColumn("small", "smallint"), GenColumn("token", "uuid"), GenColumn("shop_id", "int"),
        GenColumn("grade", "varchar", 4),
    ]
    return _seq(spark, sf).select("seq", *[generate.gen_value(F.col("seq"), c, KEY).alias(c.name) for c in columns])


_J = {n: s.khash("seq", f"json.{n}") for n in ("department", "status", "salary", "createddate", "active")}
_SALARY = f"(({_J['salary']} % 1500000) + 500000)::DOUBLE / 100.0::DOUBLE"


@query(
    "gen_csv_rows",
    f"SELECT CAST(seq AS VARCHAR) AS id, {s.provider('full_name', 'seq', 'json.fullname')} AS \"fullName\", {s.provider('email', 'seq', 'json.email')} AS email, "
    f"{s.provider('phone', 'seq', 'json.phone')} AS phone, {s.pick(values.DEPARTMENTS, _J['department'])} AS department, "
    f"{s.pick(values.JSON_STATUSES, _J['status'])} AS status, CAST({_SALARY} AS VARCHAR) AS salary, "
    f"strftime(DATE '2025-01-01' - CAST({_J['createddate']} % 365 AS INTEGER), '%Y-%m-%d') AS \"createdDate\" FROM {_SEQ}",
)
def gen_csv_rows(spark, sf):
    return generate.gen_csv(_seq(spark, sf), KEY)


@query(
    "gen_json_template",
    f"SELECT seq AS id, {s.provider('full_name', 'seq', 'json.fullname')} AS full_name, {s.provider('email', 'seq', 'json.email')} AS email, "
    f"{s.provider('city', 'seq', 'json.city')} AS city0, 2 AS n_homes, 3 AS n_marks, {_J['active']} % 2 = 1 AS active FROM {_SEQ}",
)
def gen_json_template(spark, sf):
    """Records shaped like a sample: nesting and array lengths are kept."""
    template = {
        "id": 1, "profile": {"fullName": "A", "email": "a@b.c"}, "homes": [{"city": "x"}, {"city": "y"}], "marks": [1, 2, 3], "active": True,
    }
    made = generate.gen_json(_seq(spark, sf), KEY, template=template)
    return made.select(
        "id", F.col("profile.fullName").alias("full_name"), "profile.email", F.col("homes")[0]["city"].alias("city0"),
        F.size("homes").alias("n_homes"), F.size("marks").alias("n_marks"), "active",
    )


_D = {n: s.khash("seq", f"doc.{n}") for n in ("amount", "createdat", "age")}


@query(
    "gen_documents",
    f"SELECT substr(sha256('{s.subkey(KEY, 'doc')}' || seq), 1, 24) AS _id, {s.provider('full_name', 'seq', 'doc.name')} AS name, "
    f"{s.words(values.DOC_STATUSES)}[(seq - 1) % 4 + 1] AS status, (({_D['amount']} % 500000) + 10000)::DOUBLE / 100.0::DOUBLE AS amount, "
    f"TIMESTAMP '2025-01-01' - to_days(CAST({_D['createdat']} % 365 AS INTEGER)) AS \"createdAt\", lpad(to_base((seq - 1) % 46656, 36), 3, '0') AS code, "
    f"left({s.provider('word', 'seq', 'doc.remark')}, 10) AS remark, CAST({_D['age']} % 50 + 20 AS INTEGER) AS age FROM {_SEQ}",
)
def gen_documents(spark, sf):
    sample = {"_id": "1", "name": "Somebody", "status": "PENDING", "amount": 1.0, "createdAt": None, "code": "abc"}
    return generate.gen_docs(_seq(spark, sf), KEY, sample, ["remark:string(10)", "age:int"])


@query(
    "coerced_values",
    "SELECT o_orderkey, CAST(CASE WHEN o_orderkey BETWEEN 1 AND 32767 THEN o_orderkey ELSE abs(o_orderkey) % 32000 + 1 END AS SMALLINT) AS a, "
    "CAST(1 AS INTEGER) AS b, left(o_orderpriority, 3) AS c, o_totalprice AS d, [o_orderstatus] AS e, 0.0::DOUBLE AS f FROM orders",
)
def coerced_values(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", generate.coerce(F.col("o_orderkey"), GenColumn("a", "smallint")).alias("a"),
        generate.coerce(F.col("o_orderpriority"), GenColumn("b", "int")).alias("b"),
        generate.coerce(F.col("o_orderpriority"), GenColumn("c", "varchar", 3)).alias("c"),
        generate.coerce(F.col("o_totalprice"), GenColumn("d", "double")).alias("d"),
        generate.coerce(F.col("o_orderstatus"), GenColumn("e", "text[]")).alias("e"),
        generate.coerce(F.col("o_orderstatus"), GenColumn("f", "double")).alias("f"),
    )


@query(
    "generated_table",
    "SELECT count(*) AS n_rows, count(*) AS n_ids, 0::BIGINT AS n_orphans, (SELECT count(*) FROM region) AS n_regions, count(*) AS n_codes FROM customer",
)
def generated_table(spark, sf):
    """A table with a key, a declared and an inferred parent, both read from the given tables."""
    regions = generate.indexed_keys(table(spark, sf, "region"), "r_regionkey")
    nations = generate.indexed_keys(table(spark, sf, "nation"), "n_nationkey")
    parents = {("region", "r_regionkey"): (regions, regions.count()), ("nation", "n_nationkey"): (nations, nations.count())}
    rows = _seq(spark, sf)
    spec = TableSpec(
        "shop",
        (
            GenColumn("shop_no", "bigint", primary=True), GenColumn("code", "varchar", 20, unique=True), GenColumn("nation_id", "int"),
            GenColumn("home", "int", foreign=("region", "r_regionkey")), GenColumn("full_name", "varchar", 40),
        ),
        rows.count(),
    )
    made = generate.generate(rows, spec, KEY, parents)
    joined = made.join(nations.select(F.col("key").alias("nation_id"), F.lit(1).alias("known")), "nation_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("shop_no").alias("n_ids"), F.count_if(F.col("known").isNull()).alias("n_orphans"),
        F.countDistinct("home").alias("n_regions"), F.countDistinct("code").alias("n_codes"),
    )


@query(
    "generation_report",
    "SELECT 'customer' AS \"table\", count(*) AS n_rows, count(*) * 2 AS target, 50 AS percent FROM customer UNION ALL "
    "SELECT 'supplier', count(*), 10::BIGINT, 100 FROM supplier",
)
def generation_report(spark, sf):
    made = {"customer": _seq(spark, sf), "supplier": _seq(spark, sf, "supplier", "s_suppkey")}
    n = row_counts({"customer": made["customer"]}).head().n_rows
    return generate.generation_report(made, {"customer": 2 * n, "supplier": 10})


@query(
    "generated_dataset",
    "SELECT 'parent' AS \"table\", 1::BIGINT AS n_made, count(*) AS n_rows, 0::BIGINT AS n_orphans FROM customer UNION ALL "
    "SELECT 'child', 1, 2 * count(*), 0 FROM customer",
)
def generated_dataset(spark, sf):
    """A job that breaks at its second table and is started again: each table is made once, and all keys join."""
    n = table(spark, sf, "customer").count()
    target, book = fresh_path(spark, "dataset"), Ledger(spark, fresh_path(spark, "ledger"), "generate")
    parent = TableSpec("parent", (GenColumn("id", "bigint", primary=True), GenColumn("full_name", size=40)), n)
    link = GenColumn("parent_id", "bigint", foreign=("parent", "id"))
    broken = TableSpec("child", (GenColumn("id", "char", 1, primary=True), link), 2 * n)  # a letter cannot number so many
    child = TableSpec("child", (GenColumn("id", "bigint", primary=True), link), 2 * n)
    try:
        jobs.generate_dataset(spark, [parent, broken], target, KEY, book, restart=True)
        raise AssertionError("the first run should break")
    except ValueError:
        made = jobs.generate_dataset(spark, [parent, child], target, KEY, book, restart=True)
    steps = book.entries().where("status = 'COMPLETED' AND step LIKE '%#%'")
    times = steps.groupBy(F.substring_index("step", "#", 1).alias("table")).agg(F.count(F.lit(1)).alias("n_made"))
    orphans = integrity.check_foreign_key(made["child"], ["parent_id"], made["parent"], ["id"]).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"))
    orphans = orphans.select(F.lit("child").alias("table"), F.col("n").alias("n_orphans"))
    counted = times.join(row_counts(made), "table").join(orphans, "table", "left")
    return counted.select("table", "n_made", "n_rows", F.coalesce("n_orphans", F.lit(0).cast("long")).alias("n_orphans"))


@query(
    "generation_order",
    "SELECT * FROM (VALUES ('region', 1), ('nation', 2), ('customer', 3), ('supplier', 4), ('orders', 5), ('part', 6), ('lineitem', 7)) v(\"table\", pos) "
    "JOIN (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "orders", "part", "lineitem")) + ") USING (\"table\")",
)
def generation_order(spark, sf):
    """Parents before children over the keys of the given tables, with each table's rows."""
    keys = [
        ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)), ForeignKey("lineitem", ("l_partkey",), "part", ("p_partkey",)),
        ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)), ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
        ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)), ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    ]
    order = generate.topo_order(["lineitem", "region", "nation", "customer", "supplier", "orders", "part"], keys)
    pos = F.array_position(F.array(*[F.lit(n) for n in order]), F.col("table")).cast("int")
    return row_counts({n: table(spark, sf, n) for n in order}).withColumn("pos", pos)


@query(
    "seed_cards",
    "SELECT (SELECT count(*) FROM customer) AS n_customers, (SELECT count(*) FROM customer) AS n_cards, (SELECT count(*) FROM supplier) AS n_payments, "
    "(SELECT count(*) FROM supplier) AS n_disputes, 0::BIGINT AS n_orphans, "
    f"(SELECT CAST(sum({s.khash('seq', 'amount', 'seed')} % 2500000 + 1000) AS BIGINT) FROM (SELECT s_suppkey + 1 AS seq FROM supplier)) AS cents",
)
def seed_cards(spark, sf):
    """The card dataset over the given key ranges: the n-th card pays the n-th merchant."""
    made = generate.seed_card_dataset(_seq(spark, sf), _seq(spark, sf, "supplier", "s_suppkey"))
    orphans = made["transactions"].join(made["credit_cards"], "card_id", "left_anti")
    parts = [
        made["customers"].agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("n_customers")),
        made["credit_cards"].agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("n_cards")),
        made["transactions"].agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("n_payments")),
        made["disputes"].agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("n_disputes")),
        orphans.agg(F.count(F.lit(1)).alias("v")).withColumn("k", F.lit("n_orphans")),
        made["transactions"].agg(F.sum((F.col("amount") * 100).cast("long")).alias("v")).withColumn("k", F.lit("cents")),
    ]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    names = ["n_customers", "n_cards", "n_payments", "n_disputes", "n_orphans", "cents"]
    return long.agg(*[F.max(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names])


@query(
    "seed_shop",
    f"SELECT seq AS id, {s.khash('seq', 'user', 'seed')} % 1000 + 1 AS user_id, {s.khash('seq', 'product', 'seed')} % 100 + 1 AS product_id, "
    f"CAST({s.khash('seq', 'quantity', 'seed')} % 10 + 1 AS INTEGER) AS quantity, "
    f"CAST(CAST({s.khash('seq', 'total', 'seed')} % 500000 + 10000 AS DECIMAL(20,0)) / 100 AS DECIMAL(10,2)) AS total_amount FROM {_SEQ}",
)
def seed_shop(spark, sf):
    rows = _seq(spark, sf)
    return generate.seed_shop_dataset(rows, rows, rows)["orders"]


