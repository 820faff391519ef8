"""Queries over masking functions and compiled rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import formats, fpe, partial, regextext, synthetic, tokens
from veilframe.functions.sql import register_functions
from veilframe.plans.compiler import mask_table
from veilframe.plans.nested import mask_array, mask_docs, mask_json
from veilframe.plans.rules import RuleSet
from veilframe.registry import sqltext as s
from veilframe.registry.base import query, table
from veilframe.registry.sqltext import KEY

# ---------------------------------------------------------------- rules on flat tables

CUSTOMER_RULES = RuleSet(
    key=KEY, nullify=("customer.c_mktsegment",), partial=("public.customer.c_name",), defaults={"c_acctbal": "0.5"}
)
_LAST4_X = "CASE WHEN length({c}) <= 4 THEN {c} ELSE repeat('X', length({c}) - 4) || right({c}, 4) END"
_LAST4_STAR = "CASE WHEN length({c}) <= 4 THEN repeat('*', length({c})) ELSE repeat('*', length({c}) - 4) || right({c}, 4) END"
_FIXED = "CASE WHEN length({c}) <= 4 THEN '****' ELSE '****' || right({c}, 4) END"
_ENDS = (
    "CASE WHEN length({c}) <= 3 THEN repeat('*', length({c})) ELSE left({c}, least(2, length({c}) // 4)) || "
    "repeat('*', length({c}) - 2 * least(2, length({c}) // 4)) || right({c}, least(2, length({c}) // 4)) END"
)


@query(
    "mask_table_customer",
    f"SELECT c_custkey, {_LAST4_X.format(c='c_name')} AS c_name, c_nationkey, 0.5::DOUBLE AS c_acctbal, "
    "NULL::VARCHAR AS c_mktsegment FROM customer",
)
def mask_table_customer(spark, sf):
    return mask_table(table(spark, sf, "customer"), "customer", CUSTOMER_RULES)


@query(
    "mask_table_keys",
    "SELECT k1 AS c_custkey, CAST(k2 AS INTEGER) AS c_nationkey, "
    + s.provider("full_name", "c_name", "c_name")
    + " AS c_name FROM "
    + s.feistel(
        s.feistel("customer", "c_custkey", 1, 9223372036854775806, "int.long", "k1"),
        "c_nationkey", 1, 2147483647, "int.int", "k2",
    ),
)
def mask_table_keys(spark, sf):
    rules = RuleSet(key=KEY, constraint=("c_custkey", "c_nationkey"), masking=("c_name",))
    return mask_table(table(spark, sf, "customer"), "customer", rules).select("c_custkey", "c_nationkey", "c_name")


@query(
    "mask_table_precedence",
    "SELECT c_custkey, NULL::VARCHAR AS c_name, 'AAA' AS c_mktsegment, "
    "CAST(round(abs(CAST(c_acctbal AS DECIMAL(38,10))), 1) AS DOUBLE) AS c_acctbal, "
    "c_nationkey FROM customer",
)
def mask_table_precedence(spark, sf):
    """Null before default before format before the rest, for one column under every rule."""
    both = ("c_name", "c_mktsegment", "c_acctbal")
    rules = RuleSet(
        key=KEY, nullify=("c_name",), defaults={"c_name": "x", "*.c_mktsegment": "AAA"},
        formats={"c_mktsegment": "TEXT:no", "customer.c_acctbal": "NUM:POSITIVE:SCALE(1)"}, masking=both, partial=both,
        constraint=both,
    )
    return mask_table(table(spark, sf, "customer"), "customer", rules)


@query(
    "mask_table_scoping",
    "SELECT s_suppkey, s_name, s_nationkey, s_acctbal, "
    f"{_LAST4_X.format(c='s_name')} AS wild_name FROM supplier",
)
def mask_table_scoping(spark, sf):
    """A rule scoped to another table leaves the column alone, unless wildcards are asked for."""
    df = table(spark, sf, "supplier")
    strict = mask_table(df, "supplier", RuleSet(key=KEY, partial=("vendor.s_name",)))
    wild = RuleSet(key=KEY, partial=("vendor.wild_name",), wildcard=True)
    return mask_table(strict.withColumn("wild_name", F.col("s_name")), "supplier", wild)


_H_PRICE = s.khash("o_totalprice", "o_totalprice.value")


@query(
    "mask_sql_export_orders",
    f"SELECT {_LAST4_STAR.format(c='o_orderpriority')} AS o_orderpriority, "
    f"CAST(CAST(({_H_PRICE} % 999000 + 1000) AS DECIMAL(20,0)) / 100 AS DOUBLE) AS o_totalprice, "
    f"CAST(DATE '2025-01-01' - CAST({s.khash('o_orderdate', 'o_orderdate.value')} % 365 AS INTEGER) AS TIMESTAMP) AS o_orderdate, "
    "CASE WHEN o_orderstatus IS NOT NULL THEN 'Z' END AS o_orderstatus, k AS o_custkey, o_orderkey FROM "
    + s.feistel("orders", "o_custkey", 1, 9223372036854775806, "int.long", "k"),
)
def mask_sql_export_orders(spark, sf):
    rules = RuleSet(
        key=KEY, partial=("orders.o_orderpriority",), masking=("orders.o_totalprice", "o_orderdate"),
        constraint=("orders.o_custkey", "o_orderpriority"), defaults={"orders.o_orderstatus": "Z"},
    )
    return mask_table(table(spark, sf, "orders"), "orders", rules, "sql_export")


_H_SUPP = s.chars("s_acctbal", 2, "digit", "s_acctbal.mark0")


@query(
    "mask_csv_supplier",
    f"SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, {_ENDS.format(c='s_name')} AS s_name, '' AS s_nationkey, "
    f"{_H_SUPP} || '-' || {s.chars('s_acctbal', 2, 'alpha', 's_acctbal.mark2')} AS s_acctbal FROM supplier",
)
def mask_csv_supplier(spark, sf):
    """The file profile: all text, null becomes empty, partial mask keeps both ends, # and X patterns."""
    df = table(spark, sf, "supplier")
    df = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    rules = RuleSet(
        key=KEY, nullify=("supplier.csv.s_nationkey",), formats={"s_acctbal": "##-XX"}, partial_fields={"supplier.csv": ("s_name",)}
    )
    return mask_table(df, "supplier.csv", rules, "csv")


# ---------------------------------------------------------------- nested data

_PROPS = "struct<k:bigint>"


def _event_docs(spark, sf):
    df = table(spark, sf, "events")
    item = F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("uid"))
    return df.select(
        "event_id",
        F.struct("event_type", F.from_json("props", _PROPS).alias("props"), F.col("user_id").cast("string").alias("code")).alias("body"),
        F.array(item, F.struct(F.lit("second").alias("kind"), F.lit(None).cast("long").alias("uid"))).alias("items"),
        F.array("event_type", F.lit("tail")).alias("tags"),
    )


_TAGS = "[event_type, 'tail'] AS tags"


@query(
    "mask_docs_events",
    f"SELECT event_id, {_LAST4_X.format(c='event_type')} AS event_type, 7::BIGINT AS k, "
    "CAST(user_id AS VARCHAR) AS code, "
    f"{s.provider('letters', 'event_type', 'items.kind')} AS kind0, "
    + s.provider("letters", "'second'", "items.kind")
    + " AS kind1, "
    + s.provider("letters", "event_type", "tags")
    + " AS tag0 FROM events",
)
def mask_docs_events(spark, sf):
    rules = RuleSet(
        key=KEY, partial=("events.body.event_type",), masking=("items.kind", "tags"), defaults={"events.body.props.k": "7"}
    )
    out = mask_docs(_event_docs(spark, sf), "events", rules)
    return out.select(
        "event_id", "body.event_type", "body.props.k", "body.code", F.col("items")[0]["kind"].alias("kind0"),
        F.col("items")[1]["kind"].alias("kind1"), F.col("tags")[0].alias("tag0"),
    )


@query(
    "mask_docs_export_events",
    f"SELECT event_id, {_FIXED.format(c='code')} AS code, {_FIXED.format(c='event_type')} AS kind0, 'done' AS event_type FROM "
    "(SELECT *, CAST(user_id AS VARCHAR) || '-' || event_type AS code FROM events)",
)
def mask_docs_export_events(spark, sf):
    """All matching rules in sequence: a later one acts on the result of the earlier."""
    rules = RuleSet(
        key=KEY, partial=("events.body.code", "events.items.kind"), masking=("events.body.event_type",),
        defaults={"events.body.event_type": "done"},
    )
    docs = _event_docs(spark, sf).withColumn("body", F.col("body").withField("code", F.concat("body.code", F.lit("-"), "body.event_type")))
    out = mask_docs(docs, "events", rules, "doc_export")
    return out.select("event_id", "body.code", F.col("items")[0]["kind"].alias("kind0"), "body.event_type")


@query(
    "mask_json_events",
    f"SELECT event_id, {_LAST4_STAR.format(c='event_type')} AS event_type, "
    "least(greatest(k, 10), 50) AS k, [uid * 0 + 5, NULL]::BIGINT[] AS uids, ['N/A', 'N/A'] AS tags FROM ("
    "SELECT event_id, event_type, user_id AS uid, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)",
)
def mask_json_events(spark, sf):
    """Scalars in objects keep their type, every scalar in an array is masked."""
    rules = RuleSet(
        key=KEY, partial=("event_type",), formats={"props.k": "NUM:RANGE(10,50)", "items.uid": "NUM:RANGE(5,5)"},
        defaults={"tags[*]": "N/A"},
    )
    out = mask_json(_event_docs(spark, sf), "events.json", rules)
    fixed = F.transform("items", lambda i: i["uid"])
    return out.select(
        "event_id", "body.event_type", "body.props.k", F.array(fixed[0], F.when(fixed[1].isNull(), fixed[1])).alias("uids"), "tags"
    )


@query(
    "mask_json_export_events",
    f"SELECT event_id, {_FIXED.format(c='event_type')} AS event_type, 'DONE' AS code, "
    f"[{_FIXED.format(c='event_type')}, '****'] AS tags, "
    f"CAST({s.khash('k', 'body.props.k.value')} % 98999 + 1000 AS BIGINT) AS k FROM ("
    "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)",
)
def mask_json_export_events(spark, sf):
    """File-qualified rules and per-file field lists."""
    rules = RuleSet(
        key=KEY, partial=("events.body.event_type", "events.json.tags"), defaults={"body.code": "DONE"},
        masking_fields={"events.json": ("body.props.k",)},
    )
    out = mask_json(_event_docs(spark, sf), "events.json", rules, "json_export")
    return out.select("event_id", "body.event_type", "body.code", "tags", "body.props.k")


@query(
    "mask_array_embeddings",
    "SELECT vec_id, CAST(sum(CAST(round(x, 2) * 100 AS BIGINT)) AS BIGINT) AS total, count(x) AS n, "
    "min(label) AS label FROM (SELECT vec_id, label, least(greatest(abs(CAST(CAST(e AS VARCHAR) AS DECIMAL(38,10))), 0.01), 0.2) AS x "
    "FROM (SELECT vec_id, label, unnest(embedding) AS e FROM embeddings)) GROUP BY vec_id",
)
def mask_array_embeddings(spark, sf):
    """A number format on every element of an array column."""
    df = table(spark, sf, "embeddings")
    rules = RuleSet(key=KEY, formats={"embedding": "NUM:RANGE(0.01,0.2):POSITIVE:SCALE(2)"})
    plain = df.withColumn("embedding", F.transform("embedding", lambda e: F.abs(e.cast("string").cast("decimal(20,10)"))))
    out = mask_array(plain, "embedding", rules)
    cents = F.transform("embedding", lambda e: (e * 100).cast("long"))
    return out.select(
        "vec_id", F.aggregate(cents, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.size("embedding").cast("long").alias("n"), "label",
    )


@query(
    "mask_array_fill_empty",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN ['SEC-1', 'SEC-1'] ELSE ['SEC-1'] END AS codes, "
    "CASE WHEN c_acctbal < 0 THEN [[NULL, NULL], [NULL, NULL]]::VARCHAR[][] ELSE [[NULL]]::VARCHAR[][] END AS nested_names FROM customer",
)
def mask_array_fill_empty(spark, sf):
    """Empty arrays get two values, nested ones two times two."""
    one = F.array("c_name")
    empty = F.filter(one, lambda x: F.lit(False))
    df = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, empty).otherwise(one).alias("codes"),
        F.when(F.col("c_acctbal") < 0, F.filter(F.array(one), lambda x: F.lit(False))).otherwise(F.array(one)).alias("nested_names"),
    )
    rules = RuleSet(key=KEY, formats={"codes": "TEXT:SEC-1"}, nullify=("nested_names",))
    return mask_json(df, "c.json", rules)


# ---------------------------------------------------------------- partial masks


@query("partial_last4_x", f"SELECT p_partkey, {_LAST4_X.format(c='p_name')} AS v FROM part")
def partial_last4_x(spark, sf):
    return table(spark, sf, "part").select("p_partkey", partial.keep_last4(F.col("p_name")).alias("v"))


@query("partial_last4_star", f"SELECT p_partkey, {_LAST4_STAR.format(c='p_type')} AS v FROM part")
def partial_last4_star(spark, sf):
    return table(spark, sf, "part").select("p_partkey", partial.keep_last4(F.col("p_type"), "*", True).alias("v"))


@query("partial_fixed", f"SELECT p_partkey, {_FIXED.format(c='p_brand')} AS v FROM part")
def partial_fixed(spark, sf):
    return table(spark, sf, "part").select("p_partkey", partial.fixed_prefix(F.col("p_brand")).alias("v"))


@query("partial_ends", f"SELECT doc_id, md5({_ENDS.format(c='text')}) AS v FROM documents")
def partial_ends(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(partial.keep_ends(F.col("text"))).alias("v"))


@query(
    "redacted_pages",
    "SELECT page_id, '•••••••• [SFD PROTECTED]' AS url, coalesce(html, 'N/A') AS html FROM pages",
)
def redacted_pages(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", partial.redact(F.col("url"), "SFD").alias("url"), partial.redact(F.col("html"), "NONE").alias("html")
    )


# ---------------------------------------------------------------- formats


@query("cmf_date", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS v FROM orders")
def cmf_date(spark, sf):
    """A text column of ISO dates printed with another pattern."""
    c = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf, "orders").select(
        "o_orderkey", formats.apply_format(c, T.StringType(), "DATE:dd/MM/yyyy", KEY, "d").alias("v")
    )


@query("cmf_date_forms", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS v FROM orders")
def cmf_date_forms(spark, sf):
    """Eight spellings of the same day are all read."""
    forms = [
        "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss.SSS'+02:00'",
        "yyyy/MM/dd", "dd-MM-yyyy", "yyyyMMdd", "dd/MM/yyyy",
    ]
    spelled = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        spelled = F.when(F.col("o_orderkey") % len(forms) == i, F.date_format("o_orderdate", form)).otherwise(spelled)
    rule = formats.parse_date_rule("DATE:yyyyMMdd")
    return table(spark, sf, "orders").select(
        "o_orderkey", formats.format_date(spelled, T.StringType(), rule, KEY, "d", None).alias("v")
    )


@query(
    "cmf_date_shift",
    "SELECT o_orderkey, o_orderdate + to_days(CAST(-3 + "
    f"{s.khash('o_orderdate', 'd.shift')} % 11 AS INTEGER)) AS v FROM orders",
)
def cmf_date_shift(spark, sf):
    """A timestamp column keeps its type; the pattern has no effect."""
    df = table(spark, sf, "orders")
    rule = "DATE:yyyy-MM-dd:SHIFT(-3,7)"
    return df.select("o_orderkey", formats.apply_format(F.col("o_orderdate"), df.schema["o_orderdate"].dataType, rule, KEY, "d").alias("v"))


_HD = s.khash("x", "d.date")


@query(
    "cmf_date_unreadable",
    f"SELECT c_custkey, strftime(make_timestamp({s.digit(_HD, 44)} + 1980, {s.digit(_HD, 12, 44)} + 1, {s.digit(_HD, 28, 528)} + 1, "
    f"{s.digit(_HD, 24, 14784)}, {s.digit(_HD, 60, 354816)}, {s.digit(_HD, 60, 21288960)}), '%Y-%m-%d %I:%M %p') AS v "
    "FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_name END AS x FROM customer)",
)
def cmf_date_unreadable(spark, sf):
    """Null and unreadable dates become a drawn date between 1980 and 2023."""
    c = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name"))
    return table(spark, sf, "customer").select(
        "c_custkey",
        formats.apply_format(c, T.StringType(), "DATE:yyyy-MM-dd hh:mm a", KEY, "d", F.col("c_custkey")).alias("v"),
    )


@query(
    "cmf_text",
    f"SELECT c_custkey, 'ORD-' || {s.chars('c_custkey', 3, 'alpha', 't.text0')} || '-' || "
    f"{s.chars('c_custkey', 4, 'digit', 't.text1')} || '-' || {s.chars('c_custkey', 6, 'alnum', 't.text2')} || '-CONST' AS v FROM customer",
)
def cmf_text(spark, sf):
    rule = "TEXT:ORD-{rand_alpha:3}-{rand_num:4}-{rand:6}-CONST"
    return table(spark, sf, "customer").select(
        "c_custkey", formats.apply_format(F.col("c_custkey"), T.LongType(), rule, KEY, "t").alias("v")
    )


@query(
    "cmf_pattern",
    f"SELECT c_custkey, {s.chars('c_custkey', 2, 'digit', 'p.mark0')} || '-' || {s.chars('c_custkey', 2, 'alpha', 'p.mark2')} AS v FROM customer",
)
def cmf_pattern(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", formats.char_pattern(F.col("c_custkey"), "##-XX", KEY, "p").alias("v"))


@query("cmf_regex", "SELECT count(*) AS n_rows, count(*) AS n_match FROM orders")
def cmf_regex(spark, sf):
    """Every generated text matches the pattern it was made from."""
    regex = r"[A-F]{2}(north|south)-\d{3,5}[xyz]?"
    made = formats.apply_format(F.col("o_orderkey"), T.LongType(), "REGEX:" + regex, KEY, "r")
    df = table(spark, sf, "orders").select(made.alias("v"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("v").rlike(f"^(?:{regex})$")).alias("n_match"))


@query(
    "unique_texts",
    "SELECT count(*) AS n_rows, count(*) AS n_match, count(DISTINCT o_orderkey) AS n_texts FROM orders",
)
def unique_texts(spark, sf):
    """A text of its own for every order, by the number of the order among the texts of a pattern."""
    regex = r"[A-F]{2}(north|south)-\d{3,5}[xyz]?"
    df = table(spark, sf, "orders").select(regextext.unique_text(F.col("o_orderkey"), regex, KEY).alias("v"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("v").rlike(f"^(?:{regex})$")).alias("n_match"),
        F.countDistinct("v").alias("n_texts"),
    )


@query(
    "cmf_number",
    "SELECT l_orderkey, l_linenumber, CAST(round(abs(p), 1) AS DOUBLE) AS a, CAST(-round(abs(p), 0) AS DOUBLE) AS b, "
    "CAST(least(greatest(p, 1000), 5000.5) AS DOUBLE) AS c, CAST(least(greatest(l_linenumber, 3), 5) AS INTEGER) AS d, "
    "CAST(CAST(round(p, 2) AS DECIMAL(38,2)) AS VARCHAR) AS e FROM ("
    "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(28,10)) AS p FROM lineitem)",
)
def cmf_number(spark, sf):
    df = table(spark, sf, "lineitem")
    price, line = F.col("l_extendedprice"), F.col("l_linenumber")

    def made(c, dtype, rule):
        return formats.apply_format(c, dtype, rule, KEY, "n")

    return df.select(
        "l_orderkey", "l_linenumber", made(price, T.DoubleType(), "NUM:POSITIVE:SCALE(1)").alias("a"),
        made(price, T.DoubleType(), "NUM:NEGATIVE:INTEGER").alias("b"),
        made(price, T.DoubleType(), "NUMBER:RANGE(1000,5000.5)").alias("c"),
        made(line, T.IntegerType(), "RANGE(3,5)").alias("d"),
        made(F.concat(F.lit("USD "), price.cast("string")), T.StringType(), "NUM:SCALE(2)").alias("e"),
    )


@query(
    "numeric_variance",
    "SELECT o_orderkey, round(o_totalprice * (1.0::DOUBLE + 0.15::DOUBLE * ("
    f"({s.khash('o_totalprice', 'v.var')} % 2000001 - 1000000)::DOUBLE / 1000000.0::DOUBLE)), 3) AS v FROM orders",
)
def numeric_variance(spark, sf):
    v = formats.numeric_variance(F.col("o_totalprice"), T.DoubleType(), 15, KEY, "v")
    return table(spark, sf, "orders").select("o_orderkey", F.round(v, 3).alias("v"))


# ---------------------------------------------------------------- synthetic

_TEXT_PROVIDERS = [
    "email", "first_name", "last_name", "full_name", "phone", "street", "full_address", "city", "state", "country", "zip",
    "ssn", "company", "skill", "job", "word", "letters",
]


@query(
    "synthetic_texts",
    "SELECT c_custkey, " + ", ".join(f"{s.provider(p, 'c_name', 'syn')} AS {p}" for p in _TEXT_PROVIDERS) + " FROM customer",
)
def synthetic_texts(spark, sf):
    c = F.col("c_name")
    return table(spark, sf, "customer").select(
        "c_custkey", *[synthetic.provide(p, c, KEY, "syn").alias(p) for p in _TEXT_PROVIDERS]
    )


@query(
    "synthetic_cards",
    "SELECT count(*) AS n_rows, count(*) AS n_valid FROM supplier",
)
def synthetic_cards(spark, sf):
    """Card numbers have sixteen digits, a card prefix and a right check digit."""
    card = F.replace(synthetic.provide("card", F.col("s_name"), KEY, "card"), F.lit("-"))
    df = table(spark, sf, "supplier").select(card.alias("n"))
    digits = F.transform(F.split("n", ""), lambda d: d.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    ok = F.col("n").rlike(r"^5[1-5]\d{14}$") & (total % 10 == 0)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_valid"))


@query(
    "synthetic_by_name",
    f"SELECT c_custkey, {s.provider('full_name', 'c_name', 'c_name')} AS c_name, "
    f"left({s.provider('letters', 'c_mktsegment', 'c_mktsegment')}, 6) AS c_mktsegment, "
    f"CAST({s.khash('c_nationkey', 'c_nationkey.value')} % 99999 + 1 AS INTEGER) AS c_nationkey FROM customer",
)
def synthetic_by_name(spark, sf):
    """The provider follows the column name, the text is cut to the declared length."""
    df = table(spark, sf, "customer")
    df = df.withMetadata("c_mktsegment", {"max_length": 6}).select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return mask_table(df, "customer", RuleSet(key=KEY, masking=("c_name", "c_mktsegment", "c_nationkey")))


def _between(x: str, lo: int, hi: int) -> str:
    return f"{s.khash(x, 'n.value')} % {hi - lo} + {lo}"


@query(
    "synthetic_numbers",
    f"SELECT o_orderkey, CAST({_between('o_orderkey', 1, 32767)} AS SMALLINT) AS small, "
    f"CAST({_between('o_orderkey', 1, 100000)} AS INTEGER) AS whole, CAST({_between('o_orderkey', 1, 1000000000)} AS BIGINT) AS big, "
    f"CAST(CAST(({_between('o_orderkey', 1, 999)}) * 100 + {s.khash('o_orderkey', 'n.value')} // 1000000000 % 99 AS DECIMAL(20,0)) / 100 AS DECIMAL(5,2)) AS money, "
    f"{s.khash('o_orderkey', 'n.value')} % 2 = 1 AS flag, {s.hash_uuid('o_orderkey', 'n')} AS id, "
    f"CAST(DATE '2025-01-01' - CAST({s.khash('o_orderkey', 'n.value')} % 10958 + 7305 AS INTEGER) AS DATE) AS birthday FROM orders",
)
def synthetic_numbers(spark, sf):
    c = F.col("o_orderkey")

    def made(dtype, **kw):
        return synthetic.synthetic(c, dtype, "value", KEY, "n", **kw)

    return table(spark, sf, "orders").select(
        "o_orderkey", made(T.ShortType()).alias("small"), made(T.IntegerType()).alias("whole"), made(T.LongType()).alias("big"),
        made(T.DecimalType(5, 2)).alias("money"), made(T.BooleanType()).alias("flag"),
        made(T.StringType(), logical="uuid").alias("id"), made(T.DateType()).alias("birthday"),
    )


# ---------------------------------------------------------------- encryption


@query("fpe_bigint", "SELECT l_orderkey, k FROM " + s.feistel("lineitem", "l_orderkey", 1, 9223372036854775806, "int.long", "k"))
def fpe_bigint(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_orderkey").alias("k"))
    return mask_table(df, "lineitem", RuleSet(key=KEY, constraint=("lineitem.k",)))


@query(
    "fpe_int_smallint_tinyint",
    "SELECT p_partkey, CAST(a AS INTEGER) AS a, CAST(b AS SMALLINT) AS b, CAST(c AS TINYINT) AS c FROM "
    + s.feistel(
        s.feistel(s.feistel("part", "p_size", 1, 2147483647, "int.int", "a"), "p_partkey % 32767", 1, 32767, "int.short", "b"),
        "p_size", 1, 127, "int.byte", "c",
    ),
)
def fpe_int_smallint_tinyint(spark, sf):
    df = table(spark, sf, "part").select(
        "p_partkey", F.col("p_size").alias("a"), (F.col("p_partkey") % 32767).cast("smallint").alias("b"),
        F.col("p_size").cast("tinyint").alias("c"),
    )
    return mask_table(df, "part", RuleSet(key=KEY, constraint=("a", "b", "c")))


@query(
    "fpe_decimal",
    "SELECT c_custkey, CAST((w * 100 + (part + "
    + s.khash("greatest(least(CAST(floor(x) AS BIGINT), 999999999), 1)", "decimal.fraction")
    + " % 100) % 100) / 100.0 AS DECIMAL(12,2)) AS v FROM "
    + s.feistel(
        "(SELECT c_custkey, abs(CAST(c_acctbal AS DECIMAL(12,2))) AS x, CAST((x - floor(x)) * 100 AS BIGINT) AS part FROM customer)",
        "greatest(least(CAST(floor(x) AS BIGINT), 999999999), 1)", 1, 999999999, "decimal.9", "w",
    ),
)
def fpe_decimal(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").cast("decimal(12,2)").alias("v"))
    return mask_table(df, "customer", RuleSet(key=KEY, constraint=("v",)))


@query(
    "fpe_double",
    f"SELECT o_orderkey, w + ({s.khash('o_totalprice', 'fraction')} % 10000)::DOUBLE / 10000.0::DOUBLE AS v FROM "
    + s.feistel("orders", "greatest(CAST(floor(abs(o_totalprice)) AS BIGINT), 1)", 1, 1000000000, "double", "w"),
)
def fpe_double(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return mask_table(df, "orders", RuleSet(key=KEY, constraint=("v",)))


@query(
    "fpe_uuid",
    "SELECT c_custkey, " + s.uuid_from_md5(f"md5(unhex(sha256(c_name || '{s.subkey(KEY, 'uuid')}')))") + " AS v FROM customer",
)
def fpe_uuid(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fpe.fpe(F.col("c_name"), "uuid", KEY).alias("v"))


_TEXT_CHECK = (
    "SELECT count(*) AS n_rows, count(DISTINCT x) AS n_in, count(DISTINCT x) AS n_out, count(*) AS same_length, "
    "count(*) AS in_class, count(DISTINCT x) AS n_pairs FROM ({source})"
)


def _text_check(df, x, pattern):
    pairs = df.select(x.alias("x")).withColumn("y", fpe.fpe_text(F.col("x"), KEY))
    # distinct counts over digests, so that whole texts are not shuffled
    rows = pairs.select(
        F.sha2("x", 256).alias("x"), F.sha2("y", 256).alias("y"), (F.length("x") == F.length("y")).alias("same"),
        F.col("y").rlike(pattern).alias("fits"),
    )
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("x").alias("n_in"), F.countDistinct("y").alias("n_out"),
        F.count_if("same").alias("same_length"), F.count_if("fits").alias("in_class"), F.countDistinct("x", "y").alias("n_pairs"),
    )


@query("fpe_digits", _TEXT_CHECK.format(source="SELECT lpad(CAST(o_orderkey AS VARCHAR), 18, '0') AS x FROM orders"))
def fpe_digits(spark, sf):
    return _text_check(table(spark, sf, "orders"), F.lpad(F.col("o_orderkey").cast("string"), 18, "0"), r"^\d{18}$")


@query("fpe_text_base36", _TEXT_CHECK.format(source="SELECT lpad(to_base(o_orderkey, 36), 9, '0') AS x FROM orders"))
def fpe_text_base36(spark, sf):
    x = F.concat(F.lit("A"), F.lpad(F.conv(F.col("o_orderkey").cast("string"), 10, 36), 8, "0"))
    return _text_check(table(spark, sf, "orders"), x, r"^[0-9A-Z]{9}$")


@query("fpe_text_long", _TEXT_CHECK.format(source="SELECT c_name AS x FROM customer"))
def fpe_text_long(spark, sf):
    return _text_check(table(spark, sf, "customer"), F.col("c_name"), r"^[ -~]{18}$")


@query("fpe_text_documents", _TEXT_CHECK.format(source="SELECT text AS x FROM documents"))
def fpe_text_documents(spark, sf):
    """Whole texts in several scripts: length kept, nothing merged."""
    return _text_check(table(spark, sf, "documents"), F.col("text"), r"(?s)^.*$")


@query("fpe_text_changes", "SELECT count(*) AS n_changed FROM documents WHERE length(text) > 1")
def fpe_text_changes(spark, sf):
    """No text comes out as it went in (one character may)."""
    df = table(spark, sf, "documents").filter(F.length("text") > 1)
    return df.agg(F.count_if(fpe.fpe_text(F.col("text"), KEY) != F.col("text")).alias("n_changed"))


@query("fpe_bool", "SELECT count(DISTINCT (o_orderstatus = 'F')) AS n_out, count(*) AS n_rows FROM orders")
def fpe_bool(spark, sf):
    flag = fpe.fpe_bool(F.col("o_orderstatus") == "F", KEY)
    return table(spark, sf, "orders").agg(F.countDistinct(flag).alias("n_out"), F.count(F.lit(1)).alias("n_rows"))


@query("hash_token", f"SELECT c_custkey, 'ENC_' || substr(sha256('{s.subkey(KEY, 'token')}' || c_name), 1, 16) AS v FROM customer")
def hash_token(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", fpe.hash_token(F.col("c_name"), KEY).alias("v"))


@query("token_roundtrip", "SELECT conv_id, turn, text AS v, TRUE AS hidden, conv_id * 1000 - turn AS n FROM conversations")
def token_roundtrip(spark, sf):
    df = table(spark, sf, "conversations").withColumn("n", F.col("conv_id") * 1000 - F.col("turn"))
    made = df.select(
        "conv_id", "turn", "text", tokens.tokenize(F.col("text"), KEY, "salt").alias("token"),
        tokens.tokenize_number(F.col("n"), KEY, "s").alias("number"),
    )
    return made.select(
        "conv_id", "turn", tokens.detokenize(F.col("token"), KEY, "salt").alias("v"),
        (F.col("token") != F.col("text")).alias("hidden"), tokens.detokenize_number(F.col("number"), KEY, "s").alias("n"),
    )


@query(
    "sql_functions",
    f"SELECT c_custkey, k1 AS k, CAST(k2 AS INTEGER) AS n, {_LAST4_X.format(c='c_name')} AS l, "
    f"'ENC_' || substr(sha256('{s.subkey(KEY, 'token')}' || c_mktsegment), 1, 16) AS t FROM "
    + s.feistel(
        s.feistel("customer", "c_custkey", 1, 9223372036854775806, "int.long", "k1"),
        "c_nationkey", 1, 2147483647, "int.int", "k2",
    ),
)
def sql_functions(spark, sf):
    """The same functions called from SQL text."""
    register_functions(spark, KEY)
    table(spark, sf, "customer").createOrReplaceTempView("veil_customer")
    return spark.sql(
        "SELECT c_custkey, mask_bigint(c_custkey) AS k, mask_int(c_nationkey) AS n, mask_last4(c_name) AS l, "
        "mask_token(c_mktsegment) AS t FROM veil_customer"
    )


# What each profile takes for a column name; stated here on its own, so that the tables of the library are checked.
_BY_PROFILE = {
    "table": {"work_email": "email", "first_name": "first_name", "lastname": "last_name", "nick_name": "full_name", "phone": "phone", "home_address": "full_address", "zip_code": "zip", "ssn": "ssn", "remark": "letters"},
    "sql_export": {"work_email": "email", "firstname": "first_name", "nick_name": "full_name", "home_address": "street", "district": "state", "postal": "zip", "country": "country", "remark": "word"},
    "json": {"user_name": "full_name", "work_email": "email", "address": "full_address", "company": "company", "skills": "skill", "job_title": "job", "city": "city", "remark": "word"},
    "json_export": {"username": "full_name", "mobile": "phone", "street": "full_address", "postal": "zip", "company": "company", "remark": "word"},
    "csv": {"work_email": "email", "last_name": "full_name", "address": "street", "company": "company", "zip": "zip", "remark": "word"},
}


@query(
    "synthetic_by_profile",
    "SELECT c_custkey, " + ", ".join(f"{s.provider(p, 'c_name', 'profile')} AS {f}_{n}" for f, names in _BY_PROFILE.items() for n, p in names.items()) + " FROM customer",
)
def synthetic_by_profile(spark, sf):
    """The replacement each profile chooses by a column's name."""
    return table(spark, sf, "customer").select("c_custkey", *[
        synthetic.provide(synthetic.provider_for(n, f), F.col("c_name"), KEY, "profile").alias(f"{f}_{n}") for f, names in _BY_PROFILE.items() for n in names
    ])


@query("fpe_text_single", _TEXT_CHECK.format(source="SELECT o_orderstatus AS x FROM orders"))
def fpe_text_single(spark, sf):
    return _text_check(table(spark, sf, "orders"), F.col("o_orderstatus"), r"^[A-Z]$")


@query("fpe_text_lower", _TEXT_CHECK.format(source="SELECT lower(c_mktsegment) AS x FROM customer"))
def fpe_text_lower(spark, sf):
    return _text_check(table(spark, sf, "customer"), F.lower("c_mktsegment"), r"^[0-9a-z]+$")


@query("fpe_text_letters", _TEXT_CHECK.format(source="SELECT 'x' || c_mktsegment AS x FROM customer"))
def fpe_text_letters(spark, sf):
    return _text_check(table(spark, sf, "customer"), F.concat(F.lit("x"), "c_mktsegment"), r"^[A-Za-z]+$")


@query("fpe_text_hex", _TEXT_CHECK.format(source="SELECT left(md5(CAST(o_orderkey AS VARCHAR)), 24) AS x FROM orders"))
def fpe_text_hex(spark, sf):
    return _text_check(table(spark, sf, "orders"), F.left(F.md5(F.col("o_orderkey").cast("string")), F.lit(24)), r"^[0-9a-f]{24}$")
