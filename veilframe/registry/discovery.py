"""Queries over catalogs, classification, preview and key checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilframe.operators import catalog, classify, integrity, preview, sqldump
from veilframe.plans import jobs
from veilframe.plans.compiler import mask_table
from veilframe.plans.rules import ForeignKey, RuleSet, select_targets, virtual_relationships
from veilframe.registry import sqltext as s
from veilframe.registry.base import TABLES, query, table, tables
from veilframe.registry.sqltext import KEY
from veilframe.session import fresh_path, stage
from veilframe.sources import writers
from veilframe.sources.writers import map_type_name

_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in TABLES)


@query("row_counts", f"{_COUNTS} UNION ALL SELECT '*', CAST(sum(n_rows) AS BIGINT) FROM ({_COUNTS})")
def row_counts(spark, sf):
    return catalog.row_counts(tables(spark, sf), total=True)


_SPARK_TYPES = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")],
}


def _profile_sql() -> str:
    parts = []
    for t, columns in _SPARK_TYPES.items():
        for i, (c, kind) in enumerate(columns, 1):
            longest = f"max(length({c}))" if kind == "string" else "NULL"
            parts.append(
                f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{kind}' AS type, {i} AS pos, count(*) AS n_rows, "
                f"count(*) - count({c}) AS n_null, CAST({longest} AS INTEGER) AS max_length FROM {t}"
            )
    return " UNION ALL ".join(parts)


@query("column_profile", _profile_sql())
def column_profile(spark, sf):
    return catalog.column_profile(tables(spark, sf, _SPARK_TYPES))


@query(
    "created_column_types",
    "SELECT \"column\", CASE type WHEN 'bigint' THEN 'BIGINT' WHEN 'int' THEN 'INTEGER' WHEN 'double' THEN 'DOUBLE PRECISION' "
    "WHEN 'timestamp_ntz' THEN 'TIMESTAMP' ELSE 'VARCHAR(' || max_length || ')' END AS ddl FROM (" + _profile_sql() + ")",
)
def created_column_types(spark, sf):
    """Column types for the created tables, text sized by the widest value found."""
    names = {"bigint": "bigint", "int": "integer", "double": "double precision", "timestamp_ntz": "timestamp"}
    ddl = F.lit(None).cast("string")
    for spark_name, sql_name in names.items():
        ddl = F.when(F.col("type") == spark_name, map_type_name(sql_name)).otherwise(ddl)
    text = map_type_name("varchar", 0).replace("TEXT", "VARCHAR(")
    sized = F.concat(F.lit(text), F.col("max_length").cast("string"), F.lit(")"))
    return catalog.column_profile(tables(spark, sf, _SPARK_TYPES)).select("column", F.coalesce(ddl, sized).alias("ddl"))


@query(
    "profile_dataset",
    "SELECT 'customer' AS \"table\", count(*) AS n_rows, 'c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment' AS columns, "
    "5 AS n_columns, 'c_custkey' AS key_columns FROM customer UNION ALL "
    "SELECT 'region', count(*), 'r_regionkey, r_name', 2, '' FROM region",
)
def profile_dataset(spark, sf):
    return catalog.profile_dataset(tables(spark, sf, ["customer", "region"]), {"customer": ["c_custkey"]})


@query("sample_rows", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def sample_rows(spark, sf):
    return catalog.sample_rows(table(spark, sf, "orders"), 50, "o_orderkey")


@query(
    "json_field_paths",
    "SELECT path, count(*) AS n_rows FROM (SELECT unnest(json_keys(props)) AS path FROM events) GROUP BY path",
)
def json_field_paths(spark, sf):
    return catalog.json_field_counts(table(spark, sf, "events"), "props")


@query(
    "json_leaf_paths",
    "SELECT 'event.kind' AS path, count(*) AS n_values FROM events UNION ALL SELECT 'event.id', count(*) FROM events UNION ALL "
    "SELECT 'items.uid', CAST(sum(event_id % 3) AS BIGINT) FROM events UNION ALL "
    "SELECT 'items.tags', CAST(sum(2 * (event_id % 3)) AS BIGINT) FROM events",
)
def json_leaf_paths(spark, sf):
    """Values below objects and arrays at any depth, counted by path."""
    item = F.struct(F.col("user_id").alias("uid"), F.array(F.lit("a"), F.col("event_type")).alias("tags"))
    doc = F.struct(
        F.struct(F.col("event_type").alias("kind"), F.col("event_id").alias("id")).alias("event"),
        F.array_repeat(item, (F.col("event_id") % 3).cast("int")).alias("items"),
    )
    return catalog.json_leaf_counts(table(spark, sf, "events").select(F.to_json(doc).alias("doc")), "doc")


@query(
    "discovered_tables",
    "SELECT 'customer' AS name, count(*) AS n_rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders",
)
def discovered_tables(spark, sf):
    """Tables of a database of the session's catalog, without the job runner's, and their rows."""
    database = f"veilframe_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{fresh_path(spark, 'database')}'")
    try:
        for name, source in (("customer", "customer"), ("orders", "orders"), ("BATCH_step", "orders")):
            spark.sql(f"CREATE VIEW {database}.{name} AS SELECT * FROM parquet.`{sf}/{source}.parquet`")
        names = catalog.discover_tables(spark, database=database)
        out = None
        for name in names:
            one = spark.table(f"{database}.{name}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
            out = one if out is None else out.unionByName(one)
        return stage(out, "tables")
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


@query("prepared_table", "SELECT c_custkey, c_name FROM customer")
def prepared_table(spark, sf):
    """A target that is dropped and created again with the schema before it is loaded."""
    df, path = table(spark, sf, "customer").select("c_custkey", "c_name"), fresh_path(spark, "prepared")
    df.select(F.lit("old").alias("other")).write.parquet(path)
    writers.prepare_table(spark, df.schema, path)
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path)


@query(
    "document_field_paths",
    "SELECT p AS path, n FROM (SELECT unnest(['event', 'event.kind', 'event.props', 'event.props.k', 'items', 'items[].uid']) AS p), "
    "(SELECT count(*) AS n FROM events)",
)
def document_field_paths(spark, sf):
    """Paths found from the agreed schema of all documents, containers included."""
    docs = table(spark, sf, "events").select(
        F.to_json(
            F.struct(
                F.struct(F.col("event_type").alias("kind"), F.from_json("props", "k bigint").alias("props")).alias("event"),
                F.array(F.struct(F.col("user_id").alias("uid"))).alias("items"),
            )
        ).alias("doc")
    )
    paths = catalog.field_paths(catalog.json_schema(docs, "doc"), containers=True)
    return docs.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.lit(p) for p in paths])).alias("path"), "n")


# ---------------------------------------------------------------- key catalogs read from data


def _catalog_views(spark, sf):
    """Catalog views with one constraint per supplier: its line items name columns, its parts the referenced ones."""
    li = table(spark, sf, "lineitem")
    name = F.concat(F.lit("c_"), F.col("l_suppkey").cast("string"))
    kinds = F.when(F.col("l_suppkey") % 3 == 0, "FOREIGN KEY").when(F.col("l_suppkey") % 3 == 1, "PRIMARY KEY").otherwise("CHECK")
    constraints = li.select(
        name.alias("constraint_name"), kinds.alias("constraint_type"), F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("table_name")
    ).distinct()
    usage = li.select(
        name.alias("constraint_name"), F.concat(F.lit("col"), F.col("l_linenumber").cast("string")).alias("column_name"),
        F.col("l_linenumber").alias("ordinal_position"),
    )
    refs = li.filter("l_suppkey % 3 = 0").select(name.alias("constraint_name"), F.lit("parent").alias("table_name"), F.lower("l_returnflag").alias("column_name"))
    return constraints, usage, refs


_CONSTRAINT_SQL = (
    "SELECT 'c_' || l_suppkey AS constraint_name, CASE l_suppkey % 3 WHEN 0 THEN 'FOREIGN KEY' ELSE 'PRIMARY KEY' END AS constraint_type, "
    "'t' || l_suppkey AS table_name, string_agg(DISTINCT 'col' || l_linenumber, ', ' ORDER BY 'col' || l_linenumber) AS column_name, "
    "CASE WHEN l_suppkey % 3 = 0 THEN 'parent' END AS foreign_table, "
    "CASE WHEN l_suppkey % 3 = 0 THEN string_agg(DISTINCT lower(l_returnflag), ', ' ORDER BY lower(l_returnflag)) END AS foreign_column "
    "FROM lineitem WHERE l_suppkey % 3 <> 2 GROUP BY l_suppkey"
)


@query("discovered_constraints", _CONSTRAINT_SQL)
def discovered_constraints(spark, sf):
    return catalog.discover_constraints(*_catalog_views(spark, sf))


@query(
    "discovered_foreign_keys",
    "SELECT DISTINCT 'c_' || a.l_suppkey AS constraint_name, 't' || a.l_suppkey AS table_name, 'col' || a.l_linenumber AS column_name, "
    "'parent' AS foreign_table, lower(b.l_returnflag) AS foreign_column, a.l_linenumber AS ordinal_position "
    "FROM (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) b "
    "ON a.l_suppkey = b.l_suppkey WHERE a.l_suppkey % 3 = 0 UNION ALL "
    "SELECT NULL, 'orders', 'o_custkey', 'customer', 'c_custkey', 1",
)
def discovered_foreign_keys(spark, sf):
    """Catalog keys and one relation declared by the user."""
    constraints, usage, refs = _catalog_views(spark, sf)
    declared = spark.createDataFrame(
        [("orders", "o_custkey", "customer", "c_custkey", 1)],
        "table_name string, column_name string, foreign_table string, foreign_column string, ordinal_position int",
    )
    return catalog.discover_foreign_keys(constraints, usage.distinct(), refs.distinct(), declared)


@query(
    "constraint_ddl",
    "SELECT table_name AS \"table\", constraint_name AS name, 'ALTER TABLE ' || table_name || ' ADD CONSTRAINT ' || constraint_name || ' ' || "
    "constraint_type || ' (' || column_name || ')' || CASE WHEN constraint_type = 'FOREIGN KEY' THEN ' REFERENCES ' || foreign_table || ' (' || foreign_column || ')' "
    f"ELSE '' END || ';' AS ddl FROM ({_CONSTRAINT_SQL})",
)
def constraint_ddl(spark, sf):
    found = catalog.discover_constraints(*_catalog_views(spark, sf))
    rows = found.select(
        F.col("constraint_name").alias("name"), F.col("constraint_type").alias("type"), F.col("table_name").alias("table"),
        F.split("column_name", ", ").alias("cols"), F.col("foreign_table").alias("ref_table"), F.split("foreign_column", ", ").alias("ref_cols"),
    )
    return sqldump.constraint_ddl(rows)


# ---------------------------------------------------------------- classification

# column catalogs read from part names: plural tables, junction tables, key and value columns
_NAMES_SQL = (
    "(SELECT DISTINCT x.t AS \"table\", x.c AS \"column\" FROM (SELECT unnest(["
    "{{'t': b || 's', 'c': b || '_id'}}, {{'t': b || 's', 'c': a || '_id'}}, {{'t': b || 's', 'c': a || '_name'}}, "
    "{{'t': a || '_' || b, 'c': a || '_id'}}, {{'t': a || '_' || b, 'c': b || '_id'}}, {{'t': a || '_' || b, 'c': lower(p_type) || '_price'}}, "
    "{{'t': lower(p_type), 'c': 'pk_' || lower(p_type)}}, {{'t': lower(p_type), 'c': ['email', 'ssn', 'cvv', 'dob', 'user_name', 'uuid', 'tenant_id', 'notes'][p_partkey % 8 + 1]}}"
    "]) AS x FROM (SELECT *, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)))"
).replace("{{", "{").replace("}}", "}")


def _name_catalog(spark, sf):
    part = table(spark, sf, "part").withColumns(
        {"a": F.split_part("p_name", F.lit(" "), F.lit(1)), "b": F.split_part("p_name", F.lit(" "), F.lit(2)), "k": F.lower("p_type")}
    )
    odd = ["email", "ssn", "cvv", "dob", "user_name", "uuid", "tenant_id", "notes"]
    value = F.get(F.array(*[F.lit(o) for o in odd]), (F.col("p_partkey") % 8).cast("int"))
    plural, junction = F.concat("b", F.lit("s")), F.concat("a", F.lit("_"), "b")

    def pair(t, c):
        return F.struct(t.alias("table"), c.alias("column"))

    a_id, b_id = F.concat("a", F.lit("_id")), F.concat("b", F.lit("_id"))
    pairs = [
        pair(plural, b_id), pair(plural, a_id), pair(plural, F.concat("a", F.lit("_name"))), pair(junction, a_id), pair(junction, b_id),
        pair(junction, F.concat("k", F.lit("_price"))), pair(F.col("k"), F.concat(F.lit("pk_"), "k")), pair(F.col("k"), value),
    ]
    return part.select(F.explode(F.array(*pairs)).alias("x")).select("x.table", "x.column").distinct()


def _singular_sql(x: str) -> str:
    return (
        f"CASE WHEN length({x}) <= 3 THEN {x} WHEN {x} LIKE '%ies' THEN left({x}, length({x}) - 3) || 'y' "
        f"WHEN regexp_matches({x}, '(ses|xes|shes|ches)$') THEN left({x}, length({x}) - 2) "
        f"WHEN {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN left({x}, length({x}) - 1) ELSE {x} END"
    )


def _classify_sql() -> str:
    rules = " ".join(f"WHEN regexp_full_match(c, '{pattern}', 'i') THEN {i}" for i, (_, _, _, _, pattern, _) in enumerate(classify.NAME_RULES))
    columns = [s.words([r[k] for r in classify.NAME_RULES]) for k in (0, 1, 2, 5)]
    scores = "[" + ", ".join(f"{r[3]}::DOUBLE" for r in classify.NAME_RULES) + "]"
    hints = " OR ".join(f"contains(t, '{h}')" for h in classify.JUNCTION_HINTS)
    return f"""
WITH n AS (SELECT *, lower(trim("table")) AS t, lower(trim("column")) AS c FROM {_NAMES_SQL}),
i AS (SELECT *, count(*) FILTER (WHERE c LIKE '%\\_id' ESCAPE '\\') OVER (PARTITION BY "table") AS ids, {_singular_sql('t')} AS sg FROM n),
k AS (SELECT *, c IN ('id', t || '_id', t || 'id', 'pk_' || t, sg || '_id', sg || 'id', 'pk_' || sg) AS pk,
  CASE WHEN c LIKE '%\\_id' ESCAPE '\\' OR c LIKE '%\\_fk' ESCAPE '\\' THEN left(c, length(c) - 3) WHEN c LIKE 'fk\\_%' ESCAPE '\\' THEN substr(c, 4) END AS cand FROM i),
f AS (SELECT *, NOT pk AND (c LIKE '%\\_id' ESCAPE '\\' OR c LIKE '%\\_fk' ESCAPE '\\' OR c LIKE 'fk\\_%' ESCAPE '\\') AS fk FROM k),
tn AS (SELECT DISTINCT "table" AS tgt, lower(trim("table")) AS t FROM n),
sp AS (SELECT tgt, t AS cand, 0 AS r FROM tn UNION ALL SELECT tgt, {_singular_sql('t')}, 1 FROM tn
  UNION ALL SELECT tgt, left(t, length(t) - 1), 2 FROM tn WHERE t LIKE '%s'),
lk AS (SELECT cand, arg_min(tgt, (r, tgt)) AS tgt FROM sp GROUP BY cand),
m AS (SELECT f.*, coalesce(lk.tgt, nullif(f.cand, '')) AS target,
  CASE WHEN regexp_full_match(c, '{classify.TENANT_NAMES}') OR (contains(t, '_') AND ({hints} OR ids >= 2) AND fk) THEN 'TABLE_MAPPING'
    WHEN pk THEN 'PRIMARY_KEY' WHEN fk THEN 'FOREIGN_KEY'
    WHEN c IN ({', '.join(s.quote(u) for u in classify.UNIQUE_NAMES)}) THEN 'UNIQUE_KEY' END AS kind,
  CASE {rules} END AS rule_no FROM f LEFT JOIN lk ON f.cand = lk.cand)
SELECT "table", "column", coalesce(kind, {columns[0]}[rule_no + 1]) AS category,
  CASE WHEN kind IS NOT NULL THEN 'FPH' ELSE {columns[1]}[rule_no + 1] END AS rule,
  CASE WHEN kind IS NOT NULL THEN 'encrypt' ELSE {columns[2]}[rule_no + 1] END AS provider,
  CASE kind WHEN 'TABLE_MAPPING' THEN 0.96::DOUBLE WHEN 'PRIMARY_KEY' THEN 0.99 WHEN 'FOREIGN_KEY' THEN 0.95 WHEN 'UNIQUE_KEY' THEN 0.92
    ELSE {scores}[rule_no + 1] END AS confidence,
  CASE WHEN kind IS NOT NULL THEN kind WHEN c IN ('username', 'user_name') THEN 'UNIQUE_KEY' END AS key_type,
  CASE WHEN kind IN ('TABLE_MAPPING', 'FOREIGN_KEY') AND c <> 'parent_id' THEN target END AS target_table,
  CASE WHEN kind IN ('TABLE_MAPPING', 'FOREIGN_KEY') THEN 'id' END AS target_column,
  CASE kind WHEN 'TABLE_MAPPING' THEN 'mapping column' WHEN 'PRIMARY_KEY' THEN 'primary key' WHEN 'FOREIGN_KEY' THEN 'foreign key'
    WHEN 'UNIQUE_KEY' THEN 'unique identifier' ELSE {columns[3]}[rule_no + 1] END AS reason
FROM m WHERE kind IS NOT NULL OR rule_no IS NOT NULL"""


@query("classify_columns", _classify_sql())
def classify_columns(spark, sf):
    return classify.classify_columns(_name_catalog(spark, sf))


_SUMMARY_CLASSES = f"({_classify_sql()})"


@query(
    "classification_summary",
    "SELECT g AS \"group\", count(*) AS n_columns FROM (SELECT unnest(['rule:' || rule, 'key:' || key_type, 'total:columns', "
    f"CASE WHEN key_type IS NOT NULL THEN 'total:keys' END]) AS g FROM {_SUMMARY_CLASSES}) WHERE g IS NOT NULL GROUP BY g",
)
def classification_summary(spark, sf):
    return classify.classification_summary(classify.classify_columns(_name_catalog(spark, sf)), lists=False)


@query(
    "classification_lists",
    "WITH g AS (SELECT g, f FROM (SELECT unnest(['rule:' || rule, 'key:' || key_type, 'total:columns', CASE WHEN key_type IS NOT NULL THEN 'total:keys' END]) AS g, "
    f"\"table\" || '.' || \"column\" AS f FROM {_SUMMARY_CLASSES}) WHERE g IS NOT NULL), n AS (SELECT g, count(*) AS n FROM g GROUP BY g), "
    "p AS (SELECT g, f, (row_number() OVER (PARTITION BY g ORDER BY f) - 1) // 50 AS chunk FROM (SELECT DISTINCT g, f FROM g WHERE g NOT LIKE 'total:%')), "
    "c AS (SELECT g, chunk, string_agg(f, ', ' ORDER BY f) AS columns FROM p GROUP BY g, chunk) "
    "SELECT n.g AS \"group\", CAST(coalesce(chunk, 0) AS INTEGER) AS chunk, n AS n_columns, coalesce(columns, '') AS columns FROM n LEFT JOIN c USING (g)",
)
def classification_lists(spark, sf):
    """The names of each group, fifty to a row."""
    return classify.classification_summary(classify.classify_columns(_name_catalog(spark, sf)), names=50)


@query(
    "sensitive_columns_by_table",
    "SELECT \"table\", count(*) AS n_columns, CAST(max(n_rows) AS BIGINT) AS n_rows FROM (SELECT * FROM (VALUES ('customer', 'c_name', 'SFD')) v(\"table\", \"column\", rule)) "
    "JOIN (SELECT count(*) AS n_rows FROM customer) ON true GROUP BY \"table\" UNION ALL "
    "SELECT 'events', 2, count(*) FROM events",
)
def sensitive_columns_by_table(spark, sf):
    """Classified columns of the given tables with the rows they put at risk."""
    profile = catalog.column_profile(tables(spark, sf, _SPARK_TYPES))
    found = classify.classify_columns(profile.select("table", "column"))
    return found.join(profile, ["table", "column"]).groupBy("table").agg(
        F.count(F.lit(1)).alias("n_columns"), F.max("n_rows").alias("n_rows")
    )


@query("singular_names", f"SELECT p_partkey, {_singular_sql('x')} AS v FROM (SELECT p_partkey, split_part(p_name, ' ', 2) || ['s', 'es', 'ies', 'ss', 'sses', 'ches'][p_partkey % 6 + 1] AS x FROM part)")
def singular_names(spark, sf):
    ends = F.get(F.array(*[F.lit(e) for e in ("s", "es", "ies", "ss", "sses", "ches")]), (F.col("p_partkey") % 6).cast("int"))
    name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), ends)
    return table(spark, sf, "part").select("p_partkey", classify.singular(name).alias("v"))


@query(
    "model_labels",
    "SELECT c_custkey, 'customer.' || lower(c_mktsegment) AS name, 'customer' AS \"table\", lower(c_mktsegment) AS \"column\", 'EMAIL' AS category, "
    "'PMD' AS rule, 'full_name' AS provider, 0.95::DOUBLE AS confidence, 'labelled by the model' AS reason, NULL::VARCHAR AS key_type, "
    "NULL::VARCHAR AS target_table, NULL::VARCHAR AS target_column FROM customer WHERE c_custkey % 3 <> 2 UNION ALL "
    "SELECT c_custkey, 'note', '', 'note', 'PII', 'SFD', 'full_name', 0.5, 'labelled by the model', NULL, NULL, NULL FROM customer WHERE c_custkey % 3 = 1",
)
def model_labels(spark, sf):
    """Fenced, wrapped and bare replies; a reply that is not JSON gives nothing."""
    label = F.concat(F.lit('{"customer.'), F.lower("c_mktsegment"), F.lit('": {"category": "EMAIL", "ruleType": "pmd"}'))
    fenced = F.concat(F.lit("```json\n"), F.concat(F.lit('{"detectedEntities": '), label, F.lit("}}")), F.lit("\n```"))
    bare = F.concat(label, F.lit(', "note": {"confidence": 0.5}}'))
    k = F.col("c_custkey") % 3
    reply = F.when(k == 0, fenced).when(k == 1, bare).otherwise("no entities found")
    return classify.parse_model_labels(table(spark, sf, "customer").select("c_custkey", reply.alias("reply")), "reply")


# ---------------------------------------------------------------- preview

_PREVIEW_RULES = RuleSet(key=KEY, partial=("customer.c_mktsegment",), nullify=("c_acctbal",))


@query(
    "preview_before",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, '•••••••• [SFD PROTECTED]' AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
    "'•••••••• [NULL PROTECTED]' AS c_acctbal, '•••••••• [PMD PROTECTED]' AS c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 5",
)
def preview_before(spark, sf):
    """Protected values never show; an unruled name column is labelled by its name."""
    return preview.preview(table(spark, sf, "customer"), "customer", _PREVIEW_RULES, 5, key="c_custkey").before


@query(
    "preview_after",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, 'NULL' AS c_acctbal, "
    "repeat('X', length(c_mktsegment) - 4) || right(c_mktsegment, 4) AS c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 10",
)
def preview_after(spark, sf):
    return preview.preview(table(spark, sf, "customer"), "customer", _PREVIEW_RULES, 99, key="c_custkey").after


@query(
    "stand_in_values",
    "SELECT c_custkey, CAST(c_custkey + 1000 AS INTEGER) AS order_id, 'user' || c_custkey || '@example.com' AS email, "
    "'User ' || c_custkey AS nick_name, c_custkey * 250 + 5000.0::DOUBLE AS salary, TRUE AS is_open, 'Sample remark ' || c_custkey AS remark, "
    "strftime(make_date(CAST(1985 + c_custkey % 15 AS INTEGER), CAST(c_custkey % 12 + 1 AS INTEGER), CAST(c_custkey % 28 + 1 AS INTEGER)), '%Y-%m-%d') AS dob FROM customer",
)
def stand_in_values(spark, sf):
    names = ["order_id", "email", "nick_name", "salary", "is_open", "remark", "dob"]
    return table(spark, sf, "customer").select("c_custkey", *[preview.stand_in_value(n, F.col("c_custkey"))[0].alias(n) for n in names])


# ---------------------------------------------------------------- checks

_KEYS = [
    ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
]


@query(
    "unique_violations",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def unique_violations(spark, sf):
    return integrity.check_unique(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "primary_key_violations",
    "SELECT k, count(*) AS n_rows FROM (SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey // 2 END AS k FROM customer) GROUP BY k HAVING count(*) > 1 OR k IS NULL",
)
def primary_key_violations(spark, sf):
    key = F.when(F.col("c_custkey") % 50 != 0, F.floor(F.col("c_custkey") / 2))
    return integrity.check_unique(table(spark, sf, "customer").select(key.alias("k")), ["k"], primary=True)


@query(
    "orphans",
    "SELECT o_custkey, count(*) AS n_rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY 1",
)
def orphans(spark, sf):
    parents = table(spark, sf, "customer").filter("c_acctbal > 0")
    return integrity.check_foreign_key(table(spark, sf, "orders"), ["o_custkey"], parents, ["c_custkey"])


@query(
    "not_null_violations",
    "SELECT 'value' AS \"column\", count(*) AS n_null FROM events WHERE value > 50 HAVING count(*) > 0",
)
def not_null_violations(spark, sf):
    df = table(spark, sf, "events").withColumn("value", F.when(~(F.col("value") > 50), F.col("value")))
    return integrity.check_not_null(df, ["event_id", "event_type", "value"])


@query(
    "injective_keys",
    "SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS distinct_in, count(DISTINCT o_custkey) AS distinct_out FROM orders",
)
def injective_keys(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", F.col("o_custkey").alias("masked"))
    masked = mask_table(df, "orders", RuleSet(key=KEY, constraint=("masked",)))
    return integrity.check_injective(masked, "o_custkey", "masked")


@query(
    "whole_keys_distinct",
    "SELECT count(DISTINCT l_orderkey * 40009 - 3000000) AS distinct_in, count(DISTINCT l_orderkey * 40009 - 3000000) AS distinct_out FROM lineitem",
)
def whole_keys_distinct(spark, sf):
    """Negative keys, zero and keys beyond an int parent stay apart in a bigint child."""
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 40_009 - 3_000_000).alias("before"))
    masked = mask_table(rows.withColumn("k", F.col("before")), "lineitem", RuleSet(key=KEY, constraint=("lineitem.k",)), "table", {"lineitem.k": "int"})
    return integrity.check_injective(masked, "before", "k")


@query(
    "decimal_keys_distinct",
    "SELECT count(DISTINCT v) AS distinct_in, count(DISTINCT v) AS distinct_out FROM "
    "(SELECT CAST(c_acctbal AS DECIMAL(12,2)) AS v FROM customer UNION ALL SELECT -CAST(c_acctbal AS DECIMAL(12,2)) FROM customer)",
)
def decimal_keys_distinct(spark, sf):
    """Amounts of both signs stay apart."""
    amount = F.col("c_acctbal").cast("decimal(12,2)")
    rows = table(spark, sf, "customer").select(F.explode(F.array(amount, (-amount).cast("decimal(12,2)"))).alias("before"))
    masked = mask_table(rows.withColumn("k", F.col("before")), "customer", RuleSet(key=KEY, constraint=("customer.k",)), "table", {"customer.k": "decimal"})
    return integrity.check_injective(masked, "before", "k")


@query(
    "outside_domain",
    "SELECT o_custkey, count(*) AS n_rows FROM orders WHERE o_custkey < 1 OR o_custkey > 500 GROUP BY 1",
)
def outside_domain(spark, sf):
    return integrity.check_domain(table(spark, sf, "orders"), "o_custkey", 1, 500)


def _orphan_sql(name: str, child: str, c: str, parent: str, p: str) -> str:
    n = f"(SELECT count(*) FROM {child} WHERE {c} NOT IN (SELECT {p} FROM {parent}))"
    return f"SELECT '{name}' AS child, {n} AS orphans_before, {n} AS orphans_after"


@query(
    "foreign_keys_preserved",
    " UNION ALL ".join(
        [
            _orphan_sql("orders", "orders", "o_custkey", "customer", "c_custkey"),
            _orphan_sql("lineitem", "lineitem", "l_orderkey", "orders", "o_orderkey"),
            _orphan_sql("rich", "orders", "o_custkey", "customer WHERE c_acctbal > 0", "c_custkey"),
        ]
    ),
)
def foreign_keys_preserved(spark, sf):
    """A rule on the parent key masks its children alike, through two levels and across integer widths."""
    given = tables(spark, sf, ["customer", "orders", "lineitem"])
    given["customer"] = given["customer"].withColumn("c_custkey", F.col("c_custkey").cast("int"))
    rules, domains = jobs.key_plan(given, RuleSet(key=KEY, constraint=("customer.c_custkey", "lineitem.l_orderkey")), _KEYS)
    masked = {n: mask_table(df, n, rules, "table", domains) for n, df in given.items()}
    rich = {"given": given["customer"].filter("c_acctbal > 0"), "masked": masked["customer"].filter("c_acctbal > 0")}
    cases = [
        ("orders", given["orders"], ["o_custkey"], given["customer"], ["c_custkey"], masked["orders"], masked["customer"]),
        ("lineitem", given["lineitem"], ["l_orderkey"], given["orders"], ["o_orderkey"], masked["lineitem"], masked["orders"]),
        ("rich", given["orders"], ["o_custkey"], rich["given"], ["c_custkey"], masked["orders"], rich["masked"]),
    ]
    out = None
    for name, child, cc, parent, pc, mc, mp in cases:
        one = integrity.check_fk_preserved(child, cc, parent, pc, mc, mp).withColumn("child", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "reconciled_counts",
    "SELECT coalesce(a.t, b.t) AS \"table\", a.n AS source_rows, b.n AS target_rows, a.n IS NOT DISTINCT FROM b.n AS matches FROM "
    "(SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part) a FULL JOIN "
    "(SELECT 'orders' AS t, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL "
    "SELECT 'supplier', count(*) FROM supplier) b ON a.t = b.t",
)
def reconciled_counts(spark, sf):
    given = tables(spark, sf, ["orders", "nation", "part", "supplier"])
    target = {"orders": given["orders"].filter("o_orderstatus <> 'P'"), "nation": given["nation"], "supplier": given["supplier"]}
    return integrity.reconcile({n: given[n] for n in ("orders", "nation", "part")}, target)


@query(
    "parent_keys_newest",
    "SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey DESC LIMIT 1000",
)
def parent_keys_newest(spark, sf):
    return catalog.parent_keys(table(spark, sf, "orders"), ["o_custkey"], 1000)


@query(
    "paired_by_number",
    "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey DESC) AS n FROM customer) "
    "JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_name) AS n FROM supplier) USING (n)",
)
def paired_by_number(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey", (-F.col("c_custkey")).alias("o"))
    right = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return catalog.pair_by_number(left, right, ["o"], ["s_name"]).select("c_custkey", "s_suppkey")


@query(
    "running_bytes",
    "SELECT doc_id, CAST(sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS BIGINT) AS before FROM documents",
)
def running_bytes(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars")
    return catalog.running_total(df, "n_chars", ["doc_id"], "before").select("doc_id", "before")


@query(
    "key_columns_per_table",
    f"SELECT \"table\", \"column\", count(*) FILTER (WHERE \"column\" LIKE '%\\_id' ESCAPE '\\') OVER (PARTITION BY \"table\") AS n_id_columns FROM {_NAMES_SQL}",
)
def key_columns_per_table(spark, sf):
    return catalog.key_column_count(_name_catalog(spark, sf))


@query(
    "distinct_field_names",
    "SELECT DISTINCT k AS name FROM (SELECT unnest(json_keys(props)) AS k FROM events UNION ALL SELECT event_type FROM events)",
)
def distinct_field_names(spark, sf):
    """A union of names without repeats."""
    df = table(spark, sf, "events")
    names = df.select(F.explode(F.json_object_keys("props")).alias("name")).unionByName(df.select(F.col("event_type").alias("name")))
    return names.distinct()


@query(
    "unused_keys",
    "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders",
)
def unused_keys(spark, sf):
    """Parent keys no child uses yet."""
    return table(spark, sf, "customer").select("c_custkey").join(
        table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti"
    )




@query(
    "described_columns",
    'SELECT table_name AS "table", column_name AS "column", CAST(ordinal_position AS INTEGER) AS pos FROM information_schema.columns '
    "WHERE table_name IN ('orders', 'customer', 'nation')",
)
def described_columns(spark, sf):
    """Columns of the tables a job is limited to, from their schemas."""
    given = tables(spark, sf)
    chosen = select_targets(given, ["Orders", " customer", "NATION"])
    return catalog.describe_columns(spark, {n: given[n] for n in chosen}).select("table", "column", "pos")


@query(
    "declared_relation_orphans",
    "SELECT DISTINCT s_nationkey AS missing FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 <> 0)",
)
def declared_relation_orphans(spark, sf):
    """A relation that only the job file declares, checked against a parent that lacks some keys."""
    (key,) = virtual_relationships([{"parent": "nation.n_nationkey", "child": "supplier.s_nationkey"}])
    given = tables(spark, sf, [key.parent, key.child])
    parent = given[key.parent].where("n_nationkey % 3 <> 0")
    found = integrity.check_foreign_key(given[key.child], list(key.child_columns), parent, list(key.parent_columns))
    return found.select(F.col(key.child_columns[0]).alias("missing"))
