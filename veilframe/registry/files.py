"""Queries over readers, writers, bundles and SQL dumps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.operators import bundle, rotation, sqldump
from veilframe.plans import jobs
from veilframe.plans.rules import RuleSet
from veilframe.registry.base import query, table, tables
from veilframe.registry.masking import _FIXED, _LAST4_STAR
from veilframe.registry.sqltext import KEY
from veilframe.session import fresh_path, stage
from veilframe.sources import readers, writers


@query(
    "scan_projected",
    "SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-06-01' AND l_quantity < 10",
)
def scan_projected(spark, sf):
    """Two columns and two filters reach the scan."""
    df = table(spark, sf, "lineitem").filter((F.col("l_shipdate") >= F.lit("1999-06-01").cast("timestamp_ntz")) & (F.col("l_quantity") < 10))
    return df.select("l_orderkey", "l_extendedprice")


@query(
    "csv_roundtrip_part",
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || ', \"' || p_brand || '\"' END AS p_name, "
    "CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part",
)
def csv_roundtrip_part(spark, sf):
    """Commas and quotes survive, null comes back as empty text, padding is trimmed."""
    name = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("  "), "p_name", F.lit(', "'), "p_brand", F.lit('"  ')))
    path = fresh_path(spark, "csv")
    writers.write_csv(table(spark, sf, "part").select("p_partkey", name.alias("p_name"), "p_retailprice"), path)
    return readers.scan_csv(spark, path)


@query(
    "csv_roundtrip_conversations",
    "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, md5(trim(replace(text, chr(13), ''), E' \\t\\r\\n')) AS text "
    "FROM conversations",
)
def csv_roundtrip_conversations(spark, sf):
    """Texts with line breaks, read in multi-line mode."""
    path = fresh_path(spark, "csv")
    df = table(spark, sf, "conversations").select("conv_id", "turn", F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    writers.write_csv(df, path)
    return readers.scan_csv(spark, path, multiline=True).withColumn("text", F.md5("text"))


@query(
    "csv_carriage_returns",
    "SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, "
    "md5('<' || replace(coalesce(text, ''), ' ', chr(13)) || chr(13) || chr(10) || '>') AS text FROM conversations",
)
def csv_carriage_returns(spark, sf):
    """Whole texts with carriage returns, alone and before line breaks, come back as they were."""
    path, text = fresh_path(spark, "csv"), F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("\r"))
    df = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("<"), text, F.lit("\r\n>")).alias("text"))
    writers.write_csv(df, path)
    return readers.scan_csv(spark, path, multiline=True).withColumn("text", F.md5("text"))


@query(
    "csv_row_count",
    "SELECT count(*) AS n_rows FROM supplier",
)
def csv_row_count(spark, sf):
    path = fresh_path(spark, "csv")
    writers.write_csv(table(spark, sf, "supplier"), path)
    return readers.scan_csv(spark, path).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "json_roundtrip_events",
    "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value FROM events",
)
def json_roundtrip_events(spark, sf):
    """Documents with nested fields and nulls through JSON lines."""
    path = fresh_path(spark, "json")
    docs = table(spark, sf, "events").select(
        "event_id", "event_type", F.from_json("props", "k bigint").alias("props"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value")
    )
    writers.write_docs(docs, path)
    back = readers.scan_docs(spark, path, docs.schema)
    return back.select("event_id", "event_type", "props.k", "value")


@query(
    "json_array_files",
    "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT n_nationkey + 1000, NULL FROM nation",
)
def json_array_files(spark, sf):
    """One JSON array per file; its elements become rows."""
    one = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    other = F.struct((F.col("n_nationkey") + 1000).alias("id"), F.lit(None).cast("string").alias("name"))
    path = fresh_path(spark, "json")
    arrays = table(spark, sf, "nation").select(F.to_json(F.array(one, other)).alias("value"))
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    return readers.scan_json(spark, path, T.StructType.fromDDL("id int, name string"))


@query(
    "insert_ignoring_conflicts",
    "WITH src AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2), "
    "tgt AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_returnflag = 'R') "
    "SELECT k, n, price FROM src WHERE NOT EXISTS (SELECT 1 FROM tgt WHERE tgt.k = src.k AND tgt.n = src.n)",
)
def insert_ignoring_conflicts(spark, sf):
    df = table(spark, sf, "lineitem")
    new = df.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("price"))
    target = df.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    return writers.new_rows(new, target, ["k", "n"], ["price"])


@query(
    "mirrored_files",
    "SELECT 'seg=' || c_mktsegment AS rel, count(*) AS n_rows, min(c_name) AS first FROM customer GROUP BY c_mktsegment",
)
def mirrored_files(spark, sf):
    """Output folders follow the source file's relative path."""
    source, target = fresh_path(spark, "tree"), fresh_path(spark, "tree")
    df = table(spark, sf, "customer").withColumn("seg", F.col("c_mktsegment"))
    df.write.partitionBy("seg").parquet(source)
    rows = writers.with_relative_path(spark.read.parquet(source).drop("seg"), source)
    writers.write_mirrored(rows.withColumn("rel", F.regexp_extract("rel", "^([^/]+)/", 1)), target, "json")
    return spark.read.json(target).groupBy("rel").agg(F.count(F.lit(1)).alias("n_rows"), F.min("c_name").alias("first"))


@query(
    "mirrored_tree",
    "SELECT c_mktsegment || '/in 1/customers.csv' AS path, count(*) AS n_rows, min(c_name) AS first, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY c_mktsegment",
)
def mirrored_tree(spark, sf):
    """The tree of the sources under its own paths; of files written by several tasks the parts are counted together."""
    target = fresh_path(spark, "tree")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", F.concat("c_mktsegment", F.lit("/in 1/customers.csv")).alias("rel"))
    writers.save_mirrored(rows, target)
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(target, header=True, schema="c_custkey long, c_name string")
    path = F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), f"^.*{target.rsplit('/', 1)[-1]}/", ""), r"-part\d+\.csv$", ".csv")
    return read.select(path.alias("path"), "*").groupBy("path").agg(F.count("*").alias("n_rows"), F.min("c_name").alias("first"), F.sum("c_custkey").alias("keys"))


@query("record_files", "SELECT 'suppliers_' || s_suppkey || '.json' AS name, s_name, s_nationkey FROM supplier")
def record_files(spark, sf):
    """One JSON file per supplier under its own name, written twice: the second commit replaces the first."""
    target, df = fresh_path(spark, "records"), table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    for rows in (df.where("s_suppkey % 2 = 0"), df):
        writers.save_one_per_record(rows, target, writers.record_name("suppliers_12.json", F.col("s_suppkey"), 2))
    read = spark.read.schema("s_name string, s_nationkey " + dict(df.dtypes)["s_nationkey"]).json(target)
    return read.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("name"), "*")


@query("record_names", "SELECT o_orderkey, 'orders_' || CAST(o_orderkey + 1 AS VARCHAR) || '.json' AS name FROM orders")
def record_names(spark, sf):
    name = writers.record_name("orders_12.json", F.col("o_orderkey") + 1, 2)
    return table(spark, sf, "orders").select("o_orderkey", name.alias("name"))


@query(
    "rejected_rows",
    "SELECT CASE WHEN p_partkey % 7 = 0 THEN 'rejected' ELSE 'loaded' END AS side, count(*) AS n_rows, "
    "CAST(sum(p_partkey) AS BIGINT) AS keys FROM part GROUP BY 1",
)
def rejected_rows(spark, sf):
    """Rows whose text does not fit the column type are set aside, the rest are typed."""
    size = F.when(F.col("p_partkey") % 7 == 0, F.col("p_name")).otherwise(F.col("p_size").cast("string"))
    text = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("key"), size.alias("size"))
    good, bad = writers.split_rejects(text, T.StructType.fromDDL("key bigint, size int"))
    sides = good.select(F.lit("loaded").alias("side"), "key").unionByName(
        bad.select(F.lit("rejected").alias("side"), F.col("key").cast("long"))
    )
    return sides.groupBy("side").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("key").alias("keys"))


@query(
    "csv_ragged_rows",
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_partkey % 3 > 0 THEN p_brand ELSE '' END AS col_2, "
    "CASE WHEN p_partkey % 3 = 2 THEN p_type ELSE '' END AS col_3 FROM part",
)
def csv_ragged_rows(spark, sf):
    """Rows with more fields than the header; the surplus gets columns of its own."""
    k = F.col("p_partkey") % 3
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), "p_name", F.when(k > 0, F.col("p_brand")), F.when(k == 2, F.col("p_type")))
    path = fresh_path(spark, "csv")
    table(spark, sf, "part").select(line.alias("p_partkey,p_name")).write.csv(path, header=True, sep=";")
    return readers.scan_csv(spark, path, ragged="col_")


# ---------------------------------------------------------------- bundles

_PART_BYTES = 40_000


@query(
    "assign_parts",
    f"WITH r AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars AS start FROM documents) "
    f"SELECT doc_id, CAST(start // {_PART_BYTES} + 1 AS INTEGER) AS part_no, CASE WHEN max(start) OVER () < {_PART_BYTES} THEN 'docs' "
    f"ELSE 'docs-part' || CAST(start // {_PART_BYTES} + 1 AS VARCHAR) END AS part_name FROM r",
)
def assign_parts(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "n_chars")
    return bundle.assign_parts(df, "n_chars", _PART_BYTES, "docs", ["doc_id"]).select("doc_id", "part_no", "part_name")


@query(
    "rotated_parts",
    "WITH RECURSIVE r AS (SELECT doc_id, strlen(text) + 1 AS size, row_number() OVER (ORDER BY doc_id) AS no FROM documents), "
    "o AS (SELECT doc_id, no, sum(size) OVER (ORDER BY no ROWS UNBOUNDED PRECEDING) AS fin, "
    "sum(size) OVER (ORDER BY no ROWS UNBOUNDED PRECEDING) - size AS start FROM r), "
    f"n AS (SELECT a.no, greatest(b.no, a.no + 1) AS following FROM o a JOIN o b ON b.fin >= a.start + {_PART_BYTES} AND b.start < a.start + {_PART_BYTES}), "
    "cuts AS (SELECT CAST(1 AS BIGINT) AS no, 1 AS part_no UNION ALL SELECT n.following, cuts.part_no + 1 FROM cuts JOIN n ON n.no = cuts.no "
    "WHERE n.following <= (SELECT count(*) FROM r)) "
    "SELECT o.doc_id, c.part_no, CASE WHEN (SELECT count(*) FROM cuts) > 1 THEN 'docs-part' || CAST(c.part_no AS VARCHAR) ELSE 'docs' END AS part_name "
    "FROM o JOIN (SELECT no, part_no, lead(no, 1, 9223372036854775807) OVER (ORDER BY no) AS stop FROM cuts) c ON o.no >= c.no AND o.no < c.stop",
)
def rotated_parts(spark, sf):
    """Parts filled greedily: a document that would bring a part to the limit begins the next one."""
    df = table(spark, sf, "documents").select("doc_id", (F.octet_length("text") + 1).alias("size"))
    return rotation.greedy_parts(df, "size", _PART_BYTES, "docs", ["doc_id"]).select("doc_id", "part_no", "part_name")


@query(
    "part_files",
    "WITH r AS (SELECT doc_id, strlen(text) + 1 AS size FROM documents), "
    "o AS (SELECT size, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS start FROM r), "
    "p AS (SELECT start // 100000 + 1 AS no, CAST(sum(size) + 19 AS BIGINT) AS length, max(max(start)) OVER () AS last FROM o GROUP BY 1) "
    "SELECT CASE WHEN last < 100000 THEN 'docs.txt' ELSE 'docs-part' || CAST(no AS VARCHAR) || '.txt' END AS name, length, "
    "CAST(CASE WHEN last < 100000 THEN 0 ELSE no END AS INTEGER) AS part_no FROM p",
)
def part_files(spark, sf):
    """Parts written as files, listed and put in natural order."""
    folder = fresh_path(spark, "parts")
    parts = bundle.pack_parts(table(spark, sf, "documents"), F.col("text"), 100_000, "docs", ".txt", ["doc_id"])
    stage(bundle.write_part_files(parts, folder), "part-log")
    files = bundle.find_parts(readers.list_files(spark, folder, [".txt"]), prefix="docs")
    return files.select("name", "length", bundle.part_number(F.col("name")).alias("part_no"))


@query(
    "bundle_roundtrip",
    "SELECT 'nation' AS file, n_nationkey AS id, n_name AS name, n_regionkey AS ref FROM nation UNION ALL "
    "SELECT 'customer', c_custkey, c_name, c_nationkey FROM customer",
)
def bundle_roundtrip(spark, sf):
    """Two tables in one encrypted bundle of many parts, and back."""
    given = tables(spark, sf, ["nation", "customer"])
    parts = stage(bundle.export_bundle(given, "backup", "20KB", KEY), "bundle")
    records = bundle.scan_bundle(parts, KEY)
    nation = bundle.restore_table(records, "nation", given["nation"].schema)
    customer = bundle.restore_table(records, "customer", given["customer"].schema)
    return nation.select(
        F.lit("nation").alias("file"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"),
        F.col("n_regionkey").alias("ref"),
    ).unionByName(
        customer.select(
            F.lit("customer").alias("file"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("ref")
        )
    )


@query("bundle_documents", "SELECT doc_id, md5(text) AS text, lang FROM documents")
def bundle_documents(spark, sf):
    """Whole texts with line breaks survive packing and encryption."""
    df = table(spark, sf, "documents").select("doc_id", "text", "lang")
    parts = stage(bundle.export_bundle({"documents": df}, "docs", "200KB", KEY), "bundle")
    back = bundle.restore_table(bundle.scan_bundle(parts, KEY), "documents", df.schema)
    return back.withColumn("text", F.md5("text"))


@query(
    "bundle_inspection",
    "SELECT 'SUCCESS' AS status, 'supplier' AS file, 's_suppkey,s_name,s_nationkey,s_acctbal' AS columns, count(*) AS records, 'right' AS key FROM supplier "
    "UNION ALL SELECT 'INVALID_KEY', NULL, NULL, 0, 'wrong' UNION ALL SELECT 'KEY_REQUIRED', NULL, NULL, 0, 'none'",
)
def bundle_inspection(spark, sf):
    """File names and columns with the right key, a status otherwise."""
    parts = stage(bundle.export_bundle({"supplier": table(spark, sf, "supplier")}, "s", "3KB", KEY), "bundle")
    out = None
    for label, key in (("right", KEY), ("wrong", "some-other-key"), ("none", None)):
        one = bundle.inspect_bundle(parts, key).select(
            "status", "file", F.array_join("columns", ",").alias("columns"), "records", F.lit(label).alias("key")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "part_order",
    "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END AS INTEGER) AS part_no FROM orders",
)
def part_order(spark, sf):
    """Part numbers read from file names; names without one count as 0."""
    key = F.col("o_orderkey").cast("string")
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("export-part"), key, F.lit(".sql.enc"))).otherwise("export.sql.enc")
    return table(spark, sf, "orders").select("o_orderkey", bundle.part_number(name).alias("part_no"))


# ---------------------------------------------------------------- SQL text

_MASKED_SUPPLIER = (
    f"SELECT s_suppkey, {_LAST4_STAR.format(c='s_name')} AS s_name, s_nationkey, s_acctbal FROM supplier"
)


@query(
    "sql_dump_text",
    "SELECT 'INSERT INTO customer (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, active) VALUES (' || c_custkey || ', ' || "
    "CASE WHEN c_custkey % 4 = 0 THEN 'NULL' ELSE '''O''''' || c_name || '''' END || ', ' || c_nationkey || ', ' || c_acctbal || ', ''' || c_mktsegment || ''', ' || "
    "CASE WHEN c_acctbal > 0 THEN 'TRUE' ELSE 'FALSE' END || ');' AS value FROM customer",
)
def sql_dump_text(spark, sf):
    df = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("O'"), "c_name"))
    return sqldump.insert_statements(df.withColumns({"c_name": name, "active": F.col("c_acctbal") > 0}), "customer")


@query(
    "sql_dump_roundtrip",
    "SELECT doc_id, md5(text) AS text, n_chars, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang || '''s' END AS lang, doc_id % 2 = 0 AS even FROM documents",
)
def sql_dump_roundtrip(spark, sf):
    """Documents as INSERT text in files, read back into typed rows."""
    df = table(spark, sf, "documents").select(
        "doc_id", "text", "n_chars", F.when(F.col("doc_id") % 3 != 0, F.concat("lang", F.lit("'s"))).alias("lang"),
        (F.col("doc_id") % 2 == 0).alias("even"),
    )
    path = fresh_path(spark, "dump")
    sqldump.to_sql_dump(df, "documents", ["doc_id"]).write.text(path)
    text = sqldump.scan_sql_dump(spark, path, {"documents": df.schema})["documents"]
    good, _ = writers.split_rejects(text, df.schema)
    return good.withColumn("text", F.md5("text"))


@query(
    "secure_sql_roundtrip",
    _MASKED_SUPPLIER,
)
def secure_sql_roundtrip(spark, sf):
    """Masked, dumped as SQL text, encrypted, written as files, opened and loaded again."""
    df, folder = table(spark, sf, "supplier"), fresh_path(spark, "secure")
    rules = RuleSet(key=KEY, partial=("supplier.s_name",))
    jobs.secure_export_tables({"supplier": df}, rules, folder, KEY, max_bytes="2KB", primary_keys={"supplier": ["s_suppkey"]})
    return jobs.secure_import_tables(spark, folder, KEY, {"supplier": df.schema})["supplier"][0]


@query(
    "secure_json_roundtrip",
    f"SELECT event_id, {_FIXED.format(c='event_type')} AS event_type, CAST(NULL AS DOUBLE) AS value FROM events",
)
def secure_json_roundtrip(spark, sf):
    """Exported with one rule set, imported with a second."""
    df, folder = table(spark, sf, "events").select("event_id", "event_type", "value"), fresh_path(spark, "secure")
    jobs.secure_export("json", {"events.json": df}, RuleSet(key=KEY, partial=("event_type",)), folder, KEY, max_bytes="100KB")
    again = RuleSet(key=KEY, nullify=("events.value",))
    return jobs.secure_import(spark, folder, KEY, {"events.json": df.schema}, again, "json")["events.json"]


@query(
    "secure_docs_roundtrip",
    f"SELECT event_id, {_FIXED.format(c='event_type')} AS kind, user_id AS uid, 'x' AS note FROM events",
)
def secure_docs_roundtrip(spark, sf):
    """Nested documents exported under the rules of a document backup and restored."""
    docs = table(spark, sf, "events").select(
        "event_id", F.struct(F.col("event_type").alias("kind"), F.lit("secret").alias("note")).alias("body"),
        F.array(F.struct(F.col("user_id").alias("uid"))).alias("items"),
    )
    folder = fresh_path(spark, "secure")
    rules = RuleSet(key=KEY, partial=("events.body.kind",), defaults={"events.body.note": "x"})
    jobs.secure_export("docs", {"events": docs}, rules, folder, KEY, max_bytes="200KB")
    back = jobs.secure_import(spark, folder, KEY, {"events": docs.schema})["events"]
    return back.select("event_id", "body.kind", F.col("items")[0]["uid"].alias("uid"), "body.note")


@query(
    "restored_tables",
    "SELECT 'nation' AS file, count(*) AS records, count(*) AS restored, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation UNION ALL "
    "SELECT 'supplier', count(*), count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier UNION ALL "
    "SELECT 'customer', count(*), count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer",
)
def restored_tables(spark, sf):
    """Tables of one backup, each restored from the parts that the manifest names for it."""
    given = tables(spark, sf, ["nation", "supplier", "customer"])
    folder = fresh_path(spark, "secure")
    jobs.secure_export("tables", given, RuleSet(key=KEY), folder, KEY, "all", "20KB")
    back = jobs.secure_import(spark, folder, KEY, {n: d.schema for n, d in given.items()}, base="all")
    out = None
    for name, df in back.items():
        one = df.agg(F.count(F.lit(1)).alias("restored"), F.sum(F.col(df.columns[0]).cast("long")).alias("keys"))
        one = one.select(F.lit(name).alias("file"), "restored", "keys")
        out = one if out is None else out.unionByName(one)
    records = bundle.part_index(spark, folder, KEY, "all").groupBy("file").agg(F.sum("lines").alias("records"))
    return records.join(out, "file")


@query(
    "backup_key_check",
    "SELECT count(*) AS n_rows, TRUE AS right_key, FALSE AS wrong_key, FALSE AS no_key FROM customer",
)
def backup_key_check(spark, sf):
    """The first part tells whether a key opens the backup."""
    df = table(spark, sf, "customer")
    parts = stage(bundle.export_bundle({"customer": df}, "backup", "30KB", KEY), "bundle")
    answers = [bundle.validate_key(parts, k) for k in (KEY, KEY + "x", None)]
    restored = bundle.scan_bundle(parts, KEY)
    names = ("right_key", "wrong_key", "no_key")
    return restored.agg(F.count(F.lit(1)).alias("n_rows"), *[F.lit(a).alias(n) for n, a in zip(names, answers, strict=True)])


@query(
    "sql_dump_foreign_forms",
    "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, 'it''s (' || s_name || '), ok;' AS s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier",
)
def sql_dump_foreign_forms(spark, sf):
    """A dump of another tool: CRLF ends, several rows a statement, every other statement without a column list."""
    row = F.format_string("(%d, 'it''s (%s), ok;', %d)", "s_suppkey", "s_name", "s_nationkey")
    head = F.when(F.col("g") % 2 == 0, "INSERT INTO supplier VALUES ").otherwise('INSERT INTO "public"."supplier" ("s_suppkey", s_name, s_nationkey) VALUES\r\n')
    rows = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 64).alias("g"), F.floor(F.col("s_suppkey") / 6400).alias("block")).agg(F.collect_list(row).alias("rows"))  # 100 rows a statement
    path = fresh_path(spark, "dump")
    rows.select(F.concat(head, F.array_join("rows", ",\r\n")).alias("value")).write.option("lineSep", ";\r\n").text(path)
    schema = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey").schema
    return sqldump.scan_sql_dump(spark, path, {"supplier": schema})["supplier"]


@query(
    "sql_dump_awkward_literals",
    r"""SELECT c_custkey, 'x;' || chr(10) || c_name || ''';' AS note, '["a' || c_custkey || '", "b,)''"]' AS tags,
    CAST('2020-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS DATE) AS day, c_mktsegment || ';--' AS segment, CAST(1 AS BIGINT) AS n_rejects FROM customer""",
)
def sql_dump_awkward_literals(spark, sf):
    """A dump with statement ends inside literals, comments and dollar quotes, arrays and casts; one statement is no INSERT."""
    key, day = F.col("c_custkey").cast("string"), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0")
    text = F.concat(
        F.lit("/* it's; */ INSERT INTO public.customer (c_custkey, note, tags, day, segment) VALUES\r\n("), key, F.lit(", 'x;\n"), "c_name",
        F.lit("'';', ARRAY['a"), key, F.lit("', E'b,)\\''::text], '2020-01-"), day, F.lit("'::date, $q$"), "c_mktsegment", F.lit(";--$q$);"),
    )
    path = fresh_path(spark, "dump")
    other = spark.createDataFrame([("ALTER TABLE customer ADD PRIMARY KEY (c_custkey);",)], "value string")
    other.unionAll(table(spark, sf, "customer").select(text.alias("value"))).write.text(path)
    schema = T.StructType.fromDDL("c_custkey bigint, note string, tags string, day date, segment string")
    found = sqldump.scan_sql_dump(spark, path, {"customer": schema})
    good, _ = writers.split_rejects(found["customer"], schema)
    return good.withColumn("n_rejects", F.lit(found.rejects.count()).cast("long"))


@query(
    "secure_csv_roundtrip",
    "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) AS c_name FROM customer",
)
def secure_csv_roundtrip(spark, sf):
    """A backup written twice, the second time in fewer parts, and restored by name beside another one."""
    folder, rules = fresh_path(spark, "secure"), RuleSet(key=KEY, partial=("customer.csv.c_name",))
    df = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), "c_name")
    other = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("c_custkey"), F.col("s_name").alias("c_name"))
    jobs.secure_export("csv", {"customer.csv": other}, rules, folder, KEY, base="export-old")
    for size in ("10KB", "10MB"):
        jobs.secure_export("csv", {"customer.csv": df}, rules, folder, KEY, max_bytes=size)
    return jobs.secure_import(spark, folder, KEY, {"customer.csv": df.schema}, base="export")["customer.csv"]
