"""Queries over the run ledger, whole jobs and the stream."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from veilframe.operators import ledger
from veilframe.operators.keystore import KeyStore
from veilframe.plans import jobs
from veilframe.plans.compiler import mask_table
from veilframe.plans.rules import ForeignKey, RuleSet
from veilframe.registry import sqltext as s
from veilframe.registry.base import query, table, tables
from veilframe.registry.masking import _LAST4_X
from veilframe.registry.sqltext import KEY
from veilframe.session import fresh_path
from veilframe.sources import readers, writers
from veilframe.streaming import masking as streaming


def _entries(spark, sf):
    """Ledger entries from the events: a user is a run, an event type a step, each event a change of state."""
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run_id"), F.lit("sql").alias("kind"), F.col("event_type").alias("step"),
        F.when(F.col("value") < 5, "RUNNING").when(F.col("event_id") % 11 == 0, "FAILED").otherwise("COMPLETED").alias("status"),
        F.col("event_id").alias("read_rows"), F.col("event_id").alias("written_rows"),
        F.when((F.col("event_id") % 11 == 0) & (F.col("value") >= 5), F.concat(F.lit("error "), F.col("event_id"))).alias("error"),
        F.col("ts").alias("started"), F.col("ts").alias("ended"),
    )


_ENTRIES = (
    "(SELECT CAST(user_id AS VARCHAR) AS run_id, 'sql' AS kind, event_type AS step, CASE WHEN value < 5 THEN 'RUNNING' WHEN event_id % 11 = 0 THEN 'FAILED' "
    "ELSE 'COMPLETED' END AS status, event_id AS written_rows, CASE WHEN event_id % 11 = 0 AND value >= 5 THEN 'error ' || event_id END AS error, ts AS started FROM events)"
)
_STATES = (
    f"(SELECT run_id, kind, step, arg_max(struct_pack(status, written_rows, error, started), (started, status <> 'RUNNING')) AS x FROM {_ENTRIES} GROUP BY ALL)"
)


@query(
    "ledger_status",
    "SELECT *, CASE WHEN completed = steps THEN 100 ELSE least(CAST(floor(completed * 100 / steps) AS INTEGER), 99) END AS percent, "
    "CASE WHEN failed > 0 THEN 'FAILED' WHEN completed = steps THEN 'COMPLETED' ELSE 'RUNNING' END AS status FROM ("
    "SELECT run_id, kind, count(*) AS steps, count(*) FILTER (WHERE x.status = 'COMPLETED') AS completed, count(*) FILTER (WHERE x.status = 'FAILED') AS failed, "
    "CAST(sum(x.written_rows) AS BIGINT) AS written_rows, arg_min(x.error, (x.started, step)) FILTER (WHERE x.error IS NOT NULL) AS first_error "
    f"FROM {_STATES} GROUP BY run_id, kind)",
)
def ledger_status(spark, sf):
    return ledger.status(_entries(spark, sf))


@query(
    "ledger_history",
    "SELECT 'event' AS kind, CAST(event_id AS VARCHAR) AS run_id, ts AS started, event_type AS note FROM events UNION ALL "
    "SELECT 'order', 'o' || o_orderkey, o_orderdate, NULL FROM orders",
)
def ledger_history(spark, sf):
    """Two kinds of runs in one list, newest first."""
    a = table(spark, sf, "events").select(
        F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("started"), F.col("event_type").alias("note")
    )
    b = table(spark, sf, "orders").select(
        F.lit("order").alias("kind"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("run_id"), F.col("o_orderdate").alias("started")
    )
    return ledger.history(a, b)


@query(
    "ledger_latest",
    "SELECT event_type AS kind, arg_max(CAST(event_id AS VARCHAR), (ts, CAST(event_id AS VARCHAR))) AS run_id, max(ts) AS started FROM events GROUP BY 1",
)
def ledger_latest(spark, sf):
    runs = table(spark, sf, "events").select(
        F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("started")
    )
    return ledger.latest_run(runs)


@query("summary_by_key", "SELECT o_orderstatus, count(*) AS n_rows FROM orders GROUP BY ROLLUP (o_orderstatus)")
def summary_by_key(spark, sf):
    return ledger.summary_by_key(table(spark, sf, "orders"), "o_orderstatus")


@query(
    "job_counts",
    "SELECT 'customer' AS step, 'COMPLETED' AS status, count(*) AS read_rows, count(*) AS written_rows FROM customer UNION ALL "
    "SELECT 'orders', 'COMPLETED', count(*), count(*) FROM orders",
)
def job_counts(spark, sf):
    """A migration job's ledger: the counts come from the write itself."""
    book = ledger.Ledger(spark, fresh_path(spark, "ledger"), "sql")
    jobs.migrate_tables(
        spark, tables(spark, sf, ["customer", "orders"]), fresh_path(spark, "job"), RuleSet(key=KEY, partial=("c_name",)), book
    )
    return ledger.latest_state(book.entries()).select("step", "status", "read_rows", "written_rows")


@query(
    "migrated_tables",
    "SELECT o_orderkey, CASE WHEN o_custkey = 0 THEN 0 ELSE k END AS o_custkey, TRUE AS has_customer FROM " + s.feistel("orders", "o_custkey", 1, 2147483647, "int.int", "k"),
)
def migrated_tables(spark, sf):
    """A key rule on the parent reaches the child; both are written and still join."""
    given = tables(spark, sf, ["customer", "orders"])
    given["customer"] = given["customer"].withColumn("c_custkey", F.col("c_custkey").cast("int"))
    target = fresh_path(spark, "job")
    keys = [ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",))]
    book = ledger.Ledger(spark, fresh_path(spark, "ledger"), "sql")
    jobs.migrate_tables(spark, given, target, RuleSet(key=KEY, constraint=("customer.c_custkey",)), book, keys)
    orders, customer = spark.read.parquet(f"{target}/orders"), spark.read.parquet(f"{target}/customer")
    known = customer.select(F.col("c_custkey").cast("long").alias("o_custkey"), F.lit(True).alias("known")).distinct()
    return orders.join(known, "o_custkey", "left").select("o_orderkey", "o_custkey", F.coalesce("known", F.lit(False)).alias("has_customer"))


@query(
    "migration_checks",
    "SELECT step, CASE WHEN violations > 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status, violations FROM ("
    "SELECT 'check unique customer(c_custkey)' AS step, count(*) AS violations FROM customer WHERE c_custkey % 6 = 0 UNION ALL "
    "SELECT 'check foreign key orders(o_custkey)', count(DISTINCT o_custkey) FROM orders WHERE o_custkey % 2 <> 0 AND o_custkey % 3 <> 0 UNION ALL "
    "SELECT 'check not null orders(o_custkey)', count(*) FROM (SELECT count(*) AS n FROM orders WHERE o_custkey IS NULL) WHERE n > 0)",
)
def migration_checks(spark, sf):
    """Even customers are loaded, then every third one with all orders: repeated keys and orphans of the second load."""
    given = tables(spark, sf, ["customer", "orders"])
    target, path, keys = fresh_path(spark, "job"), fresh_path(spark, "keys"), [ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",))]
    loads = {
        "first": {"customer": given["customer"].where("c_custkey % 2 = 0")},
        "second": {"customer": given["customer"].where("c_custkey % 3 = 0"), "orders": given["orders"]},
    }
    for load, part in loads.items():
        book = ledger.Ledger(spark, fresh_path(spark, "ledger"), "sql")
        jobs.migrate_tables(
            spark, part, target, RuleSet(key=KEY, constraint=("customer.c_custkey",)), book, keys, {"customer": [["c_custkey"]]},
            not_null={"orders": ["o_custkey"]}, store=KeyStore(spark, path, load), append=True,
        )
    steps = ledger.latest_state(book.entries()).where(F.col("step").startswith("check "))
    return steps.select("step", "status", F.col("read_rows").alias("violations"))


@query(
    "migrated_csv",
    "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, left(s_name, 2) || repeat('*', length(s_name) - 4) || right(s_name, 2) AS s_name, '' AS s_nationkey, "
    "CAST(s_acctbal AS VARCHAR) AS s_acctbal FROM supplier",
)
def migrated_csv(spark, sf):
    source, target = fresh_path(spark, "csv"), fresh_path(spark, "csv")
    writers.write_csv(table(spark, sf, "supplier"), f"{source}/supplier.csv")
    book = ledger.Ledger(spark, fresh_path(spark, "ledger"), "csv")
    rules = RuleSet(key=KEY, partial=("supplier.csv.s_name",), nullify=("s_nationkey",))
    jobs.migrate_csv(spark, source, ["supplier.csv"], target, rules, book)
    return readers.scan_csv(spark, f"{target}/supplier.csv")


@query(
    "migrated_docs",
    f"SELECT event_id, {_LAST4_X.format(c='event_type')} AS kind, CAST(NULL AS BIGINT) AS uid FROM events",
)
def migrated_docs(spark, sf):
    docs = table(spark, sf, "events").select(
        "event_id", F.struct(F.col("event_type").alias("kind")).alias("body"), F.array(F.struct(F.col("user_id").alias("uid"))).alias("items")
    )
    target = fresh_path(spark, "docs")
    book = ledger.Ledger(spark, fresh_path(spark, "ledger"), "docs")
    rules = RuleSet(key=KEY, partial=("events.body.kind",), nullify=("events.items.uid",))
    jobs.migrate_docs({"events": docs}, target, rules, book)
    back = readers.scan_docs(spark, f"{target}/events", docs.schema)
    return back.select("event_id", "body.kind", F.col("items")[0]["uid"].alias("uid"))


@query(
    "migrated_json",
    "SELECT n_nationkey AS id, repeat('*', length(n_name) - 4) || right(n_name, 4) AS name, ['-', '-'] AS tags FROM nation",
)
def migrated_json(spark, sf):
    """JSON files of one array each; an empty array under a default is filled."""
    source, target = fresh_path(spark, "json"), fresh_path(spark, "json")
    one = F.to_json(F.array(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.array().cast("array<string>").alias("tags"))))
    table(spark, sf, "nation").select(one.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{source}/nation.json")
    book = ledger.Ledger(spark, fresh_path(spark, "ledger"), "json")
    rules = RuleSet(key=KEY, partial=("name",), defaults={"tags": "-"})
    jobs.migrate_json(spark, source, ["nation.json"], target, rules, book)
    return spark.read.schema("id int, name string, tags array<string>").json(f"{target}/nation.json")


@query(
    "mask_by_classification",
    "SELECT c_custkey, " + s.provider("full_name", "c_name", "c_name") + " AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def mask_by_classification(spark, sf):
    """Rules taken from the classification of the tables, applied to one of them."""
    given = tables(spark, sf, ["customer", "events", "labels"])
    _, suggested = jobs.classify_tables(spark, given)
    return mask_table(given["customer"], "customer", replace(suggested, key=KEY))


@query(
    "stream_masked_events",
    f"SELECT k AS event_id, ts, user_id, {_LAST4_X.format(c='event_type')} AS event_type, 0.0::DOUBLE AS value, props FROM "
    + s.feistel("events", "event_id", 1, 9223372036854775806, "int.long", "k"),
)
def stream_masked_events(spark, sf):
    """The events as a file stream, masked, written with a checkpoint, read back."""
    events = table(spark, sf, "events")
    if all(f.endswith("/events.parquet") for f in events.inputFiles()):  # one file: a stream takes folders
        stream = streaming.read_file_stream(spark, sf, events.schema, pathGlobFilter="events.parquet")
    else:
        stream = streaming.read_file_stream(spark, f"{sf}/events.parquet", events.schema)
    rules = RuleSet(key=KEY, constraint=("events.event_id",), partial=("event_type",), defaults={"value": "0"})
    out = fresh_path(spark, "stream")
    streaming.start_masking(streaming.mask_stream(stream, "events", rules), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/data")
