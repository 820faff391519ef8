"""Readers, writers, bundles, dumps."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.operators import bundle, sqldump
from veilframe.operators.ledger import Ledger, latest_state
from veilframe.plans import jobs
from veilframe.plans.rules import ForeignKey, RuleSet
from veilframe.sources import readers, writers

KEY = "0123456789abcdef"


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


def text_of(folder):
    out = ""
    for name in sorted(os.listdir(folder)):
        if name.startswith("part-"):
            with open(f"{folder}/{name}", encoding="utf-8") as f:
                out += f.read()
    return out


def test_csv_reading(spark, tmp_path):
    path = write(tmp_path / "a" / "x.csv", 'id, name ,note\n1,  "Doe, ""J""" ,\n\n2,b\n3,c,d,extra,"q,r"\n')
    rows = {r.id: r for r in readers.scan_csv(spark, path).collect()}
    assert rows["1"].name == 'Doe, "J"' and rows["1"].note == "" and rows["2"].note == ""
    assert readers.csv_headers(spark, path) == ["id", "name", "note"] and readers.count_rows_csv(spark, path) == 3
    wide = {r.id: r for r in readers.scan_csv(spark, path, ragged="col_").collect()}
    assert wide["3"]["col_3"] == "extra" and wide["3"]["col_4"] == "q,r" and wide["1"]["col_3"] == ""


def test_csv_migration(spark, tmp_path):
    source = tmp_path / "src"
    write(source / "customers.csv", 'id,name,email,card_number,notes\n1,Ann,ann@x.org,4532123456789012,"a,b"\n2,Bob,bob@y.org,4532123456789013,\n')
    rules = RuleSet(
        key=KEY, masking=("customers.csv.name",), partial=("email",), constraint=("card_number",), nullify=("customers.csv.notes",)
    )
    book = Ledger(spark, str(tmp_path / "ledger"), "csv")
    result = jobs.migrate_csv(spark, str(source), ["customers.csv", "missing.csv"], str(tmp_path / "out"), rules, book)
    assert result.completed == ["customers.csv"] and result.failed == ["missing.csv"]
    rows = readers.scan_csv(spark, str(tmp_path / "out" / "customers.csv")).orderBy("id").collect()
    assert rows[0].email == "an*****rg" and len(rows[0].card_number) == 16 and rows[0].notes == "" and rows[0].name != "Ann"
    states = {r.step: r for r in latest_state(book.entries()).collect()}
    assert states["customers.csv"].written_rows == 2 and states["missing.csv"].status == "FAILED" and states["missing.csv"].error


def test_quotes_only_where_needed(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x"y', "p,q", None)], "a string, b string, c string, d string").coalesce(1)
    writers.write_csv(df, str(tmp_path / "o"))
    assert text_of(tmp_path / "o") == 'a,b,c,d\na,"x""y","p,q",\n'


def test_json_reading(spark, tmp_path):
    write(tmp_path / "j" / "many.json", '[{"id": 1, "name": "a"},\n {"id": 2, "name": null}]')
    write(tmp_path / "k" / "one.json", '{\n"id": 3,\n"profile": {"address": "x"}\n}')
    assert readers.scan_json(spark, str(tmp_path / "j")).count() == 2
    assert readers.scan_json(spark, str(tmp_path / "k")).head().profile.address == "x"


def test_listing_and_natural_order(spark, tmp_path):
    for name in ("e-part10.sql.enc", "e-part2.sql.enc", "e-part1.sql.enc", "other_3.json", "sub/deep.csv"):
        write(tmp_path / "f" / name, "x")
    files = readers.list_files(spark, str(tmp_path / "f"))
    assert files.count() == 4 and {r.kind for r in files.collect()} == {"SQL", "JSON"}
    assert readers.list_files(spark, str(tmp_path / "f"), [".csv"], depth=3).head().name == "deep.csv"
    assert readers.list_files(spark, str(tmp_path / "f"), depth=1).filter("encrypted").count() == 3
    ordered = [r.name for r in bundle.find_parts(files, start="e-part2.sql.enc").collect()]
    assert ordered == ["e-part1.sql.enc", "e-part2.sql.enc", "e-part10.sql.enc"]
    assert [r.name for r in bundle.find_parts(files, prefix="OTHER").collect()] == ["other_3.json"]
    assert bundle.find_parts(files, prefix="nothing").count() == 4


@pytest.mark.parametrize("text, size", [("100MB", 104857600), ("250", 250), ("250B", 250), ("1 GB", 2**30), ("2k", 2048), ("", 104857600), ("x", 104857600), (None, 104857600)])
def test_sizes(text, size):
    assert bundle.parse_size(text) == size


def test_many_files_in_small_parts(spark, tmp_path):
    tables = {
        f"file_{i}.csv": spark.range(30).select(*[(F.col("id") + i * c).cast("string").alias(f"col{c}") for c in range(1, 5)])
        for i in range(20)
    }
    folder = str(tmp_path / "parts")
    log = jobs.secure_export("csv", tables, RuleSet(key=KEY), folder, KEY, "backup", "1KB")
    assert log.count() > 1 and all(r.name.endswith(".jsonl.enc") for r in log.collect())
    schemas = {n: d.schema for n, d in tables.items()}
    back = jobs.secure_import(spark, folder, KEY, schemas)
    for name in ("file_0.csv", "file_19.csv"):
        assert sorted(back[name].collect()) == sorted(tables[name].collect())
    with pytest.raises(ValueError):
        jobs.secure_import(spark, folder, "wrong", schemas)


def test_second_rules_on_import(spark, tmp_path):
    staff = spark.createDataFrame([("1", "Ann", "ann@x.org", "9")], "id string, name string, email string, score string")
    folder = str(tmp_path / "p")
    jobs.secure_export("csv", {"staff.csv": staff}, RuleSet(key=KEY, partial=("email",)), folder, KEY)
    again = RuleSet(key=KEY, nullify=("staff.csv.score",), targets=("staff.csv",))
    row = jobs.secure_import(spark, folder, KEY, {"staff.csv": staff.schema}, again)["staff.csv"].head()
    assert row.email == "an*****rg" and row.score == "" and row.name == "Ann"


def test_offsets_over_many_tasks(spark):
    df = spark.range(0, 10_000, 1, 13).select(F.col("id").alias("k"), (F.col("id") % 97).alias("size"))
    rows = bundle.with_offsets(df.repartition(7), F.col("size"), ["k"]).orderBy("k").collect()
    total = 0
    for i, r in enumerate(rows):
        assert r["__row"] == i and r["__start"] == total
        total += r["size"]


def test_sql_dump_statements(spark):
    df = spark.createDataFrame([(1, "O'Neil", True, bytearray(b"\x01\xff"), None)], "id int, name string, ok boolean, raw binary, note string")
    lines = [r.value for r in sqldump.to_sql_dump(df, "t", ["id"]).collect()]
    assert lines[0] == "-- CREATE TABLE t"
    assert lines[1] == "CREATE TABLE t (id INTEGER, name TEXT, ok BOOLEAN, raw BYTEA, note TEXT, PRIMARY KEY (id));"
    assert lines[2] == r"INSERT INTO t (id, name, ok, raw, note) VALUES (1, 'O''Neil', TRUE, E'\\x01ff', NULL);"


def test_sql_dump_reads_awkward_text(spark):
    values = ["plain", "it''s", "a;\nb", "line\nbreak", "back\\slash\nn", "\\n", "", "comma, 'q'", "x" * 20000 + "'" * 500, None, " pad "]
    df = spark.createDataFrame(list(enumerate(values)), "id int, s string")
    back = sqldump.table_of(sqldump.parse_inserts(sqldump.insert_statements(df, "T")), "t", df.schema)
    good, bad = writers.split_rejects(back, df.schema)
    assert bad.count() == 0 and [r.s for r in good.orderBy("id").collect()] == values


def test_foreign_key_text():
    keys = [ForeignKey("orders", ("cid",), "customer", ("id",))]
    assert sqldump.foreign_key_ddl(keys) == ["ALTER TABLE orders ADD CONSTRAINT fk_orders_cid FOREIGN KEY (cid) REFERENCES customer(id);"]


def test_table_preparation_and_conflicts(spark, tmp_path):
    schema = T.StructType.fromDDL("k int, v string")
    path = str(tmp_path / "t")
    writers.prepare_table(spark, schema, path)
    assert spark.read.parquet(path).count() == 0
    writers.write_ignore_conflicts(spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "d"), (None, "d")], schema), path, ["k"])
    writers.write_ignore_conflicts(spark.createDataFrame([(2, "z"), (3, "e")], schema), path, ["k"])
    rows = sorted((r.k or 0, r.v) for r in spark.read.parquet(path).collect())
    assert rows == [(0, "d"), (0, "d"), (1, "a"), (2, "c"), (3, "e")]


def test_types_of_created_tables():
    assert writers.map_type_name("character varying", 20) == "VARCHAR(20)" and writers.map_type_name("varchar") == "TEXT"
    assert writers.map_type_name("numeric", precision=10, scale=2) == "NUMERIC(10,2)" and writers.map_type_name("char") == "CHAR(1)"
    assert writers.map_type_name("tsvector") == "tsvector" and writers.map_type_name("jsonb") == "JSONB"
    assert writers.map_type(T.StructField("a", T.DecimalType(5, 2))) == "NUMERIC(5,2)"


def test_jdbc_options():
    options = readers.jdbc_options("jdbc:x", "t", ["a", "b"], "a", (1, 100), 4)
    assert options["dbtable"] == "(SELECT a, b FROM t) src" and options["fetchsize"] == "2500"
    assert (options["partitionColumn"], options["upperBound"], options["numPartitions"]) == ("a", "100", "4")


def test_one_file_per_record(spark, tmp_path):
    writers.write_one_per_record(spark.range(5).coalesce(1), str(tmp_path / "o"))
    assert len([n for n in os.listdir(tmp_path / "o") if n.startswith("part-")]) == 5


def test_files_with_different_headers_are_refused(spark, tmp_path):
    write(tmp_path / "d" / "a.csv", "id,name\n1,x\n")
    write(tmp_path / "d" / "b.csv", "name,id\ny,2\n")
    with pytest.raises(Exception, match="header"):
        readers.scan_csv(spark, str(tmp_path / "d")).collect()


def test_declared_lengths_of_table_columns(spark, tmp_path):
    from veilframe.operators.catalog import describe_columns
    from veilframe.plans.compiler import mask_table

    spark.sql(f"CREATE TABLE veil_len (c VARCHAR(6), d CHAR(3)) USING parquet LOCATION '{tmp_path}/len'")
    try:
        spark.sql("INSERT INTO veil_len VALUES ('ab', 'cde')")
        df = spark.table("veil_len")
        assert [r.max_length for r in describe_columns(spark, {"t": df}).orderBy("pos").collect()] == [6, 3]
        assert len(mask_table(df, "t", RuleSet(key=KEY, masking=("c",))).head().c) == 6
        assert sqldump.create_statement(df.schema, "t").startswith("CREATE TABLE t (c VARCHAR(6),")
    finally:
        spark.sql("DROP TABLE veil_len")


def test_csv_keeps_blanks_and_empty_rows(spark, tmp_path):
    df = spark.createDataFrame([(" a ",), (None,), ("",), ("b",)], "v string")
    writers.write_csv(df, str(tmp_path / "one"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "one")).collect() if r.value != "v")
    assert lines == sorted([" a ", '""', '""', "b"])
    assert readers.scan_csv(spark, str(tmp_path / "one")).count() == 4  # reading trims, but loses no row


def test_foreign_dump_forms(spark, tmp_path):
    (tmp_path / "d.sql").write_text(
        "-- a dump\nCREATE TABLE t (a int, b text);\nINSERT INTO t VALUES (1,'x'), (2,'y;z (q)');\nINSERT INTO t (b, a) VALUES ('it''s', 3);\n"
        "INSERT INTO t (a, b) VALUES (4, E'a\\\\nb\u0001c\\nd\\\\');\nINSERT INTO t SELECT * FROM u;\nINSERT INTO t VALUES (5, 'open);\n"
    )
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    path = str(tmp_path / "d.sql")
    rows = {(r.a, r.b) for r in sqldump.scan_sql_dump(spark, path, {"t": schema})["t"].collect()}
    assert rows == {("1", "x"), ("2", "y;z (q)"), ("3", "it's"), ("4", "a\\nb\u0001c\nd\\")}
    left = [r.value for r in sqldump.unread_statements(sqldump.read_statements(spark, path)).collect()]
    assert sorted(x.split()[3] for x in left) == ["SELECT", "VALUES"]


def test_backups_of_one_folder_stay_apart(spark, tmp_path):
    folder, schema = str(tmp_path / "b"), spark.createDataFrame([("1",)], "id string").schema
    rows = lambda n, p: spark.range(n).select(F.concat(F.lit(p), F.col("id").cast("string")).alias("id"))
    jobs.secure_export("csv", {"t.csv": rows(200, "old")}, RuleSet(key=KEY), folder, KEY, "one", "1KB")
    jobs.secure_export("csv", {"t.csv": rows(30, "b")}, RuleSet(key=KEY), folder, KEY + "2", "one_more", "1KB")
    jobs.secure_export("csv", {"t.csv": rows(10, "a")}, RuleSet(key=KEY), folder, KEY, "one", "1KB")
    read = lambda base, key: sorted(r.id for r in jobs.secure_import(spark, folder, key, {"t.csv": schema}, base=base)["t.csv"].collect())
    assert read("one", KEY) == sorted(f"a{i}" for i in range(10))
    assert read("one_more", KEY + "2") == sorted(f"b{i}" for i in range(30))
    with pytest.raises(ValueError):
        read("missing", KEY)
