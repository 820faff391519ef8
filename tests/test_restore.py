"""Backups whose manifest tells what lies in which part."""

import json
import os
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from veilframe.operators import bundle
from veilframe.plans import jobs
from veilframe.plans.rules import ForeignKey, RuleSet

KEY = "0123456789abcdef"


def given(spark):
    table = lambda n, p: spark.range(n).select(F.concat(F.lit(p), F.col("id").cast("string")).alias("k"))
    return {"a": table(300, "a"), "b": table(5, "b"), "c": table(400, "c"), "none": table(0, "x")}


def opened(frames):
    return [sorted(unquote(os.path.basename(f)) for f in df.inputFiles()) for df in frames]


def test_a_table_opens_its_own_parts(spark, tmp_path):
    folder, tables = str(tmp_path / "b"), given(spark)
    names = {r.name for r in jobs.secure_export("csv", tables, RuleSet(key=KEY), folder, KEY, "e*[1]", "2KB").collect()}
    back = jobs.secure_import(spark, folder, KEY, {n: d.schema for n, d in tables.items()}, base="e*[1]")
    for name, df in tables.items():
        assert sorted(r.k for r in back[name].collect()) == sorted(r.k for r in df.collect())
    a, b, c = opened(back[n] for n in "abc")
    assert set(a) | set(b) | set(c) == names and len(names) > 8
    assert len(a) + len(b) + len(c) <= len(names) + 2  # a part on a border is opened for both its tables
    lines = bundle.part_index(spark, folder, KEY, "e*[1]").groupBy("file").agg(F.sum("lines").alias("n")).collect()
    assert {r.file: r.n for r in lines} == {"a": 300, "b": 5, "c": 400}
    manifest = (tmp_path / "b" / "_e*[1].manifest").read_text()
    assert '"a"' not in manifest and all(json.loads(x)["sha256"] for x in manifest.splitlines())


def test_sql_backups_by_manifest(spark, tmp_path):
    folder, tables = str(tmp_path / "b"), given(spark)
    keys = [ForeignKey("b", ("k",), "a", ("k",))]
    jobs.secure_export_tables(tables, RuleSet(key=KEY), folder, KEY, max_bytes="2KB", primary_keys={"a": ["k"]}, keys=keys)
    schemas = {n: d.schema for n, d in tables.items()}
    by_index = jobs.secure_import_tables(spark, folder, KEY, schemas, base="export")
    for name, df in tables.items():
        rows, rejects = by_index[name]
        assert sorted(r.k for r in rows.collect()) == sorted(r.k for r in df.collect()) and rejects.count() == 0
    assert by_index.rejects.count() == 1
    assert len(opened([by_index["b"][0]])[0]) <= 2 < len(opened([by_index["c"][0]])[0])


def test_damaged_and_absent_parts(spark, tmp_path):
    folder, tables = str(tmp_path / "b"), given(spark)
    names = [r.name for r in jobs.secure_export("csv", tables, RuleSet(key=KEY), folder, KEY, max_bytes="2KB").collect()]
    status = lambda: {r.name: r.status for r in bundle.check_part_files(spark, folder, "export").collect()}
    assert status() == dict.fromkeys(names, "OK")
    first, second, third = sorted(names)[:3]
    content = (tmp_path / "b" / second).read_bytes()
    (tmp_path / "b" / second).write_bytes(content[:-1] + bytes([content[-1] ^ 1]))
    (tmp_path / "b" / third).unlink()
    assert status() == {**dict.fromkeys(names, "OK"), second: "DAMAGED", third: "ABSENT"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|damaged part"):
        back = jobs.secure_import(spark, folder, KEY, {n: d.schema for n, d in tables.items()}, base="export")
        [df.collect() for df in back.values()]


def test_backups_without_an_index(spark, tmp_path):
    folder, tables = str(tmp_path / "b"), given(spark)
    bundle.save_parts(bundle.export_bundle(tables, "old", "2KB", KEY), folder, "old")
    back = jobs.secure_import(spark, folder, KEY, {"b": tables["b"].schema}, base="old")["b"]
    assert sorted(r.k for r in back.collect()) == [f"b{i}" for i in range(5)]
    assert {r.file for r in bundle.part_index(spark, folder, KEY, "old").collect()} == {None}
