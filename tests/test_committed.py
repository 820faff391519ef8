"""Files under their own names, put in place together."""

import os

import pytest
from pyspark.sql import functions as F

from veilframe.operators import bundle
from veilframe.plans import jobs
from veilframe.plans.rules import RuleSet
from veilframe.sources import writers
from veilframe.sources.committed import CommittedFolder, committed_files

KEY = "0123456789abcdef"


def tree(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names if not n.startswith("."))


def test_backups_leave_other_files_alone(spark, tmp_path):
    folder, rules = str(tmp_path / "b"), RuleSet(key=KEY)
    os.makedirs(folder)
    others = ["export.csv", "export_2024.xlsx", "export-1.tar.gz", "export-part9.jsonl.enc"]
    for name in others:
        (tmp_path / "b" / name).write_text("mine")
    df = spark.range(400).select(F.col("id").cast("string").alias("k"))
    many = [r.name for r in jobs.secure_export("csv", {"t.csv": df}, rules, folder, KEY, max_bytes="3KB").collect()]
    assert len(many) > 1 and set(tree(folder)) == {*others, *many, "_export.manifest"} and len(many) < 9
    few = [r.name for r in jobs.secure_export("csv", {"t.csv": df}, rules, folder, KEY, max_bytes="1MB").collect()]
    assert few == ["export.jsonl.enc"] and set(tree(folder)) == {*others, *few, "_export.manifest"}
    assert [r.name for r in committed_files(spark, folder, "export").collect()] == few
    back = jobs.secure_import(spark, folder, KEY, {"t.csv": df.schema}, base="export")["t.csv"]
    assert sorted(r.k for r in back.collect()) == sorted(str(i) for i in range(400))
    assert all((tmp_path / "b" / n).read_text() == "mine" for n in others)


def test_a_failed_export_leaves_the_old_backup(spark, tmp_path):
    folder = str(tmp_path / "b")
    df = spark.range(300).select(F.col("id").cast("string").alias("k"))
    jobs.secure_export("csv", {"t.csv": df}, RuleSet(key=KEY), folder, KEY, max_bytes="3KB")
    before = {n: (tmp_path / "b" / n).read_bytes() for n in tree(folder)}
    broken = df.withColumn("k", F.when(F.col("k") == "299", F.raise_error(F.lit("broken"))).otherwise(F.col("k")))
    with pytest.raises(Exception, match="broken"):
        jobs.secure_export("csv", {"t.csv": broken}, RuleSet(key=KEY), folder, KEY, max_bytes="2KB")
    assert {n: (tmp_path / "b" / n).read_bytes() for n in tree(folder)} == before


def test_a_failed_commit_puts_everything_back(spark, tmp_path):
    folder = str(tmp_path / "b")
    df = spark.range(300).select(F.col("id").cast("string").alias("k"))
    parts = bundle.export_bundle({"t": df}, "export", "3KB", KEY)
    bundle.save_parts(parts, folder, "export")
    before = {n: (tmp_path / "b" / n).read_bytes() for n in tree(folder)}
    out = CommittedFolder(spark, folder, "export")
    bundle.write_part_files(parts, out.staging).collect()
    names = out.staged()
    assert len(names) > 2
    with pytest.raises(Exception, match="could not move|does not exist|No such file|FileNotFound"):
        out.commit({**{n: n for n in names}, "absent": "new-file"})
    out.drop_staging()
    assert {n: (tmp_path / "b" / n).read_bytes() for n in tree(folder)} == before


def test_names_of_others_are_refused(spark, tmp_path):
    folder = str(tmp_path / "b")
    os.makedirs(folder)
    (tmp_path / "b" / "export.jsonl.enc").write_text("mine")
    with pytest.raises(FileExistsError, match="export.jsonl.enc"):
        jobs.secure_export("csv", {"t.csv": spark.range(3).selectExpr("cast(id as string) k")}, RuleSet(key=KEY), folder, KEY)
    assert tree(folder) == ["export.jsonl.enc"] and (tmp_path / "b" / "export.jsonl.enc").read_text() == "mine"


def test_mirrored_files_of_several_tasks(spark, tmp_path):
    rows = spark.range(100).repartition(4).select("id", F.when(F.col("id") < 99, "a b/x=1/ü%.csv").otherwise("top").alias("rel"))
    names = writers.save_mirrored(rows, str(tmp_path / "t"))
    assert names == sorted(["top", *(f"a b/x=1/ü%-part{i}.csv" for i in range(1, 5))])
    assert tree(tmp_path / "t") == sorted([*names, "_mirror.manifest"])
    assert writers.save_mirrored(rows.where("id = 99"), str(tmp_path / "t")) == ["top"] and tree(tmp_path / "t") == ["_mirror.manifest", "top"]


def test_one_file_per_record(spark, tmp_path):
    df = spark.createDataFrame([(1, "x\ny"), (2, None)], "id int, text string")
    writers.save_one_per_record(df, str(tmp_path / "r"), writers.record_name("notes.json", F.col("id"), 2))
    assert tree(tmp_path / "r") == ["_records.manifest", "notes_1.json", "notes_2.json"]
    assert (tmp_path / "r" / "notes_1.json").read_text() == '{"id":1,"text":"x\\ny"}\n' and (tmp_path / "r" / "notes_2.json").read_text() == '{"id":2,"text":null}\n'
    with pytest.raises(ValueError, match="name"):
        writers.save_one_per_record(df, str(tmp_path / "r"), F.lit("a"), "a/b")


def test_very_many_records(spark, tmp_path, monkeypatch):
    folder, moved = str(tmp_path / "r"), []
    monkeypatch.setattr(CommittedFolder, "_move", lambda self, *pair, f=CommittedFolder._move: moved.append(pair) or f(self, *pair))

    def save(first, end):
        df = spark.range(first, end).select("id", F.lit(end).alias("end"))
        return writers.save_one_per_record(df, folder, F.concat(F.when(F.col("id") % 2 == 0, "a b/").otherwise(""), F.col("id").cast("string")))

    def held():
        return {n: (tmp_path / "r" / n).read_text() for n in tree(folder) if n != "_records.manifest"}

    def wanted(first, end):
        return {f"{'' if i % 2 else 'a b/'}{i}": f'{{"id":{i},"end":{end}}}\n' for i in range(first, end)}

    assert save(0, 1500) == sorted(wanted(0, 1500)) and held() == wanted(0, 1500)
    assert save(700, 2000) == sorted(wanted(700, 2000)) and held() == wanted(700, 2000)
    assert len(moved) < 10  # tasks move the files
    (tmp_path / "r" / "2001").write_text("mine")
    with pytest.raises(FileExistsError, match="such as 2001"):
        save(600, 2003)
    out = CommittedFolder(spark, folder, "records")
    out.make_staging()
    (tmp_path / "r" / os.path.basename(out.staging) / "x").write_text("new")
    with pytest.raises(OSError, match="could not move"):
        out.commit({"x": "701", "absent": "702"})
    out.drop_staging()
    assert held() == {**wanted(700, 2000), "2001": "mine"}


def test_checksums_go_with_their_files(spark, tmp_path, monkeypatch):
    from veilframe.sources import committed

    folder, df = str(tmp_path / "t"), spark.range(40).coalesce(1)
    rows = df.select("id", F.concat(F.lit("f"), F.col("id")).alias("rel"))
    writers.save_mirrored(rows, folder)
    monkeypatch.setattr(committed, "BY_TASKS", 1)
    writers.save_mirrored(rows.withColumn("id", F.col("id") + 100), folder)
    assert sorted(r.id for r in spark.read.csv([f"{folder}/f{i}" for i in range(40)], header=True, schema="id long").collect()) == list(range(100, 140))
    text = rows.select(F.col("id").cast("string").alias("value"), F.col("rel").alias(committed.NAME))
    committed.save_lines(text, folder, "mirror")
    assert sorted(int(r.value) for r in spark.read.text([f"{folder}/f{i}" for i in range(40)]).collect()) == list(range(40))


def test_records_of_one_name_or_none(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "id int, name string").repartition(4)
    assert writers.save_one_per_record(df.select("id", "name"), str(tmp_path / "r"), F.col("name")) == ["__HIVE_DEFAULT_PARTITION__", "a"]
    assert sorted((tmp_path / "r" / "a").read_text().splitlines()) == ['{"id":1,"name":"a"}', '{"id":2,"name":"a"}']
