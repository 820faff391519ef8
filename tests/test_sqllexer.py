"""Dumps cut and read by a lexer, whatever blocks their files are read in."""

import random

import pytest
from pyspark.sql import types as T

from veilframe.operators import sqldump, sqllexer


def test_values():
    read = lambda rows: sqllexer.parse(f"INSERT INTO t VALUES {rows};")
    assert read("(3, ARRAY['q','r'])") == ("t", None, [["3", "'[\"q\", \"r\"]'"]])
    assert read("('2020'::date, 1::numeric(10, 2), '{}'::text[], NULL::character varying(20))")[2] == [["'2020'", "1", "'{}'", "NULL"]]
    assert read("($$it's;$$, $a$ $$ $a$, E'a\\'b\\n', 'x;\ny')")[2] == [["'it''s;'", "' $$ '", "'a''b\n'", "'x;\ny'"]]
    assert read("(ARRAY[[1,2],[3,NULL]]::int[], now(), CAST('x' AS date)), (ARRAY[], -1.5e3, '')")[2] == [
        ["'[[1, 2], [3, null]]'", "now()", "CAST('x' AS date)"], ["'[]'", "-1.5e3", "''"]]
    for bad in ("(1,,2)", "(1", "(1) ON CONFLICT DO NOTHING", "", "(1),", "('a' 'b'", "(ARRAY[1 2])"):
        assert read(bad) is None, bad
    assert sqllexer.parse('-- c\n/* ; */ insert into "S"."My ""T" ("a", b) values (1, 2)') == ("my \"t", ["a", "b"], [["1", "2"]])
    assert sqllexer.ignored("-- x\n create table a (b int);") and sqllexer.ignored(" ;\r\n") and not sqllexer.ignored("SET x = 1;")


def some_dump(rng):
    texts = ["plain", "it''s", "a;\nb", "$$", "--", "/*", "x" * 70, '"', "\r\n;\r\n", "E", "$q$;"]
    statements, want, left = [], [], []
    for i in range(60):
        body = rng.choice(texts)
        kind = rng.randrange(7)
        literal, value = [(f"'{body}'", body.replace("''", "'")), (f"E'{body}\\n\\'\\\\'", body.replace("''", "'") + "\n'\\"), (f"$t${body}$t$", body)][kind % 3]
        if kind == 6:
            left.append(f"UPDATE t SET x = {literal} WHERE id = {i};")
            statements.append(left[-1])
        else:
            want.append((str(i), value))
            statements.append(f"{rng.choice(['', '-- it is; {$$', '/* ; ' + chr(39) + ' */'])}\nINSERT INTO t (id, x) VALUES ({i}, {literal}::text);")
    return rng.choice(["\n", "\r\n", " "]).join(statements) + "\n", sorted(want), sorted(left)


@pytest.mark.parametrize("seed", range(2))
def test_blocks_of_any_size(spark, tmp_path, seed):
    text, want, left = some_dump(random.Random(seed))
    path = tmp_path / "dump.sql"
    path.write_bytes(text.encode())
    schema = T.StructType.fromDDL("id string, x string")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("61", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            found = sqldump.scan_sql_dump(spark, str(path), {"t": schema})
            assert sorted(map(tuple, found["t"].collect())) == want, size
            assert sorted(r.value for r in found.rejects.collect()) == left, size
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_and_unfinished(spark, tmp_path):
    (tmp_path / "a.sql").write_text("")
    (tmp_path / "b.sql").write_text("INSERT INTO t VALUES (1, 'open")
    found = sqldump.scan_sql_dump(spark, str(tmp_path), {"t": T.StructType.fromDDL("a int, b string")})
    assert found["t"].count() == 0 and [r.value for r in found.rejects.collect()] == ["INSERT INTO t VALUES (1, 'open"]
