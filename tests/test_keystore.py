"""Key checks of loads: against stored digests, recorded in the ledger, violations kept."""

from veilframe.operators.keystore import KeyStore
from veilframe.operators.ledger import Ledger, latest_state, status
from veilframe.plans.jobs import migrate_tables
from veilframe.plans.rules import ForeignKey, RuleSet

RULES = RuleSet(key="0123456789abcdef")
KEYS = [ForeignKey("child", ("pid",), "parent", ("id",))]


def parent(spark, ids):
    return spark.createDataFrame([(i, "x") for i in ids], "id long, v string")


def child(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "pid int")


def run(spark, tmp_path, load, tables, **more):
    book = Ledger(spark, f"{tmp_path}/ledger-{load}", "sql")
    result = migrate_tables(
        spark, tables, f"{tmp_path}/out", RULES, book, KEYS, {"parent": [["id"]]}, not_null={"parent": ["id", "v"]}, **more
    )
    return result, {r.step: r for r in latest_state(book.entries()).collect()}, status(book.entries()).head()


def test_checks_run_and_are_recorded(spark, tmp_path):
    tables = {"parent": parent(spark, [1, 2, 2, None]), "child": child(spark, [1, 2, 3, 3, None])}
    result, steps, run_state = run(spark, tmp_path, "one", tables)
    assert [(r.id, r.n_rows) for r in result.checks["unique parent(id)"].collect()] == [(2, 2)]
    assert [(r.pid, r.n_rows) for r in result.checks["foreign key child(pid)"].collect()] == [(3, 2)]
    assert [(r.column, r.n_null) for r in result.checks["not null parent(id, v)"].collect()] == [("id", 1)]
    assert steps["check unique parent(id)"].read_rows == 1 and run_state.status == "FAILED"


def test_clean_tables_complete(spark, tmp_path):
    _, steps, run_state = run(spark, tmp_path, "one", {"parent": parent(spark, [1, 2]), "child": child(spark, [2, 2])})
    assert run_state.status == "COMPLETED" and steps["check foreign key child(pid)"].read_rows == 0


def test_later_loads_are_checked_against_earlier_ones(spark, tmp_path):
    store = f"{tmp_path}/keys"
    run(spark, tmp_path, "a", {"parent": parent(spark, [1, 2])}, store=KeyStore(spark, store, "a"), append=True)
    for _ in range(2):  # a repeated load replaces its own keys and finds the same
        result, steps, _ = run(
            spark, tmp_path, "b", {"parent": parent(spark, [2, 3, 4, 4]), "child": child(spark, [1, 3, 9])},
            store=KeyStore(spark, store, "b"), append=True,
        )
        found = {(r.id, r.n_rows, r.loaded_before) for r in result.checks["unique parent(id)"].collect()}
        assert found == {(2, 1, True), (4, 2, False)}
        assert [r.pid for r in result.checks["foreign key child(pid)"].collect()] == [9]
    assert steps["check unique parent(id)"].read_rows == 2
    later = migrate_tables(
        spark, {"child": child(spark, [1, 4, 8])}, f"{tmp_path}/out", RULES, Ledger(spark, f"{tmp_path}/ledger-c", "sql"), KEYS,
        store=KeyStore(spark, store, "c"), append=True,
    )
    assert [r.pid for r in later.checks["foreign key child(pid)"].collect()] == [8]
