"""Broken references on small tables, with skew, nulls, repeats and clashing columns."""

from datetime import datetime

from pyspark.sql import functions as F

from paperlake.operators import references as R

T = [datetime(2024, 1, d) for d in range(1, 10)]
CHILD = "_id string, ref string, created_at timestamp_ntz, parents int, key string"
PARENT = "name string, created_at timestamp_ntz, refs int"


def found(spark, children, parents):
    c = spark.createDataFrame([(*x, 1, "k") for x in children], CHILD)
    p = spark.createDataFrame([(*x, 1) for x in parents], PARENT)
    rows = R.broken_references(c, p, child_id="_id", child_key="ref", parent_key="name").collect()
    return sorted((r.child_id, r.ref_state) for r in rows)


def test_states(spark):
    children = [
        ("1", "a", T[0]), ("2", "a", T[5]), ("3", "none", T[0]), ("4", None, T[0]), ("5", " \t", T[0]), ("6", "A", T[0]),
        ("7", "a", None), ("3", "none", T[0]), ("8", "a", T[3]), ("9", "none", None), ("10", "b", T[1]),
    ]
    parents = [("a", T[3]), ("a", T[3]), (None, T[0]), ("b", T[4]), ("b", T[1]), ("c", None)]
    assert found(spark, children, parents) == [("1", "late"), ("3", "missing"), ("6", "missing"), ("9", "missing")]


def test_empty_tables(spark):
    assert found(spark, [], [("a", T[0])]) == []
    assert found(spark, [("1", "a", T[0])], []) == [("1", "missing")]


def test_parent_without_time_makes_nothing_late(spark):
    assert found(spark, [("1", "c", T[0])], [("c", None)]) == []


def test_hot_key(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT_REFERENCES", 10)
    children = [(str(i), "hot" if i % 3 else f"k{i}", T[i % 5]) for i in range(300)]
    got = found(spark, children, [("hot", T[2])])
    expected = [(i, "late" if k == "hot" else "missing") for i, k, t in children if k != "hot" or t < T[2]]
    assert got == sorted(expected)


def test_deltas_lead_from_version_to_version(spark):
    old = spark.createDataFrame([("1", "a", T[0]), ("2", "b", T[0]), ("3", "b", T[0])], "_id string, ref string, created_at timestamp_ntz")
    new = spark.createDataFrame([("1", "a", T[0]), ("2", "a", T[0]), ("4", "c", T[0])], "_id string, ref string, created_at timestamp_ntz")
    p_old = spark.createDataFrame([("a", T[0]), ("b", T[0])], "name string, created_at timestamp_ntz")
    p_new = spark.createDataFrame([("b", T[0])], "name string, created_at timestamp_ntz")
    state = R.fold(R.reference_deltas(old, "ref", "created_at"), R.existence_deltas(p_old, "name", "created_at"))
    assert R.orphan_keys(state).count() == 0
    state = R.fold(
        state,
        R.changed(old, new, "_id", "ref", "created_at", "child"),
        R.changed(p_old, p_new, "name", "name", "created_at", "parent"),
    )
    assert {(r.key, r.refs) for r in R.orphan_keys(state).collect()} == {("a", 2), ("c", 1)}


def test_report(spark):
    rows = [("papers", "k", T[0], "late"), ("papers", "k", T[1], "late"), ("papers", "l", None, "missing")]
    df = spark.createDataFrame(rows, "child_table string, ref_key string, created_at timestamp_ntz, ref_state string")
    got = {(r.month, r.ref_state): (r.n_refs, r.n_keys) for r in R.reference_report(df).collect()}
    assert got == {("2024-01", "late"): (2, 1), (None, "missing"): (1, 1)}
    assert R.reference_report(df.where(F.lit(False))).count() == 0
