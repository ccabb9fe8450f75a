"""Collections: creation, reads, pages, updates, deletes, snapshots."""

from datetime import datetime

import pytest

from paperlake.sources.store import Catalog, DuplicateKey, NotConnected, WriteConflict

SAMPLE = "_id string, created_at timestamp_ntz, updated_at timestamp_ntz, field1 string, field2 int"


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path))


@pytest.fixture
def samples(catalog):
    return catalog.collection("samples", SAMPLE)


def fill(samples, *rows):
    return samples.create_many([{"field1": a, "field2": b} for a, b in rows])


def names(samples):
    return [r.field1 for r in samples.rows().orderBy("_seq").collect()]


def test_create_and_get(samples):
    made = samples.create_one({"field1": "test", "field2": 123})
    assert made.success and made.created_count == 1
    row = samples.get_by_id(made.ids[0])
    assert (row["field1"], row["field2"]) == ("test", 123) and row["created_at"] == row["updated_at"]
    assert isinstance(row["created_at"], datetime) and "_seq" not in row
    assert samples.get_by_id("0" * 24) is None
    with pytest.raises(ValueError):
        samples.get_by_id("nothing")


def test_create_many_keeps_order_and_nulls(samples):
    made = fill(samples, ("test1", 100), ("test2", 200), ("test3", None))
    assert made.created_count == 3
    assert [samples.get_by_id(i)["field2"] for i in made.ids] == [100, 200, None]


def test_create_none(samples):
    made = samples.create_many([])
    assert (made.success, made.created_count, made.ids) == (False, 0, [])
    assert samples.version() == 0


def test_get_one(samples):
    assert samples.get_one() is None
    fill(samples, ("test1", None), ("test2", 200))
    assert samples.get_one()["field1"] == "test1"
    assert samples.get_one({"field1": "test2"})["field2"] == 200
    assert samples.get_one({"field1": "nonexistent"}) is None


def test_pages_of_ties_keep_insertion_order(samples):
    fill(samples, *[(f"doc{i}", i) for i in range(5)])
    assert [r.field1 for r in samples.get_many(skip=2, limit=2).collect()] == ["doc2", "doc3"]
    assert samples.get_many(limit=0).count() == 5
    assert samples.get_many(limit=-2).count() == 2
    with pytest.raises(ValueError):
        samples.get_many(skip=-1)


def test_update_one(samples):
    made = fill(samples, ("original", 1), ("original", 1))
    before = samples.get_by_id(made.ids[0])["updated_at"]
    done = samples.update_one({"field1": "original"}, {"field1": "updated"}, field2=2)
    assert (done.success, done.matched_count, done.modified_count) == (True, 1, 1)
    row = samples.get_by_id(made.ids[0])
    assert (row["field1"], row["field2"]) == ("updated", 2) and row["updated_at"] > before
    assert samples.get_by_id(made.ids[1])["field1"] == "original"


def test_update_sets_explicit_null_and_keeps_the_rest(samples):
    made = fill(samples, ("a", 1))
    samples.update_by_id(made.ids[0], {"field2": None})
    row = samples.get_by_id(made.ids[0])
    assert row["field1"] == "a" and row["field2"] is None


def test_update_nothing(samples):
    fill(samples, ("a", 1))
    version = samples.version()
    assert samples.update_one({"field1": "none"}, {"field2": 5}).matched_count == 0
    empty = samples.update_one({"field1": "a"}, {})
    assert (empty.success, empty.matched_count, empty.message) == (False, 0, "No fields to update")
    assert samples.version() == version


def test_update_many(samples):
    fill(samples, ("update_me", 1), ("update_me", 2), ("dont_update", 3))
    done = samples.update_many({"field1": "update_me"}, field2=10)
    assert (done.matched_count, done.modified_count) == (2, 2)
    assert [r.field2 for r in samples.rows().orderBy("_seq").collect()] == [10, 10, 3]


def test_delete(samples):
    fill(samples, ("test1", 1), ("test2", 2), ("test3", 3))
    assert samples.delete_one({"field1": "none"}).deleted_count == 0
    assert samples.delete_one().deleted_count == 1
    assert names(samples) == ["test2", "test3"]
    assert samples.delete_many({"field1": "test3"}).deleted_count == 1
    assert samples.delete_many().deleted_count == 1
    assert samples.count_documents() == 0
    assert samples.delete_many().success is False


def test_null_never_deleted_by_comparison(samples):
    fill(samples, ("a", None), ("b", 1))
    assert samples.delete_many({"field2": {"$lt": 5}}).deleted_count == 1
    assert names(samples) == ["a"]
    assert samples.count_documents({"field2": None}) == 1


def test_unique_names(catalog):
    configs = catalog.collection("crawler_configs")
    configs.create_one({"name": "x", "source": "acl_anthology"})
    with pytest.raises(DuplicateKey):
        configs.create_one({"name": "x"})
    with pytest.raises(DuplicateKey):
        configs.create_many([{"name": "y"}, {"name": "y"}])
    assert configs.count_documents() == 1


def test_defaults_and_validation(catalog):
    configs = catalog.collection("crawler_configs")
    configs.create_many([{"name": "x", "source": "acl_anthology"}, {"name": "y", "source": "other", "rate_limit": 0}])
    shown = {r["name"]: r for r in configs.read().collect()}
    assert shown["x"]["rate_limit"] == 10 and shown["x"]["output_dir"] == "crawled_papers"
    assert configs.get_one({"name": "x"})["rate_limit"] is None
    assert {r._id: set(r.fields) for r in configs.invalid().collect()} == {shown["y"]["_id"]: {"rate_limit", "source"}}
    with pytest.raises(Exception, match="invalid row"):
        configs.read(validate=True).collect()


def test_readers_keep_their_snapshot(samples):
    fill(samples, ("a", 1))
    before = samples.rows()
    samples.update_many({}, field2=7)
    assert [r.field2 for r in before.collect()] == [1]
    assert [r.field2 for r in samples.rows().collect()] == [7]


def test_of_two_writers_one_fails(samples):
    fill(samples, ("a", 1))
    version, (segments, following) = samples.version(), samples._state(samples.version())
    samples.update_many({}, field2=7)
    with pytest.raises(WriteConflict):
        samples._commit(version + 1, segments, following)
    assert [r.field2 for r in samples.rows().collect()] == [7]


def test_inserts_add_segments_and_vacuum_removes_old_ones(samples):
    fill(samples, ("a", 1))
    first = samples._state(samples.version())[0]
    fill(samples, ("b", 2))
    assert samples._state(samples.version())[0][:1] == first and len(samples._state(samples.version())[0]) == 2
    assert samples.vacuum() == 0
    samples.delete_one({"field1": "a"})
    assert samples.vacuum() == 2 and names(samples) == ["b"]
    fill(samples, ("c", 3))
    assert names(samples) == ["b", "c"] and len({r._seq for r in samples.rows().collect()}) == 2


def test_writes_that_match_nothing_leave_nothing(samples, tmp_path):
    fill(samples, ("a", 1))
    before = sorted(p.name for p in (tmp_path / "samples").iterdir())
    samples.delete_many({"field1": "none"})
    samples.update_many({"field1": "none"}, field2=1)
    assert sorted(p.name for p in (tmp_path / "samples").iterdir()) == before


def test_bulk_from_a_table(samples, spark):
    fill(samples, ("first", 0))
    made = samples.create_many(spark.range(50).selectExpr("cast(id as string) field1", "cast(id as int) field2"))
    assert made.created_count == 50
    rows = samples.rows()
    assert rows.select("_id").distinct().count() == rows.select("_seq").distinct().count() == 51


def test_catalog(catalog):
    assert catalog.collection("papers") is catalog.collection("papers")
    with pytest.raises(KeyError):
        catalog.collection("unknown")
    assert catalog.healthy()
    catalog.close()
    assert not catalog.healthy()
    with pytest.raises(NotConnected):
        catalog.collection("papers")
