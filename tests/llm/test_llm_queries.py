"""The package's queries on the smallest tables: columns, types, distinct rows, and SQL where there is some."""

import glob
import os

import pytest

from paperlake.llm import registry

COLUMNS = {
    "p1_found": [("name_a", "string"), ("name_b", "string")],
    "p2_found": [("group_id", "string"), ("field_name", "string"), ("paper_id", "string")],
    "p4_found": [("paper_id", "string"), ("end_char", "int")],
    "p5_found": [("paper_id", "string"), ("section_key", "string")],
    "p6_found": [("paper_id", "string"), ("section_key", "string"), ("line_no", "int"), ("repair", "string")],
    "p7_found": [("paper_id", "string"), ("field_name", "string")],
    "p9_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_runs(spark, data, name):
    df = registry.queries()[name](spark, data)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    out = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(tuple(r[x] for x in columns) for r in df.collect()) == sorted(tuple(r[names.index(x)] for x in columns) for r in out.fetchall())
