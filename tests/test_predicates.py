import pytest
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from paperlake.operators.predicates import compile_filter

SCHEMA = StructType().add("a", IntegerType()).add("b", StringType()).add("tags", ArrayType(StringType()))
ROWS = [(1, "x", ["p", "q"]), (2, None, ["q"]), (None, "y", None), (1, "x", ["p", "q"])]


@pytest.mark.parametrize(
    "query, expected",
    [
        (None, 4),
        ({}, 4),
        ({"a": 1}, 2),
        ({"a": None}, 1),
        ({"a": 1, "b": "y"}, 0),
        ({"tags": "q"}, 3),
        ({"tags": ["q"]}, 1),
        ({"a": {"$gt": 1}}, 1),
        ({"a": {"$ne": 1}}, 2),
        ({"a": {"$in": [2, None]}}, 2),
        ({"a": {"$nin": [2]}}, 3),
        ({"b": {"$exists": False}}, 1),
        ({"b": {"$regex": "^[xy]"}}, 3),
        ({"$or": [{"a": 2}, {"b": "y"}]}, 2),
        ({"$and": [{"a": 1}, {"tags": "p"}]}, 2),
        ({"a": {"$not": {"$gte": 2}}}, 3),
        ({"missing": None}, 4),
        ({"missing": 1}, 0),
        ({"a": {"$gte": 1, "$lt": 2}}, 2),
    ],
)
def test_filters(spark, query, expected):
    df = spark.createDataFrame(ROWS, SCHEMA)
    condition = compile_filter(query, df.schema)
    assert df.where(condition).count() == expected
    assert df.where(condition.isNull()).count() == 0


def test_unknown_operators(spark):
    with pytest.raises(ValueError):
        compile_filter({"a": {"$near": 1}}, SCHEMA)
    with pytest.raises(ValueError):
        compile_filter({"$nor": []}, SCHEMA)
