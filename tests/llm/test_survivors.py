from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paperlake.llm import survivors as S


def test_consensus_takes_the_majority_per_column():
    values = [("The quick brown fox", 1.0), ("The quikc brown fox", 1.0), ("The quick brown fix", 1.0), ("A quick brown fox jumps", 1.0)]
    assert "".join(S.consensus(values)) == "The quick brown fox"
    assert S.closest(values) == "The quick brown fox"
    assert S.closest([("a b c d", 1.0), ("a b x d", 1.0), ("a y c d", 1.0), ("z b c d", 1.0)]) == "a b c d"
    assert S.closest([("x", 1.0), ("y", 3.0)]) == "y"
    assert S.closest([("", 1.0), ("", 1.0)]) == ""


def test_consensus_values(spark, monkeypatch):
    rows = [("g", "same text", 1.0), ("g", "same text", 1.0), ("g", "same test", 1.0), ("h", None, 1.0), ("i", "only", 1.0), ("j", "", 1.0), ("j", None, 1.0)]
    votes = spark.createDataFrame(rows, "group string, value string, weight double")
    expected = {"g": "same text", "i": "only", "j": ""}
    assert {r.group: r.value for r in S.consensus_values(votes).collect()} == expected
    assert S.consensus_values(votes.limit(0)).count() == 0
    many = [("big", f"title number {i}", 1.0) for i in range(300)] + [("big", "title number x", 50.0)]
    monkeypatch.setattr(S, "CHUNK", 8)
    got = S.consensus_values(spark.createDataFrame(many, "group string, value string, weight double")).collect()
    assert len(got) == 1 and got[0].value == "title number x"


@pytest.mark.parametrize("n", [40, 300])
def test_all_values_of_a_large_group_vote(spark, n):
    """Every value differs from the consensus in one word but the one that is the consensus."""
    words = [f"w{i}" for i in range(10)]
    values = [" ".join([*words[: i % 10], f"zz{i}", *words[i % 10 + 1 :]]) for i in range(n)] + [" ".join(words)]
    votes = spark.createDataFrame([("g", v, 1.0) for v in values] + [("h", "a", 1.0), ("h", "b", 2.0)], "group string, value string, weight double")
    assert {r.group: r.value for r in S.consensus_values(votes).collect()} == {"g": " ".join(words), "h": "b"}


@pytest.mark.parametrize("n", [31, 65, 300])
def test_one_rule_for_groups_of_any_size(spark, n):
    """What the cluster returns is what one process returns on all values, below and above a chunk."""
    values = [(f"near equal title {i % 7} of {i} words {i % 3}", 1.0 + i % 2) for i in range(n)]
    votes = spark.createDataFrame([("g", v, w) for v, w in values], "group string, value string, weight double")
    assert [r.value for r in S.consensus_values(votes).collect()] == [S.closest(values)]


def test_only_some_values_may_survive(spark):
    rows = [("g", "a b c", 1.0, True), ("g", "a b d", 1.0, True), ("g", "x b d", 0.5, False), ("h", "no", 1.0, False)]
    votes = spark.createDataFrame(rows, "group string, value string, weight double, may boolean")
    assert {r.group: r.value for r in S.consensus_values(votes).collect()} == {"g": "a b d"}


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2018.corp_ws.2", "2018.corp-ws.2"), (" 2018.Corp-WS.2 ", "2018.corp-ws.2"), ("https://a.example/2018.corp-ws.2/", "2018.corp-ws.2"),
        ("2018.corp-ws.2.pdf", "2018.corp-ws.2"), ("​2018.corp‐ws.2", "2018.corp-ws.2"), ("", None), (" / ", None), (None, None),
    ],
)
def test_source_ids(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.canonical_source_id(F.col("t"))).first()[0] == expected


@pytest.mark.parametrize(
    "url, good",
    [
        ("https://a.example/x.pdf", True), ("HTTP://a.example/b/x.PDF", True), ("https://", False), ("x.pdf", False), ("", False), (None, False),
        ("https://a.example/x", False), ("https://a.example/.pdf", False), ("ftp://a.example/x.pdf", False), ("https://a.example", False), ("N/A", False),
    ],
)
def test_pdf_addresses(spark, url, good):
    assert spark.createDataFrame([(url,)], "t string").select(S.is_pdf_address(F.col("t"))).first()[0] is good


def test_survivors(spark):
    t = [datetime(2024, 1, d) for d in range(1, 5)]
    rows = [
        ("b", "g", "v1", t[0]), ("a", "g", "v2", t[2]), ("c", "g", "bad", t[3]), ("a", "g", "v2", t[2]),  # the newest that may survive
        ("d", "h", "v", None), ("e", "h", "v", None),  # all oldest, same value: smallest id
        ("f", "i", "one two three", t[1]), ("g2", "i", "one two tree", t[1]), ("h2", "i", "one two three", t[1]),  # ties vote
        ("i2", "j", "alone", t[1]), ("j2", None, "x", t[1]), ("k2", None, "y", t[1]),
        ("l2", "k", "bad", t[1]), ("m2", "k", "bad", t[2]),
    ]
    df = spark.createDataFrame(rows, "_id string, group_key string, v string, updated_at timestamp_ntz").withColumn("key", F.lit("clash")).withColumn("rank", F.lit(1))
    fields = {"v": (F.col("v"), F.col("v") != "bad", (F.col("updated_at"),))}
    got = {(r.group_id, r.field_name, r.record_id) for r in S.survivors(df, fields).collect()}
    assert got == {("a", "v", "a"), ("d", "v", "d"), ("f", "v", "f")}
    assert S.survivors(df.limit(0), fields).count() == 0


def test_lower_ranks_decide_ties_and_nothing_else(spark):
    t = [datetime(2024, 1, d) for d in range(1, 5)]
    rows = [
        ("a", "g", "one two three", t[2]), ("b", "g", "one two four", t[2]),  # tied
        ("c", "g", "zero two four", t[1]), ("d", "g", "five six four", t[0]), ("d", "g", "five six four", t[0]),
        ("e", "h", "new", t[3]), *((f"f{i}", "h", "old", t[0]) for i in range(50)),  # many old ones don't outvote
        ("i", "j", "x y", None), ("j", "j", "x z", None),  # tied at the oldest: the greater token
    ]
    df = spark.createDataFrame(rows, "_id string, group_key string, v string, updated_at timestamp_ntz")
    fields = {"v": (F.col("v"), F.col("v") != "bad", (F.col("updated_at"),))}
    assert {(r.group_id, r.record_id) for r in S.survivors(df, fields).collect()} == {("a", "b"), ("e", "e"), ("i", "j")}
