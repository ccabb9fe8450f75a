"""Best representative of each group of duplicate records.

For every field the records of a group vote with weights.  The values are
aligned token by token, progressively from the heaviest on; in each column the
heaviest token wins; the existing value closest to that consensus survives.

Values are aligned in chunks of CHUNK in order of weight; the chunks' votes per
column are aligned with each other in order, FAN_IN at a time.  That is one rule for
groups of any size, and no task holds a whole large group.

A rule such as "the most recently updated" is a weight too: a record of the
highest rank weighs 1, all records of lower rank weigh LOWER together.  So a
record of the highest rank outvotes them all, and where such records disagree
the others decide between them.

A value with more than half of its group's weight is the consensus: its token
wins every column, and so does its gap.  Such groups are settled by counting,
without moving or aligning their values.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.llm.inputs import map_lists
from paperlake.session import cut

#: Values aligned one after another, and chunks aligned with each other.
CHUNK = 64
FAN_IN = 8
#: Weight of all records of lower rank together.
LOWER = 0.5
_TOKEN = re.compile(r"\w+|[^\w\s]|\s+")


def merged(columns: list[Counter], total: float, others: list[Counter], other_total: float) -> list[Counter]:
    """The column votes of two sets of values, aligned by their heaviest tokens."""
    current, tokens = ([max(c.items(), key=lambda x: (x[1], x[0]))[0] for c in x] for x in (columns, others))
    out: list[Counter] = []
    for _, a, b, x, y in SequenceMatcher(None, current, tokens, autojunk=False).get_opcodes():
        for i in range(max(b - a, y - x)):
            column = columns[a + i] if a + i < b else Counter({"": total})
            for token, weight in (others[x + i] if x + i < y else {"": other_total}).items():
                column[token] += weight
            out.append(column)
    return out


def column_votes(profiles: list[tuple[list[Counter], float]]) -> tuple[list[Counter], float]:
    """The column votes of all profiles, aligned in their order."""
    columns, total = profiles[0]
    for others, weight in profiles[1:]:
        columns = merged(columns, total, others, weight)
        total += weight
    return columns, total


def in_order(values: list[tuple[str, float]]) -> list[tuple[str, float]]:
    """The order of alignment: the heaviest first, equals by code point."""
    return sorted(values, key=lambda v: (-v[1], v[0]))


def profiles_of(values: list[tuple[str, float]]) -> list[tuple[list[Counter], float]]:
    return [([Counter({t: w}) for t in _TOKEN.findall(v)], w) for v, w in values]


def heaviest(columns: list[Counter]) -> list[str]:
    chosen = (max(c.items(), key=lambda x: (x[1], x[0] != "", x[0]))[0] for c in columns)
    return [t for t in chosen if t]


def consensus(values: list[tuple[str, float]]) -> list[str]:
    """Tokens that the weighted values agree on, by progressive alignment."""
    ordered = in_order(values)
    level = [column_votes(profiles_of(ordered[i : i + CHUNK])) for i in range(0, len(ordered), CHUNK)]
    while len(level) > 1:
        level = [column_votes(level[i : i + FAN_IN]) for i in range(0, len(level), FAN_IN)]
    return heaviest(level[0][0])


def likeness(value: str, wanted: list[str]) -> float:
    return SequenceMatcher(None, _TOKEN.findall(value), wanted, autojunk=False).ratio()


def closest(values: list[tuple[str, float]], may_survive: frozenset[str] | None = None) -> str:
    """The existing value closest to the consensus; among equals the heavier, then the first by code point."""
    if len(values) == 1:
        return values[0][0]
    wanted = consensus(values)
    score = {v: likeness(v, wanted) for v, _ in values if may_survive is None or v in may_survive}
    return min((v for v in values if v[0] in score), key=lambda v: (-score[v[0]], -v[1], v[0]))[0]


_PROFILE = "group string, part bigint, total double, columns array<struct<tokens:array<string>,weights:array<double>>>"


def _profile_row(group: str, part: int, columns: list[Counter], total: float) -> tuple:
    return group, part, total, [{"tokens": list(c), "weights": list(c.values())} for c in columns]


def _large_groups(votes: DataFrame) -> DataFrame:
    """(group, value) for groups (group, value, weight, may) of more values than one chunk.

    Every chunk of values passes on all its column votes; these are merged in
    rounds, and each value of the group is compared with the consensus.
    """

    def first(group: list, part: list, values: list) -> list[tuple]:
        return [_profile_row(g, p, *column_votes(profiles_of(in_order([(x["value"], x["weight"]) for x in v])))) for g, p, v in zip(group, part, values)]

    def again(group: list, part: list, profiles: list) -> list[tuple]:
        out = []
        for g, p, found in zip(group, part, profiles):
            ready = [
                ([Counter(dict(zip(c["tokens"], c["weights"]))) for c in f["columns"]], f["total"]) for f in sorted(found, key=lambda f: f["part"])
            ]
            out.append(_profile_row(g, p, *column_votes(ready)))
        return out

    def final(group: list, columns: list) -> list[tuple]:
        return [(g, heaviest([Counter(dict(zip(c["tokens"], c["weights"]))) for c in x])) for g, x in zip(group, columns)]

    def scored(group: list, value: list, weight: list, wanted: list) -> list[tuple]:
        return [(g, v, w, likeness(v, t)) for g, v, w, t in zip(group, value, weight, wanted)]

    place = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("weight"), "value")) - 1
    gathered = (
        votes.withColumn("part", F.floor(place / CHUNK).cast("bigint"))
        .groupBy("group", "part")
        .agg(F.collect_list(F.struct("value", "weight")).alias("values"))
    )
    profiles = cut(map_lists(gathered, first, _PROFILE))
    while not profiles.where(F.col("part") > 0).isEmpty():
        gathered = (
            profiles.groupBy("group", F.floor(F.col("part") / FAN_IN).cast("bigint").alias("next"))
            .agg(F.collect_list(F.struct("part", "total", "columns")).alias("profiles"))
        )
        profiles = cut(map_lists(gathered, again, _PROFILE))
    wanted = map_lists(profiles.select("group", "columns"), final, "group string, wanted array<string>")
    scores = map_lists(
        votes.where("may").join(wanted, "group").select("group", "value", "weight", "wanted"),
        scored,
        "group string, value string, weight double, score double",
    )
    return scores.groupBy("group").agg(F.min_by("value", F.struct(-F.col("score"), -F.col("weight"), F.col("value"))).alias("value"))


def consensus_values(votes: DataFrame) -> DataFrame:
    """(group, value): the surviving value of every group of `votes` (group, value, weight[, may]).

    Weights of equal values are added up before anything is gathered.  A value
    with more than half of the weight needs no alignment.  A value survives
    only if `may` holds in one of its rows; all others still vote.  Null values
    don't vote; a group of nulls, or without a value that may survive, gives no
    row; an empty table gives none.
    """
    may = F.col("may") if "may" in votes.columns else F.lit(True)
    votes = (
        votes.where(F.col("value").isNotNull())
        .groupBy("group", "value")
        .agg(F.sum("weight").cast("double").alias("weight"), F.max(may).alias("may"))
    )

    def rows(group: list, values: list) -> list[tuple]:
        return [
            (g, closest([(x["value"], x["weight"]) for x in v], frozenset(x["value"] for x in v if x["may"]))) for g, v in zip(group, values)
        ]

    votes = cut(votes)
    count = votes.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("weight").alias("total"),
        F.max_by(F.struct("value", "weight", "may"), F.struct("weight", "value")).alias("top"),
        F.max("may").alias("any"),
    )
    sure = (F.col("top.weight") * 2 > F.col("total")) & F.col("top.may")
    settled = count.where(sure).select("group", F.col("top.value").alias("value"))
    todo = votes.join(count.where(~sure & F.col("any")).select("group", "n"), "group")
    small = todo.where(F.col("n") <= CHUNK).groupBy("group").agg(F.collect_list(F.struct("value", "weight", "may")).alias("values"))
    found = settled.unionByName(map_lists(small, rows, "group string, value string"))
    large = todo.where(F.col("n") > CHUNK)
    return found if large.isEmpty() else found.unionByName(_large_groups(large))


def canonical_source_id(source_id: Column) -> Column:
    """A source id without address, case, file ending, outer space and the spelling of its separators; null if nothing is left."""
    plain = F.regexp_replace(F.lower(source_id), r"(?U)[\s\u200b-\u200d\u2060\ufeff\u00ad]+", "")
    last = F.regexp_extract(F.regexp_replace(plain, r"[/?#]+$", ""), r"([^/]*)$", 1)
    bare = F.regexp_replace(F.regexp_replace(last, r"\.pdf$", ""), "[_‐‑–]", "-")
    return F.nullif(bare, F.lit(""))


def is_pdf_address(url: Column) -> Column:
    """True for a complete web address of a PDF file."""
    return F.coalesce(url.rlike(r"(?i)^https?://[^\s/?#]+\.[^\s/?#]+/[^\s?#]*[^\s/?#]\.pdf$"), F.lit(False))


def survivors(
    records: DataFrame, fields: dict[str, tuple[Column, Column, tuple[Column, ...]]], *, group: str = "group_key", record_id: str = "_id"
) -> DataFrame:
    """(group_id, field_name, record_id) of the surviving value of every field in every group of two or more records.

    `fields` gives, per field, the text that votes, whether it may survive, and
    the ranks that weigh records, best first (nulls weigh least).  group_id is
    the group's smallest record id.  A record that occurs twice counts once; a
    null group key belongs to no group; a field none of whose values may
    survive gives no row; only values of the highest rank survive; among records
    with the surviving value and the same rank the smallest id stands for them.
    Texts are only moved where no value of the highest rank has most of the weight.
    """
    base = records.where(F.col(group).isNotNull())
    ids = base.groupBy(group).agg(F.min(record_id).alias("group_id"), F.max(record_id).alias("last_id")).where(
        F.col("group_id") < F.col("last_id")
    )
    out = None
    for name, (text, eligible, ranks) in fields.items():
        rank = F.struct(*(r.alias(f"r{i}") for i, r in enumerate(ranks)))
        may = base.where(eligible).select(
            F.col(group).alias("key"), F.col(record_id).alias("record_id"), rank.alias("rank"), F.xxhash64(text).alias("value_hash")
        )
        best = may.groupBy("key").agg(F.max("rank").alias("rank"))
        top = cut(
            may.join(best, ["key", "rank"])
            .groupBy("key", "value_hash")
            .agg(F.min("record_id").alias("record_id"), F.count_distinct("record_id").alias("weight"))
        )
        # The heaviest value against the others of its rank and, at most, LOWER.
        count = top.groupBy("key").agg(F.sum("weight").alias("total"), F.max_by(F.struct("record_id", "weight"), F.struct("weight", "record_id")).alias("most"))
        sure = F.col("most.weight") * 2 > F.col("total") + LOWER
        settled = count.where(sure).select("key", "most.record_id")
        open_ = cut(count.where(~sure).select("key"))
        decided = _decided(base.where(eligible), open_, best, group, record_id, rank, text)
        part = (
            settled.unionByName(decided)
            .join(ids.select(F.col(group).alias("key"), "group_id"), "key")
            .select("group_id", F.lit(name).alias("field_name"), "record_id")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _decided(records: DataFrame, keys: DataFrame, best: DataFrame, group: str, record_id: str, rank: Column, text: Column) -> DataFrame:
    """(key, record_id) of the surviving values of the groups `keys`, all records voting with the weights of their ranks."""
    votes = cut(
        records.select(F.col(group).alias("key"), F.col(record_id).alias("record_id"), rank.alias("rank"), text.alias("value"))
        .join(keys, "key")
        .groupBy("key", "record_id", "rank")
        .agg(F.min("value").alias("value"))
        .join(best.select("key", F.col("rank").alias("best")), "key")
        .select("key", "record_id", "value", (F.col("rank") == F.col("best")).alias("may"))
    )
    lower = votes.where(~F.col("may")).groupBy("key").agg(F.count(F.lit(1)).alias("n_lower"))
    weighed = votes.join(lower, "key", "left").select(
        F.col("key").alias("group"), "value", F.when(F.col("may"), 1.0).otherwise(LOWER / F.col("n_lower")).alias("weight"), "may"
    )
    chosen = consensus_values(weighed)
    return votes.where("may").join(chosen.withColumnRenamed("group", "key"), ["key", "value"]).groupBy("key").agg(F.min("record_id").alias("record_id"))
