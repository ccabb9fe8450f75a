"""References to records that do not exist.

Every change to a table becomes signed deltas on a key: a child row that starts
to refer to a key adds +1 to its references, one that stops adds -1, and a
parent row does the same to the key's existence.  Deltas add up in any order,
so a state may be built from a whole table, from a batch of changes, or from an
old state plus a batch.  A key whose references are positive and whose
existence is zero is an orphan reference.

The sums are combined before the shuffle, so a key that a third of all rows
refer to travels as one row per input partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.session import cut

#: A key with at least this many references is spread over SALTS rows when the
#: state is joined back to the child rows.
HOT_REFERENCES = 100_000
SALTS = 32
#: Hot keys up to this number are broadcast to the child rows; there is one for HOT_REFERENCES rows at most.
MOST_HOT = 50_000


def usable(reference: Column) -> Column:
    """True for a reference that is neither null nor blank."""
    return F.coalesce(F.length(F.regexp_replace(reference, r"(?U)\s+", "")) > 0, F.lit(False))


def reference_deltas(children: DataFrame, key: str, created: str, sign: Column | int = 1) -> DataFrame:
    """Signed reference counts of child rows; null and blank references are none."""
    return children.where(usable(F.col(key))).select(
        F.col(key).alias("key"),
        (F.lit(sign) if isinstance(sign, int) else sign).cast("long").alias("refs"),
        F.lit(0).cast("long").alias("parents"),
        F.col(created).alias("first_ref_at"),
        F.lit(None).cast("timestamp_ntz").alias("parent_at"),
    )


def existence_deltas(parents: DataFrame, key: str, created: str, sign: Column | int = 1) -> DataFrame:
    """Signed existence counts of parent rows; a null key names nothing."""
    return parents.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"),
        F.lit(0).cast("long").alias("refs"),
        (F.lit(sign) if isinstance(sign, int) else sign).cast("long").alias("parents"),
        F.lit(None).cast("timestamp_ntz").alias("first_ref_at"),
        F.col(created).alias("parent_at"),
    )


def fold(*deltas: DataFrame) -> DataFrame:
    """One row per key: the sums of all deltas, and of older states, given.

    `first_ref_at` and `parent_at` are the earliest creation times seen; a
    deletion does not move them forward, so they only ever prove that a
    reference is not late.
    """
    merged = reduce(DataFrame.unionByName, deltas)
    return merged.groupBy("key").agg(
        F.sum("refs").alias("refs"),
        F.sum("parents").alias("parents"),
        F.min("first_ref_at").alias("first_ref_at"),
        F.min("parent_at").alias("parent_at"),
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys that are referred to and do not exist."""
    return state.where((F.col("refs") > 0) & (F.col("parents") <= 0))


def changed(before: DataFrame, after: DataFrame, row_id: str, key: str, created: str, side: str) -> DataFrame:
    """Deltas that lead from one version of a table to the next.

    `side` is "child" or "parent".  Rows that are the same in both versions
    cancel in the fold, so both versions are simply added with opposite signs.
    """
    make = reference_deltas if side == "child" else existence_deltas
    old, new = (x.dropDuplicates([row_id]) for x in (before, after))
    return make(old, key, created, -1).unionByName(make(new, key, created, 1))


def broken_references(
    children: DataFrame,
    parents: DataFrame,
    *,
    child_id: str,
    child_key: str,
    parent_key: str,
    created: str = "created_at",
) -> DataFrame:
    """Child rows whose reference is `missing` or `late`.

    Returns child_id, created_at, ref_key, ref_state.  `missing`: no parent has
    the key, compared exactly.  `late`: parents exist and the earliest of them
    was created after the child.  A null creation time on either side leaves a
    reference to an existing key unreported.  Exact repeats of a child row
    count once; null or blank references are no cases; an empty parent table
    makes every reference missing, an empty child table gives no rows.  Columns
    beyond those named are ignored, whatever their names.
    """
    child = children.select(
        F.col(child_id).alias("child_id"), F.col(child_key).alias("key"), F.col(created).alias("created_at")
    ).where(usable(F.col("key")))
    state = fold(reference_deltas(child, "key", "created_at"), existence_deltas(parents, parent_key, created))
    # A key whose first reference is no older than its parent cannot be late.
    suspect = state.where(
        (F.col("refs") > 0)
        & ((F.col("parents") <= 0) | (F.col("first_ref_at") < F.col("parent_at")))
    )
    suspect = cut(suspect.select("key", "refs", "parents", "parent_at"))
    is_hot = F.col("refs") >= HOT_REFERENCES
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    spread = suspect.select("key", "parents", "parent_at", F.explode(copies).alias("salt"))
    own = F.pmod(F.xxhash64("child_id"), F.lit(SALTS)).cast("int")
    hot = suspect.where(is_hot).select("key", F.lit(True).alias("hot"))
    if hot.limit(MOST_HOT + 1).count() <= MOST_HOT:
        placed = child.join(F.broadcast(hot), "key", "left").withColumn("salt", F.when(F.col("hot"), own).otherwise(F.lit(-1))).drop("hot")
    else:
        # Too many to tell every row whether its key is one: each takes part for the plain copy and for its salt.
        placed = child.withColumn("salt", F.explode(F.array(F.lit(-1), own)))
    return (
        placed.join(spread, ["key", "salt"])
        .withColumn(
            "ref_state",
            F.when(F.col("parents") <= 0, "missing").when(F.col("parent_at") > F.col("created_at"), "late"),
        )
        .where(F.col("ref_state").isNotNull())
        .select("child_id", "created_at", F.col("key").alias("ref_key"), "ref_state")
        .distinct()
    )


def reference_report(broken: DataFrame) -> DataFrame:
    """Broken references counted per table, month of creation and state (month null where unknown)."""
    return broken.groupBy(
        "child_table", F.date_format("created_at", "yyyy-MM").alias("month"), "ref_state"
    ).agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct("ref_key").alias("n_keys"))
