"""Filling fixed-capacity containers with items.

Hierarchical residual packing.  Every partition packs its items best-fit.
The next round merges the residues of several partitions and packs again, until
no two containers fit together.  Two can only be put together if one is at most
half full.  Best fit leaves one of those in a portion, so the next round needs
these and just as many of the emptiest others to take them: what a fuller one
can take, one of these can take too.  The rest is final, which keeps the
residue as small as the number of portions.
Only ids and sizes are moved, never texts; what each container holds is looked
up at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.llm.inputs import map_lists
from paperlake.llm.tokens import CAPACITY, TOKENIZERS, cut, encoding
from paperlake.session import cut as written

#: Items or containers that a task holds at once; what it packs is packed in portions of so many.
PORTION = 500_000
FAN_IN = 8


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The container of every item, largest items first, each into the fullest container that still takes it.

    One bit per number of free places says whether a container has so many
    left, so the best one is found by two bit operations.
    """
    out = [0] * len(sizes)
    free: dict[int, list[int]] = {}
    bits = n = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = bits >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            stack = free[room]
            container = stack.pop()
            if not stack:
                bits &= ~(1 << room)
        else:
            container, room = n, capacity
            n += 1
        out[i] = container
        left = room - size
        if left:
            free.setdefault(left, []).append(container)
            bits |= 1 << left
    return out


def item_sizes(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, piece_no, n_tokens): every text as one item, a text above the capacity as its pieces.

    A null or empty text is an item of no tokens; it takes one place, so that
    a container holds a bounded number of items.
    """

    def rows(doc: list, text: list) -> list[tuple]:
        out = []
        encode = encoding(folder).encode_ordinary
        for d, t in zip(doc, text):
            if not t:
                out.append((d, 0, 0))
            elif len(t) * 4 <= capacity or len(t.encode()) <= capacity:
                out.append((d, 0, len(encode(t))))
            else:
                out += [(d, i, p[3]) for i, p in enumerate(cut(t, capacity, 0, folder, cohesive=False))]
        return out

    return map_lists(documents.select("doc_id", "text"), rows, "doc_id bigint, piece_no int, n_tokens int")


def _pack(items: DataFrame, capacity: int, size: str, schema: str, number: int) -> DataFrame:
    """One round: the rows of `items` with the bin that each is put into, which no other round or partition uses."""

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        base, made = (number << 56) | (TaskContext.get().partitionId() << 32), 0

        def packed(rows: list) -> pd.DataFrame:
            nonlocal made
            out = pd.concat(rows, ignore_index=True)
            at = best_fit(out[size].clip(lower=1).tolist(), capacity)
            out["bin"] = [base + made + b for b in at]
            made += max(at) + 1
            return out

        waiting: list = []
        n = 0
        for batch in batches:
            if len(batch):
                waiting.append(batch)
                n += len(batch)
            if n >= PORTION:
                yield packed(waiting)
                waiting, n = [], 0
        if waiting:
            yield packed(waiting)

    return items.mapInPandas(run, schema)


def _residue(bins: DataFrame, capacity: int) -> DataFrame | None:
    """The bins of the next round: those at most half full, and of the others the emptiest, as many; None if none fit together."""
    # One row for each possible size.
    count = dict(sorted((r.used, r.n) for r in bins.groupBy("used").agg(F.count(F.lit(1)).alias("n")).collect()))
    small = sum(n for used, n in count.items() if 2 * used <= capacity)
    others = {used: n for used, n in count.items() if 2 * used > capacity and used + min(count) <= capacity}
    if small < 1 or small == 1 and not others:
        return None
    kept, wanted = F.col("used") * 2 <= capacity, small
    for used, n in others.items():
        if n > wanted:
            # Of equals just as many as are wanted.
            return bins.where(kept).unionByName(bins.where(F.col("used") == used).orderBy("bin").limit(wanted))
        kept = kept | (F.col("used") == used)
        wanted -= n
        if not wanted:
            break
    return bins.where(kept)


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, doc_id, piece_no, n_tokens) for items (doc_id, piece_no, n_tokens) of at most the capacity.

    Items of no tokens take one place.  An empty table gives no rows; repeated
    rows are separate items.  container_id is the round and a number within it;
    it is fixed when the round is written.
    """
    placed = written(
        _pack(items.select("doc_id", "piece_no", "n_tokens"), capacity, "n_tokens", "doc_id bigint, piece_no int, n_tokens int, bin bigint", 0)
    )
    bins = placed.groupBy("bin").agg(F.sum(F.greatest("n_tokens", F.lit(1))).cast("int").alias("used"))
    partitions = max(1, placed.rdd.getNumPartitions())
    moves: list[DataFrame] = []
    while True:
        bins = written(bins)
        residue = _residue(bins, capacity)
        if residue is None:
            break
        partitions = -(-partitions // FAN_IN)
        spread = residue.select(F.col("bin").alias("part"), "used").repartition(partitions, F.xxhash64("part"))
        moved = written(_pack(spread, capacity, "used", "part bigint, used int, bin bigint", len(moves) + 1))
        moves.append(moved.select("part", "bin"))
        bins = moved.groupBy("bin").agg(F.sum("used").cast("int").alias("used"))
    # Where every bin went in the end, from the last round to the first.
    at = None
    for move in reversed(moves):
        at = move.select("part", "bin") if at is None else move.join(at.select(F.col("part").alias("bin"), F.col("bin").alias("last")), "bin", "left").select(
            "part", F.coalesce("last", "bin").alias("bin")
        )
    if at is not None:
        placed = placed.join(at.select(F.col("part").alias("bin"), F.col("bin").alias("last")), "bin", "left").withColumn("bin", F.coalesce("last", "bin"))
    container = F.concat_ws("-", F.shiftright("bin", 56).cast("string"), F.expr(f"bin & {(1 << 56) - 1}").cast("string"))
    return placed.select(container.alias("container_id"), "doc_id", "piece_no", "n_tokens")


def containers(documents: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZERS) -> DataFrame:
    """(container_id, doc_id, piece_no, n_tokens): every document's container."""
    return pack(item_sizes(documents, capacity, folder), capacity)
