"""Collections kept as immutable snapshots.

A collection is a folder of segments, which are never changed, and of files
that name the segments of each version.  An insert adds a segment; an update or
delete writes one new segment in one pass, which also counts what it matches.
The file of the next version is created only if nobody else made it, so that
of two writers at a time one fails with WriteConflict and none is lost.
Readers of an older version are not disturbed; vacuum() removes what no
version that is kept needs.  `_seq` is the order of insertion; it gives the
natural order, breaks ties and is never shown.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperlake.functions.scalars import new_id
from paperlake.operators.predicates import compile_filter
from paperlake.operators.reads import get_many, get_one
from paperlake.schemas import COLLECTIONS, UNIQUE, fail_on_violation, violations, with_defaults


class DuplicateKey(ValueError):
    """A unique field already has the value."""


class WriteConflict(RuntimeError):
    """Another writer made the next version first."""


class NotConnected(RuntimeError):
    """The catalog was closed or never opened."""


@dataclass(frozen=True)
class Created:
    success: bool
    created_count: int
    ids: list[str]
    message: str


@dataclass(frozen=True)
class Updated:
    success: bool
    matched_count: int
    modified_count: int
    message: str


@dataclass(frozen=True)
class Deleted:
    success: bool
    deleted_count: int
    message: str


def _now() -> datetime:
    """Now in UTC, without zone, in milliseconds."""
    t = datetime.now(timezone.utc).replace(tzinfo=None)
    return t.replace(microsecond=t.microsecond // 1000 * 1000)


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, unique: tuple[str, ...] = ()) -> None:
        self.spark, self.name, self.unique = spark, name, unique
        self.path = f"{root.rstrip('/')}/{name}"
        self.schema = StructType.fromDDL(schema)
        self.stored = StructType.fromDDL(f"{schema}, _seq bigint")

    # The folder is reached through Hadoop, so it may lie in any file system.
    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(n.removeprefix("version-")) for n in names if n.startswith("version-"))

    def version(self) -> int:
        return max(self._versions(), default=0)

    def _state(self, version: int) -> tuple[list[str], int]:
        """Segments of a version and the next place in the order of insertion."""
        if not version:
            return [], 0
        fs, mark = self._fs(f"{self.path}/version-{version}")
        stream = fs.open(mark)
        try:
            state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return state["segments"], state["next"]

    def _of(self, segments: list[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*(f"{self.path}/{s}" for s in segments))

    def rows(self) -> DataFrame:
        """The current snapshot with `_seq`."""
        return self._of(self._state(self.version())[0])

    def _segment(self, df: DataFrame) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        df.select(*self.stored.fieldNames()).write.parquet(f"{self.path}/{name}")
        return name

    def _drop(self, segment: str) -> None:
        fs, p = self._fs(f"{self.path}/{segment}")
        fs.delete(p, True)

    def _commit(self, version: int, segments: list[str], following: int) -> None:
        """Make `version`, unless there is one already."""
        fs, mark = self._fs(f"{self.path}/version-{version}")
        try:
            stream = fs.create(mark, False)
        except Py4JJavaError as e:
            raise WriteConflict(self.name) from e
        try:
            stream.write(bytearray(json.dumps({"segments": segments, "next": following}).encode()))
        finally:
            stream.close()

    def vacuum(self, keep: int = 1) -> int:
        """Remove all but the latest `keep` versions and the segments that none of these has; returns how many were removed."""
        versions = self._versions()
        kept = versions[-keep:]
        used = {s for v in kept for s in self._state(v)[0]}
        fs, p = self._fs(self.path)
        gone = [x.getPath() for x in fs.listStatus(p)] if versions else []
        gone = [x for x in gone if x.getName().startswith("segment-") and x.getName() not in used]
        for v in versions[:-keep]:
            fs.delete(self._fs(f"{self.path}/version-{v}")[1], False)
        for x in gone:
            fs.delete(x, True)
        return len(gone)

    def read(self, validate: bool = False) -> DataFrame:
        """Rows as they are shown: with defaults for fields never stored; `validate` fails on the first invalid row."""
        df = self.rows()
        if validate and self.name in COLLECTIONS:
            df = df.where(fail_on_violation(self.name))
        if self.name in COLLECTIONS:
            df = df.select(*with_defaults(self.name, self.stored.fieldNames()))
        return df

    def create_many(self, objects: list[dict[str, Any]] | DataFrame) -> Created:
        """Append rows; each gets an id and both times.  Order of a list is kept, of a DataFrame not defined."""
        if isinstance(objects, DataFrame):
            batch = objects
        else:
            if not objects:
                return Created(False, 0, [], "No documents to create")
            fields = [f for f in self.schema.fields if f.name not in ("_id", "created_at", "updated_at")]
            kept = StructType([*fields, StructType.fromDDL("_place bigint")[0]])
            batch = self.spark.createDataFrame(
                [[o.get(f.name) for f in fields] + [i] for i, o in enumerate(objects)], kept
            )
        for name in self.schema.fieldNames():
            if name not in batch.columns and name not in ("_id", "created_at", "updated_at"):
                batch = batch.withColumn(name, F.lit(None).cast(self.schema[name].dataType))
        now = _now()
        if "_place" not in batch.columns:
            batch = batch.withColumn("_place", F.monotonically_increasing_id())
        version = self.version()
        segments, first = self._state(version)
        for field in self.unique:
            taken = self._of(segments).select(field, F.lit(True).alias("stored")).unionByName(batch.select(field, F.lit(False).alias("stored")))
            twice = taken.where(F.col(field).isNotNull()).groupBy(field).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("stored")).alias("new"))
            if not twice.where("n > 1 AND new > 0").isEmpty():
                raise DuplicateKey(field)
        seq = F.col("_place") + F.lit(first)
        nonce = F.lit(uuid.uuid4().hex)
        batch = batch.withColumns(
            {"_seq": seq, "_id": new_id(nonce, seq), "created_at": F.lit(now).cast("timestamp_ntz"), "updated_at": F.lit(now).cast("timestamp_ntz")}
        ).select(*self.stored.fieldNames())
        segment = self._segment(batch)
        added = self._of([segment])
        n, last = added.agg(F.count(F.lit(1)), F.max("_seq")).first()
        if not n:
            self._drop(segment)
            return Created(False, 0, [], "No documents to create")
        self._commit(version + 1, [*segments, segment], last + 1)
        # The ids of a list are returned in its order; those of a table are left in the collection.
        ids = [] if isinstance(objects, DataFrame) else [r._id for r in added.orderBy("_seq").select("_id").collect()]
        return Created(True, n, ids, f"Created {n} documents")

    def create_one(self, obj: dict[str, Any]) -> Created:
        return self.create_many([obj])

    @staticmethod
    def _by_id(id: str) -> dict[str, Any]:
        if len(id) != 24 or any(c not in "0123456789abcdefABCDEF" for c in id):
            raise ValueError(f"malformed id {id!r}")
        return {"_id": id}

    def get_by_id(self, id: str) -> dict[str, Any] | None:
        return self.get_one(self._by_id(id))

    def get_one(self, query: dict[str, Any] | None = None) -> dict[str, Any] | None:
        row = get_one(self.rows(), query, "_seq").drop("_seq").first()
        return row.asDict(recursive=True) if row else None

    def get_many(self, query: dict[str, Any] | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
        return get_many(self.rows(), query, skip, limit, "_seq").drop("_seq")

    def count_documents(self, query: dict[str, Any] | None = None) -> int:
        return self.rows().where(compile_filter(query, self.stored)).count()

    def _update(self, query: dict[str, Any] | None, patch: dict[str, Any], one: bool) -> Updated:
        word = "Document" if one else "Documents"
        if not patch:
            return Updated(False, 0, 0, "No fields to update")
        unknown = set(patch) - set(self.schema.fieldNames())
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        version = self.version()
        segments, following = self._state(version)
        if not segments:
            return Updated(False, 0, 0, f"{word} not found for update")
        df = self._of(segments)
        matches = self._matches(df, query, one)
        new = {k: F.lit(v).cast(self.schema[k].dataType) for k, v in {**patch, "updated_at": _now()}.items()}
        changes = F.lit(False)
        for k, v in new.items():
            changes = changes | ~F.col(k).eqNullSafe(v)
        counts = Observation()
        seen = df.observe(counts, F.count_if(matches).alias("matched"), F.count_if(matches & changes).alias("modified"))
        segment = self._segment(seen.withColumns({k: F.when(matches, v).otherwise(F.col(k)) for k, v in new.items()}))
        n, modified = counts.get["matched"], counts.get["modified"]
        if not n:
            self._drop(segment)
            return Updated(False, 0, 0, f"{word} not found for update")
        self._commit(version + 1, [segment], following)
        if modified:
            return Updated(True, n, modified, f"{word} updated successfully")
        return Updated(False, n, 0, f"{word} found but no changes made")

    def _matches(self, df: DataFrame, query: dict[str, Any] | None, one: bool):
        # Never a constant, which would let the plan skip the pass that counts.
        matches = compile_filter(query, self.stored) & F.col("_seq").isNotNull()
        if one:
            first = df.where(matches).agg(F.min("_seq")).first()[0]
            matches = F.col("_seq") == F.lit(first) if first is not None else F.lit(False)
        return matches

    def update_one(self, query: dict[str, Any], patch: dict[str, Any] | None = None, **extra: Any) -> Updated:
        return self._update(query, {**(patch or {}), **extra}, True)

    def update_many(self, query: dict[str, Any], patch: dict[str, Any] | None = None, **extra: Any) -> Updated:
        return self._update(query, {**(patch or {}), **extra}, False)

    def update_by_id(self, id: str, patch: dict[str, Any] | None = None, **extra: Any) -> Updated:
        return self.update_one(self._by_id(id), patch, **extra)

    def merge(self, changes: DataFrame) -> Updated:
        """Set the columns of `changes` in the rows with the same `_id`, nulls included, all in one pass.

        Ids that the collection lacks are passed over; an id given twice is an error.
        """
        version = self.version()
        segments, following = self._state(version)
        fields = [c for c in changes.columns if c != "_id"]
        unknown = set(fields) - set(self.schema.fieldNames())
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        if not segments:
            return Updated(False, 0, 0, "Documents not found for update")
        now = F.lit(_now()).cast("timestamp_ntz")
        if not changes.groupBy("_id").count().where("count > 1").isEmpty():
            raise DuplicateKey("_id")
        new = changes.select("_id", F.struct(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in fields)).alias("_new"))
        df = self._of(segments).join(new, "_id", "left")
        matches = F.col("_new").isNotNull()
        different = F.lit(False)
        for c in fields:
            different = different | ~F.col(c).eqNullSafe(F.col("_new")[c])
        counts = Observation()
        seen = df.observe(counts, F.count_if(matches).alias("matched"), F.count_if(matches & different).alias("modified"))
        patched = {c: F.when(matches, F.col("_new")[c]).otherwise(F.col(c)) for c in fields} | {
            "updated_at": F.when(matches, now).otherwise(F.col("updated_at"))
        }
        segment = self._segment(seen.withColumns(patched))
        n, modified = counts.get["matched"], counts.get["modified"]
        if not n:
            self._drop(segment)
            return Updated(False, 0, 0, "Documents not found for update")
        self._commit(version + 1, [segment], following)
        return Updated(modified > 0, n, modified, "Documents updated successfully" if modified else "Documents found but no changes made")

    def _delete(self, query: dict[str, Any] | None, one: bool) -> Deleted:
        word = "Document" if one else "Documents"
        version = self.version()
        segments, following = self._state(version)
        if not segments:
            return Deleted(False, 0, f"{word} not found for deletion")
        df = self._of(segments)
        matches = self._matches(df, query, one)
        counts = Observation()
        segment = self._segment(df.observe(counts, F.count_if(matches).alias("matched")).where(~matches))
        n = counts.get["matched"]
        if not n:
            self._drop(segment)
            return Deleted(False, 0, f"{word} not found for deletion")
        self._commit(version + 1, [segment], following)
        return Deleted(True, n, f"{word} deleted successfully")

    def delete_one(self, query: dict[str, Any] | None = None) -> Deleted:
        return self._delete(query, True)

    def delete_many(self, query: dict[str, Any] | None = None) -> Deleted:
        return self._delete(query, False)

    def delete_by_id(self, id: str) -> Deleted:
        return self.delete_one(self._by_id(id))

    def invalid(self) -> DataFrame:
        """Rows that break a bound or enumeration, with the names of the fields; reads don't fail on them."""
        broken = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in violations(self.name).items())))
        return self.rows().select("_id", broken.alias("fields")).where(F.size("fields") > 0)


class Catalog:
    """Opens collections by name and keeps them until it is closed."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._open: dict[str, Collection] | None = {}

    def collection(self, name: str, schema: str | None = None, unique: tuple[str, ...] | None = None) -> Collection:
        if self._open is None:
            raise NotConnected(name)
        if name not in self._open:
            if schema is None and name not in COLLECTIONS:
                raise KeyError(name)
            self._open[name] = Collection(self.spark, self.root, name, schema or COLLECTIONS[name], UNIQUE.get(name, ()) if unique is None else unique)
        return self._open[name]

    def healthy(self) -> bool:
        if self._open is None:
            return False
        try:
            return self.spark.range(1).count() == 1
        except Exception:
            return False

    def close(self) -> None:
        self._open = None


def numbered(df: DataFrame, order: str) -> DataFrame:
    """A table with `_seq`, for stored tables that have none.  Numbers follow `order` within one global sort."""
    ordered = df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    return ordered.withColumn("_seq", F.monotonically_increasing_id())


__all__ = ["Catalog", "Collection", "Created", "Deleted", "DuplicateKey", "NotConnected", "Updated", "WriteConflict", "numbered"]
