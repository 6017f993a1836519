"""Tables of one row a key, kept by copy-on-write merges: Parquet in buckets of the key's hash, behind numbered manifests."""

from __future__ import annotations

import time
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tidewell.sources import records
from tidewell.sources.shared import stored

#: Buckets of a new table, and times that a merge begins again after another writer was first.
BUCKETS, TRIES = 16, 20


class Merge(NamedTuple):
    """What a merge did: the version that holds its rows, and counts; nothing was written if ``rewritten`` is empty."""

    version: int
    rewritten: dict[int, int]  #: rows of each bucket that was written anew
    inserted: int
    updated: int
    same: int


class Keyed:
    """A table below ``root`` with one row for each value of ``keys``.

    A manifest names, for each bucket, the folder that holds its rows and how many there
    are.  A merge writes the buckets that change into a new folder and takes the next
    manifest number; buckets without changes stay where they are, and readers of the
    manifest before see the table as it was.  If another writer has the number, the merge is
    made again over what that one left, so no update is lost.

    ``buckets`` holds for a new table and stays; it is the parallelism of a whole merge and
    bounds what a key's lookup reads.  The driver sees one entry a bucket.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    def _now(self) -> tuple[int, int, dict]:
        """The greatest manifest number, and number and body of the newest complete one."""
        top, number, body = records.newest(self.spark, f"{self.root}/manifest")
        return top, number, body or {"buckets": self.buckets, "at": {}, "rows": {}, "schema": None}

    def version(self) -> int:
        return self._now()[1]

    def _bucket(self, n: int):  # noqa: ANN202
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _rows(self, body: dict, only: set[int] | None = None) -> DataFrame | None:
        """Rows of some buckets with ``_bucket``; None if there are none."""
        if not body["schema"]:
            return None
        schema = StructType.fromJson(body["schema"])
        paths = [f"{self.root}/data/_made={folder}/_bucket={b}" for b, folder in body["at"].items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("_bucket", F.lit(0))
        read = self.spark.read.schema(StructType([*schema.fields]).add("_bucket", IntegerType()))
        return read.option("basePath", f"{self.root}/data").parquet(*paths).select(*schema.names, "_bucket")

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows, of the newest version or a given one; None before the first merge."""
        body = self._now()[2] if version is None else records.record(self.spark, f"{self.root}/manifest", version)
        rows = self._rows(body)
        return None if rows is None else rows.drop("_bucket")

    def lookup(self, wanted: list[tuple]) -> DataFrame | None:
        """The rows of some keys, from the buckets that they are in."""
        *_, body = self._now()
        if (all_ := self._rows(body)) is None:
            return None
        asked = self.spark.createDataFrame(wanted, StructType([all_.schema[k] for k in self.keys]))
        only = {r[0] for r in asked.select(self._bucket(body["buckets"])).distinct().collect()}
        return self._rows(body, only).join(F.broadcast(asked), self.keys, "left_semi").drop("_bucket")

    def upsert(self, rows: DataFrame) -> Merge:
        """Put ``rows`` in, over rows with the same keys.

        Of several rows with the same keys the greatest stays, so the result does not hang on
        their order.  Rows that are there already, with all values equal, change nothing.
        Columns that one side lacks are null in its rows.
        """
        best = rows.groupBy(*self.keys).agg(F.max(F.struct(*[c for c in rows.columns if c not in self.keys])).alias("_v")).select(*self.keys, "_v.*").select(*rows.columns)
        best = stored(best, "keyed-rows")
        for _ in range(TRIES):
            if merge := self._merge(best):
                return merge
        raise RuntimeError(f"{self.root}: other writers were first {TRIES} times")

    def _merge(self, rows: DataFrame) -> Merge | None:
        top, number, body = self._now()
        n = body["buckets"]
        rows = rows.withColumn("_bucket", self._bucket(n))
        old = self._rows(body)
        if old is None:
            schema, held, marked = rows.drop("_bucket").schema, None, rows.withColumn("_state", F.lit("inserted"))
        else:
            held, rows = old, old.limit(0).unionByName(rows, allowMissingColumns=True)
            held = held.unionByName(rows.limit(0), allowMissingColumns=True)
            schema = rows.drop("_bucket").schema
            values = [c for c in schema.names if c not in self.keys]
            before = held.select(*self.keys, F.struct(*values).alias("_old"))
            now = rows.join(before, self.keys, "left")
            state = F.when(F.col("_old").isNull(), "inserted").when(F.col("_old").eqNullSafe(F.struct(*values)), "same").otherwise("updated")
            marked = now.withColumn("_state", state).drop("_old")
        counts = {(r._bucket, r._state): r["count"] for r in marked.groupBy("_bucket", "_state").count().collect()}
        total = lambda state: sum(c for (_, s), c in counts.items() if s == state)
        touched = sorted({b for b, s in counts if s != "same"})
        if not touched and (body["schema"] or not counts):
            return Merge(number, {}, 0, 0, total("same"))
        new = rows.where(F.col("_bucket").isin(touched))
        if held is not None:
            stay = held.where(F.col("_bucket").isin(touched)).join(new.select(*self.keys), self.keys, "left_anti")
            new = stay.unionByName(new)
        folder = uuid.uuid4().hex
        out = f"{self.root}/data/_made={folder}"
        new.repartitionById(n, "_bucket").sortWithinPartitions("_bucket", *self.keys).write.partitionBy("_bucket").parquet(out)
        inserted = {b: counts.get((b, "inserted"), 0) for b in touched}
        size = {b: body["rows"].get(str(b), 0) + inserted[b] for b in touched}
        made = {
            "buckets": n, "keys": self.keys, "schema": schema.jsonValue(),
            "at": body["at"] | {str(b): folder for b in touched}, "rows": body["rows"] | {str(b): size[b] for b in touched},
        }
        if not records.take(self.spark, f"{self.root}/manifest", top + 1, made):
            records.delete(self.spark, out)
            return None
        return Merge(top + 1, size, total("inserted"), total("updated"), total("same"))

    def prune(self, keep: int = 2, older_s: float = 86400.0) -> list[str]:
        """Delete folders that none of the ``keep`` newest versions names and that nobody wrote to for ``older_s``; their names."""
        held, at = set(), f"{self.root}/manifest"
        for number in records.numbers(self.spark, at)[-keep:]:
            held |= set((records.record(self.spark, at, number) or {"at": {}})["at"].values())
        fs, data = records.store_of(self.spark, f"{self.root}/data/*")
        found = [(f.getPath().getName().removeprefix("_made="), f.getModificationTime() / 1000) for f in fs.globStatus(data) or []]
        gone = sorted(name for name, at_s in found if name not in held and time.time() - at_s >= older_s)
        for name in gone:
            records.delete(self.spark, f"{self.root}/data/_made={name}")
        return gone
