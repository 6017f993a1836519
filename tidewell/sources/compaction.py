"""Incremental compaction: sealed sessions of a date and fleet, deduplicated, in parts of bounded size, written again only when their seals change."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.sessions import EMPTY, placed, within
from tidewell.sources import records
from tidewell.sources.keyed import Keyed, Merge
from tidewell.sources.segments import decoded, raw_segments
from tidewell.sources.shared import stored

#: JSON bytes of a part.
PART_BYTES = 256 << 20
#: Dates up to which those that changed are named in the scan's filter; beyond, the join alone finds them.
NAMED_DATES = 10_000
BY = ("dt", "fleet")


class Compacted(NamedTuple):
    """A date and fleet that one run wrote anew."""

    dt: str
    fleet: str
    generation: str
    rows_in: int
    rows_out: int
    parts: int


def seals(spark: SparkSession, root: str) -> Keyed:
    """Seals of a lake: fleet_id, session_id, first_at, ended_at, events."""
    return Keyed(spark, f"{root}/seals", ["fleet_id", "session_id"])


def seal(spark: SparkSession, root: str, marks: DataFrame) -> Merge:
    """Put seals in; one that is there already, with the same content, changes nothing."""
    return seals(spark, root).upsert(marks.select("fleet_id", "session_id", "first_at", "ended_at", F.col("events").cast("long").alias("events")))


def marks_of(envelopes: DataFrame) -> DataFrame:
    """Seals of the sessions of ``envelopes`` that have ended, over all their events."""
    of = envelopes.groupBy("fleet_id", "session_id").agg(F.min("emitted_at").alias("first_at"), F.max("emitted_at").alias("ended_at"), F.count("*").alias("events"), F.bool_or(F.col("event_type") == "session_end").alias("ended"))
    return of.where("ended").drop("ended")


def marks(spark: SparkSession, root: str) -> Keyed:
    """What is compacted: dt, fleet, generation, rows_in, rows_out, parts."""
    return Keyed(spark, f"{root}/compacted-marks", list(BY), buckets=4)


def sealed_dates(seals: DataFrame) -> DataFrame:
    """(dt, fleet, session_id, content): each date that a sealed session may have events of."""
    day = lambda c: F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))
    days = seals.where(day("first_at") <= day("ended_at")).withColumn("dt", F.explode(F.sequence(day("first_at"), day("ended_at"))))
    fleet = F.when(F.coalesce("fleet_id", F.lit("")) == "", "none").otherwise(F.col("fleet_id"))
    return days.select(F.col("dt").cast("string").alias("dt"), fleet.alias("fleet"), "session_id", F.xxhash64("session_id", "ended_at", "events").alias("content"))


def generations(sealed: DataFrame) -> DataFrame:
    """(dt, fleet, generation): a name of the seals of a date and fleet, the same in any order.

    It is a hash of sums of hashes, so that no date's seals stand together in a list.
    """
    wide = lambda c: F.sum(c.cast("decimal(38,0)")).cast("string")
    again = F.xxhash64("session_id", "content", F.lit(7))
    return sealed.groupBy(*BY).agg(F.sha2(F.concat_ws("/", F.count("*").cast("string"), wide(F.col("content")), wide(again)), 256).alias("generation"))


def deduplicated(rows: DataFrame) -> DataFrame:
    """The first event of each (date, fleet, session, content hash), with ``_in``: the rows that it stands for; events without content all stay."""
    empty = F.col("content_hash") == EMPTY
    own = F.when(empty, F.concat(F.lit("#"), "event_id")).otherwise(F.col("content_hash"))
    same = Window.partitionBy(*BY, "session_id", own)
    numbered = rows.withColumn("_n", F.row_number().over(same.orderBy("event_id", "envelope_json"))).withColumn("_in", F.when(F.col("_n") == 1, F.count("*").over(same)).otherwise(0))
    return numbered.where(empty | (F.col("_n") == 1)).drop("_n")


def compact(spark: SparkSession, root: str, *, part_bytes: int = PART_BYTES) -> list[Compacted]:
    """Compact the dates and fleets below ``root`` whose seals changed since the last run; what was written.

    Segments below ``root/sessions`` of sealed sessions go to
    ``root/compacted/dt=/fleet=/gen=/part=``, sorted by session and event, one file a part.
    The generation is a name of the seals, and a mark tells the current one, so that readers
    go from one whole generation to the next, a run that fails leaves the old one, and a
    second run over equal seals reads the seals alone and writes nothing.
    """
    have = seals(spark, root).read()
    if have is None:
        return []
    sealed = sealed_dates(have)
    known = marks(spark, root).read()
    wanted = generations(sealed)
    if known is not None:
        wanted = wanted.join(known.select(*BY, "generation"), [*BY, "generation"], "left_anti")
    wanted = stored(wanted, "generations")
    dates = [r.dt for r in wanted.select("dt").distinct().limit(NAMED_DATES + 1).collect()]
    if not dates:
        return []
    rows = raw_segments(spark, f"{root}/sessions")
    if len(dates) <= NAMED_DATES:
        rows = rows.where(F.col("dt").isin(dates))
    ours = sealed.join(wanted, list(BY)).select(*BY, "session_id", "generation")
    rows = rows.join(ours, [*BY, "session_id"])
    # Rows meet their seals and each other once; what is counted over them reads the narrow columns of the outcome.
    kept = stored(within(deduplicated(rows).withColumn("record", F.col("envelope_json")), BY).drop("record"), "deduplicated")
    rows_in = kept.groupBy(*BY).agg(F.sum("_in").alias("rows_in"))
    out = placed(kept.drop("_in"), part_bytes, BY).drop("bytes").withColumnRenamed("generation", "gen")
    order = [*BY, "gen", "part"]
    dealt = out.repartition(*order).sortWithinPartitions(*order, "session_id", "event_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*order).parquet(f"{root}/compacted")
    written = _generation(spark, root, wanted).groupBy(*BY).agg(F.count("*").alias("rows_out"), F.count_distinct("part").alias("parts"))
    report = wanted.join(rows_in, list(BY), "left").join(written, list(BY), "left").na.fill(0, ["rows_in", "rows_out", "parts"])
    report = stored(report.select(*Compacted._fields), "compacted")
    marks(spark, root).upsert(report)
    return sorted(Compacted(*r) for r in report.collect())


def _generation(spark: SparkSession, root: str, current: DataFrame) -> DataFrame:
    """Parts of the generations that ``current`` (dt, fleet, generation) names; a date without rows has no folder."""
    found = [f"{root}/compacted/dt={r.dt}/fleet={r.fleet}/gen={r.generation}" for r in current.select(*BY, "generation").collect()]
    there = [p for p in found if (at := records.store_of(spark, p))[0].exists(at[1])]
    types = "event_id string, emitted_at string, fleet_id string, agent_id string, runtime string, session_id string, event_type string, content_hash string, redaction_status string, envelope_json string"
    schema = f"{types}, dt string, fleet string, gen string, part long"
    return spark.read.schema(schema).option("basePath", f"{root}/compacted").parquet(*there) if there else spark.createDataFrame([], schema)


def read_compacted(spark: SparkSession, root: str, dt: str | None = None, fleet: str | None = None) -> DataFrame:
    """Current compacted events, undecoded, with dt, fleet and part; a date and a fleet prune folders."""
    current = marks(spark, root).read()
    if current is None:
        return _generation(spark, root, spark.createDataFrame([], "dt string, fleet string, generation string"))
    for name, value in (("dt", dt), ("fleet", fleet)):
        current = current.where(F.col(name) == value) if value else current
    return _generation(spark, root, current).drop("gen")


def compacted_envelopes(spark: SparkSession, root: str, **only: str) -> DataFrame:
    return decoded(read_compacted(spark, root, **only))


def prune(spark: SparkSession, root: str) -> int:
    """Delete generations that are not current; how many."""
    current = {(r.dt, r.fleet, r.generation) for r in marks(spark, root).read().collect()}
    fs, at = records.store_of(spark, f"{root}/compacted/dt=*/fleet=*/gen=*")
    gone = 0
    for f in fs.globStatus(at) or []:
        path = f.getPath()
        own = tuple(p.getName().partition("=")[2] for p in (path.getParent().getParent(), path.getParent(), path))
        if own not in current:
            fs.delete(path, True)
            gone += 1
    return gone
