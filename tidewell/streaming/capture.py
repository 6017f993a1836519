"""Live capture: a spool of NDJSON lines to bronze segments, sealed sessions and a live roster, as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.sources.segments import ENVELOPE, raw_segments, write_batch
from tidewell.streaming.spool import SpoolSource


def spool(spark: SparkSession, path: str) -> DataFrame:
    """Envelopes of the spool's lines as a stream (see SpoolSource); bad lines are skipped."""
    spark.dataSource.register(SpoolSource)
    return parsed(spark.readStream.format(SpoolSource.name()).option("path", path).load())


def parsed(lines: DataFrame) -> DataFrame:
    """Envelopes of JSON lines (value); those that are no envelope are skipped."""
    e = lines.select(F.from_json("value", ENVELOPE + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return e.where("e is not null and e._corrupt is null and e.event_id is not null").select("e.*").drop("_corrupt")


def to_bronze(envelopes: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append segments (see write_batch()); a batch that is run again overwrites what it wrote, so nothing is there twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return envelopes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bronze(spark: SparkSession, path: str) -> DataFrame:
    """Segments that to_bronze() wrote; decoded() or read_segments() gives their envelopes."""
    return raw_segments(spark, path)


def _timed(envelopes: DataFrame, late: str) -> DataFrame:
    return envelopes.withColumn("ts", F.try_to_timestamp("emitted_at")).withWatermark("ts", late)


def closed_sessions(envelopes: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions closed by ``gap`` without events: session_id, begin, end, events, ended (a session_end was seen).

    State is dropped once the watermark passes a session, and later rows open a new one.
    """
    e = _timed(envelopes, late)
    out = e.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.bool_or(F.col("event_type") == "session_end").alias("ended"))
    return out.select("session_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events", "ended")


def event_rates(envelopes: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events of each type and agent in tumbling windows."""
    return _timed(envelopes, late).groupBy(F.window("ts", window).alias("w"), "agent_id", "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), "agent_id", "event_type", "n")


def once(envelopes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event once, whatever the spool repeats within the watermark."""
    return _timed(envelopes, late).dropDuplicatesWithinWatermark(["event_id"])
