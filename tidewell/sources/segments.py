"""Captured envelopes at rest: Hive-partitioned Parquet segments with typed columns and the whole record as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.functions.text import content_hash

#: Schema of an envelope record.
ENVELOPE = (
    "schema_version int, event_id string, emitted_at string, fleet_id string, agent_id string, runtime string, session_id string, "
    "message_id string, cwd string, git_sha string, event_type string, role string, content string, content_hash string, "
    "tool struct<name: string, input: string, input_hash: string, result: string, exit_code: int, duration_ms: long, paths: array<string>>, "
    "usage struct<model: string, input_tokens: long, output_tokens: long, cache_read_tokens: long, cache_write_tokens: long, cost_usd: double>, "
    "injected_context array<struct<claim_id: string, source: string, observed_by: string>>, redaction struct<status: string, rules_fired: array<string>>, imported boolean"
)
COLUMNS = ("event_id", "emitted_at", "fleet_id", "agent_id", "runtime", "session_id", "event_type", "content_hash", "redaction_status", "envelope_json")
RUNTIMES = ("claude_code", "cursor", "hermes")
#: Path of a segment: date, fleet, runtime, agent, session.
PATH = r"(?:^|/)sessions/dt=([^/]+)/fleet=([^/]+)/runtime=([^/]+)/agent=([^/]+)/session=([^/]+)/[^/]+$"
#: Partition columns of a batch of segments.
BATCH = ("dt", "fleet", "batch")


def conformed(rows: DataFrame) -> DataFrame:
    """All fields of an envelope, null where ``rows`` has none; other columns go."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ENVELOPE).fields])


def encoded(envelopes: DataFrame) -> DataFrame:
    """The ten text columns of a segment, from rows with ENVELOPE's fields."""
    record = F.to_json(F.struct(*[F.col(c) for c in envelopes.columns]))
    status = F.coalesce("redaction.status", F.lit("clean"))
    return envelopes.withColumn("envelope_json", record).withColumn("redaction_status", status).select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in COLUMNS])


def decoded(segments: DataFrame) -> DataFrame:
    """Envelopes of segments; records that are no JSON are skipped."""
    e = segments.select(F.from_json("envelope_json", ENVELOPE + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("e")).where("e is not null and e._corrupt is null")
    return e.select("e.*").drop("_corrupt")


def write_segments(envelopes: DataFrame, path: str, mode: str = "append") -> None:
    """Segments below ``path`` (which ends in ``sessions``), by date, fleet, runtime, agent and session as partition_of() reads them."""
    rows = encoded(envelopes)
    parts = rows.withColumn("dt", F.substring("emitted_at", 1, 10)).withColumn("fleet", F.col("fleet_id")).withColumn("agent", F.col("agent_id")).withColumn("session", F.col("session_id"))
    parts.write.mode(mode).partitionBy("dt", "fleet", "runtime", "agent", "session").option("compression", "snappy").parquet(path)


def write_batch(envelopes: DataFrame, path: str, batch: int) -> None:
    """Segments of one numbered batch below ``path``, by date, fleet and batch; writing a batch again replaces what it wrote.

    Sessions stay columns, so that a batch makes one file a task and date, not one a session.
    """
    rows = encoded(envelopes).withColumns({"dt": F.substring("emitted_at", 1, 10), "fleet": F.col("fleet_id"), "batch": F.lit(batch)})
    rows = rows.withColumns({c: F.when(F.col(c) == "", "none").otherwise(F.col(c)) for c in ("dt", "fleet")})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BATCH).option("compression", "snappy").parquet(path)


def raw_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with dt and fleet, undecoded; date and fleet filters prune partitions."""
    types = ", ".join(f"{c} string" for c in COLUMNS)
    return spark.read.schema(f"{types}, dt string, fleet string").parquet(path)


def read_segments(spark: SparkSession, path: str, dt: str | None = None, fleet: str | None = None) -> DataFrame:
    """Decoded envelopes; a date and a fleet prune partitions."""
    rows = raw_segments(spark, path)
    if dt:
        rows = rows.where(F.col("dt") == dt)
    if fleet:
        rows = rows.where(F.col("fleet") == fleet)
    return decoded(rows)


def partition_of(path: Column) -> Column:
    """struct(dt, fleet, runtime, agent, session) of a segment's path, null if it is none; unknown runtimes are other."""
    part = lambda i: F.regexp_extract(path, PATH, i)
    runtime = F.when(part(3).isin(*RUNTIMES), part(3)).otherwise("other")
    return F.when(path.rlike(PATH), F.struct(part(1).alias("dt"), part(2).alias("fleet"), runtime.alias("runtime"), part(4).alias("agent"), part(5).alias("session")))


def runtime_of(name: Column) -> Column:
    return F.when(name.isin(*RUNTIMES), name).otherwise("other")


def minimal(rows: DataFrame, fleet: str = "main") -> DataFrame:
    """Rows with session, event and tool columns as ENVELOPE records; see conformed() for the fields that they lack."""
    tool = F.when(F.col("tool_name").isNotNull(), F.struct(F.col("tool_name").alias("name"), F.col("command").alias("input"), content_hash(F.coalesce("command", F.lit(""))).alias("input_hash"), F.lit(None).cast("string").alias("result"), F.col("exit_code").cast("int").alias("exit_code"), F.lit(None).cast("long").alias("duration_ms"), F.array_compact(F.array("path")).alias("paths")))
    return rows.select(
        F.lit(1).alias("schema_version"), "event_id", "emitted_at", F.lit(fleet).alias("fleet_id"), "agent_id", runtime_of(F.col("runtime")).alias("runtime"), "session_id", "cwd", "git_sha", "event_type",
        content_hash(F.coalesce("command", F.lit(""))).alias("content_hash"), tool.alias("tool"), F.struct(F.lit("clean").alias("status"), F.array().cast("array<string>").alias("rules_fired")).alias("redaction"), F.lit(False).alias("imported"),
    )
