"""Queries of ingestion: hook payloads of each runtime, segments, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.catalog import query
from tidewell.sources import segments as G
from tidewell.sources.hooks import normalized
from tidewell.sources.tables import event_envelopes, sql, table

_EXPECTED = """SELECT lpad(event_id::VARCHAR, 12, '0') AS event_id, '{runtime}' AS runtime, 'u' || user_id AS session_id,
  CASE event_type WHEN 'view' THEN 'prompt' WHEN 'signup' THEN 'session_start' WHEN 'purchase' THEN 'session_end' ELSE 'tool_call' END AS event_type,
  '/w' AS cwd, CASE WHEN event_type IN ('click', 'error') THEN 'm' || event_id END AS message_id,
  CASE WHEN event_type = 'view' THEN 'ask ' || event_id END AS content, CASE WHEN event_type IN ('click', 'error') THEN 'Bash' END AS tool_name,
  CASE WHEN event_type = 'click' THEN 'done' WHEN event_type = 'error' THEN '[withheld, denied path]' END AS result,
  CASE WHEN event_type IN ('click', 'error') THEN {code} END::BIGINT AS exit_code, CASE WHEN event_type IN ('click', 'error') THEN {duration} END::BIGINT AS duration_ms,
  CASE WHEN event_type = 'error' THEN 'quarantined' ELSE 'clean' END AS redaction_status FROM events"""


def _hooks(spark: SparkSession, sf_dir: str, names: tuple[str, str, str, str], fields: dict[str, str]) -> DataFrame:
    """Events as hook calls: errors read a denied path, clicks another."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    event = F.when(kind == "signup", names[0]).when(kind == "view", names[1]).when(kind == "purchase", names[2]).otherwise(names[3])
    known = {
        "session": F.concat(F.lit("u"), F.col("user_id").cast("string")), "ask": F.concat(F.lit("ask "), F.col("event_id").cast("string")), "message": F.concat(F.lit("m"), F.col("event_id").cast("string")),
        "path": F.when(kind == "error", "/home/me/.ssh/id_x").otherwise("/w/a.py"), "bash": F.lit("Bash"), "cwd": F.lit("/w"), "done": F.lit("done"), "value": F.col("value"),
        "code": F.when(kind == "error", 1).otherwise(0),
    }
    return e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"), event.alias("event"), F.expr("1").alias("one"), *[c.alias(f"_{k}") for k, c in known.items()]).withColumn("payload", F.expr(fields["payload"])).select("event_id", "event", "payload")


_KEPT = ("event_id", "runtime", "session_id", "event_type", "cwd", "message_id", "content", "tool_name", "result", "exit_code", "duration_ms", "redaction_status")


@query("normalize_claude_code", _EXPECTED.format(runtime="claude_code", code="NULL", duration="NULL"))
def normalize_claude_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hooks(spark, sf_dir, ("SessionStart", "UserPromptSubmit", "SessionEnd", "PostToolUse"), {"payload": "to_json(named_struct('session_id', _session, 'cwd', _cwd, 'prompt', _ask, 'tool_name', _bash, 'tool_use_id', _message, 'tool_input', named_struct('file_path', _path), 'tool_response', _done))"})
    return normalized(h, "claude_code").select(*_KEPT)


@query("normalize_cursor", _EXPECTED.format(runtime="cursor", code="CASE WHEN event_type = 'error' THEN 1 ELSE 0 END", duration="round(value)"))
def normalize_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hooks(spark, sf_dir, ("sessionStart", "beforeSubmitPrompt", "sessionEnd", "postToolUse"), {"payload": "to_json(named_struct('conversation_id', _session, 'workspace_roots', array(_cwd), 'prompt', _ask, 'tool_name', _bash, 'tool_call_id', _message, 'file_path', _path, 'tool_output', to_json(named_struct('output', _done, 'exitCode', _code)), 'duration', _value))"})
    return normalized(h, "cursor").select(*_KEPT)


@query("normalize_hermes", _EXPECTED.format(runtime="hermes", code="NULL", duration="round(value)"))
def normalize_hermes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hooks(spark, sf_dir, ("on_session_start", "pre_llm_call", "on_session_end", "post_tool_call"), {"payload": "to_json(named_struct('parent_session_id', _session, 'cwd', _cwd, 'prompt', _ask, 'tool_name', _bash, 'tool_input', named_struct('path', _path), 'extra', named_struct('tool_call_id', _message, 'result', _done, 'duration_ms', _value)))"})
    return normalized(h, "hermes").select(*_KEPT)


@query("scan_envelopes", sql("env", "SELECT event_id, emitted_at, agent_id, runtime, session_id, event_type, command, exit_code, path FROM env"))
def scan_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes through the columns of a segment and back."""
    e = G.decoded(G.encoded(G.minimal(event_envelopes(spark, sf_dir))))
    return e.select("event_id", "emitted_at", "agent_id", "runtime", "session_id", "event_type", F.col("tool.input").alias("command"), F.col("tool.exit_code").cast("long").alias("exit_code"), F.get("tool.paths", F.lit(0)).alias("path"))


@query("partition_parse", sql("env", "SELECT event_id, emitted_at[1:10] AS dt, 'main' AS fleet, runtime, agent_id AS agent, session_id AS session FROM env WHERE event_type <> 'prompt'"))
def partition_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partition values of paths; other paths (here of prompts) give none."""
    e = event_envelopes(spark, sf_dir)
    root = F.when(F.col("event_type") == "prompt", "lake/live/").otherwise("lake/sessions/")
    path = F.concat(root, F.lit("dt="), F.substring("emitted_at", 1, 10), F.lit("/fleet=main/runtime="), F.col("runtime"), F.lit("/agent="), F.col("agent_id"), F.lit("/session="), F.col("session_id"), F.lit("/seg-000001.parquet"))
    return e.select("event_id", G.partition_of(path).alias("p")).where("p is not null").select("event_id", "p.*")
