"""The generic tables as captured sessions, claims, presence and calibration, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import content_hash

#: Commands and paths that an event's number stands for, in both engines.
COMMANDS = ("cargo test --workspace", "git commit -m wip", "make build", "pytest -q", "ls -la")
KINDS = {"signup": "session_start", "purchase": "session_end", "view": "prompt", "click": "tool_call", "error": "tool_call"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope an event: a user's week is a session; clicks and errors are commands that end well or badly."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    tool = F.col("event_type").isin("click", "error")
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), F.pmod(k, F.lit(5)) + 1)
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")).alias("session_id"),
        F.concat(F.lit("a"), F.pmod("user_id", F.lit(7)).cast("string")).alias("agent_id"),
        F.element_at(F.array(F.lit("claude_code"), F.lit("cursor"), F.lit("hermes"), F.lit("other")), (F.pmod("user_id", F.lit(4)) + 1).cast("int")).alias("runtime"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("event_id"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("emitted_at"),
        ts.alias("ts"),
        kind.alias("event_type"),
        F.concat(F.lit("/w/p"), F.pmod(k, F.lit(3)).cast("string")).alias("cwd"),
        F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit("sha"), k.cast("string"))).alias("git_sha"),
        F.when(tool, F.lit("Bash")).alias("tool_name"),
        F.when(tool, command).alias("command"),
        F.when(tool, F.concat(F.lit("/w/src/f"), F.pmod(k, F.lit(5)).cast("string"), F.lit(".py"))).alias("path"),
        F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "error", 1).cast("long").alias("exit_code"),
        F.when(F.col("event_type") == "view", k.cast("long")).alias("input_tokens"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("cost_usd"),
    )


def conversation_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope a turn of a conversation."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"),
        F.lpad(F.col("turn").cast("string"), 6, "0").alias("event_id"),
        F.col("turn").cast("string").alias("message_id"),
        F.when(F.col("role") == "user", "prompt").when(F.col("role") == "assistant", "assistant").otherwise("session_start").alias("event_type"),
        F.col("text").alias("content"),
        content_hash(F.col("text")).alias("content_hash"),
    )


def document_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim a document."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kinds = F.array(*map(F.lit, ("environment", "outcome", "convention", "hypothesis", "preference")))
    return d.select(
        F.lpad(i.cast("string"), 12, "0").alias("claim_id"),
        F.col("text").alias("claim"),
        F.element_at(kinds, (F.pmod(i, F.lit(5)) + 1).cast("int")).alias("claim_type"),
        F.concat(F.col("lang"), F.pmod(i, F.lit(10)).cast("string")).alias("subject"),
        F.col("source").alias("observed_by"),
        F.concat(F.lit("2024-"), F.lpad((F.pmod(i, F.lit(12)) + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.pmod(i, F.lit(28)) + 1).cast("string"), 2, "0")).alias("observed_at"),
        F.when(F.pmod(i, F.lit(3)) == 0, "candidate").when(F.pmod(i, F.lit(17)) == 1, "contested").otherwise("promoted").alias("status"),
        (F.pmod(i, F.lit(4)).cast("long")).alias("independent_count"),
        ((F.pmod(i, F.lit(10)) + 1) / 11.0).alias("confidence"),
    )


def claim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of claim events: each user a claim, each event a step in its life."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp_ntz")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(*[F.lit(x) for pair in (("signup", "proposed"), ("view", "proposed"), ("click", "promoted"), ("error", "contested"), ("purchase", "retired")) for x in pair])
    return e.select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("claim_id"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("key"),
        F.date_format(ts, "yyyy-MM-dd'T'HH").alias("at"),
        kind[F.col("event_type")].alias("kind"),
        F.concat(F.lit("a"), F.pmod(k, F.lit(7)).cast("string")).alias("agent_id"),
        F.concat(F.lit("claim "), k.cast("string")).alias("claim"),
        F.concat(F.lit("s"), F.pmod(k, F.lit(9)).cast("string")).alias("evidence_session"),
        F.pmod(k, F.lit(4)).cast("long").alias("independent_count"),
        (F.col("value") / 100.0).alias("confidence"),
        k.cast("long").alias("k"),
    )


_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_LIST = ", ".join(f"'{c}'" for c in COMMANDS)

#: The same views for DuckDB, as bodies of common table expressions.
SQL = {
    "env": f"""
  SELECT user_id || '@' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS session_id, 'a' || (user_id % 7) AS agent_id,
    ['claude_code', 'cursor', 'hermes', 'other'][(user_id % 4 + 1)::INT] AS runtime, lpad(event_id::VARCHAR, 12, '0') AS event_id,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS emitted_at, ts,
    CASE event_type WHEN 'signup' THEN 'session_start' WHEN 'purchase' THEN 'session_end' WHEN 'view' THEN 'prompt' ELSE 'tool_call' END AS event_type,
    '/w/p' || ({_K} % 3) AS cwd, CASE WHEN {_K} % 4 = 0 THEN 'sha' || {_K} END AS git_sha,
    CASE WHEN event_type IN ('click', 'error') THEN 'Bash' END AS tool_name,
    CASE WHEN event_type IN ('click', 'error') THEN [{_LIST}][{_K} % 5 + 1] END AS command,
    CASE WHEN event_type IN ('click', 'error') THEN '/w/src/f' || ({_K} % 5) || '.py' END AS path,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 END::BIGINT AS exit_code,
    CASE WHEN event_type = 'view' THEN {_K}::BIGINT END AS input_tokens, CASE WHEN event_type = 'view' THEN value END AS cost_usd
  FROM events""",
    "conv": """
  SELECT conv_id::VARCHAR AS session_id, lpad(turn::VARCHAR, 6, '0') AS event_id, turn::VARCHAR AS message_id,
    CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'assistant' ELSE 'session_start' END AS event_type,
    text AS content, 'sha256:' || sha256(text) AS content_hash FROM conversations""",
    "claims": """
  SELECT lpad(doc_id::VARCHAR, 12, '0') AS claim_id, text AS claim,
    ['environment', 'outcome', 'convention', 'hypothesis', 'preference'][(doc_id % 5 + 1)::INT] AS claim_type, lang || (doc_id % 10) AS subject,
    source AS observed_by, '2024-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS observed_at,
    CASE WHEN doc_id % 3 = 0 THEN 'candidate' WHEN doc_id % 17 = 1 THEN 'contested' ELSE 'promoted' END AS status,
    (doc_id % 4)::BIGINT AS independent_count, (doc_id % 10 + 1) / 11.0::DOUBLE AS confidence FROM documents""",
    "log": f"""
  SELECT 'c' || user_id AS claim_id, lpad(event_id::VARCHAR, 12, '0') AS key, strftime(ts, '%Y-%m-%dT%H') AS at,
    CASE event_type WHEN 'click' THEN 'promoted' WHEN 'error' THEN 'contested' WHEN 'purchase' THEN 'retired' ELSE 'proposed' END AS kind,
    'a' || ({_K} % 7) AS agent_id, 'claim ' || {_K} AS claim, 's' || ({_K} % 9) AS evidence_session,
    ({_K} % 4)::BIGINT AS independent_count, value / 100.0::DOUBLE AS confidence, {_K}::BIGINT AS k FROM events""",
}


def sql(views: str, body: str) -> str:
    """``body`` after the views it reads; a body that begins with a comma adds its own."""
    with_ = "WITH " + ", ".join(f"{v} AS ({SQL[v]})" for v in views.split())
    return f"{with_}\n{body}"
