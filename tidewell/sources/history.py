"""A runtime's exported history (sessions, messages, model usage) as envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.redaction import scrub, tool_result
from tidewell.functions.scores import instant_of_epoch
from tidewell.operators.sessions import filled_times, run_ends, usage

#: Columns of ``messages`` that an import needs.
REQUIRED = ("id", "session_id", "role", "content", "tool_call_id", "tool_calls", "tool_name", "timestamp", "compacted")
_KEPT = ("session_id", "order", "part", "event_type", "emitted_at", "message_id", "parent_message_id", "content", "tool_name", "tool_input", "result", "path", "input_tokens", "output_tokens", "cost_usd", "model")


def missing_columns(messages: DataFrame) -> list[str]:
    return [c for c in REQUIRED if c not in messages.columns]


def tool_calls(messages: DataFrame) -> DataFrame:
    """(session_id, row_id, call_id, name, input) of every call that a row's JSON holds, whichever of the known shapes."""
    one = F.col("c")
    field = lambda *paths: F.coalesce(*[F.nullif(F.get_json_object(one, f"$.{p}"), F.lit("")) for p in paths])
    calls = F.from_json("tool_calls", "array<string>")
    rows = messages.where("tool_calls is not null").select("session_id", F.col("id").alias("row_id"), F.posexplode(calls).alias("n", "c"))
    return rows.select("session_id", "row_id", "n", field("id", "call_id").alias("call_id"), field("function.name", "name").alias("name"), field("function.arguments", "arguments", "input", "args").alias("input"))


def envelopes(sessions: DataFrame, messages: DataFrame, model_usage: DataFrame) -> DataFrame:
    """session_start, messages, tool calls, compactions and session_end of each session, in order.

    A result row takes name and input from its own call, else from the last row that asked
    under its call id.  Times without a reading come from the row before, leading ones from
    the first there is.  The end carries the session's usage over all models.
    """
    usable = F.col("timestamp").isNotNull() & ~F.isnan("timestamp") & (F.abs("timestamp") < 1e12)
    timed = filled_times(messages.withColumn("_t", F.when(usable, F.col("timestamp"))), "session_id", "id", "_t").drop("_t")
    timed = timed.withColumn("emitted_at", instant_of_epoch(F.col("filled")))
    calls = tool_calls(messages)
    asked = calls.where("call_id is not null").groupBy("session_id", "call_id").agg(F.max(F.struct("row_id", "n", "name", "input")).alias("a"))
    asked = asked.select("session_id", F.col("call_id").alias("tool_call_id"), F.col("a.row_id").alias("parent"), F.col("a.name").alias("a_name"), F.col("a.input").alias("a_input"))
    own = calls.join(messages.where("role = 'tool'").select("session_id", F.col("id").alias("row_id"), "tool_call_id"), ["session_id", "row_id"]).where("tool_call_id is null or tool_call_id = call_id")
    own = own.groupBy("session_id", F.col("row_id").alias("id")).agg(F.min(F.struct("n", "name", "input")).alias("o")).select("session_id", "id", F.col("o.name").alias("o_name"), F.col("o.input").alias("o_input"))
    t = timed.where("role = 'tool'").join(asked, ["session_id", "tool_call_id"], "left").join(own, ["session_id", "id"], "left")
    given = F.coalesce("o_input", "a_input")
    t = t.withColumn("path", F.coalesce(F.get_json_object(given, "$.file_path"), F.get_json_object(given, "$.path")))
    at = lambda df, kind, part, **more: _row(df, kind, part, more)
    spoken = timed.where(F.col("role").isin("user", "assistant"))
    kind = F.when(F.col("role") == "user", "prompt").otherwise("assistant")
    message = F.col("id").cast("string")
    tools = at(
        t, F.lit("tool_call"), 1, message_id=message, parent_message_id=F.col("parent").cast("string"), tool_name=F.coalesce(F.nullif("tool_name", F.lit("")), "o_name", "a_name", F.lit("unknown")),
        tool_input=tool_result(given, F.coalesce("path", F.lit("")))["text"], result=tool_result(F.col("content"), F.coalesce("path", F.lit("")))["text"], path=F.col("path"),
    )
    ends = run_ends(timed, "session_id", "id", F.coalesce(F.col("compacted").cast("boolean"), F.lit(False)))
    span = timed.groupBy("session_id").agg(F.min(F.struct("id", "emitted_at")).alias("a"), F.max(F.struct("id", "emitted_at")).alias("b"))
    known = sessions.select(F.col("id").alias("session_id")).join(span, "session_id")
    start = at(known.withColumn("emitted_at", F.col("a.emitted_at")).withColumn("id", F.col("a.id") - 1), F.lit("session_start"), 0)
    total = usage(model_usage, "session_id")
    end = at(
        known.join(total, "session_id", "left").withColumn("emitted_at", F.col("b.emitted_at")).withColumn("id", F.col("b.id") + 1), F.lit("session_end"), 3,
        **{c: F.col(c) for c in ("input_tokens", "output_tokens", "cost_usd", "model")},
    )
    said = at(spoken, kind, 1, message_id=message, content=scrub(F.col("content"))["text"])
    return start.union(said).union(tools).union(at(ends, F.lit("compact"), 2, message_id=message)).union(end)


def _row(df: DataFrame, kind: object, part: int, more: dict) -> DataFrame:
    types = {"input_tokens": "long", "output_tokens": "long", "cost_usd": "double"}
    base = {"order": F.col("id").cast("long"), "part": F.lit(part), "event_type": kind, "session_id": F.col("session_id"), "emitted_at": F.col("emitted_at")}
    made = {**base, **more}
    return df.select(*[made[c].alias(c) if c in made else F.lit(None).cast(types.get(c, "string")).alias(c) for c in _KEPT])


def since(messages: DataFrame, seconds: float) -> DataFrame:
    """Messages of sessions whose last activity is not before ``seconds``; a session comes whole or not at all."""
    late = messages.groupBy("session_id").agg(F.max("timestamp").alias("t")).where(F.col("t") >= seconds).select("session_id")
    return messages.join(late, "session_id", "left_semi")
