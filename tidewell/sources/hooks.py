"""Hook payloads of the supported runtimes as envelopes, by JSON functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.redaction import merged_status, scrub, tool_result
from tidewell.functions.text import capped, content_hash

#: Event names of each runtime and the envelope's event type.  Fixed values.
EVENTS = {
    "claude_code": {
        "SessionStart": "session_start", "UserPromptSubmit": "prompt", "PreToolUse": "tool_call", "PostToolUse": "tool_call", "PostToolUseFailure": "tool_call",
        "PreCompact": "compact", "Stop": "assistant", "SubagentStop": "assistant", "SessionEnd": "session_end",
    },
    "cursor": {
        "sessionStart": "session_start", "beforeSubmitPrompt": "prompt", "afterAgentResponse": "assistant", "stop": "assistant", "preToolUse": "tool_call", "postToolUse": "tool_call",
        "postToolUseFailure": "tool_call", "beforeShellExecution": "tool_call", "afterShellExecution": "tool_call", "beforeMCPExecution": "tool_call", "afterFileEdit": "tool_call",
        "beforeReadFile": "tool_call", "subagentStart": "tool_call", "subagentStop": "tool_call", "preCompact": "compact", "sessionEnd": "session_end",
    },
    "hermes": {
        "on_session_start": "session_start", "pre_llm_call": "prompt", "post_llm_call": "assistant", "pre_tool_call": "tool_call", "post_tool_call": "tool_call",
        "on_session_end": "session_end", "on_session_finalize": "session_end", "on_session_reset": "session_end",
    },
}


def _get(payload: Column, path: str) -> Column:
    """Text at a path of a parsed payload; objects and lists as JSON."""
    return F.try_variant_get(payload, f"$.{path}", "string")


def _field(payload: Column, *paths: str) -> Column:
    """The first field that is there and not empty."""
    return F.coalesce(*[F.nullif(_get(payload, p), F.lit("")) for p in paths])


def tool_output(payload: Column) -> list[Column]:
    """exit_code, output and duration_ms of a parsed payload whose output may be JSON in a string."""
    raw = _get(payload, "tool_output")
    inner = F.try_parse_json(raw)
    duration = _field(payload, "duration_ms", "duration").try_cast("double")
    return [
        F.coalesce(_get(inner, "exitCode"), _get(payload, "exit_code")).try_cast("long").alias("exit_code"),
        F.coalesce(_get(inner, "output"), raw).alias("output"),
        F.round(duration).cast("long").alias("duration_ms"),
    ]


def _event(runtime: str) -> Column:
    names = EVENTS[runtime]
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])


def normalized(hooks: DataFrame, runtime: str) -> DataFrame:
    """Envelopes of hook calls (event, payload, and an id column ``event_id``) of one runtime.

    Events that the runtime does not record go.  Texts are cut to a MiB each, then scrubbed,
    a result of a denied path is withheld, and the status is the worst of all fields.
    """
    p = F.col("parsed")
    known = hooks.where(F.col("event").isin(*EVENTS[runtime])).withColumn("event_type", _event(runtime)[F.col("event")])
    base = known.withColumn("parsed", F.try_parse_json("payload"))
    tool = F.col("event_type") == "tool_call"
    if runtime == "cursor":
        session, text = _field(p, "session_id", "conversation_id"), _field(p, "prompt", "text")
        event = F.col("event")
        of = lambda word, path: F.coalesce(F.concat(F.lit(f"{word}:"), _field(p, path)), F.lit(word))
        name = F.when(event.isin("beforeShellExecution", "afterShellExecution"), "shell").when(event == "afterFileEdit", "edit").when(event == "beforeReadFile", "read")
        name = F.coalesce(name.when(event == "beforeMCPExecution", of("mcp", "mcp_server_name")).when(event.isin("subagentStart", "subagentStop"), of("subagent", "subagent_type")), _field(p, "tool_name"))
        given, path, message = F.coalesce(_field(p, "command", "tool_input", "edits", "task")), _field(p, "file_path", "tool_input.file_path"), _field(p, "tool_use_id", "tool_call_id")
        code, output, duration = tool_output(p)
        output = F.coalesce(output, _field(p, "output", "error_message"), F.when(event == "beforeReadFile", _field(p, "content")))
        cwd = _field(p, "cwd", "workspace_roots[0]")
    elif runtime == "hermes":
        session, text = _field(p, "session_id", "parent_session_id"), _field(p, "prompt", "extra.user_message", "extra.response")
        name, given, path = _field(p, "tool_name"), _field(p, "tool_input"), _field(p, "tool_input.file_path", "tool_input.path")
        message, code, output = _field(p, "extra.tool_call_id"), F.lit(None).cast("long"), _field(p, "extra.result")
        duration, cwd = F.round(_field(p, "extra.duration_ms").try_cast("double")).cast("long"), _field(p, "cwd")
    else:
        session, text = _field(p, "session_id"), _field(p, "prompt", "user_input")
        name, given, path = _field(p, "tool_name"), _field(p, "tool_input"), _field(p, "tool_input.file_path", "tool_input.path")
        message, output, cwd = _field(p, "tool_use_id"), _field(p, "tool_response"), _field(p, "cwd")
        code, duration = F.lit(None).cast("long"), F.lit(None).cast("long")
    rows = base.select(
        "event_id",
        F.lit(runtime).alias("runtime"),
        session.alias("session_id"),
        "event_type",
        cwd.alias("cwd"),
        F.when(tool, message).alias("message_id"),
        F.when(F.col("event_type").isin("prompt", "assistant"), text).alias("text"),
        F.when(tool, name).alias("tool_name"),
        F.when(tool, given).alias("given"),
        F.when(tool, output).alias("output"),
        F.when(tool, path).alias("path"),
        F.when(tool, code).alias("exit_code"),
        F.when(tool, duration).alias("duration_ms"),
    )
    rows = rows.withColumns({c: capped(F.col(c)) for c in ("text", "given", "output")})
    made = {"c": scrub(F.col("text")), "i": scrub(F.col("given")), "r": F.when(F.col("event_type") == "tool_call", tool_result(F.col("output"), F.coalesce("path", F.lit(""))))}
    rows = rows.withColumns(made)
    has = lambda c: F.when(F.col(f"{c}.text").isNotNull(), F.col(f"{c}.status"))
    rules = F.array_distinct(F.flatten(F.array_compact(F.array("c.rules", "i.rules", "r.rules"))))
    return rows.select(
        "event_id", "runtime", "session_id", "event_type", "cwd", "message_id", F.col("c.text").alias("content"), content_hash(F.coalesce("c.text", F.lit(""))).alias("content_hash"),
        "tool_name", F.col("i.text").alias("tool_input"), content_hash(F.coalesce("i.text", F.lit(""))).alias("input_hash"), F.col("r.text").alias("result"), "path", "exit_code", "duration_ms",
        merged_status(has("c"), has("i"), has("r")).alias("redaction_status"), F.array_join(rules, ",").alias("redaction_rules"),
    )
