from pyspark.sql import functions as F

from tidewell.operators import sessions as S
from tidewell.operators.imports import accepted
from tidewell.operators.transcripts import problems
from tidewell.sources import transcripts

COLUMNS = "session_id string, event_id string, emitted_at string, event_type string, command string, exit_code long, path string, cwd string, git_sha string, input_tokens long, cost_usd double"


def events(spark, *rows):
    full = [(s, f"{i:04d}", f"2024-01-01T00:00:{i:02d}.500Z", kind, cmd, code, path, cwd, None, 1, 0.5) for i, (s, kind, cmd, code, path, cwd) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def test_three_trailing_failures_without_an_end_abandon(spark):
    bad = ("tool_call", "make", 1, None, "/w")
    ok = ("tool_call", "make", 0, None, "/w")
    e = events(spark, *[("a", *bad)] * 3, *[("b", *bad)] * 3, ("b", "session_end", None, None, None, "/w"), ("c", *bad), ("c", *ok), *[("c", *bad)] * 2, ("d", *ok), *[("d", *bad)] * 4)
    assert {(r.session_id, r["count"]) for r in S.abandoned(e).collect()} == {("a", 3), ("d", 4)}
    d = {r.session_id: r for r in S.digest(e).collect()}
    assert (d["a"].outcome, d["b"].outcome, d["c"].outcome, d["d"].outcome) == ("abandoned", "error", "error", "abandoned")
    assert d["a"].duration_ms == 2000 and d["a"].cost_usd == 1.5
    assert {(r.session_id, r.command) for r in S.repeated_failures(e).collect()} == {("b", "make"), ("c", "make")}


def test_ties_of_directories_go_to_the_greatest(spark):
    e = events(spark, *[("a", "prompt", None, None, None, c) for c in ("/x", "/y", "/y", "/x", "")])
    assert S.dominant_cwd(e).first().cwd == "/y"


def test_only_more_than_five_touches_make_a_file_hot(spark):
    e = events(spark, *[("a", "tool_call", "x", 0, "/f", "/w")] * 6, *[("a", "tool_call", "x", 0, "/g", "/w")] * 5)
    assert [(r.path, r["count"]) for r in S.hot_files(e).collect()] == [("/f", 6)]
    assert S.summaries(e).first().summary == "edited /f 6x · touched /f, /g · 11 command(s), all clean"


def test_a_session_without_anything_says_so(spark):
    e = events(spark, ("a", "prompt", None, None, None, None))
    assert S.summaries(e).first().summary == "1 turn(s), nothing recorded"
    assert S.digest(e).first().outcome == "clean"
    assert S.digest(e.limit(0)).count() == 0


def test_compaction_keeps_the_first_and_all_without_content(spark):
    empty = "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    r = spark.createDataFrame([("a", "1", "h"), ("a", "2", "h"), ("b", "3", "h"), ("a", "4", empty), ("a", "5", empty)], "session_id string, event_id string, content_hash string")
    kept = S.compacted(r)
    assert sorted(x.event_id for x in kept.collect()) == ["1", "3", "4", "5"]
    assert sorted(x.event_id for x in S.compacted(kept).collect()) == ["1", "3", "4", "5"]


def test_enrichment_fills_only_what_is_missing(spark):
    e = spark.createDataFrame([("s", "m1", "Bash", None, None, ["/a"]), ("s", "m2", "Bash", "r", 0, None), ("s", "m3", None, None, None, None)], "session_id string, message_id string, tool_name string, result string, exit_code long, paths array<string>")
    o = spark.createDataFrame([("s", m, "late", 2, ["/a", "/b"]) for m in ("m1", "m2", "m3")], "session_id string, message_id string, result string, exit_code long, paths array<string>")
    got = {r.message_id: (r.result, r.exit_code, r.paths) for r in S.enriched(e, o).collect()}
    assert got == {"m1": ("late", 2, ["/a", "/b"]), "m2": ("r", 0, ["/a", "/b"]), "m3": (None, None, [])}


def test_transcripts_give_outcomes_and_usage(spark):
    lines = [
        '{"gitBranch":"","message":{"usage":{"input_tokens":3,"output_tokens":1}}}',
        '{"gitBranch":"main","toolUseResult":{"stdout":"ok","filePath":"/f","structuredPatch":[{"file":"/g"},{"path":"/f"}]},"message":{"content":[{"type":"tool_result","tool_use_id":"t1","is_error":true}]}}',
        "no json",
        '{"message":{"usage":{"input_tokens":4}}}',
    ]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session_id string, n int, value string")
    r = transcripts.outcomes(df).first()
    assert (r.message_id, r.result, r.exit_code, r.paths) == ("t1", "ok", 1, ["/f", "/g"])
    u = transcripts.usage(df).first()
    assert (u.input_tokens, u.output_tokens, u.branch) == (7, 1, "main")


def test_import_takes_new_events_once(spark):
    e = spark.createDataFrame([(1,), (1,), (2,), (3,)], "k int")
    assert sorted(r.k for r in accepted(e, e.where("k = 3"), ["k"]).collect()) == [1, 2]


def test_proposals(spark):
    cite = [("s", "m")]
    rows = [("c", "outcome", "x", cite), (" ", "outcome", "x", cite), ("c", "outcome", "", cite), ("c", "guess", "x", cite), ("c", "outcome", "x", []), ("c", "outcome", "x", None), ("c", "outcome", "x", cite * 21), ("c", "outcome", "x", [("s", " ")])]
    df = spark.createDataFrame(rows, "claim string, claim_type string, subject string, evidence array<struct<session_id: string, message_id: string>>")
    assert [r.problem for r in problems(df).select(F.col("problem")).collect()] == [None, "claim is empty", "subject is empty", "unknown type", "no evidence", "no evidence", "too much evidence", "evidence names no message"]


def test_history_becomes_envelopes(spark):
    from tidewell.sources import history

    sessions = spark.createDataFrame([("a",), ("empty",)], "id string")
    calls = '[{"id":"c1","function":{"name":"read","arguments":"{\\"path\\":\\"/w/x\\"}"}}]'
    rows = [
        (1, "a", "user", "hi", None, None, None, None, 0), (2, "a", "assistant", "ok", None, calls, None, 1700000000.0, 1), (3, "a", "tool", "body", "c1", None, "", 1e13, 1),
        (4, "a", "tool", "secret", "c2", '[{"id":"c2","name":"cat","args":"{\\"path\\":\\"/h/.ssh/id_a\\"}"}]', None, 1700000009.0, 0), (5, "a", "system", "x", None, None, None, None, None),
    ]
    messages = spark.createDataFrame(rows, "id long, session_id string, role string, content string, tool_call_id string, tool_calls string, tool_name string, timestamp double, compacted int")
    used = spark.createDataFrame([("a", "m1", 3, 4, None), ("a", "m2", 1, 1, 0.5)], "session_id string, model string, input_tokens long, output_tokens long, cost_usd double")
    got = history.envelopes(sessions, messages, used).orderBy("order", "part").collect()
    assert [r.event_type for r in got] == ["session_start", "prompt", "assistant", "tool_call", "compact", "tool_call", "session_end"]
    assert got[1].emitted_at == got[2].emitted_at == "2023-11-14T22:13:20.000Z"
    assert (got[3].tool_name, got[3].parent_message_id, got[3].path, got[3].result) == ("read", "2", "/w/x", "body")
    assert got[5].tool_name == "cat" and "secret" not in got[5].result
    assert (got[6].input_tokens, got[6].cost_usd, got[6].model) == (4, 0.5, None)
    assert history.missing_columns(messages.drop("role")) == ["role"]
    assert history.since(messages, 1800000000.0 * 1e5).count() == 0


def test_known_claims_pass_over_what_does_not_fit(spark):
    from tidewell.operators.transcripts import BUDGET, known_claims

    rows = [("3", "outcome", "x" * BUDGET, "promoted"), ("2", "outcome", "short", "contested"), ("1", "outcome", "new", "candidate")]
    df = spark.createDataFrame(rows, "claim_id string, claim_type string, claim string, status string")
    assert [(r.claim_id, r.line) for r in known_claims(df).collect()] == [("2", "- [outcome] short\n")]


def test_hook_events_of_each_kind(spark):
    import json

    from tidewell.sources.hooks import normalized

    rows = [
        ("1", "beforeMCPExecution", {"session_id": "s", "mcp_server_name": "db", "tool_input": {"q": 1}}),
        ("2", "beforeReadFile", {"session_id": "s", "file_path": "/w/a", "content": "text"}),
        ("3", "subagentStart", {"conversation_id": "s", "subagent_type": "plan", "task": "do"}),
        ("4", "postToolUseFailure", {"session_id": "s", "tool_name": "Bash", "error_message": "no"}),
        ("5", "beforeReadFile", {"session_id": "s", "file_path": "/w/.env", "content": "KEY=1"}),
        ("6", "stop", {"session_id": "s", "text": "done"}),
        ("7", "unheardOf", {"session_id": "s"}),
        ("8", "beforeShellExecution", {"session_id": "s", "command": "ls"}),
        ("long", "beforeSubmitPrompt", {"session_id": "s", "prompt": "é" * (1 << 20)}),
    ]
    df = spark.createDataFrame([(i, e, json.dumps(p)) for i, e, p in rows] + [("9", "preToolUse", "{broken")], "event_id string, event string, payload string")
    got = {r.event_id: r for r in normalized(df, "cursor").collect()}
    assert [(got[i].tool_name, got[i].tool_input, got[i].result) for i in "12348"] == [("mcp:db", '{"q":1}', None), ("read", None, "text"), ("subagent:plan", "do", None), ("Bash", None, "no"), ("shell", "ls", None)]
    assert got["5"].redaction_status == "quarantined" and got["5"].result == "[withheld, denied path]"
    assert got["long"].content == "é" * (1 << 19) + "...[truncated]"
    assert got["6"].event_type == "assistant" and "7" not in got and got["9"].session_id is None
    kinds = {r.event: r.event_type for e in ("PreToolUse", "PostToolUseFailure", "SubagentStop") for r in normalized(spark.createDataFrame([(e, e, "{}")], "event_id string, event string, payload string"), "claude_code").selectExpr("event_id as event", "event_type").collect()}
    assert kinds == {"PreToolUse": "tool_call", "PostToolUseFailure": "tool_call", "SubagentStop": "assistant"}
