from pathlib import Path

from pyspark.sql import functions as F

from tidewell.plans import maintenance as X
from tidewell.sources import compaction as C
from tidewell.sources import eventlog as L
from tidewell.sources.segments import conformed, raw_segments, write_batch

AT = "2024-02-01T00:00:00Z"


def session(spark, root, batch, name, agent, n=4, shown=None):
    tool = "named_struct('name', 'Bash', 'input', '{\"command\": \"make ' || i || '\"}', 'input_hash', '', 'result', '', 'exit_code', cast(i = 2 as int), 'duration_ms', cast(1 as long), 'paths', array('a/' || i, 'b'))"
    rows = spark.range(n).selectExpr(
        "cast(id as int) i", f"'{name}-' || id event_id", f"'2024-01-0{batch + 1}T00:00:0' || id || 'Z' emitted_at", f"'{name}' session_id", f"'{agent}' agent_id", "'f' fleet_id", "'m' || id message_id",
        f"case when id = {n - 1} then 'session_end' when id = 0 then 'prompt' else 'tool_call' end event_type", "'h' || id content_hash", "'c' content",
    )
    ctx = f"array(named_struct('claim_id', '{shown}', 'source', 'x', 'observed_by', 'y'))" if shown else "null"
    rows = rows.selectExpr("*", f"case when event_type = 'tool_call' then {tool} end tool", f"{ctx} injected_context", "named_struct('model', 'm', 'input_tokens', 1L, 'output_tokens', 2L, 'cache_read_tokens', 3L, 'cache_write_tokens', 4L, 'cost_usd', 0.5D) usage")
    write_batch(conformed(rows), f"{root}/sessions", batch)
    e = raw_segments(spark, f"{root}/sessions").where(F.col("session_id") == name)
    C.seal(spark, root, C.marks_of(e))


def claim(spark, root, name, subject, text, by, cites, kind="environment", at="2024-01-03"):
    row = [(name, at, "proposed", by, text, kind, subject, [(s, m, None, t) for s, m, t in cites])]
    L.append(spark.createDataFrame(row, "claim_id string, at string, kind string, agent_id string, claim string, claim_type string, subject string, evidence array<struct<session_id: string, message_id: string, excerpt_hash: string, observed_at: string>>"), root)


def test_chain_takes_up_only_what_changed(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    session(spark, root, 0, "s0", "a1")
    session(spark, root, 1, "s1", "a2", shown="echo")
    in0, in1 = ("s0", "m1", "2024-01-01T00:00:01Z"), ("s1", "m1", "2024-01-02T00:00:01Z")
    claim(spark, root, "good", "p", "the build needs two steps", "a1", [in0, in1])
    claim(spark, root, "rival", "p", "the build needs three steps", "a1", [in0])
    claim(spark, root, "echo", "q", "seen before", "a2", [in1])
    claim(spark, root, "late", "r", "out of its window", "a1", [("s0", "m1", "2024-01-09T00:00:00Z")])
    claim(spark, root, "lost", "r", "no such message there", "a1", [("s0", "m77", in0[2])])
    claim(spark, root, "ghost", "r", "nobody knows me", "a9", [in0])
    claim(spark, root, "guess", "r", "a guess only", "a1", [in0], "hypothesis")
    claim(spark, root, "bare", "r", "without evidence", "a1", [])
    first = X.run(spark, root, AT)
    assert [(x.dt, x.rows_out) for x in first.compacted] == [("2024-01-01", 4), ("2024-01-02", 4)]
    assert first.digests.inserted == 2 and first.decisions == {"promote": 1, "contest": 1, "review": 6}
    state = {r.claim_id: r for r in X.opened(spark, f"{root}/snapshot", "claims").collect()}
    # "good" came first by id and is promoted; its rival contests both
    assert {c: r.status for c, r in state.items() if r.status != "candidate"} == {"good": "contested", "rival": "contested"}
    d = {r.session_id: r for r in X.opened(spark, f"{root}/snapshot", "sessions").collect()}["s0"]
    assert (d.n_commands, d.n_failed, d.n_files, d.input_tokens, d.output_tokens, d.cache_read_tokens, d.cache_write_tokens, d.cost_usd) == (2, 1, 3, 4, 8, 12, 16, 2.0)
    assert [c.command for c in d.commands] == ["make 1", "make 2"] and d.files == ["a/1", "a/2", "b"] and d.summary
    files = {str(p) for p in Path(f"{tmp_path}/lake").rglob("*.parquet")}
    again = X.run(spark, root, "2024-02-02T00:00:00Z")
    assert (again.compacted, again.digests.rewritten, again.events, again.claims.rewritten, again.snapshot) == ([], {}, 0, {}, first.snapshot)
    assert {str(p) for p in Path(f"{tmp_path}/lake").rglob("*.parquet")} == files
    # one more session and claim; an agent in quarantine
    session(spark, root, 2, "s2", "a3")
    claim(spark, root, "new", "t", "a fresh thing", "a3", [("s2", "m1", "2024-01-03T00:00:01Z"), in0])
    third = X.run(spark, root, "2024-02-03T00:00:00Z")
    assert [x.dt for x in third.compacted] == ["2024-01-03"] and (third.digests.inserted, third.digests.updated) == (1, 0) and third.decisions["promote"] == 1
    shown = {r.claim_id: r for r in X.opened(spark, f"{root}/snapshot", "claims").where("visible_to_agents").collect()}
    assert shown.keys() == {"new"} and shown["new"].independent_count == 2
    L.append(spark.createDataFrame([("2024-02-04", "agent_quarantined", "a3", "none")], "at string, kind string, agent_id string, claim_id string"), root)
    fourth = X.run(spark, root, "2024-02-05T00:00:00Z")
    assert fourth.events == 1 and fourth.claims.updated == 1
    assert X.claim_table(spark, root).lookup([("new",)]).first().status == "contested"
