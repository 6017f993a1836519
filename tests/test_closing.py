import json

from tidewell.sources import compaction as C
from tidewell.streaming import capture, closing


def put(root, name, *rows, mode="w"):
    (root / "hermes").mkdir(parents=True, exist_ok=True)
    with (root / "hermes" / name).open(mode) as f:
        f.writelines((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows)


def event(i, at, kind="prompt", session="s", agent="a"):
    return {"event_id": f"{i:03d}", "emitted_at": at, "session_id": session, "agent_id": agent, "fleet_id": "f", "event_type": kind}


def seals(spark, root):
    got = C.seals(spark, root).read()
    return {} if got is None else {r.session_id: (r.first_at, r.ended_at, r.events) for r in got.collect()}


def test_sessions_are_sealed_when_all_is_there(spark, tmp_path):
    spool, root, check = tmp_path / "spool", f"file://{tmp_path}/lake", str(tmp_path / "check")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run():
        closing.to_seals(closing.spool_lines(spark, str(spool)), root, check).awaitTermination()

    put(spool, "s.ndjson", event(1, "2024-01-01T00:00:00Z"), "{broken", event(2, "2024-01-02T00:00:00Z", "session_end"))
    put(spool, "t.ndjson", event(3, "2024-01-01T00:00:00Z", session="t"))
    (spool / "hermes" / "t.done").write_text("x")
    run()
    assert seals(spark, root) == {}  # s has no mark, t no end
    (spool / "hermes" / "s.done").write_text("x")
    run()
    assert seals(spark, root) == {"s": ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", 2)}
    version = C.seals(spark, root).version()
    # t ends in a file that is rotated meanwhile; s goes on, and ends again
    (spool / "hermes" / "t.ndjson").rename(spool / "hermes" / "t.ndjson.1")
    put(spool, "t.ndjson", event(4, "2024-01-03T00:00:00Z", "session_end", "t"))
    put(spool, "s.ndjson", event(5, "2024-01-05T00:00:00Z"), mode="a")
    run()
    assert seals(spark, root).keys() == {"s", "t"} and seals(spark, root)["t"][2] == 2 and seals(spark, root)["s"][2] == 2
    put(spool, "s.ndjson", event(6, "2024-01-06T00:00:00Z", "session_end"), mode="a")
    run()
    assert seals(spark, root)["s"] == ("2024-01-01T00:00:00Z", "2024-01-06T00:00:00Z", 4)
    # a replayed batch changes nothing
    now = C.seals(spark, root).version()
    assert now > version
    have = C.seals(spark, root).read()
    assert C.seal(spark, root, have).rewritten == {} and C.seals(spark, root).version() == now
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_changes_tell_of_reopened_sessions_and_of_agents(spark, tmp_path):
    spool = tmp_path / "spool"
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    put(spool, "s.ndjson", event(1, "2024-01-01T00:00:00Z"), event(2, "2024-01-01T00:01:00Z", "session_end"))
    (spool / "hermes" / "s.done").write_text("x")
    start = lambda df, name: df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q = start(closing.session_changes(closing.spool_lines(spark, str(spool))), "changes")
    p = start(closing.presence_changes(capture.spool(spark, str(spool))), "agents")
    try:
        q.processAllAvailable()
        p.processAllAvailable()
        put(spool, "s.ndjson", event(3, "2024-01-01T00:02:00Z"), event(4, "2024-01-01T00:09:30Z", agent="b"), mode="a")
        q.processAllAvailable()
        p.processAllAvailable()
        put(spool, "s.ndjson", event(5, "2024-01-01T00:09:40Z", "session_end", agent="b"), event(6, "2024-01-01T00:00:30Z", agent="late"), mode="a")
        q.processAllAvailable()
        p.processAllAvailable()
        put(spool, "u.ndjson", event(7, "2024-01-01T00:10:00Z", session="u"), event(8, "2024-01-01T00:30:00Z", session="u", agent="c"))
        for _ in range(2):
            q.processAllAvailable()
            p.processAllAvailable()
        got = [(r.session_id, r.kind, r.events, r.seals) for r in spark.table("changes").collect()]
        assert got == [("s", "sealed", 2, 1), ("s", "reopened", 4, 1), ("s", "sealed", 6, 2)] or got == [("s", "sealed", 2, 1), ("s", "reopened", 4, 1), ("s", "sealed", 5, 2), ("s", "reopened", 6, 2)]
        seen = [(r.agent_id, r.kind, r.at_ms // 1000 % 3600) for r in spark.table("agents").collect()]
        assert seen[:1] == [("a", "came", 60)] and ("a", "gone", 120) in seen and ("b", "came", 570) in seen
        assert sum(k == "came" for a, k, _ in seen if a == "a") == 2 and not any(a == "late" for a, _, _ in seen)
        assert ("b", "gone", 580) in seen and ("c", "gone", 1800) not in seen
    finally:
        q.stop()
        p.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
