import json

from pyspark.sql import functions as F

from tidewell.sources.segments import decoded, minimal, partition_of, read_segments, write_segments
from tidewell.sources.tables import event_envelopes
from tidewell.streaming import capture
from tidewell.streaming.spool import spool_files


def lines(path, name, rows):
    (path / "cursor").mkdir(parents=True, exist_ok=True)
    (path / "cursor" / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows) + "\n")


def event(i, at, kind="prompt", session="s"):
    return {"event_id": f"{i:03d}", "emitted_at": at, "session_id": session, "agent_id": "a", "event_type": kind}


def test_spool_to_bronze_and_sessions(spark, tmp_path):
    spool = tmp_path / "spool"
    lines(spool, "a.ndjson", [event(1, "2024-01-01T00:00:00Z"), "{broken", event(2, "2024-01-01T00:05:00Z", "session_end"), event(3, "2024-01-01T09:00:00Z", session="t")])
    for _ in range(2):
        capture.to_bronze(capture.spool(spark, str(spool)), str(tmp_path / "bronze"), str(tmp_path / "check")).awaitTermination()
    assert decoded(capture.bronze(spark, str(tmp_path / "bronze"))).count() == 3
    lines(spool, "b.ndjson", [event(4, "2024-01-01T12:00:00Z", session="u")])
    capture.to_bronze(capture.spool(spark, str(spool)), str(tmp_path / "bronze"), str(tmp_path / "check")).awaitTermination()
    assert decoded(capture.bronze(spark, str(tmp_path / "bronze"))).count() == 4
    # an append, a half-written line, its end, and a rotation
    with (spool / "cursor" / "b.ndjson").open("a") as f:
        f.write(json.dumps(event(5, "2024-01-01T12:01:00Z", session="u")) + "\n" + json.dumps(event(6, "2024-01-01T12:02:00Z", session="u"))[:20])
    capture.to_bronze(capture.spool(spark, str(spool)), str(tmp_path / "bronze"), str(tmp_path / "check")).awaitTermination()
    assert decoded(capture.bronze(spark, str(tmp_path / "bronze"))).count() == 5
    with (spool / "cursor" / "b.ndjson").open("a") as f:
        f.write(json.dumps(event(6, "2024-01-01T12:02:00Z", session="u"))[20:] + "\n")
    (spool / "cursor" / "b.ndjson").rename(spool / "cursor" / "b.ndjson.7")
    lines(spool, "b.ndjson", [event(7, "2024-01-01T12:03:00Z", session="u")])
    (spool / "cursor" / "b.done").write_text("x\n")
    for _ in range(2):
        capture.to_bronze(capture.spool(spark, str(spool)), str(tmp_path / "bronze"), str(tmp_path / "check")).awaitTermination()
    ids = sorted(r.event_id for r in decoded(capture.bronze(spark, str(tmp_path / "bronze"))).collect())
    assert ids == [f"{i:03d}" for i in range(1, 8)]
    assert [(f.session_id, f.rotation) for f in spool_files(str(spool))] == [("a", ""), ("b", "7"), ("b", "")]
    q = capture.closed_sessions(capture.spool(spark, str(spool))).writeStream.format("memory").queryName("closed").outputMode("append").trigger(processingTime="1 second").start()
    q.processAllAvailable()
    q.stop()
    got = {r.session_id: (r.events, r.ended) for r in spark.table("closed").collect()}
    assert got["s"] == (2, True)


def test_segments_prune_by_date(spark, tmp_path):
    e = minimal(event_envelopes(spark, "/root/testdata/sf0.001"))
    write_segments(e.where("emitted_at < '2024-01-04'"), str(tmp_path / "sessions"))
    day = read_segments(spark, str(tmp_path / "sessions"), dt="2024-01-02", fleet="main")
    files = spark.read.parquet(str(tmp_path / "sessions")).select(partition_of(F.input_file_name()).alias("p")).distinct().collect()
    assert files and all(r.p is not None and r.p.fleet == "main" for r in files)
    assert day.count() == e.where("emitted_at like '2024-01-02%'").count() > 0
