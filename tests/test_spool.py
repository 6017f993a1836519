import json

from tidewell.sources.segments import decoded
from tidewell.streaming import capture
from tidewell.streaming.spool import SpoolReader


def put(root, name, *rows, mode="w"):
    (root / "cursor").mkdir(parents=True, exist_ok=True)
    with (root / "cursor" / name).open(mode) as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)


def event(i, at="2024-01-01T00:00:00Z", kind="prompt", session="s"):
    return {"event_id": f"{i:03d}", "emitted_at": at, "session_id": session, "agent_id": "a", "fleet_id": "f", "event_type": kind}


def step(reader, start):
    """Rows of one batch, and its end."""
    end = json.loads(json.dumps(reader.latestOffset()))
    rows = [r for p in reader.partitions(start, end) for r in reader.read(p)]
    return rows, end


def ids(rows):
    return [json.loads(r[-1])["event_id"] for r in rows if r[-1]]


def test_files_that_begin_alike_are_two(tmp_path):
    put(tmp_path, "s.ndjson.1", event(1), event(2))
    put(tmp_path, "s.ndjson.2", event(1), event(3))
    put(tmp_path, "s.ndjson", event(1), event(4))
    r = SpoolReader(str(tmp_path))
    rows, end = step(r, {})
    assert ids(rows) == ["001", "002", "001", "003", "001", "004"]
    # a rotation with a new file that begins as the old one did, and the first rotation cleared
    (tmp_path / "cursor" / "s.ndjson").rename(tmp_path / "cursor" / "s.ndjson.3")
    put(tmp_path, "s.ndjson.3", event(5), mode="a")
    put(tmp_path, "s.ndjson", event(1), event(6), event(7))
    (tmp_path / "cursor" / "s.ndjson.1").unlink()
    rows, end = step(SpoolReader(str(tmp_path)), end)  # a new process, which knows the checkpoint alone
    assert sorted(ids(rows)) == ["001", "005", "006", "007"]
    assert step(r, end)[0] == []


def test_only_files_that_changed_are_opened(tmp_path):
    for i in range(20):
        put(tmp_path, f"s{i}.ndjson", event(i))
    r = SpoolReader(str(tmp_path))
    _, end = step(r, {})
    r.opened = 0
    assert r.latestOffset() == r.latestOffset() == {k: list(v) for k, v in end.items()} and r.opened == 0
    put(tmp_path, "s3.ndjson", event(99), mode="a")
    rows, _ = step(r, end)
    assert ids(rows) == ["099"] and r.opened <= 5


def test_planned_files_may_be_renamed_or_cleared(tmp_path):
    put(tmp_path, "s.ndjson", event(1), event(2))
    put(tmp_path, "t.ndjson", event(3))
    r = SpoolReader(str(tmp_path))
    end = r.latestOffset()
    (tmp_path / "cursor" / "s.ndjson").rename(tmp_path / "cursor" / "s.ndjson.9")
    gone = (tmp_path / "cursor" / "t.ndjson").stat().st_size
    (tmp_path / "cursor" / "t.ndjson").unlink()
    rows = [x for p in r.partitions({}, end) for x in r.read(p)]
    assert ids(rows) == ["001", "002"] and [(x[1], x[2], x[4]) for x in rows if x[-1] is None] == [("t", "lost", gone)]


def test_done_comes_with_the_last_bytes(tmp_path):
    put(tmp_path, "s.ndjson", event(1))
    with (tmp_path / "cursor" / "s.ndjson").open("a") as f:
        f.write('{"half')
    (tmp_path / "cursor" / "s.done").write_text("x")
    r = SpoolReader(str(tmp_path))
    rows, end = step(r, {})
    assert ids(rows) == ["001"] and "done" not in {x[2] for x in rows}
    with (tmp_path / "cursor" / "s.ndjson").open("a") as f:
        f.write('"}\n')
    rows, end = step(r, end)
    assert [x[2] for x in rows] == ["", "done"] and rows[1][3] == (tmp_path / "cursor" / "s.ndjson").stat().st_size
    assert step(r, end)[0] == []


def test_query_goes_on_after_a_cleared_file(spark, tmp_path):
    spool, at = tmp_path / "spool", [str(tmp_path / "bronze"), str(tmp_path / "check")]
    put(spool, "a.ndjson", event(1))
    capture.to_bronze(capture.spool(spark, str(spool)), *at).awaitTermination()
    put(spool, "b.ndjson", event(2))
    # the next batch is planned, and the process dies before it is done
    reader = SpoolReader(str(spool))
    log = tmp_path / "check" / "offsets"
    last = max(int(p.name) for p in log.iterdir() if p.name.isdigit())
    lines = (log / str(last)).read_text().split("\n")
    lines[-1] = json.dumps(reader.latestOffset())
    (log / str(last + 1)).write_text("\n".join(lines))
    (spool / "cursor" / "b.ndjson").unlink()
    (spool / "cursor" / "a.ndjson").unlink()
    put(spool, "c.ndjson", event(3))
    for _ in range(2):
        capture.to_bronze(capture.spool(spark, str(spool)), *at).awaitTermination()
    assert sorted(r.event_id for r in decoded(capture.bronze(spark, at[0])).collect()) == ["001", "003"]
