from pathlib import Path

from pyspark.sql import functions as F

from tidewell.operators import sessions as S
from tidewell.sources import compaction as C
from tidewell.sources.segments import conformed, write_batch


def events(spark, *rows):
    """(session, event, at, content hash) as envelopes."""
    made = spark.createDataFrame(list(rows), "session_id string, event_id string, emitted_at string, content_hash string, event_type string")
    return conformed(made.withColumn("fleet_id", F.lit("main")))


def marks(rows):
    return rows.groupBy("fleet_id", "session_id").agg(F.min("emitted_at").alias("first_at"), F.max("emitted_at").alias("ended_at"), F.count("*").alias("events"))


def files(root):
    return {str(p): p.stat().st_mtime_ns for p in Path(root).rglob("*.parquet")}


def test_only_dates_with_new_seals_are_written(spark, tmp_path):
    root = f"file://{tmp_path}/lake"
    assert C.compact(spark, root) == [] and C.read_compacted(spark, root).count() == 0
    rows = [(s, f"{s}{i:02d}", f"2024-01-0{d}T00:00:{i:02d}Z", f"h{i % 4}" if i % 5 else S.EMPTY, "prompt") for s, d in (("a", 1), ("b", 1), ("c", 2), ("open", 2)) for i in range(20)]
    rows += [("d", "d1", "2024-01-02T00:00:00Z", "x", "prompt"), ("d", "d2", "2024-01-03T00:00:00Z", "x", "session_end"), (None, "n", None, None, None)]
    e = events(spark, *rows)
    write_batch(e, f"{root}/sessions", 0)
    write_batch(e, f"{root}/sessions", 0)  # a batch that is run again
    C.seal(spark, root, marks(e.where("session_id in ('a', 'c', 'd')")))
    first = C.compact(spark, root, part_bytes=400)
    assert [(x.dt, x.rows_in, x.rows_out) for x in first] == [("2024-01-01", 20, 8), ("2024-01-02", 21, 9), ("2024-01-03", 1, 1)]
    assert first[0].parts > 1
    got = C.read_compacted(spark, root)
    assert {r.session_id for r in got.collect()} == {"a", "c", "d"} and got.count() == 18
    per = got.groupBy("dt", "part", F.input_file_name()).agg(F.sum(F.octet_length("envelope_json")).alias("n")).collect()
    assert len({(r.dt, r.part) for r in per}) == len(per) and all(r.n < 400 + 300 for r in per)
    before = files(f"{tmp_path}/lake")
    assert C.compact(spark, root, part_bytes=400) == [] and files(f"{tmp_path}/lake") == before
    C.seal(spark, root, marks(e.where("session_id in ('a', 'b')")))
    third = C.compact(spark, root, part_bytes=400)
    assert [(x.dt, x.rows_in, x.rows_out) for x in third] == [("2024-01-01", 40, 16)]
    kept = {p: t for p, t in files(f"{tmp_path}/lake/compacted").items() if "dt=2024-01-01" not in p}
    assert kept and all(before[p] == t for p, t in kept.items())
    day = C.read_compacted(spark, root, dt="2024-01-01", fleet="main")
    assert sorted({r.session_id for r in day.collect()}) == ["a", "b"] and all("2024-01-01" in f for f in day.inputFiles())
    assert C.prune(spark, root) == 1 and C.read_compacted(spark, root).count() == 26
    assert C.compacted_envelopes(spark, root, dt="2024-01-03").first().event_id == "d2"


def test_generation_does_not_hang_on_order(spark):
    rows = [("2024-01-01", "f", f"s{i}", i * 7) for i in range(50)]
    make = lambda x: C.generations(spark.createDataFrame(x, "dt string, fleet string, session_id string, content long")).first().generation
    assert make(rows) == make(rows[::-1]) != make(rows[1:])


def test_rows_are_counted_where_they_are_deduplicated(spark, tmp_path, monkeypatch):
    rows = [("a", f"a{i:02d}", "2024-01-01T00:00:00Z", f"h{i % 4}" if i % 5 else S.EMPTY, "prompt") for i in range(20)] + [("a", "a00", "2024-01-01T00:00:00Z", S.EMPTY, "prompt")]
    e = events(spark, *rows)
    root = f"file://{tmp_path}/lake"
    write_batch(e, f"{root}/sessions", 0)
    C.seal(spark, root, marks(e))
    plans, kept = [], C.stored

    def stored(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, label)

    monkeypatch.setattr(C, "stored", stored)
    assert [(x.rows_in, x.rows_out) for x in C.compact(spark, root)] == [(21, 9)]
    assert any("_in" in p and "envelope_json" in p for p in plans)
