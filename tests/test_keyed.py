import threading

from pyspark.sql import functions as F

from tidewell.sources import records
from tidewell.sources.keyed import Keyed


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id string, n long, tags array<string>")


def state(table):
    return sorted((r.id, r.n) for r in table.read().collect())


def test_merges_rewrite_only_buckets_that_change(spark, tmp_path):
    t = Keyed(spark, f"file://{tmp_path}/t", ["id"], buckets=8)
    assert t.read() is None and t.lookup([("a",)]) is None
    first = t.upsert(rows(spark, *[(f"k{i}", i, ["x"]) for i in range(200)]))
    assert (first.version, first.inserted, first.updated) == (1, 200, 0) and sum(first.rewritten.values()) == 200 and len(first.rewritten) == 8
    again = t.upsert(rows(spark, *[(f"k{i}", i, ["x"]) for i in range(50)]))
    assert (again.version, again.rewritten, again.same) == (1, {}, 50)
    own = t.read().groupBy(F.pmod(F.xxhash64("id"), F.lit(8)).alias("b")).count().collect()
    home = {r.b: r["count"] for r in own}
    change = t.upsert(rows(spark, ("k7", 700, None), ("k8", 8, ["x"])))
    assert (change.version, change.inserted, change.updated, change.same) == (2, 0, 1, 1)
    assert list(change.rewritten.values()) == [home[next(iter(change.rewritten))]]
    assert dict(state(t))["k7"] == 700 and len(state(t)) == 200
    assert {r.id: r.n for r in t.read(1).where("id = 'k7'").collect()} == {"k7": 7}
    found = t.lookup([("k7",), ("none",)])
    assert [(r.id, r.n) for r in found.collect()] == [("k7", 700)] and len(found.inputFiles()) <= 2
    assert len(t.prune(keep=2, older_s=0)) == 0 and len(t.prune(keep=1, older_s=0)) == 0
    t.upsert(rows(spark, *[(f"k{i}", -1, None) for i in range(200)]))
    assert len(t.prune(keep=1, older_s=0)) == 2 and len(state(t)) == 200


def test_repeated_keys_nulls_and_new_columns(spark, tmp_path):
    t = Keyed(spark, f"file://{tmp_path}/t", ["id"], buckets=4)
    assert t.upsert(rows(spark).limit(0)).rewritten == {}
    t.upsert(rows(spark, ("a", 1, None), ("a", 3, None), ("a", 2, ["z"]), ("b", None, None)))
    assert state(t) == [("a", 3), ("b", None)]
    assert t.upsert(rows(spark, ("b", None, None))).same == 1
    t.upsert(spark.createDataFrame([("c", 5, "new")], "id string, n long, more string"))
    got = {r.id: (r.n, r.tags, r.more) for r in t.read().collect()}
    assert got == {"a": (3, None, None), "b": (None, None, None), "c": (5, None, "new")}


def test_no_update_is_lost_between_writers(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    Keyed(spark, root, ["id"], buckets=2).upsert(rows(spark, ("k", 0, None)))
    failed = []

    def work(i):
        try:
            Keyed(spark, root, ["id"]).upsert(rows(spark, (f"w{i}", i, None), (f"v{i}", i, None)))
        except Exception as e:  # the assertion below tells
            failed.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert not failed and len(state(Keyed(spark, root, ["id"]))) == 9


def test_dead_writers_record_is_passed_over(spark, tmp_path, monkeypatch):
    t = Keyed(spark, f"file://{tmp_path}/t", ["id"], buckets=2)
    t.upsert(rows(spark, ("a", 1, None)))
    (tmp_path / "t" / "manifest" / f"{2:012d}.json").write_text('{"at": {"0"')
    monkeypatch.setattr(records, "GRACE", 0.0)
    assert t.upsert(rows(spark, ("b", 2, None))).version == 3
    assert state(t) == [("a", 1), ("b", 2)] and not records.take(spark, f"file://{tmp_path}/t/manifest", 3, {})
