from pathlib import Path

from pyspark.sql import functions as F

from tidewell.plans import maintenance
from tidewell.streaming import refresh


def test_each_batch_meets_the_newest_whole_snapshot(spark, tmp_path):
    snap, lines = f"file://{tmp_path}/snap", tmp_path / "lines"
    lines.mkdir()
    claims = lambda n: spark.range(n).select(F.col("id").cast("string").alias("claim_id"), F.lit(n).alias("version"))
    meet = lambda batch, tables: batch.join(tables["claims"], F.col("value") == F.col("claim_id"), "left").select("value", "version")

    def step(text):
        (lines / f"{len(list(lines.iterdir()))}.txt").write_text(text)
        stream = spark.readStream.text(str(lines))
        refresh.with_snapshot(stream, snap, meet, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        return {(r.value, r.version) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    assert refresh.newest_whole(spark, snap) is None
    maintenance.publish(spark, {"claims": claims(2)}, snap)
    assert step("0\n1\n2\n") == {("0", 2), ("1", 2), ("2", None)}
    last = maintenance.publish(spark, {"claims": claims(3)}, snap)
    assert step("2\n") >= {("2", 3)}
    newest = maintenance.publish(spark, {"claims": claims(9)}, snap)
    assert newest != last and step("8\n") >= {("8", 9)}
    # the newest is damaged: a file of it is gone, then one is cut short
    part = next(p for p in Path(f"{tmp_path}/snap/{newest}/claims").glob("part-*.parquet") if p.stat().st_size)
    whole = part.read_bytes()
    part.unlink()
    assert step("8\n2\n") >= {("8", None), ("2", 3)}
    part.write_bytes(whole[:40])
    assert refresh.newest_whole(spark, snap)["claims"].count() == 3
    part.write_bytes(whole)
    assert refresh.newest_whole(spark, snap)["claims"].count() == 9
