import random

import corpus_pipeline as P
from tidewell.llm.quality_classifier import op10_quality_classifier


def test_stages_do_their_work(spark, tmp_path):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 9))) for _ in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, text(rng.randrange(40, 120)), "en", f"s{i % 3}") for i in range(300)]
    rows += [(i, t.upper() + " ### $$$ ###" * 20, "en", "s0") for i, (_, t, _, _) in zip(range(300, 400), rows, strict=False)]
    rows += [(500 + i, rows[i][1] + " end", "en", "s1") for i in range(20)]
    rows += [(600, None, "en", None), (601, "", None, "s2")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300)) for i in range(400)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = P.quality(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and not ids & set(range(300, 400)) and len(ids & set(range(300))) > 290
    one = P.near_duplicates(spark, kept, str(tmp_path))
    left = {r.doc_id for r in one.collect()}
    assert one.columns == docs.columns and not any(500 + i in left and i in left for i in range(20))
    assert P.repeats(spark, one, str(tmp_path)).columns == docs.columns
    assert P.mixing(spark, one, str(tmp_path)).columns == docs.columns
    scored = op10_quality_classifier(spark, str(tmp_path))  # lazy, and reads files that it stored
    out = P.run(spark, str(tmp_path)).collect()
    assert scored.count() == len(rows)
    assert out and {r.doc_id for r in out} <= left


def test_five_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "source mixing", "packing"]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
