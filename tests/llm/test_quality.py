import random

import numpy as np

from tidewell.llm import quality_classifier as Q
from tidewell.llm import quality_rules as R


def corpus(n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(rng.randrange(20, 80))]
        docs.append((i, " ".join(w) if good else " ".join(x.upper() + "###" for x in w)))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus()
    df = spark.createDataFrame([*docs, (None, None), (9999, ""), (9999, "")], "doc_id long, text string")
    got = Q.quality_scores(df, spark.createDataFrame([*labels, (None, 1), (9999, None)], "doc_id long, quality int")).collect()
    assert len(got) == len(docs) + 3
    want = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 50 and np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= Q.GOOD) for r in got)
    kept = Q.good_documents(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} & {i for i, q in labels if q == 0} == set()


def test_no_labels_and_no_documents(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.quality_scores(df, none).collect()] == [0.5]
    assert [r.score for r in Q.quality_scores(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()] == [1.0]
    assert Q.quality_scores(df.limit(0), none).count() == 0


def test_isotonic_is_the_best_ascending_fit():
    rng = np.random.default_rng(0)
    y, w = rng.random(30), rng.integers(1, 5, 30).astype(float)
    fit = Q.isotonic(np.arange(30), y, w)
    assert (np.diff(fit) >= -1e-12).all()
    for v in np.unique(fit):
        at = fit == v
        assert abs(np.average(y[at], weights=w[at]) - v) < 1e-9
    assert Q.isotonic(np.arange(3), np.array([1.0, 2, 3]), np.ones(3)).tolist() == [1, 2, 3]


def test_statistics_of_odd_texts():
    raw = "\n\na b a b\né🙂".encode()
    x = Q.statistics(np.frombuffer(raw, np.uint8), np.array([0, 0, len(raw), len(raw)]))
    assert x.shape == (3, Q.N_STATISTICS) and np.isfinite(x).all() and (x[0] == x[2]).all()


def brute_repeats(words):
    from collections import Counter

    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    return len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)})


def test_rules_and_repeats(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randrange(0, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "word " * 20_000), (93, "A B C\nA B C\n\nA B C")]
    df = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in R.quality_cascade(df).collect()}
    for i, t in rows:
        w = (t or "").split()
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), brute_repeats(w)), t
        assert got[i].base_failed == (len(w) < 50 or 100 * brute_repeats(w) > 50 * len(w))
        assert got[i].kept == (got[i].failed_rule is None)
    assert got[93].n_dup_lines == 2
    assert R.quality_cascade(df.limit(0)).count() == 0
    order = R.order_rules(df)
    assert {r.name for r, _, _ in order} == {r.name for r in R.RULES}


def test_the_order_of_rules_is_the_same_each_time_and_follows_cost(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "BETA", "#", "gamma\n"]) + str(rng.randrange(99)) for _ in range(80))) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    first = R.order_rules(df, eager=wanted)
    assert first == R.order_rules(df.repartition(3), eager=wanted)
    cost = {r.name: c for r, _, c in first}
    assert cost["symbols"] == cost["word_length"] == 1 < cost["capitals"] < cost["duplicate_lines"]
    assert [s / c for _, s, c in first] == sorted((s / c for _, s, c in first), reverse=True)
    full = {r.doc_id: r.kept for r in R.quality_cascade(df).collect()}
    assert full == {r.doc_id: r.kept for r in R.quality_cascade(df, statistics=()).collect()}


def test_repeated_rows_and_names_of_the_cascade(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, None, None)], "doc_id long, text string, n_words int, _q_t string")
    got = R.quality_cascade(df)
    assert got.columns[:3] == ["doc_id", "text", "_q_t"] and sorted((r.n_words, r["_q_t"], r.kept) for r in got.where("doc_id = 1").collect()) == [(2, "x", False)] * 2
    assert got.count() == 3


def test_other_columns_of_good_documents_stay(spark):
    docs, labels = corpus(120)
    df = spark.createDataFrame([(i, t, "mine", i) for i, t in docs], "doc_id long, text string, _q_h string, _p_b long")
    kept = Q.good_documents(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = kept.collect()
    assert kept.columns == df.columns and got and all(r["_q_h"] == "mine" and r["_p_b"] == r.doc_id for r in got)
