import random
import re

import numpy as np

from tidewell.llm import ngram_join as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, num=3, den=4):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((str(d), len(sets[i]), str(least.get(find(i))) if sets[i] else str(d)) for i, (d, _) in enumerate(rows))


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def corpus(seed, n=70, edits=6):
    rng = random.Random(seed)
    word = lambda: rng.choice(["alpha", "Beta", "gamma,", "δ", "x1", "the"]) + str(rng.randrange(40))
    common = [word() for _ in range(25)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.55:
            w = rng.choice(out).split()
            for _ in range(rng.randrange(edits)):
                if w:
                    w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.choice([0, 1, 3, 5, 9, 40, 90]))]
            if rng.random() < 0.4:
                w += common
        out.append(" ".join(w))
    return out


def test_components_agree_with_all_pairs(spark):
    for seed in (1, 2):
        rows = list(enumerate(corpus(seed)))
        rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[8][1]), (3, rows[3][1]), (1003, "a " * 30_000)]
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
        assert got(J.ngram_components(df)) == brute(rows)


def test_blocks_and_trees_find_the_same(spark, monkeypatch):
    rows = list(enumerate(corpus(5, 60, 12)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(J, "FANOUT", 2)
    monkeypatch.setattr(J, "BLOCK", 3)
    monkeypatch.setattr(J, "TURNS", 0)
    assert got(J.ngram_components(df)) == brute(rows)


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 9, 9, "x"), (2, "A b c d e f", 9, 9, "y")], "doc_id long, text string, sid long, n long, label string")
    assert got(J.ngram_components(df)) == [("1", 2, "1"), ("2", 2, "1")]
    assert J.ngram_components(df.limit(0)).count() == 0
    kept = J.distinct_documents(df)
    assert kept.columns == df.columns and [r.label for r in kept.collect()] == ["x"]


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, ""), (4, None), (5, "")]
    kept = J.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5]


def test_the_tree_bound_loses_no_pair():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        sets = []
        for _ in range(50):
            own = base[rng.random(60) < rng.choice([0.5, 0.9, 0.97])]
            sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 63, rng.integers(1, 20)).astype(np.uint64)])))
        n = np.array([len(s) for s in sets])
        label = rng.integers(0, 30, 50)
        vectors = [J.count_vector(s, J.groups_of(len(s))) for s in sets]
        found = {tuple(p) for p in J.tree_pairs(n, label, vectors).tolist()}
        for i in range(50):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if label[i] != label[j] and 7 * both >= 3 * (n[i] + n[j]):
                    assert (j, i) in found
