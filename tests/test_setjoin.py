import random
import re

import numpy as np
import pytest

from tidewell.operators import gate as G
from tidewell.operators import setjoin as X
from tidewell.operators import similarity as S


@pytest.mark.parametrize("known", [3, X.KNOWN])
def test_blocks_of_coded_sets_give_all_pairs(spark, monkeypatch, known):
    monkeypatch.setattr(X, "BLOCK", 40)
    monkeypatch.setattr(X, "KNOWN", known)
    rng = random.Random(3)
    base = [[f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(1, 60))] for _ in range(30)]
    sets = [(i, sorted({w for w in rng.choice(base) if rng.random() < 0.8}), rng.choice(["x", "x", "y", None])) for i in range(300)]
    df = spark.createDataFrame(sets, "id int, words array<string>, g string")
    share = {(a, b): len(set(x) & set(y)) / len(x) for a, x, g in sets for b, y, h in sets if g and g == h and x}
    got = {(r.a, r.b): r.overlap for r in S.containment_pairs(df, df, 0.6, ["g"]).collect()}
    assert got == {k: v for k, v in share.items() if v >= 0.6} and len(got) > 1000
    both = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x, _ in sets for b, y, _ in sets if a < b and x and y}
    rows = S.jaccard_pairs(df.select("id", "words"), 0.35).collect()
    assert {(r.a, r.b): r.jaccard for r in rows} == {k: v for k, v in both.items() if v >= 0.35} and len(rows) > 1000


def test_no_join_of_sets_sends_a_row_a_word(spark):
    words = [(f"c{i}", "s", f"a{i} b c d e f g") for i in range(20)]
    claims = spark.createDataFrame(words, "claim_id string, subject string, claim string")
    sets = claims.selectExpr("claim_id id", "split(claim, ' ') words")
    for made in (G.contradictions(claims, claims), S.jaccard_pairs(sets, 0.35)):
        assert made.count() > 0
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "explode(words" not in plan and "explode(array_distinct" not in plan and "collect_list" not in plan


def test_blocks_of_vectors_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 30)
    monkeypatch.setattr(S, "ROWS", 4)
    monkeypatch.setattr(S, "COLUMNS", 7)
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 1, 1, None]), rng.choice([None, [0.0, 0.0]]) if i % 40 == 0 else [rng.gauss(0, 1) for _ in range(rng.choice([3, 3, 3, 2]))]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id int, label int, embedding array<double>")

    def cosine(x, y):
        lengths = [sum(v * v for v in e) ** 0.5 for e in (x, y)]
        return sum(p * q for p, q in zip(x, y, strict=True)) / (lengths[0] * lengths[1])

    fine = [(i, g, e) for i, g, e in rows if g is not None and e and any(e)]
    want = {(i, j): cosine(x, y) for i, g, x in fine for j, h, y in fine if g == h and len(x) == len(y)}
    got = {(r.a, r.b): r.cosine for r in S.cosine_pairs(df, 0.3, "label").collect()}
    assert got.keys() == {(i, j) for (i, j), c in want.items() if i < j and c >= 0.3} and len(got) > 500
    assert all(abs(c - want[k]) < 1e-12 for k, c in got.items())
    v = df.withColumnRenamed("vec_id", "id")
    near = {(r.a, r.b) for r in S.near_vectors(v.where("id % 2 = 0"), v.where("id % 2 = 1"), 0.35, ["label"]).collect()}
    assert near == {(i, j) for (i, j), c in want.items() if i % 2 == 0 and j % 2 == 1 and c >= 0.35}


def test_static_gate_lists_no_pairs_and_shuffles_no_texts(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 40)
    rng = random.Random(7)
    base = [[f"w{rng.randrange(90)}" for _ in range(rng.randrange(3, 30))] for _ in range(12)]
    rows = [(f"c{i:03d}", rng.choice(["x", "x", "y", None]), " ".join(w for w in rng.choice(base) if rng.random() < 0.9) or None, f"a{i % 5}") for i in range(300)]
    rows += [("c900", "x", rows[0][2], "a1"), ("c901", "x", "  ", "a1"), ("c902", "x", None, "a1")]
    claims = spark.createDataFrame(rows, "claim_id string, subject string, claim string, observed_by string").selectExpr("*", "'outcome' claim_type", "1L n_evidence", "true provenance_ok", "2L independent_count", "cast(null as double) trust")
    one, two = claims.where("substr(claim_id, 4) < '4'"), claims.where("substr(claim_id, 4) >= '4'")
    held = spark.createDataFrame([("a3",)], "agent_id string")
    want = {}
    for r in G.contradictions(one, two).collect():
        want[r.claim_id] = min(r.conflicts_with, want.get(r.claim_id, "z"))

    def listed(*_):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(G, "containment_pairs", listed)
    made = G.static_gate(one, two, held)
    got = {r.claim_id: r.conflicts_with for r in made.collect()}
    quarantined = {r[0] for r in rows if r[3] == "a3"}
    expected = {r.claim_id: None if r.claim_id in quarantined else want.get(r.claim_id) for r in one.collect()}
    assert got == expected and len(want) > 50
    assert not re.search(r"hashpartitioning\(observed_by#\d+, \d+\)", made._jdf.queryExecution().executedPlan().toString())


def test_gate_walk_reads_packed_lists(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK", 20)
    rng = random.Random(9)
    rows = [(f"c{i:03d}", rng.choice("xxy"), " ".join(sorted({f"w{rng.randrange(7)}" for _ in range(5)})), f"a{i % 5}") for i in range(160)]
    claims = spark.createDataFrame(rows, "claim_id string, subject string, claim string, observed_by string").selectExpr("*", "'outcome' claim_type", "1L n_evidence", "true provenance_ok", "cast(substr(claim_id, 4) <> '7' as long) independent_count", "cast(null as double) trust")
    one, two = claims.where("substr(claim_id, 4) < '8'"), claims.where("substr(claim_id, 4) >= '8'")
    made = {}

    def listed(*_):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(G, "containment_pairs", listed)
    monkeypatch.setattr(G, "stored", lambda df, label: made.setdefault(label, df.cache()))
    got = {r.claim_id: (r.decision, r.conflicts_with) for r in G.sequential_gate(one, two, spark.createDataFrame([("a3",)], "agent_id string")).collect()}
    assert made["gate-claims"].count() <= 160  # a row a claim, none a pair
    live, want = sorted(r for r in rows if r[0][3] >= "8"), {}
    for r in sorted(r for r in rows if r[0][3] < "8"):
        own = set(r[2].split())
        hit = next((x for x in live if x[1] == r[1] and x[2] != r[2] and len(own & set(x[2].split())) / len(own) >= 0.6), None)
        if r[3] == "a3":
            want[r[0]] = ("quarantined", None)
        elif hit:
            live.remove(hit)
            want[r[0]] = ("contest", hit[0])
        elif r[0][3] == "7":
            want[r[0]] = ("review", None)
        else:
            live.append(r)
            want[r[0]] = ("promote", None)
    assert got == want and {d for d, _ in got.values()} == {"promote", "contest", "quarantined", "review"}
    some = rng.sample(range(10**6), 500)
    assert X.listed(X.packed(np.array(some))).tolist() == sorted(some) and len(X.packed(np.arange(10**5))) < 10**4


def test_groups_without_a_hit_have_no_least(spark):
    a = spark.createDataFrame([(1, "x", ["p", "q"]), (2, "y", ["p", "q"])], "id int, g string, words array<string>")
    b = spark.createDataFrame([(8, "x", ["p", "q"], "n8"), (9, "y", ["r"], "n9")], "id int, g string, words array<string>, name string")
    assert [tuple(r) for r in S.least_containing(a, b, 0.6, ["g"]).collect()] == [("x", 1, "n8")]
    assert S.least_containing(a.where("g = 'y'"), b, 0.6, ["g"]).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_copies_are_sent_by_few_and_sets_are_shuffled_once(spark, monkeypatch, order):
    monkeypatch.setattr(X, "BLOCK", 40)
    rng = random.Random(11)
    texts = [[f"w{i % 7}", *(f"w{rng.randrange(14)}" for _ in range(6))] for i in range(30)]
    rows = [(k, "xy"[k % 2] if k else "x", sorted(set(texts[k])), f"n{i:03d}") for i in range(400) for k in [rng.randrange(30) if i % 4 == 0 else 0]]
    rows.sort(key=lambda r: r[3], reverse=order < 0)
    rows.append((29, None, ["w0"], "n0"))
    sets = spark.createDataFrame(rows, "id int, g string, words array<string>, name string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        sent = X.encoded(sets, ["g"], X.known_words(sets, 400), once=True).groupBy("g", "id").count().collect()
        assert max(r["count"] for r in sent) <= (1 if order > 0 else 9)  # once a batch at most
        some = sets.drop("name")
        least, pairs = S.least_containing(some, sets, 0.6, ["g"]), S.containment_pairs(some, sets, 0.6, ["g"])
        got, listed = {(r.g, r.a): r.least for r in least.collect()}, sorted((r.g, r.a, r.b) for r in pairs.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    near = sorted({(g, a, b, n) for a, g, x, _ in rows for b, h, y, n in rows if g and g == h and len({*x} & {*y}) / len(x) >= 0.6})
    assert listed == sorted({(g, a, b) for g, a, b, _ in near})
    want = {}
    for g, a, b, n in near:
        if a != b:
            want[g, a] = min(n, want.get((g, a), n))
    assert got == want and len(want) > 5
    for made in (least, pairs):
        assert not re.search(r"hashpartitioning\(g#\d+, id#\d+, \d+\)", made._jdf.queryExecution().executedPlan().toString())
