import random

from tidewell.operators import claims as M
from tidewell.operators import gate as G
from tidewell.operators import search as R
from tidewell.operators import similarity as S

LOG = "claim_id string, at string, key string, kind string, agent_id string, claim string, evidence_session string, independent_count long, confidence double"


def log(spark, *rows):
    return spark.createDataFrame([(c, at, key, kind, "a", f"t{key}", f"s{key}", n, n / 10) for c, at, key, kind, n in rows], LOG)


def test_the_fold_keeps_the_first_promotion_of_a_run(spark):
    e = log(spark, ("c", "0", "0", "promoted", 9), ("c", "1", "1", "proposed", 0), ("c", "2", "2", "promoted", 2), ("c", "3", "3", "promoted", 3), ("c", "4", "4", "proposed", 0), ("d", "1", "5", "promoted", 1))
    r = M.fold(e).collect()
    assert [(x.claim_id, x.status, x.independent_count, x.claim, x.evidence) for x in r] == [("c", "promoted", 2, "t1", "s1,s4")]
    again = log(spark, ("c", "1", "1", "proposed", 0), ("c", "2", "2", "promoted", 2), ("c", "3", "3", "contested", 0), ("c", "4", "4", "promoted", 4), ("c", "5", "6", "superseded", 0))
    r = M.fold(again).first()
    assert (r.status, r.independent_count) == ("retired", 4)


def test_the_two_folds_order_differently(spark):
    e = log(spark, ("c", "1", "1", "proposed", 0), ("c", "9", "2", "contested", 0), ("c", "3", "3", "promoted", 3))
    assert M.fold(e).first().status == "contested"
    assert M.fold_by_key(e).first().status == "promoted"


def test_expired_predictions_do_not_touch_the_score(spark):
    r = spark.createDataFrame([("a", "expired")] * 5 + [("b", "correct")] * 9 + [("b", "incorrect")] * 3, "agent_id string, outcome string")
    got = {x.agent_id: (x.resolved, x.brier, x.low_sample) for x in M.scores(r).collect()}
    assert got == {"a": (0, 0.5, True), "b": (12, 0.25, False)}


def test_a_hypothesis_is_judged_by_the_first_outcome_of_another(spark):
    cols = "claim_id string, claim_type string, subject string, claim string, observed_by string, observed_at string, status string, resolves_at string"
    rows = [
        ("h1", "hypothesis", "s", "It is X", "a", "2", "candidate", None), ("h2", "hypothesis", "t", "y", "a", "2", "candidate", "3"), ("h3", "hypothesis", "u", "y", "a", "2", "candidate", "8"),
        ("o0", "outcome", "s", "old", "b", "1", "promoted", None), ("o1", "outcome", "s", "it is x", "a", "2", "promoted", None), ("o2", "outcome", "s", " it is x", "b", "3", "promoted", None), ("o3", "outcome", "s", "other", "b", "4", "promoted", None),
    ]
    got = {r.claim_id: (r.outcome, r.outcome_id) for r in M.resolutions(spark.createDataFrame(rows, cols), "5").collect()}
    assert got == {"h1": ("correct", "o2"), "h2": ("expired", None)}


def gated(spark, rows):
    cols = "claim_id string, subject string, claim string, claim_type string, observed_by string, n_evidence long, provenance_ok boolean, independent_count long, trust double"
    return spark.createDataFrame(rows, cols)


def test_later_candidates_meet_earlier_promotions(spark):
    c = gated(spark, [("c1", "s", "port is one two three", "outcome", "a", 1, True, 1, None), ("c2", "s", "port is one two four", "outcome", "b", 1, True, 1, None), ("c3", "s", "port is one two five", "outcome", "b", 1, True, 1, None), ("c4", "s", "q", "outcome", "bad", 1, True, 1, None), ("c5", "s", "r", "hypothesis", "b", 1, True, 1, None)])
    none = c.limit(0)
    banned = spark.createDataFrame([("bad",)], "agent_id string")
    got = {r.claim_id: (r.decision, r.conflicts_with) for r in G.sequential_gate(c, none, banned).collect()}
    # c2 contests c1, which c3 then no longer meets
    assert got == {"c1": ("promote", None), "c2": ("contest", "c1"), "c3": ("promote", None), "c4": ("quarantined", None), "c5": ("review", None)}
    still = {r.claim_id: r.decision for r in G.static_gate(c, none, banned).collect()}
    assert still["c2"] == "promote"
    assert {r.kind for r in G.decision_events(G.sequential_gate(c, none, banned), "t").collect()} == {"promoted", "contested"}


def walked(candidates, promoted, banned):
    """The gate claim by claim: the promoted in order of id, then what was promoted on the way."""
    out, known = {}, [[c, s, t.strip().lower(), True] for c, s, t, *_ in sorted(promoted)]
    for c, s, t, kind, agent, n, ok, k, _ in sorted(candidates):
        mine, conflict, gate = set(t.lower().split()), None, None
        if agent in banned:
            gate = "quarantine"
        elif n == 0 or kind in ("hypothesis", "preference"):
            gate = "evidence"
        else:
            hit = next((x for x in known if x[3] and x[1] == s and x[2] != t.strip().lower() and mine and len(mine & set(x[2].split())) / len(mine) >= G.WORDS_CONFLICT), None)
            if hit:
                gate, conflict, hit[3] = "contradiction", hit[0], False
            elif not ok:
                gate = "provenance"
            elif k < G.NEEDED[kind]:
                gate = "independence"
        if gate is None:
            known.append([c, s, t.strip().lower(), True])
        out[c] = (gate, conflict)
    return out


def test_the_gate_agrees_with_a_plain_walk(spark):
    rng = random.Random(7)
    for n, least in ((60, 0), (200, 2)):
        rows = [
            (f"c{i:03}", rng.choice("st"), rng.choice(["", " "]) + " ".join(rng.choices("abcdefA", k=rng.randrange(least, 6))), rng.choice(["outcome", "convention", "environment", "hypothesis"]), rng.choice("xyz"), rng.randrange(4), rng.random() < 0.8, rng.randrange(3), None)
            for i in rng.sample(range(1000), n)
        ]
        c, p = rows[: 2 * n // 3], rows[2 * n // 3 :]
        banned = spark.createDataFrame([("z",), ("z",)], "agent_id string")
        got = {r.claim_id: (r.gate, r.conflicts_with) for r in G.sequential_gate(gated(spark, c), gated(spark, p), banned).collect()}
        assert got == walked(c, p, {"z"})
        assert sum(gate == "contradiction" for gate, _ in got.values()) > 5
    assert G.sequential_gate(gated(spark, c[:0]), gated(spark, p), banned).count() == 0


def test_similarity_joins_agree_with_all_pairs(spark):
    rng = random.Random(4)
    sets = [(i, sorted(set(rng.choices("abcdefghij", k=rng.randrange(0, 7)))), i % 2) for i in range(60)]
    df = spark.createDataFrame(sets, "id int, words array<string>, g int")
    for t in (0.35, 0.6, 1.0):
        share = {(a, b) for a, x, g in sets for b, y, h in sets if g == h and x and len(set(x) & set(y)) / len(x) >= t}
        assert {(r.a, r.b) for r in S.containment_pairs(df, df, t, ["g"]).collect()} == share
        both = {(a, b) for a, x, _ in sets for b, y, _ in sets if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= t}
        assert {(r.a, r.b) for r in S.jaccard_pairs(df.select("id", "words"), t).collect()} == both


def test_search(spark):
    docs = spark.createDataFrame([(1, "staging port is 2222"), (2, "port port port"), (3, "nothing here")], "id int, text string")
    assert [r.id for r in R.bm25(docs, "staging").collect()] == [1]
    assert [r.id for r in R.hybrid(docs, "staging port").orderBy("rank").collect()][0] == 1
    assert [(r.id, r.score) for r in R.hybrid(docs, "  ", 1).orderBy("rank").collect()] == [(1, 0.0), (2, 0.0)]
    assert R.hybrid(docs, "!!!").count() == 0


def near(a, b):
    if not a or not b or len(a) != len(b):
        return False
    lengths = [sum(x * x for x in v) ** 0.5 for v in (a, b)]
    return all(lengths) and sum(x * y for x, y in zip(a, b, strict=True)) / (lengths[0] * lengths[1]) >= G.COSINE_CONFLICT


def test_the_gate_agrees_with_a_plain_walk_over_words_and_vectors(spark):
    rng = random.Random(11)
    vector = lambda: rng.choice([None, [0.0, 0.0], [1.0, 2.0, 3.0], [float(rng.randrange(-4, 5)), float(rng.randrange(-4, 5))], [float(rng.randrange(-4, 5)), 1.0]])
    rows = [(f"c{i:03}", rng.choice("st"), " ".join(rng.choices("abcdefghij", k=rng.randrange(1, 6))), vector()) for i in rng.sample(range(1000), 150)]
    frame = lambda x: spark.createDataFrame([(c, s, t, "outcome", "x", 1, True, 1, None, v) for c, s, t, v in x], "claim_id string, subject string, claim string, claim_type string, observed_by string, n_evidence long, provenance_ok boolean, independent_count long, trust double, embedding array<float>")
    c, p = rows[:100], rows[100:]
    clash = lambda x, y: x[1] == y[1] and x[2] != y[2] and (len(set(x[2].split()) & set(y[2].split())) / len(set(x[2].split())) >= G.WORDS_CONFLICT or near(x[3], y[3]))
    known, want = [[x, True] for x in sorted(p, key=lambda x: x[0])], {}
    for x in sorted(c, key=lambda x: x[0]):
        hit = next((k for k in known if k[1] and clash(x, k[0])), None)
        want[x[0]] = hit[0][0] if hit else None
        if hit:
            hit[1] = False
        else:
            known.append([x, True])
    nobody = spark.createDataFrame([], "agent_id string")
    got = {r.claim_id: r.conflicts_with for r in G.sequential_gate(frame(c), frame(p), nobody).collect()}
    assert got == want and 10 < sum(v is not None for v in want.values()) < 100
    still = {r.claim_id: r.conflicts_with for r in G.static_gate(frame(c), frame(p), nobody).collect()}
    assert still == {x[0]: min((y[0] for y in p if clash(x, y)), default=None) for x in c}
    for size in (1, 2, 6):
        pairs = {(r.a, r.b) for r in S.near_vectors(frame(c).selectExpr("claim_id id", "subject", "embedding"), frame(p).selectExpr("claim_id id", "subject", "embedding"), 0.85, ["subject"], size).collect()}
        assert pairs == {(x[0], y[0]) for x in c for y in p if x[1] == y[1] and near(x[3], y[3])}


def test_predictions_may_come_true_in_other_words(spark):
    row = lambda c, kind, claim, by, v: (c, kind, "s", claim, by, "2024-01", "promoted", "2024-02", v)
    rows = [row("h1", "hypothesis", "it is fast", "a", [1.0, 0.1]), row("h2", "hypothesis", "it is not fast", "a", [1.0, 0.1]), row("h3", "hypothesis", "slow", "a", None), row("o", "outcome", "speed is good", "b", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "claim_id string, claim_type string, subject string, claim string, observed_by string, observed_at string, status string, resolves_at string, embedding array<float>")
    got = M.resolutions(df, "2024-03")
    assert {r.claim_id: r.outcome for r in got.collect()} == {"h1": "correct", "h2": "incorrect", "h3": "incorrect"}
    assert {(r.kind, r.reason) for r in M.calibration_events(got, "t").collect()} == {("retired", "resolved: correct"), ("retired", "resolved: incorrect")}


def test_subjects_of_a_few_claims_go_through_the_gate_together(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(f"c{i:04}", f"s{rng.randrange(120)}", " ".join(rng.choices("abcde", k=rng.randrange(1, 5))), rng.choice(["outcome", "convention"]), "x", 1, rng.random() < 0.9, rng.randrange(3), None) for i in rng.sample(range(1000), 400)]
    rows += [(f"d{i:04}", "large", " ".join(rng.choices("abcdef", k=3)), "outcome", "x", 1, True, 1, None) for i in range(60)]
    c, p = rows[::2], rows[1::2]
    nobody = spark.createDataFrame([], "agent_id string")
    vectors = spark.createDataFrame([(i, i % 80, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(400)], "id int, g int, embedding array<double>")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, 7)
    try:
        made = G.sequential_gate(gated(spark, c), gated(spark, p), nobody)
        got = {r.claim_id: (r.gate, r.conflicts_with) for r in made.collect()}
        least = G.static_gate(gated(spark, c), gated(spark, p), nobody)
        first = {r.claim_id: r.conflicts_with for r in least.collect()}
        near_ = S.near_vectors(vectors.where("id < 200"), vectors.where("id >= 200"), 0.35, ["g"])
        pairs = {(r.g, r.a, r.b) for r in near_.collect()}
    finally:
        spark.conf.unset(conf)
    assert got == walked(c, p, set()) and sum(gate == "contradiction" for gate, _ in got.values()) > 50
    clash = lambda x, y: x[1] == y[1] and x[2] != y[2] and len({*x[2].split()} & {*y[2].split()}) / len({*x[2].split()}) >= G.WORDS_CONFLICT
    assert first == {x[0]: min((y[0] for y in p if clash(x, y)), default=None) for x in c}
    v = [tuple(r) for r in vectors.collect()]
    cos = lambda x, y: (x[0] * y[0] + x[1] * y[1]) / ((x[0] ** 2 + x[1] ** 2) * (y[0] ** 2 + y[1] ** 2)) ** 0.5
    assert pairs == {(g, a, b) for a, g, x in v for b, h, y in v if a < 200 <= b and g == h and cos(x, y) >= 0.35} and len(pairs) > 50
    for x in (made, least, near_):  # no call of Python a subject
        assert "GroupsInPandas" not in x._jdf.queryExecution().executedPlan().toString()

    def looked_at(*_):
        raise AssertionError("subjects of one text are compared")

    monkeypatch.setattr(G, "containing_lists", looked_at)
    alone = [(*r[:1], r[0], *r[2:]) for r in rows[:100]]
    got = {r.claim_id: (r.gate, r.conflicts_with) for r in G.sequential_gate(gated(spark, alone), gated(spark, p), nobody).collect()}
    assert got == walked(alone, [], set())
