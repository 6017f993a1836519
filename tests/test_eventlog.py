import random
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidewell.operators import claims as M
from tidewell.sources import eventlog as L


def cite(s, m):
    return (s, m, None, None)


def events(spark):
    e = lambda c, at, kind, agent="a", **x: Row(claim_id=c, at=at, kind=kind, agent_id=agent, claim=x.get("claim"), claim_type=x.get("t"), subject="s", evidence=x.get("ev"), embedding=x.get("emb"), resolves_at=x.get("due"), independent_count=x.get("n"), confidence=x.get("conf"))
    rows = [
        e("c1", "2024-01-01", "proposed", claim="first", t="outcome", ev=[cite("s2", "m1"), cite("s1", "m1")]),
        e("c1", "2024-01-02", "proposed", claim="later", t="convention", ev=[cite("s0", "m9"), cite("s1", "m1")], emb=[1.0, 2.0], due="2024-03"),
        e("c1", "2024-01-03", "promoted", n=2, conf=0.8), e("c1", "2024-01-04", "proposed", emb=[9.0], due="2025", ev=[]),
        e("c2", "2024-01-01", "promoted", n=1), e("c2", "2024-01-02", "proposed", "weird/agent ü", claim="tab\there\n", t="outcome"),
    ]
    return spark.createDataFrame(rows, L.EVENT.replace("scope string, ", "").replace(", conflicts_with string, reason string", ""))


def test_each_event_stands_once(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    e = events(spark)
    assert L.read_events(spark, root).count() == 0
    assert L.append(e, root) == 6 and L.append(e.union(e).repartition(3), root) == 0
    assert L.append(e.withColumn("at", F.concat("at", F.lit("T1"))).limit(1), root) == 1
    got = L.read_events(spark, root)
    assert got.count() == 7 and not list(Path(tmp_path).glob("log/_writing*"))
    state = {r.claim_id: r for r in M.state(L.read_events(spark, root)).collect()}
    c1 = state["c1"]
    assert (c1.claim, c1.claim_type, c1.status, c1.independent_count, c1.embedding, c1.resolves_at) == ("first", "outcome", "promoted", 2, [1.0, 2.0], "2024-03")
    assert [(x.session_id, x.message_id) for x in c1.evidence] == [("s2", "m1"), ("s1", "m1"), ("s0", "m9")]
    assert (state["c2"].status, state["c2"].claim, state["c2"].evidence) == ("candidate", "tab\there\n", None)


def test_attempts_that_do_not_count_leave_nothing(tmp_path):
    rows = [Row(dt="2024-01-01", agent="a", key=f"k{i}", value="{}") for i in range(3)]
    w = L.LogWriter(f"{tmp_path}/log")
    w.write(iter(rows))  # an attempt whose task was killed
    w.commit([w.write(iter(rows[::-1])), None])
    again = L.LogWriter(f"{tmp_path}/log")
    again.commit([again.write(iter(rows))])
    files = [p for p in Path(tmp_path).rglob("*") if p.is_file()]
    assert len(files) == 1 and files[0].read_text() == "k0\t{}\nk1\t{}\nk2\t{}\n"
    third = L.LogWriter(f"{tmp_path}/log")
    third.abort([third.write(iter([Row(dt="x", agent="b", key="z", value="{}")]))])
    assert [p for p in Path(tmp_path).rglob("*") if p.is_file()] == files


def test_proposals_are_bounded_scrubbed_and_logged(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    ev = [("s", "m", None, None)]
    rows = [("a", "card 4111 1111 1111 1111 " + "x" * 5000, "outcome", "sub", ev), ("a", " ", "outcome", "sub", ev), ("b", "fine", "rumour", "sub", ev), ("b", "fine", "outcome", "sub", [])]
    p = spark.createDataFrame(rows, "agent_id string, claim string, claim_type string, subject string, evidence array<struct<session_id: string, message_id: string, excerpt_hash: string, observed_at: string>>")
    got = L.propose(p, root, "2024-02-02T00:00:00Z").collect()
    assert sorted(r.problem or "" for r in got) == ["", "claim is empty", "no evidence", "unknown type"]
    log = L.read_events(spark, root).collect()
    assert len(log) == 1 and "4111" not in log[0].claim and len(log[0].claim) < 2100 and log[0].kind == "proposed"
    L.propose(p, root, "2024-02-02T00:00:00Z")
    assert L.read_events(spark, root).count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_next_outcome_is_that_of_a_plain_search(spark, seed):
    rng = random.Random(seed)
    rows = [(f"c{i:03d}", rng.choice(["hypothesis", "outcome", "outcome"]), rng.choice("pq"), f"t{i}", rng.choice(["x", "y", "z"] if seed else ["x", "y"]), f"2024-{rng.randint(1, 12 if seed < 2 else 3):02d}", rng.choice(["promoted", "promoted", "contested"]), None) for i in range(150)]
    df = spark.createDataFrame(rows, "claim_id string, claim_type string, subject string, claim string, observed_by string, observed_at string, status string, resolves_at string")
    got = {r.claim_id: r.next.outcome_id if r.next else None for r in M.next_outcomes(df).collect()}
    want = {}
    for c, kind, subject, _, by, at, *_ in rows:
        if kind == "hypothesis":
            later = [(o[5], o[0]) for o in rows if o[1] == "outcome" and o[6] == "promoted" and o[2] == subject and o[5] >= at and o[4] != by]
            want[c] = min(later)[1] if later else None
    assert got == want
