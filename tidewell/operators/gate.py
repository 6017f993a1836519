"""The promotion gate: evidence, contradiction, provenance, independence.

Candidates have claim_id, subject, claim, claim_type, observed_by, n_evidence,
provenance_ok and independent_count; trust may be null.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scores import COSINE_CONFLICT, WORDS_CONFLICT, confidence
from tidewell.functions.text import normalized_claim, words
from tidewell.operators.setjoin import listed, whole
from tidewell.operators.similarity import containing_lists, containment_pairs, least_containing, near_vectors
from tidewell.sources.shared import stored

#: Independent sessions that a type needs; a hypothesis never gets that far.
NEEDED = {"environment": 1, "outcome": 1, "convention": 1, "preference": 0}


def contradictions(candidates: DataFrame, promoted: DataFrame, threshold: float = WORDS_CONFLICT) -> DataFrame:
    """(claim_id, conflicts_with, overlap): promoted claims on the subject that share the words, or whose vector is near, but not the text.

    Vectors count where both sides have a column ``embedding``; overlap is null for claims that only vectors bring together.
    """
    # Claims of a subject with one text are one set, and equal texts do not contradict.
    text = F.sha2(normalized_claim(F.col("claim")), 256)
    side = lambda x: x.where(F.col("claim").isNotNull()).select(text.alias("id"), "subject", words(F.col("claim")).alias("words"))
    of = lambda x, text_as, id_as: x.select("subject", text.alias(text_as), F.col("claim_id").alias(id_as))
    shared = stored(containment_pairs(side(candidates), side(promoted), threshold, ["subject"]).where("a <> b"), "contradicting-texts")
    out = shared.join(of(candidates, "a", "claim_id"), ["subject", "a"]).join(of(promoted, "b", "conflicts_with"), ["subject", "b"]).select("claim_id", "conflicts_with", "overlap")
    if _vectors(candidates, promoted):
        near = _near(candidates, promoted).withColumn("overlap", F.lit(None).cast("double"))
        out = out.unionByName(near).groupBy("claim_id", "conflicts_with").agg(F.max("overlap").alias("overlap"))
    return out


def _first_contradictions(candidates: DataFrame, promoted: DataFrame, threshold: float = WORDS_CONFLICT) -> DataFrame:
    """(claim_id, conflicts_with): the least id of contradictions(), without listing those by words."""
    text = F.sha2(normalized_claim(F.col("claim")), 256)
    side = lambda x, *more: x.where(F.col("claim").isNotNull()).select(text.alias("id"), "subject", words(F.col("claim")).alias("words"), *more)
    least = least_containing(side(candidates), side(promoted, F.col("claim_id").alias("name")), threshold, ["subject"])
    out = candidates.select("subject", text.alias("a"), "claim_id").join(least, ["subject", "a"]).select("claim_id", F.col("least").alias("conflicts_with"))
    if _vectors(candidates, promoted):
        out = out.union(_near(candidates, promoted).select("claim_id", "conflicts_with"))
    return out.groupBy("claim_id").agg(F.min("conflicts_with").alias("conflicts_with"))


def _near(candidates: DataFrame, promoted: DataFrame) -> DataFrame:
    """(claim_id, conflicts_with) of claims with near vectors and other texts."""
    text = F.sha2(normalized_claim(F.col("claim")), 256)
    sent = lambda x: x.select(F.col("claim_id").alias("id"), "subject", "embedding")
    near = near_vectors(sent(candidates), sent(promoted), COSINE_CONFLICT, ["subject"]).select("a", "b")
    named = lambda x, c: x.select(F.col("claim_id").alias(c), text.alias(f"n{c}"))
    return near.join(named(candidates, "a"), "a").join(named(promoted, "b"), "b").where("na <> nb").select(F.col("a").alias("claim_id"), F.col("b").alias("conflicts_with"))


def _vectors(*tables: DataFrame) -> bool:
    return all("embedding" in t.columns for t in tables)


def _decided(candidates: DataFrame, conflicts: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Decisions where ``conflicts`` (claim_id, conflicts_with) has the one claim that contradicts a candidate, if any."""
    c = _staged(candidates, quarantined).join(conflicts, "claim_id", "left")
    contradicted = F.when(F.col("conflicts_with").isNotNull(), "contradiction")
    c = c.withColumn("gate", F.coalesce("early", contradicted, "late"))
    gate = F.col("gate")
    decision = F.when(gate.isNull(), "promote").when(gate == "contradiction", "contest").when(gate == "quarantine", "quarantined").otherwise("review")
    go = decision == "promote"
    return c.select(
        "claim_id", decision.alias("decision"), "gate", F.when(decision == "contest", F.col("conflicts_with")).alias("conflicts_with"),
        F.when(go, F.col("independent_count")).alias("independent_count"), F.when(go, F.round(confidence(F.col("independent_count"), F.col("trust")), 6)).alias("confidence"),
    )


def _staged(candidates: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Candidates with the gate that stops them before (early) and after (late) contradiction is looked at.

    Agents, of whom there are few, go to the candidates, so that no claim's text is shuffled for them.
    """
    held = F.broadcast(quarantined.select(F.col("agent_id").alias("observed_by"), F.lit(True).alias("held")).distinct())
    kind = F.col("claim_type")
    needed = F.create_map(*[F.lit(x) for pair in NEEDED.items() for x in pair])[kind]
    early = F.when(F.col("held"), "quarantine").when((F.col("n_evidence") == 0) | kind.isin("hypothesis", "preference"), "evidence")
    late = F.when(~F.col("provenance_ok"), "provenance").when(F.col("independent_count") < needed, "independence")
    return candidates.join(held, "observed_by", "left").withColumn("early", early).withColumn("late", late)


def static_gate(candidates: DataFrame, promoted: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Decisions against the claims that are promoted already; the conflict told of is the one of least id."""
    asked = _staged(candidates, quarantined).where("early is null")
    return _decided(candidates, _first_contradictions(asked, promoted), quarantined)


def decision_events(decisions: DataFrame, at: str) -> DataFrame:
    """One event for a promotion, one for each side of a conflict, none for a review."""
    event = lambda claim, kind, other: F.struct(claim.alias("claim_id"), F.lit(kind).alias("kind"), other.alias("conflicts_with"))
    none = F.lit(None).cast("string")
    me, other = F.col("claim_id"), F.col("conflicts_with")
    made = F.when(F.col("decision") == "promote", F.array(event(me, "promoted", none))).when(F.col("decision") == "contest", F.array(event(me, "contested", other), event(other, "contested", me)))
    return decisions.select(F.explode(made).alias("e")).select("e.*", F.lit(at).alias("at"))


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contests of subjects whose rows stand together."""
    yield from map(_contests, whole(batches, ["subject"]))


def _contests(subjects: pd.DataFrame) -> pd.DataFrame:
    """Contests of whole subjects: candidates of one go in order of id, and each meets the first live claim with a text that its own contradicts.

    Texts are numbers, those of a subject from its ``base`` on.  Live claims have places in
    the order in which they are met, and each text knows the place of its first one; what a
    text contradicts is unpacked when it is asked for.
    """
    kind, group = subjects["kind"].to_numpy(), subjects["group"].to_numpy()
    claims = (kind == "candidate") | (kind == "promoted")
    number = subjects["text"].to_numpy(np.int64)
    size = np.zeros(group[-1] + 1, np.int64)
    np.maximum.at(size, group[claims], number[claims] + 1)
    base = (np.cumsum(size) - size)[group]
    subjects = subjects.assign(text=number + base, base=base)
    packed: dict[int, list[tuple[bytes, int]]] = defaultdict(list)
    others: dict[int, list[int]] = defaultdict(list)
    for r in subjects[kind == "list"].itertuples():
        packed[r.text].append((r.found, r.base))
    for r in subjects[kind == "pair"].itertuples():
        others[r.text].append(int(r.other) + r.base)
    claims = subjects[claims].sort_values(["group", "kind", "claim_id", "text"], ascending=[True, False, True, True])
    if not len(claims) or not (packed or others):
        return pd.DataFrame([], columns=["claim_id", "conflicts_with"])
    ids, texts, free = claims["claim_id"].to_numpy(), claims["text"].to_numpy(np.int64), claims["may"].to_numpy(bool)
    norm = np.zeros(texts.max() + 1, np.int64)
    norm[texts] = claims["norm"].to_numpy(np.int64)
    gone = len(claims)
    head = np.full(len(norm), gone)
    live: dict[int, deque[int]] = defaultdict(deque)

    def join(place: int) -> None:
        live[texts[place]].append(place)
        head[texts[place]] = live[texts[place]][0]

    rows = []
    for place, waits in enumerate((claims["kind"] == "candidate").to_numpy()):
        own = texts[place]
        first = gone
        if waits and (own in packed or own in others):
            near = np.concatenate([*(listed(x) + first_text for x, first_text in packed.get(own, ())), np.array(others.get(own, ()), np.int64)])
            near = near[norm[near] != norm[own]]
            first = head[near].min() if len(near) else gone
        if first < gone:
            queue = live[texts[first]]
            queue.popleft()
            head[texts[first]] = queue[0] if queue else gone
            rows.append((ids[place], ids[first]))
        elif not waits or free[place]:
            join(place)
    return pd.DataFrame(rows, columns=["claim_id", "conflicts_with"])


def sequential_gate(candidates: DataFrame, promoted: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Decisions in order of id within a subject, where each sees those before it.

    A promotion adds a claim that later candidates meet, a contest takes one away.  Texts
    that contradict each other, by words or, where both tables have a column ``embedding``,
    by vectors, are found by joins of distinct texts, which are numbers within a subject; the
    walk goes by id and without texts, subjects apart, over lists of numbers that are packed
    until they are asked for.  Claims without a subject contradict none, and those without
    words or vector neither.
    """
    with_vectors = _vectors(candidates, promoted)
    vector = F.col("embedding") if with_vectors else F.lit(None).cast("array<float>")
    # Claims of one text and vector meet the same others; texts are told apart from vectors, as equal texts do not contradict.
    norm = F.sha2(F.concat_ws("\x00", "subject", normalized_claim(F.col("claim"))), 256).alias("norm")
    text = F.concat_ws(":", norm, F.sha2(F.to_json(vector), 256)).alias("text")
    c = _staged(candidates, quarantined).where(F.col("early").isNull() & F.col("subject").isNotNull())
    c = c.select("subject", "claim_id", "claim", norm, text, vector.alias("embedding"), F.col("late").isNull().alias("may"))
    p = promoted.where(F.col("subject").isNotNull()).select("subject", "claim_id", "claim", norm, text, vector.alias("embedding"), F.lit(True).alias("may"))
    side = lambda x: x.select(F.col("text").alias("id"), "subject", words(F.col("claim")).alias("words"))
    others = p.union(c.where("may"))
    short = lambda x, kind: x.select("subject", F.lit(kind).alias("kind"), "claim_id", "norm", F.col("text").alias("id"), "may")
    claims = stored(short(c, "candidate").union(short(p, "promoted")), "gate-claims")
    # Only candidates on a subject of several texts meet one that is not their own.
    told = claims.groupBy("subject").agg(F.min("norm").alias("low"), F.max("norm").alias("high"), F.bool_or(F.col("kind") == "candidate").alias("asked"))
    several = stored(told.where("low < high and asked").select("subject"), "gate-subjects")
    if several.isEmpty():
        return _decided(candidates, claims.where(F.lit(False)).select("claim_id", F.lit(None).cast("string").alias("conflicts_with")), quarantined)
    claims = claims.join(several, "subject", "left_semi")
    # A subject's texts are numbered in their order, and so are texts without vectors.
    of = Window.partitionBy("subject").orderBy
    numbers = claims.select("subject", "norm", "id").distinct().select("subject", "id", (F.row_number().over(of("norm", "id")) - 1).alias("number"), (F.dense_rank().over(of("norm")) - 1).alias("norm"))
    numbers = stored(numbers, "gate-texts")
    named = numbers.select("subject", "id", "number")
    row = {"kind": "string", "claim_id": "string", "text": "int", "norm": "int", "may": "boolean", "other": "int", "found": "binary"}
    full = lambda x: x.select("subject", *[(F.col(k) if k in x.columns else F.lit(None)).cast(v).alias(k) for k, v in row.items()])
    lists = containing_lists(side(c), side(others), WORDS_CONFLICT, ["subject"], named, several)
    rows = full(claims.drop("norm").join(numbers, ["subject", "id"]).withColumnRenamed("number", "text")).union(full(lists.withColumnRenamed("a", "text").withColumn("kind", F.lit("list"))))
    if with_vectors:
        sent = lambda x: x.groupBy(F.col("text").alias("id"), "subject").agg(F.first("embedding").alias("embedding")).join(named, ["subject", "id"]).select("subject", F.col("number").alias("id"), "embedding")
        near = near_vectors(sent(c), sent(others), COSINE_CONFLICT, ["subject"])
        rows = rows.union(full(near.select("subject", F.lit("pair").alias("kind"), F.col("a").alias("text"), F.col("b").alias("other"))))
    contests = rows.repartition("subject").sortWithinPartitions("subject").mapInPandas(_walk, "claim_id string, conflicts_with string")
    return _decided(candidates, contests, quarantined)


def explained(groups: DataFrame, quarantined: DataFrame) -> DataFrame:
    """What a reader is told of each group (see claims.groups()): would it promote, and which gate stops it."""
    agents = F.broadcast(quarantined.agg(F.collect_set("agent_id").alias("q")))
    g = groups.join(agents).withColumn("live", F.size(F.array_except("observers", "q"))).drop("q")
    kind = F.col("claim_type")
    gate = (
        F.when((F.size("observers") > 0) & (F.col("live") == 0), "quarantine")
        .when(~F.col("all_cite"), "evidence")
        .when(kind.isin("preference", "hypothesis") | ~kind.isin(*NEEDED, "hypothesis"), "evidence")
        .when((kind == "convention") & (F.col("live") < 2), "evidence")
        .when(kind == "convention", "independence")
    )
    return g.select("claim_type", "norm", F.col("live").cast("long").alias("live_observers"), gate.isNull().alias("would_promote"), gate.alias("gate"))
