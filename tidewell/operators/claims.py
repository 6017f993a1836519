"""Claims from their event log: folds, calibration, and what readers see.

Events have claim_id, at, key (their place in the log), kind, agent_id and the fields of a kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scores import COSINE_CONFLICT, LOW_SAMPLE, brier, cosine
from tidewell.functions.text import has_negation, normalized_claim, visible_line

STATUSES = {"promoted": "promoted", "contested": "contested", "retired": "retired", "superseded": "retired"}


def _live(events: DataFrame, order: list[str]) -> DataFrame:
    """Claim events from each claim's first proposal on, with ``o`` as their order."""
    e = events.where(F.col("kind").isin("proposed", *STATUSES)).withColumn("o", F.struct(*order))
    first = e.where("kind = 'proposed'").groupBy("claim_id").agg(F.min("o").alias("begin"))
    return e.join(first, "claim_id").where(F.col("o") >= F.col("begin"))


def fold(events: DataFrame) -> DataFrame:
    """State of each claim by (at, key): a promotion counts only where the claim is not promoted already."""
    live = _live(events, ["at", "key"])
    last = Window.partitionBy("claim_id").orderBy("o")
    steps = live.where("kind <> 'proposed'").withColumn("before", F.lag("kind").over(last))
    rise = (F.col("kind") == "promoted") & (F.coalesce("before", F.lit("")) != "promoted")
    status = steps.groupBy("claim_id").agg(F.max(F.struct("o", "kind")).alias("s"), F.max(F.when(rise, F.struct("o", "independent_count", "confidence"))).alias("p"))
    made = live.where("kind = 'proposed'").groupBy("claim_id").agg(F.min(F.struct("o", "claim", "agent_id", "at")).alias("f"), F.array_sort(F.collect_set("evidence_session")).alias("evidence"))
    return made.join(status, "claim_id", "left").select(
        "claim_id", F.col("f.claim").alias("claim"), F.col("f.agent_id").alias("observed_by"), F.col("f.at").alias("observed_at"), F.array_join("evidence", ",").alias("evidence"),
        F.coalesce(_status(F.col("s.kind")), F.lit("candidate")).alias("status"), F.coalesce("p.independent_count", F.lit(0)).cast("long").alias("independent_count"), F.coalesce("p.confidence", F.lit(0.0)).alias("confidence"),
    )


def state(events: DataFrame) -> DataFrame:
    """State of each claim with all that its events tell, by (at, key); see fold() for status and promotion.

    Evidence is the union of all proposals', in the order in which each citation came first;
    embedding and resolves_at are the first proposal's that has one.
    """
    folded = fold(events.withColumn("evidence_session", F.lit(None).cast("string"))).drop("evidence")
    made = _live(events, ["at", "key"]).where("kind = 'proposed'")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("o"))).alias(c)
    told = made.groupBy("claim_id").agg(F.min_by("claim_type", "o").alias("claim_type"), F.min_by("subject", "o").alias("subject"), first("embedding"), first("resolves_at"))
    cited = made.select("claim_id", "o", F.posexplode("evidence").alias("n", "e")).where("e is not null")
    once = cited.groupBy("claim_id", "e").agg(F.min(F.struct("o", "n")).alias("first"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("first", "e"))), lambda x: x["e"])
    evidence = once.groupBy("claim_id").agg(in_order.alias("evidence"))
    return folded.join(told, "claim_id").join(evidence, "claim_id", "left")


def _status(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in STATUSES.items() for x in pair])[kind]


def fold_by_key(events: DataFrame) -> DataFrame:
    """State by key alone, where the last promotion counts; with the time of the last step."""
    live = _live(events, ["key"])
    state = live.groupBy("claim_id").agg(
        F.min(F.when(F.col("kind") == "proposed", F.struct("o", "claim", "agent_id", "at"))).alias("f"),
        F.max(F.when(F.col("kind") != "proposed", F.struct("o", "kind", "at"))).alias("s"),
        F.max(F.when(F.col("kind") == "promoted", F.struct("o", "independent_count", "confidence"))).alias("p"),
    )
    return state.select(
        "claim_id", F.col("f.claim").alias("claim"), F.coalesce(_status(F.col("s.kind")), F.lit("candidate")).alias("status"), F.coalesce("s.at", "f.at").alias("updated_at"),
        F.coalesce("p.independent_count", F.lit(0)).cast("long").alias("independent_count"), F.coalesce("p.confidence", F.lit(0.0)).alias("confidence"),
    )


def latest(events: DataFrame, by: str, *fields: str) -> DataFrame:
    """The last event's fields of each ``by``, by (at, key)."""
    return events.groupBy(by).agg(F.max(F.struct("at", "key", *fields)).alias("x")).select(by, *[F.col(f"x.{f}").alias(f) for f in fields])


def quarantined(events: DataFrame) -> DataFrame:
    """Agents whose last quarantine event is not a release."""
    e = events.where(F.col("kind").isin("agent_quarantined", "agent_unquarantined"))
    return latest(e, "agent_id", "kind").where("kind = 'agent_quarantined'").select("agent_id")


def visible(claims: DataFrame, reads_enabled: bool = True, **equal: str) -> DataFrame:
    """What agents may read: promoted claims, if reads are enabled, with the given column values."""
    out = claims.where((F.col("status") == "promoted") & F.lit(reads_enabled))
    for c, value in equal.items():
        out = out.where(F.col(c) == value)
    return out


def scores(resolutions: DataFrame) -> DataFrame:
    """Each agent's counts of correct, incorrect and expired, with the Brier score."""
    n = lambda kind: F.count_if(F.col("outcome") == kind).alias(kind)
    c = resolutions.groupBy("agent_id").agg(n("correct"), n("incorrect"), n("expired"))
    return c.withColumn("resolved", F.col("correct") + F.col("incorrect")).withColumn("brier", brier(F.col("correct"), F.col("incorrect"))).withColumn("low_sample", F.col("resolved") < LOW_SAMPLE)


def contradiction_rates(claims: DataFrame) -> DataFrame:
    decided = claims.where(F.col("status").isin("promoted", "contested"))
    c = decided.groupBy("observed_by").agg(F.count_if(F.col("status") == "promoted").alias("promoted"), F.count_if(F.col("status") == "contested").alias("contested"))
    return c.withColumn("rate", F.col("contested") / (F.col("promoted") + F.col("contested")))


def next_outcomes(claims: DataFrame) -> DataFrame:
    """Hypotheses with ``next``: the first promoted outcome on the subject, not earlier, by another agent, as struct(o_at, outcome_id, ...).

    An as-of join without a join: hypotheses and outcomes stand in one sort by subject, the
    latest first and outcomes before hypotheses of their time, and each row carries the
    earliest outcome so far and the earliest one by another agent than that one's.  One of
    the two is what a hypothesis asks for.  Texts go as hashes, so rows of the sort are small.
    """
    claims = claims if "embedding" in claims.columns else claims.withColumn("embedding", F.lit(None).cast("array<float>"))
    claims = claims.withColumn("norm", F.sha2(normalized_claim(F.col("claim")), 256)).withColumn("denies", has_negation(F.col("claim")))
    h = claims.where("claim_type = 'hypothesis'").select("subject", F.col("observed_at").alias("at"), F.lit(1).alias("asks"), "claim_id", "norm", "denies", "observed_by", "embedding", "resolves_at")
    o = claims.where("claim_type = 'outcome' and status = 'promoted'").select("subject", F.col("observed_at").alias("at"), F.lit(0).alias("asks"), "claim_id", "norm", "denies", "observed_by", "embedding")
    back = Window.partitionBy("subject").orderBy(F.desc("at"), "asks", F.desc("claim_id"))
    own = F.struct(F.col("at").alias("o_at"), F.col("claim_id").alias("outcome_id"), F.col("norm").alias("o_norm"), F.col("denies").alias("o_denies"), F.col("observed_by").alias("o_by"), F.col("embedding").alias("o_embedding"))
    # Where the agent changes from one outcome to the next, the one before is the earliest by another.
    o = o.withColumn("own", own).withColumn("before", F.lag("own").over(back))
    o = o.withColumn("other", F.when(~F.col("before.o_by").eqNullSafe(F.col("observed_by")), F.col("before")))
    rows = h.unionByName(o.drop("before"), allowMissingColumns=True)
    so_far = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("near", F.last("own", ignorenulls=True).over(so_far)).withColumn("far", F.last("other", ignorenulls=True).over(so_far))
    met = F.when(F.col("near.o_by") != F.col("observed_by"), F.col("near")).when(F.col("far.o_by") != F.col("observed_by"), F.col("far"))
    return rows.where("asks = 1").withColumn("next", met).select("claim_id", "subject", "norm", "denies", "observed_by", F.col("at").alias("observed_at"), "embedding", "resolves_at", "next")


def resolutions(claims: DataFrame, now: str) -> DataFrame:
    """Each hypothesis with its next outcome (see next_outcomes()).

    Correct if the texts are the same but for case and margins, or if both or neither deny
    and their vectors, where there is a column ``embedding``, are near; any other outcome is
    incorrect, and without one a hypothesis expires at ``resolves_at``.
    """
    both = next_outcomes(claims).select("*", F.col("next.outcome_id").alias("outcome_id"), F.col("next.o_embedding").alias("o_embedding"))
    same = F.col("norm") == F.col("next.o_norm")
    near = (F.col("denies") == F.col("next.o_denies")) & (cosine(F.col("embedding"), F.col("o_embedding")) >= COSINE_CONFLICT)
    outcome = F.when(F.col("outcome_id").isNull(), F.when(F.lit(now) >= F.col("resolves_at"), "expired")).when(same | F.coalesce(near, F.lit(False)), "correct").otherwise("incorrect")
    return both.select("claim_id", "outcome_id", F.col("observed_by").alias("agent_id"), outcome.alias("outcome")).where("outcome is not null")


def calibration_events(resolved: DataFrame, at: str) -> DataFrame:
    """Events that a calibration appends: hypotheses that were resolved retire, whatever came out."""
    reason = F.concat(F.lit("resolved: "), F.col("outcome"))
    return resolved.select("claim_id", F.lit(at).alias("at"), F.lit("retired").alias("kind"), F.lit("calibration").alias("agent_id"), F.col("outcome_id").alias("conflicts_with"), reason.alias("reason"))


def groups(candidates: DataFrame) -> DataFrame:
    """Candidates with the same type and text but for case and margins: observers, events, and whether all cite."""
    return candidates.groupBy("claim_type", normalized_claim(F.col("claim")).alias("norm")).agg(
        F.array_sort(F.collect_set("observed_by")).alias("observers"), F.count("*").alias("events"), F.bool_and("cites").alias("all_cite")
    )


def rendered(claims: DataFrame) -> DataFrame:
    """claim_id and its two lines: who, when, how well founded; and the claim."""
    n = F.col("independent_count")
    sessions = F.when(n == 1, "1 independent session").otherwise(F.concat(n.cast("string"), F.lit(" independent sessions")))
    contested = F.when(F.col("status") == "contested", ", CONTESTED").otherwise("")
    line = F.concat(F.lit("["), visible_line(F.col("observed_by"), 200), F.lit(", "), visible_line(F.col("observed_at"), 200), F.lit(", "), sessions, F.lit(", conf "), F.format_string("%.2f", "confidence"), contested, F.lit("]\n  "), visible_line(F.col("claim"), 2000))
    return claims.select("claim_id", line.alias("rendered"))


def with_prefix(claims: DataFrame, prefix: str, preview: int = 10) -> DataFrame:
    """Claims that an id's beginning may mean: the first ``preview`` by id, each with how many there are in all and whether one is meant."""
    found = claims.where(F.col("claim_id").startswith(prefix))
    n = found.agg(F.count("*").alias("n_matches"))
    return found.orderBy("claim_id").limit(preview).join(F.broadcast(n)).withColumn("meant", F.col("n_matches") == 1)


def demoted(claims: DataFrame, held: DataFrame) -> DataFrame:
    """Promoted claims whose observer is quarantined, which become contested, with the reason."""
    reason = F.concat(F.lit("observing agent "), F.col("observed_by"), F.lit(" is quarantined"))
    return claims.where("status = 'promoted'").join(held.select(F.col("agent_id").alias("observed_by")), "observed_by", "left_semi").withColumn("status", F.lit("contested")).withColumn("reason", reason)


def parsed_events(lines: DataFrame, schema: str) -> DataFrame:
    """Claim events of JSON lines (key, value); those that are no event, or have no kind or claim, are skipped."""
    e = lines.select("key", F.from_json("value", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("e"))
    return e.where("e is not null and e._corrupt is null and e.kind is not null and e.claim_id is not null").select("key", "e.*").drop("_corrupt")


def listed(claims: DataFrame, status: str) -> DataFrame:
    """Claims of a status by type and id, with their place, counted type by type."""
    mine = claims.where(F.col("status") == status)
    counts = mine.groupBy("claim_type").agg(F.count("*").alias("n"))
    before = counts.select("claim_type", (F.sum("n").over(Window.orderBy("claim_type")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("claim_type").orderBy("claim_id"))
    return mine.withColumn("place", place).join(F.broadcast(before), "claim_type").withColumn("rank", F.col("before") + F.col("place")).drop("before", "place")
