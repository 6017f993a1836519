"""What the gate asks of captured sessions: their windows, agents, messages and what they were shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An observer that needs no captured session.
HUMAN = "human"


def gate_inputs(envelopes: DataFrame) -> DataFrame:
    """(session_id, kind, value, first_at, last_at): all that the gate asks, from one scan and one shuffle.

    Kinds: ``window`` (no value; the times of a session's first and last event), ``agent``
    (an agent of the session), ``message`` (a message that a citation may name) and ``shown``
    (a claim that was put before the session).  Rows are combined before they are shuffled
    by session, kind and value, so neither a long session nor a claim that all were shown
    stands in a list.
    """
    tag = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    own = F.array(tag("window", F.lit(None)), tag("agent", F.col("agent_id")), tag("message", F.col("message_id")))
    shown = F.transform(F.coalesce("injected_context", F.array()), lambda c: tag("shown", c["claim_id"]))
    rows = envelopes.select("session_id", "emitted_at", F.explode(F.concat(own, shown)).alias("t")).select("session_id", "emitted_at", "t.*")
    rows = rows.where((F.col("kind") == "window") | F.col("value").isNotNull())
    return rows.groupBy("session_id", "kind", "value").agg(F.min("emitted_at").alias("first_at"), F.max("emitted_at").alias("last_at"))


def checked(claims: DataFrame, inputs: DataFrame) -> DataFrame:
    """``claims`` (claim_id, observed_by, evidence) with n_evidence, provenance_ok and independent_count from gate_inputs().

    Provenance holds if the observer is an agent of some session (or human) and each citation
    names a message of its session and a time in that session's window.  Sessions that were
    shown the claim do not count as independent.
    """
    of = lambda kind: inputs.where(F.col("kind") == kind)
    cites = claims.select("claim_id", F.explode("evidence").alias("e")).select("claim_id", "e.session_id", "e.message_id", "e.observed_at")
    met = cites.join(of("window").select("session_id", "first_at", "last_at"), "session_id", "left")
    met = met.join(of("message").select("session_id", F.col("value").alias("message_id"), F.lit(True).alias("there")), ["session_id", "message_id"], "left")
    met = met.join(of("shown").select("session_id", F.col("value").alias("claim_id"), F.lit(True).alias("shown")), ["session_id", "claim_id"], "left")
    good = F.coalesce(F.col("observed_at").between(F.col("first_at"), F.col("last_at")) & F.col("there"), F.lit(False))
    per = met.groupBy("claim_id").agg(F.count("*").alias("n_evidence"), F.bool_and(good).alias("good"), F.count_distinct(F.when(F.col("shown").isNull(), F.col("session_id"))).alias("independent"))
    agents = of("agent").select(F.col("value").alias("observed_by"), F.lit(True).alias("known")).distinct()
    out = claims.drop("n_evidence", "provenance_ok", "independent_count").join(per, "claim_id", "left").join(agents, "observed_by", "left")
    known = F.coalesce("known", F.lit(False)) | (F.col("observed_by") == HUMAN)
    return out.withColumns({
        "n_evidence": F.coalesce("n_evidence", F.lit(0)).cast("long"), "provenance_ok": F.coalesce(known & F.coalesce("good", F.lit(True)), F.lit(False)), "independent_count": F.coalesce("independent", F.lit(0)).cast("long"),
    }).drop("good", "independent", "known")
