"""Transcripts as text, and what a model's answer about one claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewell.functions.text import content_hash, json_payload, normalized_claim, without_injected

CLAIM_TYPES = ("environment", "convention", "preference", "outcome", "hypothesis")
#: Shape of a model's answer.
ANSWER = "claims array<struct<claim: string, claim_type: string, subject: string, evidence: array<struct<session_id: string, message_id: string>>>>"


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fenced(envelopes: DataFrame) -> DataFrame:
    """session_id and its transcript: a header, then ``[id] content`` and ``[id] tool:name ...`` lines in event order.

    Tool columns (tool_name, tool_input, exit_code, result) are read where there are any.
    """
    mark = F.concat(F.lit("["), F.coalesce("message_id", "event_id"), F.lit("] "))
    content = _trimmed(without_injected(F.col("content")))
    said = F.when(content != "", F.concat(mark, content, F.lit("\n")))
    ran = F.lit(None).cast("string")
    if "tool_name" in envelopes.columns:
        field = lambda name, c: F.coalesce(F.when(_trimmed(c) != "", F.concat(F.lit(f" {name}="), _trimmed(c))), F.lit(""))
        code = F.coalesce(F.concat(F.lit(" exit="), F.col("exit_code").cast("string")), F.lit(""))
        result = F.replace(F.col("result"), F.lit("\n"), F.lit(" ⏎ "))
        ran = F.concat(mark, F.lit("tool:"), F.col("tool_name"), field("input", F.col("tool_input")), code, field("result", result), F.lit("\n"))
    lines = envelopes.select("session_id", "event_id", F.concat_ws("", said, ran).alias("line")).where("line <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "line")))
    return lines.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("t")).select("session_id", F.concat(F.lit("session_id: "), F.col("session_id"), F.lit("\n"), F.col("t")).alias("transcript"))


def citable(envelopes: DataFrame) -> DataFrame:
    """What a citation may name: session_id, message_id, excerpt_hash, observed_at."""
    return envelopes.where("content is not null").groupBy("session_id", F.coalesce("message_id", "event_id").alias("message_id")).agg(F.max(F.struct("event_id", content_hash(F.col("content")).alias("h"), "emitted_at")).alias("x")).select("session_id", "message_id", F.col("x.h").alias("excerpt_hash"), F.col("x.emitted_at").alias("observed_at"))


#: Why a claim of an answer is dropped.
UNPARSED, NO_CLAIMS, UNKNOWN_TYPE, UNCITED = "answer is no JSON", "answer has no claims", "unknown type", "cites no message"


def judged_answers(answers: DataFrame, index: DataFrame, existing: DataFrame) -> DataFrame:
    """Claims of models' answers (session_id, answer), each with the reason why it is dropped or null.

    An answer that gives no claims has one row with its reason.  The message id verifies a
    citation; a wrong session id in it is put right, since an answer is about one session.
    A claim with the text and type of an existing one that is not retired takes that one's
    id, the least of several.
    """
    parsed = answers.select("session_id", F.from_json(json_payload(F.col("answer")), ANSWER).alias("a")).select("session_id", F.col("a.claims").alias("list"), F.posexplode_outer("a.claims").alias("n", "c"))
    early = F.when(F.col("list").isNull(), UNPARSED).when(F.col("n").isNull(), NO_CLAIMS).when(~F.coalesce(F.col("c.claim_type").isin(*CLAIM_TYPES), F.lit(False)), UNKNOWN_TYPE)
    parsed = parsed.withColumn("early", early)
    cites = parsed.where("early is null").select("session_id", "n", F.explode("c.evidence.message_id").alias("message_id")).distinct()
    found = cites.join(index, ["session_id", "message_id"]).groupBy("session_id", "n").agg(F.count("*").alias("evidence"), F.min("observed_at").alias("observed_at"))
    kept = parsed.join(found, ["session_id", "n"], "left").withColumn("norm", normalized_claim(F.col("c.claim")))
    known = existing.where("status <> 'retired'").groupBy(F.col("claim_type").alias("kt"), normalized_claim(F.col("claim")).alias("kn")).agg(F.min("claim_id").alias("claim_id"))
    met = kept.join(known, (F.col("norm") == F.col("kn")) & (F.col("c.claim_type") == F.col("kt")), "left")
    reason = F.coalesce("early", F.when(F.col("evidence").isNull(), UNCITED))
    return met.select("session_id", "n", F.col("c.claim").alias("claim"), F.col("c.claim_type").alias("claim_type"), F.col("c.subject").alias("subject"), "evidence", "observed_at", "claim_id", reason.alias("dropped"))


def claims_from_answers(answers: DataFrame, index: DataFrame, existing: DataFrame) -> DataFrame:
    """Claims of judged_answers() whose type is known and that cite real messages."""
    return judged_answers(answers, index, existing).where("dropped is null").drop("dropped")


def write_claims(answers: DataFrame, index: DataFrame, existing: DataFrame, path: str) -> dict[str, int]:
    """Write claims_from_answers() to ``path``; how many were kept and dropped, by reason.

    The counts are gathered by the write's own tasks as rows pass, without a second pass; a
    task that is run again counts once.
    """
    reasons = [UNPARSED, NO_CLAIMS, UNKNOWN_TYPE, UNCITED]
    seen = Observation()
    counts = [F.count_if(F.col("dropped").isNull()).alias("kept"), *[F.count_if(F.col("dropped") == r).alias(r) for r in reasons]]
    judged_answers(answers, index, existing).observe(seen, *counts).where("dropped is null").drop("dropped").write.parquet(path)
    return seen.get


#: Claims that a preamble lists at most, and the bytes it may take.
SHOWN, BUDGET = 400, 64 * 1024


def known_claims(claims: DataFrame) -> DataFrame:
    """(claim_id, line) that a new extraction is shown: the newest decided claims, whole ones that fit the budget.

    A line that does not fit is passed over and later ones still may; the walk is over the
    SHOWN newest rows only, which is what such a list holds.
    """
    import pandas as pd

    line = F.concat(F.lit("- ["), F.col("claim_type"), F.lit("] "), F.col("claim"), F.lit("\n"))
    top = claims.where(F.col("status").isin("promoted", "contested")).select("claim_id", line.alias("line")).orderBy(F.desc("claim_id")).limit(SHOWN)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        spent, keep = 0, []
        for text in rows.sort_values("claim_id", ascending=False)["line"]:
            size = len(text.encode())
            keep.append(spent + size <= BUDGET)
            spent += size if keep[-1] else 0
        return rows.sort_values("claim_id", ascending=False)[keep]

    return top.groupBy(F.lit(0).alias("all")).applyInPandas(lambda x: fit(x[["claim_id", "line"]]), "claim_id string, line string")


def problems(proposals: DataFrame, most: int = 20) -> DataFrame:
    """Proposals (claim, claim_type, subject, evidence array<struct>) with the first rule they break, or null."""
    blank = lambda c: F.coalesce(_trimmed(F.col(c)) == "", F.lit(True))
    hollow = F.exists("evidence", lambda e: F.coalesce(F.trim(e["session_id"]) == "", F.lit(True)) | F.coalesce(F.trim(e["message_id"]) == "", F.lit(True)))
    n = F.coalesce(F.size("evidence"), F.lit(0))
    return proposals.withColumn(
        "problem",
        F.when(blank("claim"), "claim is empty").when(blank("subject"), "subject is empty").when(~F.coalesce(F.col("claim_type").isin(*CLAIM_TYPES), F.lit(False)), "unknown type").when(n < 1, "no evidence").when(n > most, "too much evidence").when(hollow, "evidence names no message"),
    )
