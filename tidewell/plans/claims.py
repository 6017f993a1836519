"""Queries over claims: folds, calibration, the gate, and what readers get."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions import scores as C
from tidewell.functions.text import content_hash, normalized_claim
from tidewell.operators import claims as M
from tidewell.operators import gate as G
from tidewell.operators import similarity as S
from tidewell.operators import transcripts as T
from tidewell.plans.catalog import query
from tidewell.sources.shared import new_folder
from tidewell.sources.tables import claim_events, conversation_envelopes, document_claims, event_envelopes, sql, table

_FOLD = """,
first AS (SELECT claim_id, min({o}) AS begin FROM log WHERE kind = 'proposed' GROUP BY ALL),
live AS (SELECT log.*, {o} AS o FROM log JOIN first USING (claim_id) WHERE {o} >= begin),
steps AS (SELECT *, lag(kind) OVER (PARTITION BY claim_id ORDER BY o) AS before FROM live WHERE kind <> 'proposed'),
f AS (SELECT * FROM live WHERE kind = 'proposed' QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY o) = 1),
s AS (SELECT * FROM steps QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY o DESC) = 1),
p AS (SELECT * FROM steps WHERE kind = 'promoted' {rise} QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY o DESC) = 1),
ev AS (SELECT claim_id, array_to_string(list_sort(list(DISTINCT evidence_session)), ',') AS evidence FROM live WHERE kind = 'proposed' GROUP BY ALL)"""
_FOLD1 = _FOLD.format(o="\"at\" || '|' || key", rise="AND coalesce(before, '') <> 'promoted'")
_FOLD2 = _FOLD.format(o="key", rise="")


@query("claim_fold", sql("log", _FOLD1 + " SELECT f.claim_id, f.claim, f.agent_id AS observed_by, f.\"at\" AS observed_at, ev.evidence, coalesce(s.kind, 'candidate') AS status, coalesce(p.independent_count, 0) AS independent_count, coalesce(p.confidence, 0) AS confidence FROM f JOIN ev USING (claim_id) LEFT JOIN s USING (claim_id) LEFT JOIN p USING (claim_id)"))
def claim_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fold(claim_events(spark, sf_dir))


@query("claim_fold_snapshot", sql("log", _FOLD2 + " SELECT f.claim_id, f.claim, coalesce(s.kind, 'candidate') AS status, coalesce(s.\"at\", f.\"at\") AS updated_at, coalesce(p.independent_count, 0) AS independent_count, coalesce(p.confidence, 0) AS confidence FROM f LEFT JOIN s USING (claim_id) LEFT JOIN p USING (claim_id)"))
def claim_fold_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fold_by_key(claim_events(spark, sf_dir))


@query("latest_scores", sql("log", "SELECT agent_id, k AS resolved_count, confidence AS brier FROM log WHERE kind = 'promoted' QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY \"at\" DESC, key DESC) = 1"))
def latest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = claim_events(spark, sf_dir).where("kind = 'promoted'").select("agent_id", "at", "key", F.col("k").alias("resolved_count"), F.col("confidence").alias("brier"))
    return M.latest(e, "agent_id", "resolved_count", "brier")


@query("quarantined_agents", sql("log", ", q AS (SELECT agent_id, \"at\", key, CASE WHEN k % 10 < 5 THEN 'agent_quarantined' ELSE 'agent_unquarantined' END AS kind FROM log), l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY \"at\" DESC, key DESC) = 1) SELECT agent_id FROM l WHERE kind = 'agent_quarantined'"))
def quarantined_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("k") % 10 < 5, "agent_quarantined").otherwise("agent_unquarantined")
    return M.quarantined(claim_events(spark, sf_dir).withColumn("kind", kind))


@query("trust_multiplier", sql("log", ", s AS (SELECT * FROM log WHERE kind = 'promoted' QUALIFY row_number() OVER (PARTITION BY agent_id ORDER BY \"at\" DESC, key DESC) = 1) SELECT agent_id, round(CASE WHEN k = 0 THEN 1.0 ELSE 0.7 + 0.6 * ((12 * 0.5 + k * (1.0 - confidence)) / (12 + k)) END, 6) AS trust FROM s"))
def trust_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_scores(spark, sf_dir).select("agent_id", F.round(C.trust_multiplier(F.col("resolved_count"), F.col("brier")), 6).alias("trust"))


@query("derived_confidence", sql("log", "SELECT key, round(greatest(least(least(0.5 + 0.15 * independent_count, 0.95) * (0.7 + confidence), 0.95), 0.05), 6) AS sure FROM log"))
def derived_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_events(spark, sf_dir).select("key", F.round(C.confidence(F.col("independent_count"), 0.7 + F.col("confidence")), 6).alias("sure"))


@query("claims_visible", sql("claims", "SELECT claim_id, claim_type, subject FROM claims WHERE status = 'promoted' AND claim_type = 'outcome'"))
def claims_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.visible(document_claims(spark, sf_dir), claim_type="outcome").select("claim_id", "claim_type", "subject")


@query("claims_by_prefix", sql("claims", "SELECT claim_id, status FROM claims WHERE starts_with(claim_id, '00000000001')"))
def claims_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_claims(spark, sf_dir).where(F.col("claim_id").startswith("00000000001")).select("claim_id", "status")


@query("claims_citing", sql("log", "SELECT claim_id, count(*) AS citations FROM log WHERE kind = 'proposed' AND evidence_session = 's3' GROUP BY ALL"))
def claims_citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claim_events(spark, sf_dir).where("kind = 'proposed' and evidence_session = 's3'").groupBy("claim_id").agg(F.count("*").alias("citations"))


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = table(spark, sf_dir, "labels").select("doc_id", "quality")
    outcome = F.when(F.col("quality") == 1, "correct").when(F.col("quality") == 0, "incorrect").otherwise("expired")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("agent_id")).join(quality, "doc_id", "left").select("agent_id", outcome.alias("outcome"))


@query(
    "agent_scores",
    """WITH r AS (SELECT source AS agent_id, count(*) FILTER (quality = 1) AS correct, count(*) FILTER (quality = 0) AS incorrect, count(*) FILTER (quality IS NULL) AS expired
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)
SELECT *, correct + incorrect AS resolved, CASE WHEN correct + incorrect = 0 THEN 0.5 ELSE incorrect / (correct + incorrect) END AS brier, correct + incorrect < 10 AS low_sample FROM r""",
)
def agent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scores(_calibration(spark, sf_dir))


@query("contradiction_rates", sql("claims", "SELECT observed_by, count(*) FILTER (status = 'promoted') AS promoted, count(*) FILTER (status = 'contested') AS contested, count(*) FILTER (status = 'contested') / count(*) AS rate FROM claims WHERE status <> 'candidate' GROUP BY ALL"))
def contradiction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.contradiction_rates(document_claims(spark, sf_dir))


@query(
    "resolve_hypotheses",
    sql("claims", r""", h AS (SELECT *, '2024-' || lpad((substr(observed_at, 6, 2)::INT // 2 + 6)::VARCHAR, 2, '0') AS resolves_at FROM claims WHERE claim_type = 'hypothesis'),
o AS (SELECT * FROM claims WHERE claim_type = 'outcome' AND status = 'promoted'),
n AS (SELECT h.claim_id, o.claim_id AS outcome_id, o.claim AS o_claim FROM h JOIN o ON h.subject = o.subject AND o.observed_at >= h.observed_at AND o.observed_by <> h.observed_by
  QUALIFY row_number() OVER (PARTITION BY h.claim_id ORDER BY o.observed_at, o.claim_id) = 1)
SELECT h.claim_id, outcome_id, observed_by AS agent_id,
  CASE WHEN outcome_id IS NULL THEN 'expired' WHEN lower(trim(claim, E' \t\n\r')) = lower(trim(o_claim, E' \t\n\r')) THEN 'correct' ELSE 'incorrect' END AS outcome
FROM h LEFT JOIN n USING (claim_id) WHERE outcome_id IS NOT NULL OR '2024-09-01' >= resolves_at"""),
)
def resolve_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = F.concat(F.lit("2024-"), F.lpad(F.floor(F.substring("observed_at", 6, 2).cast("int") / 2 + 6).cast("string"), 2, "0"))
    return M.resolutions(document_claims(spark, sf_dir).withColumn("resolves_at", due), "2024-09-01")


@query(
    "provenance_check",
    sql("env", """, w AS (SELECT session_id, min(emitted_at) AS lo, max(emitted_at) AS hi FROM env GROUP BY ALL),
e AS (SELECT env.event_id AS citation, env.session_id, f.emitted_at AS told FROM env JOIN env f ON f.event_id::BIGINT = env.event_id::BIGINT + 500)
SELECT citation, told BETWEEN lo AND hi AS inside FROM e JOIN w USING (session_id)"""),
)
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the time a citation gives lies in the window of the session it names."""
    e = event_envelopes(spark, sf_dir).select("event_id", "session_id", "emitted_at")
    later = e.select((F.col("event_id").cast("long") - 500).alias("n"), F.col("emitted_at").alias("at"))
    cites = e.select(F.col("event_id").alias("citation"), "session_id", F.col("event_id").cast("long").alias("n")).join(later, "n")
    windows = e.groupBy("session_id").agg(F.min("emitted_at").alias("lo"), F.max("emitted_at").alias("hi"))
    return cites.join(windows, "session_id").select("citation", F.col("at").between(F.col("lo"), F.col("hi")).alias("inside"))


@query("citations_resolved", sql("conv", "SELECT doc_id, source FROM documents WHERE EXISTS (SELECT 1 FROM conv WHERE session_id = (doc_id % 120)::VARCHAR AND message_id = (doc_id % 8)::VARCHAR)"))
def citations_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("doc_id") % 120).cast("string").alias("session_id"), (F.col("doc_id") % 8).cast("string").alias("message_id"))
    return cites.join(conversation_envelopes(spark, sf_dir).select("session_id", "message_id"), ["session_id", "message_id"], "left_semi").select("doc_id", "source")


@query("independent_count", sql("log", ", e AS (SELECT DISTINCT claim_id, evidence_session AS s FROM log WHERE kind = 'proposed'), x AS (SELECT DISTINCT claim_id, evidence_session AS s FROM log WHERE kind = 'contested') SELECT claim_id, count(*) FILTER ((claim_id, s) NOT IN (SELECT (claim_id, s) FROM x)) AS independent FROM e GROUP BY ALL"))
def independent_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that cite a claim and were not shown it (here: those that contested it)."""
    log = claim_events(spark, sf_dir)
    cited = log.where("kind = 'proposed'").select("claim_id", F.col("evidence_session").alias("s")).distinct()
    shown = log.where("kind = 'contested'").select("claim_id", F.col("evidence_session").alias("s"), F.lit(True).alias("shown")).distinct()
    return cited.join(shown, ["claim_id", "s"], "left").groupBy("claim_id").agg(F.count_if(F.col("shown").isNull()).alias("independent"))


@query("claim_match", sql("claims", r"SELECT c.claim_id, min(k.claim_id) AS known FROM claims c JOIN claims k ON k.claim_type = c.claim_type AND lower(trim(k.claim, E' \t\n\r')) = lower(trim(c.claim, E' \t\n\r')) AND k.status <> 'candidate' WHERE c.status = 'candidate' GROUP BY ALL"))
def claim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose text and type a decided claim has; the subject is only a label."""
    c = document_claims(spark, sf_dir).withColumn("norm", content_hash(normalized_claim(F.col("claim"))))
    known = c.where("status <> 'candidate'").groupBy("claim_type", "norm").agg(F.min("claim_id").alias("known"))
    return c.where("status = 'candidate'").join(known, ["claim_type", "norm"]).select("claim_id", "known")


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_claims(spark, sf_dir).withColumn("cites", F.col("claim_id").cast("long") % 5 != 0)


@query("candidate_groups", sql("claims", r"SELECT claim_type, sha256(lower(trim(claim, E' \t\n\r'))) AS norm, array_to_string(list_sort(list(DISTINCT observed_by)), ',') AS observers, count(*) AS events, bool_and(claim_id::BIGINT % 5 <> 0) AS all_cite FROM claims GROUP BY claim_type, lower(trim(claim, E' \t\n\r'))"))
def candidate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.groups(_cited(spark, sf_dir)).select("claim_type", F.sha2("norm", 256).alias("norm"), F.array_join("observers", ",").alias("observers"), "events", "all_cite")


def _agents(spark: SparkSession, *names: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "agent_id string")


@query(
    "gate_explain",
    sql("claims", r""", g AS (SELECT claim_type, lower(trim(claim, E' \t\n\r')) AS norm, list(DISTINCT observed_by) AS obs, bool_and(claim_id::BIGINT % 5 <> 0) AS all_cite FROM claims GROUP BY ALL),
l AS (SELECT *, len(list_filter(obs, lambda x: x NOT IN ('src3', 'src5'))) AS live FROM g),
d AS (SELECT *, CASE WHEN live = 0 THEN 'quarantine' WHEN NOT all_cite THEN 'evidence' WHEN claim_type IN ('preference', 'hypothesis') THEN 'evidence'
  WHEN claim_type = 'convention' AND live < 2 THEN 'evidence' WHEN claim_type = 'convention' THEN 'independence' END AS gate FROM l)
SELECT claim_type, sha256(norm) AS norm, live AS live_observers, gate IS NULL AS would_promote, gate FROM d"""),
)
def gate_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.explained(M.groups(_cited(spark, sf_dir)), _agents(spark, "src3", "src5")).withColumn("norm", F.sha2("norm", 256))


def _gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = document_claims(spark, sf_dir)
    i = F.col("claim_id").cast("long")
    c = c.withColumn("n_evidence", (i % 11).cast("long")).withColumn("provenance_ok", i % 13 != 0).withColumn("trust", F.when(i % 2 == 0, F.lit(1.1)))
    return c.where("status = 'candidate'"), c.where("status = 'promoted'"), _agents(spark, "src3")


_CONFLICTS = r""", x AS (SELECT claim_id, subject, status, lower(trim(claim, E' \t\n\r')) AS norm, list_distinct(list_filter(regexp_split_to_array(lower(claim), '\s+'), lambda w: w <> '')) AS w FROM claims),
conflicts AS (SELECT a.claim_id, b.claim_id AS conflicts_with, len(list_intersect(a.w, b.w)) / len(a.w) AS overlap FROM x a JOIN x b ON a.subject = b.subject AND a.norm <> b.norm
  WHERE a.status = 'candidate' AND b.status = 'promoted' AND len(a.w) > 0 AND len(list_intersect(a.w, b.w)) / len(a.w) >= 0.6)"""
_STATIC = (
    _CONFLICTS
    + """, f AS (SELECT claim_id, min(conflicts_with) AS conflicts_with FROM conflicts GROUP BY ALL),
g AS (SELECT c.claim_id, independent_count, claim_id::BIGINT AS i, f.conflicts_with AS cw, CASE WHEN observed_by = 'src3' THEN 'quarantine' WHEN claim_id::BIGINT % 11 = 0 OR claim_type IN ('hypothesis', 'preference') THEN 'evidence'
  WHEN f.conflicts_with IS NOT NULL THEN 'contradiction' WHEN claim_id::BIGINT % 13 = 0 THEN 'provenance' WHEN independent_count < 1 THEN 'independence' END AS gate
  FROM claims c LEFT JOIN f USING (claim_id) WHERE status = 'candidate'),
d AS (SELECT claim_id, CASE WHEN gate IS NULL THEN 'promote' WHEN gate = 'contradiction' THEN 'contest' WHEN gate = 'quarantine' THEN 'quarantined' ELSE 'review' END AS decision, gate,
  CASE WHEN gate = 'contradiction' THEN cw END AS conflicts_with, CASE WHEN gate IS NULL THEN independent_count END AS independent_count,
  CASE WHEN gate IS NULL THEN round(greatest(least(least(0.5 + 0.15 * independent_count, 0.95) * CASE WHEN i % 2 = 0 THEN 1.1 ELSE 1.0 END, 0.95), 0.05), 6) END AS confidence FROM g)"""
)


@query("contradictions", sql("claims", _CONFLICTS + " SELECT claim_id, conflicts_with, round(overlap, 6) AS overlap FROM conflicts"))
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, promoted, _ = _gated(spark, sf_dir)
    return G.contradictions(candidates, promoted).withColumn("overlap", F.round("overlap", 6))


@query("gate_static", sql("claims", _STATIC + " SELECT * FROM d"))
def gate_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.static_gate(*_gated(spark, sf_dir))


@query("gate_events", sql("claims", _STATIC + " SELECT claim_id, 'promoted' AS kind, NULL AS conflicts_with, '2024-12-31' AS at FROM d WHERE decision = 'promote' UNION ALL SELECT claim_id, 'contested', conflicts_with, '2024-12-31' FROM d WHERE decision = 'contest' UNION ALL SELECT conflicts_with, 'contested', claim_id, '2024-12-31' FROM d WHERE decision = 'contest'"))
def gate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.decision_events(gate_static(spark, sf_dir), "2024-12-31")


@query("gate_run")
def gate_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sequential_gate(*_gated(spark, sf_dir))


@query("duplicate_pairs", sql("claims", r", x AS (SELECT claim_id AS id, list_distinct(list_filter(regexp_split_to_array(lower(claim), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w FROM claims WHERE status = 'promoted' AND claim_type = 'outcome') SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 6) AS jaccard FROM x a JOIN x b ON a.id < b.id WHERE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.35"))
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible outcome claims that may say the same thing."""
    from tidewell.functions.text import terms

    c = M.visible(document_claims(spark, sf_dir), claim_type="outcome").select(F.col("claim_id").alias("id"), terms(F.col("claim")).alias("words"))
    return S.jaccard_pairs(c, 0.35).withColumn("jaccard", F.round("jaccard", 6))


@query("claims_from_raw", sql("conv claims", r", r AS (SELECT session_id, content AS claim, ['environment', 'outcome', 'rumour'][(session_id::BIGINT % 3 + 1)::INT] AS claim_type, (session_id::BIGINT % 6)::VARCHAR AS cites FROM conv WHERE event_id = '000000') SELECT r.session_id, 0::BIGINT AS n, r.claim, r.claim_type, 'topic' AS subject, 1::BIGINT AS evidence, 't' || c.event_id AS observed_at, NULL::VARCHAR AS claim_id FROM r JOIN conv c ON c.session_id = r.session_id AND c.message_id = r.cites WHERE r.claim_type <> 'rumour'"))
def claims_from_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in fenced JSON, one claim each, of which some cite nothing that is there or have no known type."""
    c = conversation_envelopes(spark, sf_dir).withColumn("emitted_at", F.concat(F.lit("t"), F.col("event_id")))
    i = F.col("session_id").cast("long")
    kind = F.element_at(F.array(F.lit("environment"), F.lit("outcome"), F.lit("rumour")), (i % 3 + 1).cast("int"))
    cite = F.array(F.struct(F.lit("wrong").alias("session_id"), (i % 6).cast("string").alias("message_id")))
    answer = F.to_json(F.struct(F.array(F.struct(F.col("content").alias("claim"), kind.alias("claim_type"), F.lit("topic").alias("subject"), cite.alias("evidence"))).alias("claims")))
    answers = c.where("event_id = '000000'").select("session_id", F.concat(F.lit("```json\n"), answer, F.lit("\n```")).alias("answer"))
    none = document_claims(spark, sf_dir)
    return T.claims_from_answers(answers, T.citable(c), none).select("session_id", F.col("n").cast("long").alias("n"), "claim", "claim_type", "subject", "evidence", "observed_at", "claim_id")


@query(
    "extraction_drops",
    sql("conv", """, r AS (SELECT session_id::BIGINT AS i, session_id FROM conv WHERE event_id = '000000'),
d AS (SELECT CASE WHEN i % 7 = 0 THEN 'answer is no JSON' WHEN i % 7 = 1 THEN 'answer has no claims' WHEN i % 3 = 2 THEN 'unknown type' WHEN (i % 9)::VARCHAR NOT IN (SELECT message_id FROM conv c WHERE c.session_id = r.session_id AND content IS NOT NULL) THEN 'cites no message' ELSE 'kept' END AS reason FROM r)
SELECT reason, count(*) AS n FROM d GROUP BY 1"""),
)
def extraction_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that an extraction kept and dropped, by reason, as counted by its write."""
    c = conversation_envelopes(spark, sf_dir).withColumn("emitted_at", F.concat(F.lit("t"), F.col("event_id")))
    i = F.col("session_id").cast("long")
    kind = F.element_at(F.array(F.lit("environment"), F.lit("outcome"), F.lit("rumour")), (i % 3 + 1).cast("int"))
    cite = F.array(F.struct(F.col("session_id"), (i % 9).cast("string").alias("message_id")))
    claim = F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("claim"), kind.alias("claim_type"), F.lit("topic").alias("subject"), cite.alias("evidence"))).alias("claims")))
    answer = F.when(i % 7 == 0, "I can not say").when(i % 7 == 1, '{"claims": []}').otherwise(claim)
    made = T.write_claims(c.where("event_id = '000000'").select("session_id", answer.alias("answer")), T.citable(c), document_claims(spark, sf_dir).limit(0), new_folder(spark, "claims"))
    return spark.createDataFrame([(k, n) for k, n in made.items() if n], "reason string, n long")


@query("propose_validate", "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'claim is empty' WHEN doc_id % 5 = 0 THEN 'subject is empty' WHEN lang = 'de' THEN 'unknown type' WHEN doc_id % 25 = 1 THEN 'no evidence' WHEN doc_id % 25 > 20 THEN 'too much evidence' WHEN doc_id % 3 = 0 THEN 'evidence names no message' END AS problem FROM documents")
def propose_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    cite = F.struct(F.lit("s").alias("session_id"), F.when(i % 3 == 0, F.lit(" ")).otherwise("m").alias("message_id"))
    n = F.when(i % 25 == 1, 0).otherwise(i % 25 + 1).cast("int")
    p = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(i % 7 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("x"), F.col("text"))).alias("claim"), F.when(i % 5 == 0, F.lit("")).otherwise("lang").alias("subject"),
        F.when(F.col("lang") == "de", "guess").otherwise("outcome").alias("claim_type"), F.array_repeat(cite, F.when(i % 25 > 20, 21).otherwise(F.least(n, F.lit(20)))).alias("evidence"),
    )
    return T.problems(p).select("doc_id", "problem")


@query("render_claims", sql("claims", r", l AS (SELECT *, trim(regexp_replace(claim, '[\x00-\x08\x0B-\x1F\x7F\x{80}-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{FEFF}]', '', 'g'), E' \t\n\r') AS t FROM claims) SELECT claim_id, '[' || observed_by || ', ' || observed_at || ', ' || independent_count || CASE WHEN independent_count = 1 THEN ' independent session' ELSE ' independent sessions' END || ', conf ' || printf('%.2f', confidence) || CASE WHEN status = 'contested' THEN ', CONTESTED' ELSE '' END || ']' || chr(10) || '  ' || trim(regexp_replace(CASE WHEN length(t) > 2000 THEN t[1:2000] || '…[truncated]' ELSE t END, '\s+', ' ', 'g')) AS rendered FROM l"))
def render_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rendered(document_claims(spark, sf_dir))


@query("subject_timeline", sql("claims", "SELECT claim_id, observed_at, row_number() OVER (ORDER BY observed_at, claim_id) AS rank FROM claims WHERE subject = 'en4' AND claim_type = 'preference' AND status = 'promoted' AND observed_at >= '2024-03-01' QUALIFY rank <= 51"))
def subject_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject's promoted claims of a type since a day, oldest first, one more than the limit."""
    c = M.visible(document_claims(spark, sf_dir), claim_type="preference", subject="en4").where("observed_at >= '2024-03-01'").select("claim_id", "observed_at")
    return c.orderBy("observed_at", "claim_id").limit(51).withColumn("rank", F.row_number().over(Window.orderBy("observed_at", "claim_id")).cast("long"))


@query("briefing_claims", sql("claims", "SELECT claim_id, confidence, row_number() OVER (ORDER BY confidence DESC, claim_id) AS rank FROM claims WHERE status = 'promoted' QUALIFY rank <= 5"))
def briefing_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.visible(document_claims(spark, sf_dir)).select("claim_id", "confidence").orderBy(F.desc("confidence"), "claim_id").limit(5)
    return c.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("confidence"), "claim_id")).cast("long"))



@query("known_claims", sql("claims", "SELECT claim_id, '- [' || claim_type || '] ' || claim || chr(10) AS line FROM claims WHERE status <> 'candidate' AND claim_type = 'outcome' AND strlen(claim) < 100 QUALIFY row_number() OVER (ORDER BY claim_id DESC) <= 400"))
def known_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short outcomes that an extraction is shown as known already; few enough to fit whole."""
    c = document_claims(spark, sf_dir).where("claim_type = 'outcome' and octet_length(claim) < 100")
    return T.known_claims(c)


@query("history_import", sql("conv", ", n AS (SELECT session_id, count(*) AS n, max(event_id::BIGINT) AS m FROM conv GROUP BY ALL) SELECT session_id, event_id::BIGINT AS \"order\", event_type, message_id FROM conv WHERE event_type <> 'session_start' UNION ALL SELECT session_id, min(event_id::BIGINT) - 1, 'session_start', NULL FROM conv GROUP BY 1 UNION ALL SELECT session_id, max(event_id::BIGINT) + 1, 'session_end', NULL FROM conv GROUP BY 1"))
def history_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as an exported history: start, turns and end of each session."""
    from tidewell.sources.history import envelopes

    c = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    messages = c.select(F.col("turn").alias("id"), F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"), none.alias("tool_call_id"), none.alias("tool_calls"), none.alias("tool_name"), (F.col("turn") * 60.0 + 1.7e9).alias("timestamp"), F.lit(0).alias("compacted"))
    used = spark.createDataFrame([], "session_id string, model string, input_tokens long, output_tokens long, cost_usd double")
    return envelopes(messages.select(F.col("session_id").alias("id")).distinct(), messages, used).select("session_id", "order", "event_type", "message_id")
