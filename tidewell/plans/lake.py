"""Queries of the lake's upkeep: spool, seals, parts, pending digests, presence, listings, demotion, imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import claims as M
from tidewell.operators import evidence as E
from tidewell.operators import imports as I
from tidewell.operators import presence as P
from tidewell.operators import sessions as S
from tidewell.plans import maintenance as X
from tidewell.plans.catalog import query
from tidewell.sources import compaction as C
from tidewell.sources import eventlog as L
from tidewell.sources.segments import conformed, decoded, minimal, raw_segments, write_batch
from tidewell.sources.shared import new_folder, stored
from tidewell.sources.tables import claim_events, document_claims, event_envelopes, sql, table
from tidewell.streaming import capture
from tidewell.streaming.spool import SpoolSource


def spool_of(envelopes: DataFrame, root: str) -> None:
    """Envelopes as a spool of ``other/<session>.ndjson`` files, a session whole in one file, its lines in order."""
    spark = envelopes.sparkSession
    rows = envelopes.select("session_id", "event_id", F.to_json(F.struct(*envelopes.columns)).alias("value"))
    made = f"{root}-lines"
    rows.repartition("session_id").sortWithinPartitions("session_id", "event_id").select("value").write.text(made)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{root}/other"))
    for i, f in enumerate(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{made}/part-*"))):
        fs.rename(f.getPath(), jvm.org.apache.hadoop.fs.Path(f"{root}/other/s{i}.ndjson"))


@query("spool_capture", sql("env", "SELECT event_id, emitted_at, agent_id, session_id, event_type, 'other' AS runtime FROM env"))
def spool_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spool through the stream into bronze segments and back, one batch and then one that finds nothing new."""
    root = new_folder(spark, "spool")
    spool_of(event_envelopes(spark, sf_dir).select("event_id", "emitted_at", "agent_id", "session_id", "event_type", F.lit("other").alias("runtime")), f"{root}/spool")
    for _ in range(2):
        capture.to_bronze(capture.spool(spark, f"{root}/spool"), f"{root}/bronze", f"{root}/checkpoint").awaitTermination()
    return decoded(capture.bronze(spark, f"{root}/bronze")).select("event_id", "emitted_at", "agent_id", "session_id", "event_type", "runtime")


@query("spool_lines", sql("env", "SELECT session_id, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM env GROUP BY ALL"))
def spool_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a spool read as a batch."""
    root = new_folder(spark, "spool")
    spool_of(event_envelopes(spark, sf_dir).select("event_id", "session_id", "event_type"), root)
    spark.dataSource.register(SpoolSource)
    e = capture.parsed(spark.read.format(SpoolSource.name()).option("path", root).load())
    return e.groupBy("session_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("seal_markers", sql("env", "SELECT session_id, max(emitted_at) FILTER (event_type = 'session_end') AS ended_at, count(*) AS events, count(DISTINCT event_id) AS distinct_events FROM env GROUP BY 1 HAVING count(*) FILTER (event_type = 'session_end') > 0"))
def seal_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.seals(event_envelopes(spark, sf_dir))


@query(
    "compacted_parts",
    sql("env", """, r AS (SELECT session_id, event_id, emitted_at[1:10] AS dt, strlen(session_id || event_id || coalesce(command, '')) AS bytes FROM env),
b AS (SELECT *, sum(bytes) OVER (PARTITION BY dt ORDER BY session_id, event_id) - bytes AS before FROM r)
SELECT dt, (before // 4096)::BIGINT AS part, count(*) AS events, sum(bytes)::BIGINT AS bytes, min(session_id) AS first_session FROM b GROUP BY ALL"""),
)
def compacted_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of about 4 KiB of record text a day."""
    e = event_envelopes(spark, sf_dir).select("session_id", "event_id", F.substring("emitted_at", 1, 10).alias("dt"), F.concat("session_id", "event_id", F.coalesce("command", F.lit(""))).alias("record"))
    return S.parts(e, 4096).groupBy("dt", "part").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"), F.min("session_id").alias("first_session"))


@query("digest_pending", sql("env", ", s AS (SELECT session_id, max(event_id) AS content, count(*) AS n FROM env GROUP BY 1) SELECT session_id, content FROM s WHERE NOT (n % 3 = 0 OR (n % 3 = 1 AND n % 2 = 0))"))
def digest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions without a digest of what they hold now in the current version: some have an old version, some old content."""
    s = event_envelopes(spark, sf_dir).groupBy("session_id").agg(F.max("event_id").alias("content"), F.count("*").alias("n"))
    m = F.col("n") % 3
    done = s.select("session_id", F.when(m == 2, "old").otherwise(F.col("content")).alias("content"), F.when(m == 0, 5).when(F.col("n") % 2 == 0, 4).otherwise(3).alias("version"))
    return S.pending(s.select("session_id", "content"), done, 4)


@query("session_commands", sql("env", "SELECT session_id, string_agg(command || '=' || exit_code, ';' ORDER BY event_id) AS commands, count(*) AS n FROM env WHERE exit_code IS NOT NULL GROUP BY 1"))
def session_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.command_lists(event_envelopes(spark, sf_dir))
    return c.select("session_id", F.array_join(F.transform("commands", lambda x: F.concat(x["command"], F.lit("="), x["exit_code"].cast("string"))), ";").alias("commands"), F.size("commands").cast("long").alias("n"))


@query("session_files", sql("env", "SELECT session_id, string_agg(DISTINCT path, ';' ORDER BY path) AS files FROM env WHERE path IS NOT NULL GROUP BY 1"))
def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.files_touched(event_envelopes(spark, sf_dir)).select("session_id", F.array_join("files", ";").alias("files"))


@query("session_listing", sql("env", ", s AS (SELECT session_id, max(emitted_at) AS ended_at, count(*) AS events FROM env GROUP BY 1) SELECT session_id, ended_at, events, row_number() OVER (ORDER BY ended_at DESC, session_id) AS rank FROM s WHERE starts_with(session_id, '1') QUALIFY rank <= 20"))
def session_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest sessions of a prefix."""
    s = event_envelopes(spark, sf_dir).groupBy("session_id").agg(F.max("emitted_at").alias("ended_at"), F.count("*").alias("events"))
    return S.listed(s, "1")


@query("claims_listing", sql("claims", "SELECT claim_type, claim_id, observed_by, row_number() OVER (ORDER BY claim_type, claim_id) AS rank FROM claims WHERE status = 'contested'"))
def claims_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contested claims by type and id, with their place; counted type by type."""
    return M.listed(document_claims(spark, sf_dir), "contested").select("claim_type", "claim_id", "observed_by", "rank")


@query("claim_prefix", sql("claims", ", m AS (SELECT claim_id FROM claims WHERE starts_with(claim_id, '00000000001')) SELECT claim_id, (SELECT count(*) FROM m) AS n_matches, (SELECT count(*) FROM m) = 1 AS meant FROM m QUALIFY row_number() OVER (ORDER BY claim_id) <= 10"))
def claim_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ambiguous id may mean: ten claims at most, and how many there are."""
    return M.with_prefix(document_claims(spark, sf_dir), "00000000001").select("claim_id", "n_matches", "meant")


@query("demoted_claims", sql("claims", "SELECT claim_id, 'contested' AS status, 'observing agent ' || observed_by || ' is quarantined' AS reason FROM claims WHERE status = 'promoted' AND observed_by IN (SELECT observed_by FROM claims GROUP BY 1 HAVING count(*) % 2 = 0)"))
def demoted_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = document_claims(spark, sf_dir)
    held = c.groupBy(F.col("observed_by").alias("agent_id")).agg(F.count("*").alias("n")).where("n % 2 = 0").select("agent_id")
    return M.demoted(c, held).select("claim_id", "status", "reason")


@query("claim_event_lines", sql("log", "SELECT claim_id, kind, count(*) AS n FROM log WHERE k % 5 <> 0 GROUP BY ALL"))
def claim_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim events from JSON lines, of which some are cut short."""
    e = claim_events(spark, sf_dir)
    whole = F.to_json(F.struct("claim_id", "at", "kind", "agent_id"))
    lines = e.select("key", F.when(F.col("k") % 5 == 0, F.substring(whole, 1, 20)).otherwise(whole).alias("value"))
    return M.parsed_events(lines, "claim_id string, at string, kind string, agent_id string").groupBy("claim_id", "kind").agg(F.count("*").alias("n"))


@query("presence_intents", "SELECT o_orderkey AS key, o_custkey::VARCHAR AS agent_id, 'f1' AS fleet_id FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 7 <> 0")
def presence_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of one fleet: what their bodies say counts, whatever key they lie under; malformed ones are skipped."""
    o = table(spark, sf_dir, "orders")
    body = F.to_json(F.struct(F.concat(F.lit("f"), (F.col("o_orderkey") % 3).cast("string")).alias("fleet_id"), F.col("o_custkey").cast("string").alias("agent_id"), F.col("o_orderdate").cast("timestamp").alias("updated_at")))
    lines = o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("{")).otherwise(body).alias("value"))
    return P.intents(lines, "f1").select("key", "agent_id", "fleet_id")


@query("roster", "SELECT o_custkey::VARCHAR AS agent_id, max(o_orderdate)::TIMESTAMP AS updated_at, count(*) AS intents FROM orders GROUP BY 1")
def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an agent: its last intent, published as a table and read back."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("agent_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"))
    return stored(P.roster(o), "roster")


@query("import_counts", sql("env", "SELECT runtime, count(*) AS seen, count(*) FILTER (exit_code = 1) AS failed, count(DISTINCT session_id) AS sessions, count(*) FILTER (coalesce(exit_code, 0) <> 1) AS written FROM env GROUP BY 1"))
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import saw, skipped and wrote, by runtime."""
    return I.counts(event_envelopes(spark, sf_dir).withColumn("problem", F.when(F.col("exit_code") == 1, "failed")), "runtime").select("runtime", "seen", F.col("skipped").alias("failed"), "sessions", "written")


@query("edited_paths", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a' || (event_id % 5) || ';z' WHEN 1 THEN 'b;c' ELSE '' END AS paths FROM events")
def edited_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of edits from tools' results of three shapes."""
    i = F.col("event_id")
    own = F.concat(F.lit('{"filePath": "z", "structuredPatch": [{"file": "a'), (i % 5).cast("string"), F.lit('"}, {"path": "z"}, 7]}'))
    result = F.when(i % 3 == 0, own).when(i % 3 == 1, F.lit('{"filePath": 5, "bashEditDiff": [{"filePath": "c", "path": "b"}]}')).otherwise(F.lit("[1]"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(T.edited_paths(result), ";").alias("paths"))


@query("events_since", sql("env", "SELECT count(*) AS n, min(event_id) AS first_id FROM env WHERE emitted_at >= '2024-01-15T12:00:00'"))
def events_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events since 36 hours before a day, as a reader's ``since`` names it."""
    from datetime import UTC, datetime

    begin = T.since("36h", datetime(2024, 1, 17, tzinfo=UTC)).strftime("%Y-%m-%dT%H:%M:%S")
    return event_envelopes(spark, sf_dir).where(F.col("emitted_at") >= begin).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(
    "compacted_twice",
    sql("env", """, s AS (SELECT session_id, min(emitted_at)[1:10] AS lo, max(emitted_at)[1:10] AS hi, starts_with(session_id, '1') AS late FROM env GROUP BY 1 HAVING bool_or(event_type = 'session_end')),
r AS (SELECT emitted_at[1:10] AS dt, session_id, command FROM env WHERE session_id IN (SELECT session_id FROM s)),
d AS (SELECT dt, count(*) AS rows_in, count(*) FILTER (command IS NULL) + count(DISTINCT session_id || '|' || command) AS events, count(DISTINCT session_id) AS sessions FROM r GROUP BY 1)
SELECT *, (EXISTS (SELECT 1 FROM s WHERE NOT late AND dt BETWEEN lo AND hi))::BIGINT + (EXISTS (SELECT 1 FROM s WHERE late AND dt BETWEEN lo AND hi))::BIGINT AS written FROM d"""),
)
def compacted_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compacted dates read back after three runs: some sessions are sealed before the first, the rest before the second, none before the third.

    ``written``: how many of the runs wrote the date; a date whose seals are as they were is left alone.
    """
    root = new_folder(spark, "lake")
    write_batch(conformed(minimal(event_envelopes(spark, sf_dir))), f"{root}/sessions", 0)
    e = raw_segments(spark, f"{root}/sessions")
    ended = stored(C.marks_of(e), "marks")
    runs = []
    for some in (ended.where("not startswith(session_id, '1')"), ended, ended):
        C.seal(spark, root, some)
        runs.append(C.compact(spark, root, part_bytes=1 << 18))
    told = spark.createDataFrame([(x.dt, x.rows_in) for run in runs for x in run], "dt string, rows_in long").groupBy("dt").agg(F.max("rows_in").alias("rows_in"), F.count("*").alias("written"))
    got = C.read_compacted(spark, root).groupBy("dt").agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"))
    return got.join(told, "dt").select("dt", "rows_in", "events", "sessions", "written")


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim a document, each citing one event: some of no such message, some at another time, some by an agent that nobody saw."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), i.cast("string")).alias("claim_id"), F.concat(F.lit("a"), (i % 9).cast("string")).alias("agent_id"))
    e = event_envelopes(spark, sf_dir).select("event_id", "session_id", "emitted_at")
    met = d.join(e, F.lpad(F.col("doc_id").cast("string"), 12, "0") == F.col("event_id"))
    cite = F.struct("session_id", F.when(i % 5 == 1, "none").otherwise(F.col("event_id")).alias("message_id"), F.lit(None).cast("string").alias("excerpt_hash"), F.when(i % 5 == 2, "2031-01-01").otherwise(F.col("emitted_at")).alias("observed_at"))
    kind = F.when(i % 7 == 3, "hypothesis").otherwise("environment")
    return met.select("claim_id", F.lit("2030-01-01").alias("at"), F.lit("proposed").alias("kind"), "agent_id", F.concat(F.lit("claim "), F.col("claim_id")).alias("claim"), kind.alias("claim_type"), F.col("claim_id").alias("subject"), F.array(cite).alias("evidence"))


def _lake(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A lake of the events and the seals of the sessions that ended; every sixth event was shown the claim of its number."""
    root = new_folder(spark, "lake")
    e = event_envelopes(spark, sf_dir)
    i = F.col("event_id").cast("long")
    shown = F.when(i % 6 == 0, F.array(F.struct(F.concat(F.lit("d"), i.cast("string")).alias("claim_id"), F.lit("x").alias("source"), F.lit("y").alias("observed_by"))))
    rows = minimal(e).withColumns({"message_id": F.col("event_id"), "injected_context": shown})
    write_batch(conformed(rows), f"{root}/sessions", 0)
    return root, stored(C.marks_of(raw_segments(spark, f"{root}/sessions")), "marks")


@query(
    "maintained_claims",
    sql("env", """, s AS (SELECT session_id, min(emitted_at) AS lo, max(emitted_at) AS hi FROM env GROUP BY 1 HAVING bool_or(event_type = 'session_end')),
kept AS (SELECT env.* FROM env JOIN s USING (session_id) QUALIFY command IS NULL OR row_number() OVER (PARTITION BY emitted_at[1:10], session_id, command ORDER BY event_id) = 1),
w AS (SELECT session_id, min(emitted_at) AS lo, max(emitted_at) AS hi FROM kept GROUP BY 1),
c AS (SELECT doc_id, 'd' || doc_id AS claim_id, 'a' || (doc_id % 9) AS observed_by, env.session_id, env.event_id, env.emitted_at FROM documents JOIN env ON env.event_id::BIGINT = doc_id),
g AS (SELECT c.*, doc_id % 5 <> 1 AND doc_id % 5 <> 2 AND w.lo IS NOT NULL AND c.emitted_at BETWEEN w.lo AND w.hi AND EXISTS (SELECT 1 FROM kept k WHERE k.event_id = c.event_id) AND c.observed_by IN (SELECT agent_id FROM kept) AS ok,
  CASE WHEN doc_id % 6 = 0 AND EXISTS (SELECT 1 FROM kept k WHERE k.event_id = c.event_id) THEN 0 ELSE 1 END AS independent FROM c LEFT JOIN w USING (session_id))
SELECT claim_id, CASE WHEN doc_id % 7 <> 3 AND ok AND independent >= 1 THEN 'promoted' ELSE 'candidate' END AS status, (CASE WHEN doc_id % 7 <> 3 AND ok AND independent >= 1 THEN 1 ELSE 0 END)::BIGINT AS independent_count,
  doc_id % 7 <> 3 AND ok AND independent >= 1 AS visible_to_agents FROM g"""),
)
def maintained_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the published snapshot after the whole chain: their evidence is held against what was captured."""
    root, ended = _lake(spark, sf_dir)
    C.seal(spark, root, ended)
    L.append(_cited(spark, sf_dir), root)
    X.run(spark, root, "2030-01-02")
    return X.opened(spark, f"{root}/snapshot", "claims").select("claim_id", "status", "independent_count", "visible_to_agents")


@query(
    "maintained_digests",
    sql("env", """, s AS (SELECT session_id, count(*) AS events FROM env GROUP BY 1 HAVING bool_or(event_type = 'session_end')),
kept AS (SELECT env.* FROM env JOIN s USING (session_id) QUALIFY command IS NULL OR row_number() OVER (PARTITION BY emitted_at[1:10], session_id, command ORDER BY event_id) = 1)
SELECT session_id, count(*) FILTER (exit_code IS NOT NULL) AS n_commands, count(*) FILTER (exit_code = 1) AS n_failed, count(DISTINCT path) AS n_files, coalesce(string_agg(command, ';' ORDER BY event_id) FILTER (exit_code IS NOT NULL), '') AS commands,
  CASE WHEN NOT starts_with(session_id, '2') THEN 2 ELSE 1 END::BIGINT AS versions FROM kept GROUP BY 1"""),
)
def maintained_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest table after two runs, the first of which knew only some seals; ``versions``: that of a session's first digest."""
    root, every = _lake(spark, sf_dir)
    first: dict[int, DataFrame] = {}
    for some in (every.where("startswith(session_id, '2')"), every):
        C.seal(spark, root, some)
        C.compact(spark, root)
        merge = X.run_digests(spark, root)
        first[merge.version] = X.digest_table(spark, root).read(merge.version).select("session_id")
    numbered = None
    for version, rows in first.items():
        rows = rows.withColumn("versions", F.lit(version).cast("long"))
        numbered = rows if numbered is None else numbered.unionByName(rows)
    begun = numbered.groupBy("session_id").agg(F.min("versions").alias("versions"))
    commands = F.coalesce(F.array_join(F.transform("commands", lambda c: c["command"]), ";"), F.lit("")).alias("commands")
    return X.digest_table(spark, root).read().join(begun, "session_id").select("session_id", "n_commands", "n_failed", "n_files", commands, "versions")


@query(
    "gate_inputs",
    sql("env", """, x AS (SELECT session_id, 'window' AS kind, '' AS value, emitted_at FROM env UNION ALL SELECT session_id, 'agent', agent_id, emitted_at FROM env UNION ALL SELECT session_id, 'message', event_id, emitted_at FROM env
  UNION ALL SELECT session_id, 'shown', 'c' || (event_id::BIGINT % 50), emitted_at FROM env WHERE event_id::BIGINT % 4 = 0)
SELECT session_id, kind, value, min(emitted_at) AS first_at, max(emitted_at) AS last_at FROM x GROUP BY ALL"""),
)
def gate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, agents, messages and what was shown, in one pass over the events."""
    i = F.col("event_id").cast("long")
    shown = F.when(i % 4 == 0, F.array(F.struct(F.concat(F.lit("c"), (i % 50).cast("string")).alias("claim_id"))))
    e = event_envelopes(spark, sf_dir).withColumn("message_id", F.col("event_id")).withColumn("injected_context", shown)
    return E.gate_inputs(e).withColumn("value", F.coalesce("value", F.lit("")))


@query("claim_log", sql("log", "SELECT claim_id, kind, count(*) AS n, min(\"at\") AS first_at FROM (SELECT DISTINCT claim_id, \"at\", kind, agent_id, claim, confidence, independent_count FROM log) GROUP BY ALL"))
def claim_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim events appended to a log twice, the second time in other tasks, and read back."""
    root = new_folder(spark, "log")
    e = claim_events(spark, sf_dir).select("claim_id", "at", "kind", "agent_id", "claim", "confidence", "independent_count")
    for rows in (e, e.repartition(7)):
        L.append(rows, root)
    return L.read_events(spark, root).groupBy("claim_id", "kind").agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


@query("proposed_claims", "SELECT 'a' || (doc_id % 5) AS agent_id, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 AND coalesce(lang, '') <> '' GROUP BY doc_id % 5")
def proposed_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals that went into the log: valid ones only, each once."""
    root = new_folder(spark, "log")
    i = F.col("doc_id")
    cite = F.array(F.struct(F.lit("s").alias("session_id"), F.lit("m").alias("message_id"), F.lit(None).cast("string").alias("excerpt_hash"), F.lit(None).cast("string").alias("observed_at")))
    p = table(spark, sf_dir, "documents").select(F.concat(F.lit("a"), (i % 5).cast("string")).alias("agent_id"), F.concat(F.lit("claim "), i.cast("string")).alias("claim"), F.lit("outcome").alias("claim_type"), F.when(i % 3 == 0, "").otherwise(F.col("lang")).alias("subject"), cite.alias("evidence"))
    for _ in range(2):
        L.propose(p, root, "2030-01-01")
    return L.read_events(spark, root).groupBy("agent_id").agg(F.count("*").alias("n"))
