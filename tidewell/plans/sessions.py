"""Queries over envelopes and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.text import content_hash
from tidewell.operators import sessions as S
from tidewell.plans.catalog import query
from tidewell.sources.tables import conversation_envelopes, event_envelopes, sql, table


@query("events_by_type", sql("env", "SELECT runtime, event_type, count(*) AS n FROM env GROUP BY ALL"))
def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_envelopes(spark, sf_dir).groupBy("runtime", "event_type").agg(F.count("*").alias("n"))


@query("discover_dates", sql("env", "SELECT DISTINCT emitted_at[1:10] AS dt FROM env"))
def discover_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_envelopes(spark, sf_dir).select(F.substring("emitted_at", 1, 10).alias("dt")).distinct().orderBy("dt")


@query("session_windows", sql("env", "SELECT session_id, min(emitted_at) AS first_at, max(emitted_at) AS last_at, count(*) AS events FROM env GROUP BY ALL"))
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.session_windows(event_envelopes(spark, sf_dir))


@query("sealed_sessions", sql("env", "SELECT session_id, max(emitted_at) AS ended_at FROM env WHERE event_type = 'session_end' GROUP BY ALL"))
def sealed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sealed(event_envelopes(spark, sf_dir))


_FRICTION = """,
c AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) AS back FROM env WHERE exit_code IS NOT NULL),
l AS (SELECT session_id, command AS last_command, exit_code AS last_exit FROM c WHERE back = 1),
x AS (SELECT session_id, min(back) AS stop FROM c JOIN l USING (session_id) WHERE NOT (exit_code <> 0 AND command = last_command) GROUP BY ALL),
streak AS (SELECT l.session_id, last_command, CASE WHEN last_exit <> 0 THEN count(*) FILTER (back < coalesce(stop, 1000000000)) ELSE 0 END AS run
  FROM c JOIN l USING (session_id) LEFT JOIN x USING (session_id) GROUP BY l.session_id, last_command, last_exit, stop),
gone AS (SELECT session_id, last_command AS command, run AS count FROM streak
  WHERE run >= 3 AND session_id NOT IN (SELECT session_id FROM env WHERE event_type = 'session_end')),
rep AS (SELECT session_id, command, count(*) AS count FROM c WHERE exit_code <> 0 GROUP BY ALL HAVING count(*) >= 2),
rep2 AS (SELECT rep.* FROM rep ANTI JOIN gone ON rep.session_id = gone.session_id AND rep.command = gone.command),
hot AS (SELECT session_id, path, count(*) AS count FROM env WHERE path IS NOT NULL GROUP BY ALL HAVING count(*) > 5),
friction AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY o, count DESC, subject) AS rank FROM (
  SELECT session_id, 0 AS o, 'abandoned_after_failures' AS kind, command AS subject, count FROM gone
  UNION ALL SELECT session_id, 1, 'repeated_failure', command, count FROM rep2
  UNION ALL SELECT session_id, 2, 'hot_file', path, count FROM hot))"""
_CWD = """,
cwds AS (SELECT session_id, cwd, count(*) AS n FROM env WHERE cwd <> '' GROUP BY ALL),
dom AS (SELECT session_id, cwd, n FROM cwds QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, cwd DESC) = 1)"""
_TESTS = "cargo test|pytest|py\\.test|npm test|npm run test|yarn test|go test|jest|mvn test|make test|gradle test|rspec|phpunit"
_DIGEST = (
    _FRICTION
    + _CWD
    + f""",
run AS (SELECT session_id, count(*) AS n_commands, count(*) FILTER (exit_code <> 0) AS n_failed,
    count(*) FILTER (regexp_matches(lower(command), '{_TESTS}')) AS n_tests, count(*) FILTER (starts_with(lower(ltrim(command)), 'git commit')) AS n_commits FROM c GROUP BY ALL),
main AS (SELECT session_id, arg_min(emitted_at, event_id) AS started_at, arg_max(emitted_at, event_id) AS ended_at,
    count(*) FILTER (event_type = 'prompt') AS turn_count, arg_min(git_sha, event_id) FILTER (git_sha IS NOT NULL) AS git_sha_before,
    arg_max(git_sha, event_id) FILTER (git_sha IS NOT NULL) AS git_sha_after, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens,
    round(coalesce(sum(cost_usd), 0), 6) AS cost_usd, count(DISTINCT path) AS n_files FROM env GROUP BY ALL),
tight AS (SELECT session_id, count(*) AS n_friction FROM friction GROUP BY ALL),
digest AS (SELECT main.session_id, started_at, ended_at,
    (epoch_us(ended_at::TIMESTAMP) - epoch_us(started_at::TIMESTAMP)) // 1000 AS duration_ms, turn_count, coalesce(n_commands, 0) AS n_commands, coalesce(n_failed, 0) AS n_failed,
    coalesce(n_tests, 0) AS n_tests, coalesce(n_commits, 0) AS n_commits, n_files, coalesce(n_friction, 0) AS n_friction,
    git_sha_before, git_sha_after, dom.cwd AS repo, input_tokens, cost_usd,
    CASE WHEN gone.session_id IS NOT NULL THEN 'abandoned' WHEN l.last_exit <> 0 THEN 'error' ELSE 'clean' END AS outcome
  FROM main LEFT JOIN run USING (session_id) LEFT JOIN tight USING (session_id) LEFT JOIN dom USING (session_id)
    LEFT JOIN gone ON gone.session_id = main.session_id LEFT JOIN l ON l.session_id = main.session_id)"""
)


@query("session_digest", sql("env", _DIGEST + " SELECT * FROM digest"))
def session_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.digest(event_envelopes(spark, sf_dir))


@query("abandoned_sessions", sql("env", _FRICTION + " SELECT session_id, command, count FROM gone"))
def abandoned_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.abandoned(event_envelopes(spark, sf_dir))


@query("repeated_failures", sql("env", _FRICTION + " SELECT * FROM rep2"))
def repeated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.repeated_failures(event_envelopes(spark, sf_dir))


@query("hot_files", sql("env", _FRICTION + " SELECT * FROM hot"))
def hot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hot_files(event_envelopes(spark, sf_dir))


@query("friction", sql("env", _FRICTION + " SELECT session_id, kind, subject, count, rank FROM friction"))
def friction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.friction(event_envelopes(spark, sf_dir))


@query("files_touched", sql("env", "SELECT session_id, array_to_string(list_sort(list(DISTINCT path)), ',') AS files FROM env WHERE path IS NOT NULL GROUP BY ALL"))
def files_touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.files_touched(event_envelopes(spark, sf_dir)).select("session_id", F.array_join("files", ",").alias("files"))


@query("dominant_cwd", sql("env", _CWD + " SELECT * FROM dom"))
def dominant_cwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dominant_cwd(event_envelopes(spark, sf_dir))


_SUMMARY = (
    _DIGEST
    + """,
f1 AS (SELECT * FROM friction WHERE rank = 1),
short AS (SELECT session_id, len(fs) AS n_files2, (SELECT array_to_string(list(s ORDER BY i)[1:3], ', ') FROM (SELECT s, min(i) AS i FROM (SELECT unnest(fs) AS f, generate_subscripts(fs, 1) AS i), (SELECT 1) LEFT JOIN LATERAL (SELECT array_to_string(string_split(f, '/')[-2:], '/') AS s) ON true GROUP BY s)) AS shown,
    (SELECT least(3, count(DISTINCT array_to_string(string_split(f, '/')[-2:], '/'))) FROM (SELECT unnest(fs) AS f)) AS n_shown
  FROM (SELECT session_id, list_sort(list(DISTINCT path)) AS fs FROM env WHERE path IS NOT NULL GROUP BY ALL)),
line AS (SELECT d.session_id, d.turn_count, concat_ws(' · ',
    CASE kind WHEN 'repeated_failure' THEN '`' || subject || '` failed ' || count || 'x' WHEN 'hot_file' THEN 'edited ' || array_to_string(string_split(subject, '/')[-2:], '/') || ' ' || count || 'x'
      WHEN 'abandoned_after_failures' THEN 'abandoned after ' || count || ' failed `' || subject || '`' END,
    'touched ' || shown || CASE WHEN n_files2 > n_shown THEN ' +' || (n_files2 - n_shown) || ' more' ELSE '' END,
    CASE WHEN n_commands > 0 THEN n_commands || ' command(s), ' || CASE WHEN n_failed = 0 THEN 'all clean' ELSE n_failed || ' failed' END END,
    CASE WHEN n_commits > 0 THEN n_commits || ' commit(s)' END) AS line
  FROM digest d LEFT JOIN f1 USING (session_id) LEFT JOIN short USING (session_id))
SELECT session_id, CASE WHEN line = '' THEN turn_count || ' turn(s), nothing recorded' WHEN length(line) > 160 THEN line[1:159] || '…' ELSE line END AS summary FROM line"""
)


@query("session_summary", sql("env", _SUMMARY))
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summaries(event_envelopes(spark, sf_dir))


@query(
    "session_history",
    sql("env", _DIGEST + " SELECT row_number() OVER (ORDER BY ended_at DESC, session_id) AS rank, session_id, ended_at, repo, outcome FROM digest WHERE repo = '/w/p1' AND ended_at >= '2024-01-10' QUALIFY rank <= 51"),
)
def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a repository since a day, newest first; one more than the limit tells that more exist."""
    d = S.digest(event_envelopes(spark, sf_dir)).where("repo = '/w/p1' and ended_at >= '2024-01-10'").select("session_id", "ended_at", "repo", "outcome")
    top = d.orderBy(F.desc("ended_at"), "session_id").limit(51)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ended_at"), "session_id")).cast("long"))


def _hashed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("session_id"), "doc_id", content_hash(F.col("text")).alias("content_hash"))


@query(
    "compact_dedup",
    "SELECT source AS session_id, doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents QUALIFY text = '' OR row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1",
)
def compact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.compacted(_hashed_documents(spark, sf_dir), "doc_id")


@query("compaction_stats", "SELECT source AS session_id, count(*) AS rows_in, count(DISTINCT text) FILTER (text <> '') + count(*) FILTER (text = '') AS rows_out FROM documents GROUP BY ALL")
def compaction_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed_documents(spark, sf_dir)
    return rows.groupBy("session_id").agg(F.count("*").alias("rows_in")).join(S.compacted(rows, "doc_id").groupBy("session_id").agg(F.count("*").alias("rows_out")), "session_id")


@query("compaction_generation", sql("env", "SELECT agent_id, sha256(array_to_string(list_sort(list(DISTINCT session_id)), chr(10))) AS generation, count(DISTINCT session_id) AS keys FROM env WHERE event_type = 'session_end' GROUP BY ALL"))
def compaction_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = event_envelopes(spark, sf_dir).where("event_type = 'session_end'").select("agent_id", "session_id").distinct()
    return S.generation(ends, ["agent_id"], "session_id")


@query("pool_union", sql("env conv", "SELECT 'events' AS pool, event_type, count(*) AS n FROM env GROUP BY ALL UNION ALL SELECT 'conversations', event_type, count(*) FROM conv GROUP BY ALL"))
def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_envelopes(spark, sf_dir).select(F.lit("events").alias("pool"), "session_id", "event_type")
    c = conversation_envelopes(spark, sf_dir).select(F.lit("conversations").alias("pool"), "session_id", "event_type")
    return e.unionByName(c).groupBy("pool", "event_type").agg(F.count("*").alias("n"))


@query(
    "ts_ffill",
    sql("env", ", r AS (SELECT session_id, event_id, CASE WHEN event_type = 'tool_call' THEN emitted_at END AS t FROM env) SELECT session_id, event_id, coalesce(last_value(t IGNORE NULLS) OVER w, first_value(t IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS filled FROM r WINDOW w AS (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
)
def ts_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = event_envelopes(spark, sf_dir).select("session_id", "event_id", F.when(F.col("event_type") == "tool_call", F.col("emitted_at")).alias("t"))
    return S.filled_times(r, "session_id", "event_id", "t").select("session_id", "event_id", "filled")


@query("compact_runs", sql("env", ", r AS (SELECT session_id, event_id, event_type = 'prompt' AS f, lead(event_type = 'prompt') OVER (PARTITION BY session_id ORDER BY event_id) AS nx FROM env) SELECT session_id, event_id FROM r WHERE f AND NOT coalesce(nx, false)"))
def compact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.run_ends(event_envelopes(spark, sf_dir).select("session_id", "event_id", "event_type"), "session_id", "event_id", F.col("event_type") == "prompt").select("session_id", "event_id")


@query(
    "enrich_join",
    sql("env", ", o AS (SELECT l_orderkey::VARCHAR AS message_id, max(l_quantity)::BIGINT AS e, 'out ' || max(l_linenumber) AS r, '/x/' || min(l_linenumber) AS p FROM lineitem GROUP BY 1) SELECT env.event_id, CASE WHEN event_type = 'tool_call' THEN r END AS result, coalesce(exit_code, CASE WHEN tool_name IS NOT NULL THEN e END) AS exit_code, array_to_string(CASE WHEN tool_name IS NULL THEN [] WHEN p IS NULL THEN [path] ELSE [path, p] END, ',') AS paths FROM env LEFT JOIN o ON o.message_id = ltrim(env.event_id, '0')"),
)
def enrich_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls take what a side table (here from lineitem) knows of their message."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("message_id")).agg(F.max("l_quantity").cast("long").alias("exit_code"), F.concat(F.lit("out "), F.max("l_linenumber").cast("string")).alias("result"), F.array(F.concat(F.lit("/x/"), F.min("l_linenumber").cast("string"))).alias("paths"))
    e = event_envelopes(spark, sf_dir).withColumn("message_id", F.regexp_replace("event_id", "^0+", ""))
    e = e.withColumn("result", F.lit(None).cast("string")).withColumn("paths", F.array_compact(F.array("path")))
    sides = li.join(e.select("message_id", "session_id"), "message_id")
    return S.enriched(e, sides).select("event_id", "result", "exit_code", F.array_join("paths", ",").alias("paths"))


@query(
    "usage_rollup",
    "SELECT o_custkey, sum(l_linenumber)::BIGINT AS input_tokens, sum(l_quantity)::BIGINT AS output_tokens, round(sum(CASE WHEN l_discount > 0 THEN l_extendedprice END), 6) AS cost_usd, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) END AS model FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
)
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return S.usage(li.select("o_custkey", F.col("l_linenumber").alias("input_tokens"), F.col("l_quantity").alias("output_tokens"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("cost_usd"), F.col("l_returnflag").alias("model")), "o_custkey")


@query("roster_live", "SELECT o_custkey AS agent_id, max(o_orderdate) AS updated_at FROM orders GROUP BY 1 HAVING (SELECT max(o_orderdate) FROM orders) - max(o_orderdate) <= INTERVAL 90 DAY")
def roster_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.operators.presence import live

    o = table(spark, sf_dir, "orders")
    seen = o.groupBy(F.col("o_custkey").alias("agent_id")).agg(F.max("o_orderdate").alias("updated_at"))
    return live(seen, o.agg(F.max("o_orderdate").alias("now")), "INTERVAL 90 DAYS")


@query("prune_candidates", "SELECT o_orderkey FROM orders WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders) - INTERVAL 1 DAY AND o_orderkey NOT IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)")
def prune_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that no pointer names and that are over a day old."""
    from tidewell.operators.presence import superseded

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    pointers = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")).select("o_orderkey")
    return superseded(o, pointers, "o_orderkey", "o_orderdate", o.agg(F.max("o_orderdate").alias("now"))).select("o_orderkey")
