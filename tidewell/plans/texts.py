"""Queries over text: hashing, redaction, predicates, cleaning, JSON, similarity of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import redaction as R
from tidewell.functions import scores as C
from tidewell.functions import text as T
from tidewell.plans.catalog import query
from tidewell.sources.tables import conversation_envelopes, event_envelopes, sql, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("content_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


#: Cards in DuckDB: digit runs apart from the rest, each with its Luhn sum.
_CARDS = r"""
list_transform(regexp_extract_all({t}, '[0-9](?:[ -]?[0-9])*|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]')
  AND length(regexp_replace(p, '[^0-9]', '', 'g')) BETWEEN 13 AND 19
  AND list_sum(list_transform(range(1, length(regexp_replace(p, '[^0-9]', '', 'g')) + 1), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(p, '[^0-9]', '', 'g'))[i] AS INT)
      ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(reverse(regexp_replace(p, '[^0-9]', '', 'g'))[i] AS INT) + 1] END)) % 10 = 0
  THEN '[redacted-card]' ELSE p END)"""


@query("redact_cards", f"SELECT doc_id, array_to_string({_CARDS.format(t='text')}, '') AS text FROM documents")
def redact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", R.without_cards(F.col("text")).alias("text"))


_MARKS = ", ".join(f"['{m}', '{r}']" for m, r in R.MARKERS)
_SCRUB = rf"""
WITH m AS (SELECT doc_id, text, list_sort(list_distinct(list_transform(list_filter([{_MARKS}], lambda x: contains(text, x[1])), lambda x: x[2]))) AS marks FROM documents),
u AS (SELECT *, regexp_replace(text, '(://[^/?"''\s@:]*:)[^/?"''\s@]*(@)', '\1[redacted]\2', 'g') AS t1 FROM m),
c AS (SELECT *, array_to_string({_CARDS.format(t="t1")}, '') AS t2 FROM u),
s AS (SELECT *, regexp_replace(t2, '(^|[^0-9])(?:00[1-9]|0[1-9][0-9]|[1-57-8][0-9][0-9]|6[0-57-9][0-9]|66[0-57-9])-[0-9][0-9]-[0-9][0-9][0-9][0-9]($|[^0-9])', '\1[redacted-ssn]\2', 'g') AS t3 FROM c),
p AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t3, '(Bearer )[A-Za-z0-9+/=_-]{{16,}}', '\1[redacted]', 'g'), '(hf_)[A-Za-z0-9+/=_-]{{20,}}', '\1[redacted]', 'g'), '(npm_)[A-Za-z0-9+/=_-]{{20,}}', '\1[redacted]', 'g'), '(SG\.)[A-Za-z0-9+/=_-]{{16,}}', '\1[redacted]', 'g') AS t4 FROM s),
f AS (SELECT *, list_filter([CASE WHEN t1 <> text THEN 'uri_credentials' END, CASE WHEN t2 <> t1 THEN 'card_number' END, CASE WHEN t3 <> t2 THEN 'ssn' END,
    CASE WHEN regexp_matches(t3, 'Bearer [A-Za-z0-9+/=_-]{{16,}}') THEN 'bearer_token' END, CASE WHEN regexp_matches(t3, 'hf_[A-Za-z0-9+/=_-]{{20,}}') THEN 'huggingface_token' END,
    CASE WHEN regexp_matches(t3, 'npm_[A-Za-z0-9+/=_-]{{20,}}') THEN 'npm_token' END, CASE WHEN regexp_matches(t3, 'SG\.[A-Za-z0-9+/=_-]{{16,}}') THEN 'sendgrid_key' END], lambda x: x IS NOT NULL) AS fired FROM p)
SELECT doc_id, CASE WHEN len(marks) > 0 THEN 'quarantined' WHEN len(fired) > 0 THEN 'redacted' ELSE 'clean' END AS status,
  array_to_string(CASE WHEN len(marks) > 0 THEN marks ELSE fired END, ',') AS rules,
  CASE WHEN len(marks) > 0 THEN '[withheld, ' || strlen(text) || ' bytes, sha256:' || sha256(text) || ']' ELSE t4 END AS text FROM f"""


@query("scrub", _SCRUB)
def scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("s", R.scrub(F.col("text")))
    return d.select("doc_id", "s.status", F.array_join("s.rules", ",").alias("rules"), "s.text")


@query(
    "entropy_runs",
    """WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_-]{32,}')) AS run FROM documents),
c AS (SELECT doc_id, run, length(run) AS n, unnest(string_split(run, '')) AS ch FROM (SELECT DISTINCT * FROM r)),
k AS (SELECT doc_id, run, n, ch, count(*) AS m FROM c GROUP BY ALL)
SELECT doc_id, run, round(-sum(m / n * log2(m / n)), 6) AS bits, -sum(m / n * log2(m / n)) >= 4.5 AS secret FROM k GROUP BY doc_id, run""",
)
def entropy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _docs(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z0-9+/=_-]{32,}"), F.lit(0)))).alias("run"))
    return runs.withColumn("bits", F.round(R.entropy(F.col("run")), 6)).withColumn("secret", F.col("bits") >= R.BITS)


_DENIED = ", ".join(f"'{x}'" for x in T.DENIED_FRAGMENTS)


@query("denied_paths", f"SELECT page_id, url || '/.env' AS path, true AS denied FROM pages WHERE page_id % 7 = 0 UNION ALL SELECT page_id, url, len(list_filter([{_DENIED}], lambda x: contains(url, x))) > 0 FROM pages")
def denied_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    both = p.where("page_id % 7 = 0").select("page_id", F.concat("url", F.lit("/.env")).alias("path")).union(p.select("page_id", "url"))
    return both.withColumn("denied", T.is_denied_path(F.col("path")))


@query("test_commands", sql("env", "SELECT command, count(*) AS n, bool_or(regexp_matches(lower(command), 'cargo test|pytest|py\\.test|npm test|npm run test|yarn test|go test|jest|mvn test|make test|gradle test|rspec|phpunit')) AS is_test FROM env WHERE command IS NOT NULL GROUP BY ALL"))
def test_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_envelopes(spark, sf_dir).where("command is not null").groupBy("command").agg(F.count("*").alias("n")).withColumn("is_test", T.is_test_command(F.col("command")))


@query(
    "negation_flag",
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: list_contains(['not', 'no', 'never', 'none', 'nobody', 'nothing', 'nowhere', 'neither', 'cannot'],
  regexp_replace(w, '^[^\p{L}\p{N}'']+|[^\p{L}\p{N}'']+$', '', 'g')) OR suffix(regexp_replace(w, '^[^\p{L}\p{N}'']+|[^\p{L}\p{N}'']+$', '', 'g'), 'n''t'))) > 0 AS negated FROM documents""",
)
def negation_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.has_negation(F.col("text")).alias("negated"))


@query(
    "sanitize_text",
    r"""WITH c AS (SELECT doc_id, trim(regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F\x{80}-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2069}\x{FEFF}]', '', 'g'), E' \t\n\r') AS t FROM documents),
k AS (SELECT doc_id, CASE WHEN length(t) > 500 THEN t[1:500] || '…[truncated]' ELSE t END AS t FROM c) SELECT doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS line FROM k""",
)
def sanitize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.visible_line(F.col("text"), 500).alias("line"))


@query("strip_injected", "SELECT page_id, regexp_replace(html, '(?s)<script(?:[^>]*>.*?(?:</script>|\\z)|[^>]*\\z)', '', 'g') AS html FROM pages")
def strip_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.without_injected(F.col("html"), "script").alias("html"))


@query("short_path", "SELECT page_id, array_to_string(string_split(url, '/')[-2:], '/') AS short FROM pages")
def short_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.short_path(F.col("url")).alias("short"))


@query("command_text", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'run ' || event_type WHEN 1 THEN props ELSE 'Bash' END AS command FROM events")
def command_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "props", F.format_string('{"command": "run %s"}', "event_type").alias("made"), (F.col("event_id") % 3).alias("m"))
    made = F.when(F.col("m") == 0, F.col("made")).when(F.col("m") == 1, F.col("props"))
    return e.select("event_id", T.command_text(made, F.lit("Bash")).alias("command"))


@query("unwrap_json", "SELECT event_id, props AS payload FROM events")
def unwrap_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads dressed up in three ways come out as they were."""
    m = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select("event_id", F.when(m == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(m == 1, F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" -- done"))).otherwise(F.col("props")).alias("raw"))
    return e.select("event_id", T.json_payload(F.col("raw")).alias("payload"))


_FENCED = r"SELECT session_id, 'session_id: ' || any_value(session_id) || chr(10) || string_agg('[' || message_id || '] ' || trim(content, E' \t\n\r') || chr(10), '' ORDER BY event_id) AS transcript FROM conv WHERE trim(content, E' \t\n\r') <> '' GROUP BY session_id"


def _transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.operators.transcripts import fenced

    return fenced(conversation_envelopes(spark, sf_dir))


@query("fenced_transcript", sql("conv", _FENCED))
def fenced_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir)


@query("empty_transcripts", sql("conv", f", t AS ({_FENCED}) SELECT session_id, list_max(list_transform(list_filter(string_split(transcript, chr(10)), lambda x: NOT starts_with(x, 'session_id:')), lambda x: strlen(trim(regexp_replace(x, '^.*?\\] ', ''), ' '))))::BIGINT AS longest FROM t"))
def empty_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transcripts(spark, sf_dir).select("session_id", T.longest_substantive(F.col("transcript")).cast("long").alias("longest"))


_TURNS = "SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
_W = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: w <> ''))"
_N = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> ''))"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return c.withColumnRenamed("text", "x").join(after, ["conv_id", "turn"])


@query("lexical_overlap", f"WITH t AS ({_TURNS}) SELECT conv_id, turn, round(CASE WHEN len({_W.format('x')}) = 0 THEN 0 ELSE len(list_intersect({_W.format('x')}, {_W.format('y')})) / len({_W.format('x')}) END, 6) AS overlap FROM t")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(C.word_share(T.words(F.col("x")), T.words(F.col("y"))), 6).alias("overlap"))


@query("jaccard_words", f"WITH t AS ({_TURNS}), s AS (SELECT conv_id, turn, {_N.format('x')} AS a, {_N.format('y')} AS b FROM t) SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS jaccard FROM s")
def jaccard_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(C.jaccard(T.terms(F.col("x")), T.terms(F.col("y"))), 6).alias("jaccard"))


_EMBEDDED = r"""WITH w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM conversations),
b AS (SELECT conv_id, turn, (('0x' || md5(w)[1:8])::BIGINT % 256)::INT AS bucket, count(*) AS n FROM w GROUP BY ALL)
SELECT conv_id, turn, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM b"""


@query("hash_embedding", _EMBEDDED)
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.hash_embedding(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text").withColumn("value", F.round("value", 6))


@query("double_encoded_json", "SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::BIGINT AS exit_code, 'ok ' || event_type AS output, round(value)::BIGINT AS duration_ms FROM events")
def double_encoded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool's output that is JSON in a JSON string, with a fractional duration."""
    from tidewell.sources.hooks import tool_output

    e = table(spark, sf_dir, "events")
    inner = F.to_json(F.struct(F.concat(F.lit("ok "), F.col("event_type")).alias("output"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exitCode")))
    payload = F.to_json(F.struct(inner.alias("tool_output"), F.col("value").alias("duration")))
    return e.select("event_id", *tool_output(F.try_parse_json(payload)))


@query("epoch_to_ts", "SELECT event_id, strftime(make_timestamp((floor(epoch_us(ts) / 1000)::BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM events")
def epoch_to_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select("event_id", C.instant_of_epoch(seconds).alias("at"))


@query(
    "dedup_key",
    sql("env", "SELECT event_id, 'sha256:' || sha256(runtime || chr(0) || session_id || chr(0) || '\"' || event_type || '\"' || chr(0) || emitted_at || chr(0) || '' || chr(0) || coalesce(git_sha, '') || chr(0) || coalesce(command, '')) AS dedup_key FROM env"),
)
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewell.operators.imports import dedup_key as key_of

    return event_envelopes(spark, sf_dir).select("event_id", key_of("runtime", "session_id", "event_type", "emitted_at", F.lit(""), "git_sha", "command").alias("dedup_key"))


@query(
    "import_dedup",
    sql("env", ", k AS (SELECT DISTINCT session_id, event_type, cwd FROM env WHERE NOT (event_type = 'prompt' AND cwd = '/w/p1')) SELECT session_id, event_type, cwd FROM k"),
)
def import_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New events only: once each, and none that the ledger has (here: prompts in one directory)."""
    from tidewell.operators.imports import accepted

    e = event_envelopes(spark, sf_dir).select("session_id", "event_type", "cwd")
    return accepted(e, e.where("event_type = 'prompt' and cwd = '/w/p1'"), ["session_id", "event_type", "cwd"])


_HOSTILE = r"[\x00-\x1F\x7F\x{80}-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]"


@query("terminal_text", f"WITH c AS (SELECT doc_id, regexp_replace(text, '{_HOSTILE}', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 200 THEN t[1:200] || '…[truncated]' ELSE t END AS text FROM c")
def terminal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.terminal_text(F.col("text")).alias("text"))


@query("capped_fields", "SELECT doc_id, CASE WHEN strlen(text) <= 1000 THEN text ELSE text[1:list_max(list_filter(range(250, 1001), lambda k: strlen(text[1:k]) <= 1000))] || '...[truncated]' END AS text FROM documents")
def capped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in at most 1000 bytes, whole characters only."""
    return _docs(spark, sf_dir).select("doc_id", T.capped(F.col("text"), 1000).alias("text"))


@query("segment_ids", "SELECT page_id, url, CASE WHEN url = '' THEN 'empty' WHEN contains(url, '/') THEN 'not one segment' END AS problem FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id, CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'p' || page_id WHEN 2 THEN 'a.b' ELSE '..x' END FROM pages)")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ids may be one part of a path."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    m = F.col("page_id") % 4
    made = F.when(m == 0, "").when(m == 1, F.concat(F.lit("p"), F.col("page_id").cast("string"))).when(m == 2, "a.b").otherwise("..x")
    return p.union(p.select("page_id", made)).withColumn("problem", T.segment_problem(F.col("url")))
