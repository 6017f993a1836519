"""Sessions from envelopes: digest, friction, windows, compaction, forward fill.

Envelopes have session_id, event_id (their order), emitted_at (RFC 3339 text), event_type and,
as far as an operator reads them, tool columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scores import instant
from tidewell.functions.text import is_commit, is_test_command, short_command, short_path

#: Failures that repeat, touches above which a file is hot, trailing failures of an abandoned session.
REPEATED, HOT, TRAILING = 2, 5, 3
#: Hash of the empty string; rows that have it are never duplicates.
EMPTY = "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: Characters of a session's summary.
SUMMARY = 160


def failed(exit_code: str = "exit_code") -> Column:
    return F.coalesce(F.col(exit_code) != 0, F.lit(False))


def commands(envelopes: DataFrame) -> DataFrame:
    """Tool calls that report an exit code."""
    return envelopes.where(F.col("exit_code").isNotNull())


def last_commands(envelopes: DataFrame) -> DataFrame:
    """session_id, last_command, last_failed and the trailing run of its failures.

    The run is counted without sorting: commands after the last one that differs or succeeds.
    """
    c = commands(envelopes).select("session_id", "event_id", "command", failed().alias("bad"))
    last = c.groupBy("session_id").agg(F.max(F.struct("event_id", "command", "bad")).alias("l")).select("session_id", F.col("l.command").alias("last_command"), F.col("l.bad").alias("last_failed"))
    both = c.join(last, "session_id")
    other = ~(F.col("bad") & (F.col("command") == F.col("last_command")))
    stop = both.groupBy("session_id").agg(F.max(F.when(other, F.col("event_id"))).alias("stop"))
    run = both.join(stop, "session_id").groupBy("session_id", "last_command", "last_failed").agg(F.count_if(F.col("stop").isNull() | (F.col("event_id") > F.col("stop"))).alias("run"))
    return run.withColumn("run", F.when(F.col("last_failed"), F.col("run")).otherwise(0).cast("long"))


def abandoned(envelopes: DataFrame, trailing: int = TRAILING) -> DataFrame:
    """Sessions without an end whose last command failed ``trailing`` times or more in a row."""
    ended = envelopes.where("event_type = 'session_end'").select("session_id").distinct()
    return last_commands(envelopes).where(F.col("run") >= trailing).join(ended, "session_id", "left_anti").select("session_id", F.col("last_command").alias("command"), F.col("run").alias("count"))


def repeated_failures(envelopes: DataFrame, least: int = REPEATED) -> DataFrame:
    """session_id, command, count; the command of an abandoned session is told of there."""
    gone = abandoned(envelopes).select("session_id", "command")
    many = commands(envelopes).where(failed()).groupBy("session_id", "command").agg(F.count("*").alias("count")).where(F.col("count") >= least)
    return many.join(gone, ["session_id", "command"], "left_anti")


def hot_files(envelopes: DataFrame, above: int = HOT) -> DataFrame:
    return envelopes.where("path is not null").groupBy("session_id", "path").agg(F.count("*").alias("count")).where(F.col("count") > above)


def files_touched(envelopes: DataFrame) -> DataFrame:
    """(session_id, files): sorted distinct paths of a session's tools."""
    return envelopes.where("path is not null").groupBy("session_id").agg(F.array_sort(F.collect_set("path")).alias("files"))


def dominant_cwd(envelopes: DataFrame) -> DataFrame:
    """The working directory of most events; of equals the greatest by code point."""
    n = envelopes.where("cwd <> ''").groupBy("session_id", "cwd").agg(F.count("*").alias("n"))
    return n.groupBy("session_id").agg(F.max(F.struct("n", "cwd")).alias("m")).select("session_id", F.col("m.cwd").alias("cwd"), F.col("m.n").alias("n"))


def session_windows(envelopes: DataFrame) -> DataFrame:
    return envelopes.groupBy("session_id").agg(F.min("emitted_at").alias("first_at"), F.max("emitted_at").alias("last_at"), F.count("*").alias("events"))


def sealed(envelopes: DataFrame) -> DataFrame:
    """Sessions that have ended, with the last end."""
    return envelopes.where("event_type = 'session_end'").groupBy("session_id").agg(F.max("emitted_at").alias("ended_at"))


def friction(envelopes: DataFrame) -> DataFrame:
    """session_id, rank, kind, subject, count: abandonment, then failures, then files, most frequent first."""
    parts = [
        abandoned(envelopes).select("session_id", F.lit(0).alias("o"), F.lit("abandoned_after_failures").alias("kind"), F.col("command").alias("subject"), "count"),
        repeated_failures(envelopes).select("session_id", F.lit(1).alias("o"), F.lit("repeated_failure").alias("kind"), F.col("command").alias("subject"), "count"),
        hot_files(envelopes).select("session_id", F.lit(2).alias("o"), F.lit("hot_file").alias("kind"), F.col("path").alias("subject"), "count"),
    ]
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("o", F.desc("count"), "subject"))
    return parts[0].union(parts[1]).union(parts[2]).withColumn("rank", rank.cast("long")).drop("o")


def digest(envelopes: DataFrame, tight: DataFrame | None = None) -> DataFrame:
    """One row a session, from two aggregations by session and the friction of it; ``tight``: friction() of the same envelopes, where that is there already."""
    tight = friction(envelopes) if tight is None else tight
    key = F.col("event_id")
    run = commands(envelopes).groupBy("session_id").agg(
        F.count("*").alias("n_commands"),
        F.count_if(failed()).alias("n_failed"),
        F.count_if(is_test_command(F.col("command"))).alias("n_tests"),
        F.count_if(is_commit(F.col("command"))).alias("n_commits"),
        F.max(F.struct("event_id", failed().alias("bad"))).alias("l"),
    )
    main = envelopes.groupBy("session_id").agg(
        F.min(F.struct(key, "emitted_at")).alias("a"),
        F.max(F.struct(key, "emitted_at")).alias("b"),
        F.count_if(F.col("event_type") == "prompt").alias("turn_count"),
        F.min(F.when(F.col("git_sha").isNotNull(), F.struct(key, "git_sha"))).alias("s"),
        F.max(F.when(F.col("git_sha").isNotNull(), F.struct(key, "git_sha"))).alias("t"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
        F.count_distinct("path").alias("n_files"),
    )
    tight = tight.groupBy("session_id").agg(F.count("*").alias("n_friction"), F.bool_or(F.col("kind") == "abandoned_after_failures").alias("gone"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = main.join(run, "session_id", "left").join(tight, "session_id", "left").join(dominant_cwd(envelopes).drop("n"), "session_id", "left")
    span = F.floor((F.unix_micros(instant(F.col("b.emitted_at"))) - F.unix_micros(instant(F.col("a.emitted_at")))) / 1000).cast("long")
    return joined.select(
        "session_id",
        F.col("a.emitted_at").alias("started_at"),
        F.col("b.emitted_at").alias("ended_at"),
        span.alias("duration_ms"),
        "turn_count",
        *map(zero, ("n_commands", "n_failed", "n_tests", "n_commits", "n_files", "n_friction")),
        F.col("s.git_sha").alias("git_sha_before"),
        F.col("t.git_sha").alias("git_sha_after"),
        F.col("cwd").alias("repo"),
        F.col("input_tokens").cast("long").alias("input_tokens"),
        "cost_usd",
        F.when(F.col("gone"), "abandoned").when(F.col("l.bad"), "error").otherwise("clean").alias("outcome"),
    )


def summaries(envelopes: DataFrame, tight: DataFrame | None = None, digests: DataFrame | None = None) -> DataFrame:
    """session_id and one line of at most SUMMARY characters: friction, files, commands, commits; ``tight`` and ``digests`` of the same envelopes, where they are there already."""
    tight = friction(envelopes) if tight is None else tight
    digests = digest(envelopes, tight) if digests is None else digests
    first = tight.where("rank = 1").select("session_id", "kind", "subject", "count")
    short = files_touched(envelopes).select("session_id", F.size("files").alias("n_files"), F.slice(F.array_distinct(F.transform("files", short_path)), 1, 3).alias("shown"))
    d = digests.select("session_id", "turn_count", "n_commands", "n_failed", "n_commits").join(first, "session_id", "left").join(short, "session_id", "left")
    n = F.col("count").cast("string")
    tight = (
        F.when(F.col("kind") == "repeated_failure", F.concat(F.lit("`"), short_command(F.col("subject")), F.lit("` failed "), n, F.lit("x")))
        .when(F.col("kind") == "hot_file", F.concat(F.lit("edited "), short_path(F.col("subject")), F.lit(" "), n, F.lit("x")))
        .when(F.col("kind").isNotNull(), F.concat(F.lit("abandoned after "), n, F.lit(" failed `"), short_command(F.col("subject")), F.lit("`")))
    )
    more = F.col("n_files") - F.size("shown")
    touched = F.concat(F.lit("touched "), F.array_join("shown", ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))
    ran = F.when(F.col("n_commands") > 0, F.concat(F.col("n_commands").cast("string"), F.lit(" command(s), "), F.when(F.col("n_failed") == 0, "all clean").otherwise(F.concat(F.col("n_failed").cast("string"), F.lit(" failed")))))
    kept = F.when(F.col("n_commits") > 0, F.concat(F.col("n_commits").cast("string"), F.lit(" commit(s)")))
    line = F.concat_ws(" · ", tight, touched, ran, kept)
    line = F.when(line == "", F.concat(F.col("turn_count").cast("string"), F.lit(" turn(s), nothing recorded"))).otherwise(line)
    return d.select("session_id", F.when(F.char_length(line) > SUMMARY, F.concat(F.substring(line, 1, SUMMARY - 1), F.lit("…"))).otherwise(line).alias("summary"))


def compacted(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """The first row of each (session_id, content_hash); rows without content all stay."""
    nth = F.row_number().over(Window.partitionBy("session_id", "content_hash").orderBy(key))
    empty = F.col("content_hash") == EMPTY
    return rows.where(empty).unionByName(rows.where(~empty).withColumn("_n", nth).where("_n = 1").drop("_n"))


def generation(keys: DataFrame, by: list[str], key: str) -> DataFrame:
    """A hash of the sorted keys of each partition: equal keys need no new compaction."""
    return keys.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256).alias("generation"), F.count("*").alias("keys"))


def filled_times(rows: DataFrame, by: str, order: str, time: str) -> DataFrame:
    """``time`` with gaps taken from the row before, and leading gaps from the first there is."""
    w = Window.partitionBy(by).orderBy(order)
    so_far = F.last(time, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(time, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("filled", F.coalesce(so_far, first))


def run_ends(rows: DataFrame, by: str, order: str, flag: Column) -> DataFrame:
    """Rows at which a run of true flags ends."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("_f", flag).withColumn("_next", F.lead("_f").over(w)).where(F.col("_f") & ~F.coalesce("_next", F.lit(False))).drop("_f", "_next")


def enriched(envelopes: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Envelopes with results and exit codes that a transcript knows where they have none, and its paths added.

    outcomes: session_id, message_id, result, exit_code, paths.
    """
    o = outcomes.select("session_id", "message_id", F.col("result").alias("_r"), F.col("exit_code").alias("_e"), F.col("paths").alias("_p"))
    both = envelopes.join(o, ["session_id", "message_id"], "left")
    tool = F.col("tool_name").isNotNull()
    paths = F.coalesce("paths", F.array().cast("array<string>"))
    both = both.withColumn("result", F.coalesce("result", F.when(tool, F.col("_r")))).withColumn("exit_code", F.coalesce("exit_code", F.when(tool, F.col("_e"))))
    return both.withColumn("paths", F.when(tool & F.col("_p").isNotNull(), F.array_union(paths, "_p")).otherwise(paths)).drop("_r", "_e", "_p")


def usage(rows: DataFrame, by: str) -> DataFrame:
    """Token sums over models; the model only if there is one, the cost only if any is known."""
    return rows.groupBy(by).agg(
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
        F.when(F.count_distinct("model") == 1, F.max("model")).alias("model"),
    )


def command_lists(envelopes: DataFrame) -> DataFrame:
    """(session_id, commands) of sessions with commands, those that came back with an exit code, in the order of their events.

    Each is struct(event_id, tool, command, exit_code, is_test).  One aggregation a session;
    a list is as long as the session, which its runtime bounds.
    """
    ran = envelopes.where("exit_code is not null")
    one = F.struct("event_id", F.col("tool_name").alias("tool"), "command", "exit_code", F.coalesce(is_test_command(F.col("command")), F.lit(False)).alias("is_test"))
    return ran.groupBy("session_id").agg(F.array_sort(F.collect_list(one)).alias("commands"))


def pending(sessions: DataFrame, done: DataFrame, version: int) -> DataFrame:
    """Rows of ``sessions`` (session_id, content) that ``done`` (session_id, content, version) does not hold in this version or a later one."""
    current = done.where(F.col("version") >= version).select("session_id", "content").distinct()
    return sessions.join(current, ["session_id", "content"], "left_anti")


def seals(envelopes: DataFrame) -> DataFrame:
    """Seal marks of sessions that ended: session_id, ended_at, and the events and distinct events that were there."""
    of = envelopes.groupBy("session_id").agg(
        F.max(F.when(F.col("event_type") == "session_end", F.col("emitted_at"))).alias("ended_at"), F.count("*").alias("events"), F.count_distinct("event_id").alias("distinct_events")
    )
    return of.where("ended_at is not null")


def parts(envelopes: DataFrame, most: int, by: tuple[str, ...] = ("dt",)) -> DataFrame:
    """Add ``part``: the compacted part of its date (or of each ``by``) that an event goes to, by order of event.

    Parts are cut where ``most`` bytes of JSON are reached, counted from each session's begin,
    and sessions follow each other, so that running sums stay within a session and a table of
    one row a session.
    """
    return placed(within(envelopes, by), most, by)


def within(envelopes: DataFrame, by: tuple[str, ...] = ("dt",)) -> DataFrame:
    """Add ``bytes`` of each record, and ``within``: those of the records before it in its session."""
    before = F.sum("bytes").over(Window.partitionBy(*by, "session_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")
    return envelopes.withColumn("bytes", F.octet_length("record").cast("long")).withColumn("within", before)


def placed(sized: DataFrame, most: int, by: tuple[str, ...] = ("dt",)) -> DataFrame:
    """parts() of rows that within() has gone over; where these are stored, only their sizes are read for the sums."""
    whole = sized.groupBy(*by, "session_id").agg(F.sum("bytes").alias("all"))
    before = whole.select(*by, "session_id", (F.sum("all").over(Window.partitionBy(*by).orderBy("session_id")) - F.col("all")).alias("before"))
    return sized.join(before, [*by, "session_id"]).withColumn("part", F.floor((F.col("before") + F.col("within")) / most).cast("long")).drop("within", "before")


def listed(sessions: DataFrame, prefix: str | None = None, limit: int = 20) -> DataFrame:
    """Newest sessions first, of those whose id begins with ``prefix``, with their place."""
    mine = sessions if prefix is None else sessions.where(F.col("session_id").startswith(prefix))
    top = mine.orderBy(F.desc("ended_at"), "session_id").limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ended_at"), "session_id")).cast("long"))
