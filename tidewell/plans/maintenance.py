"""The maintenance chain: compact, digest, fold, gate, and publish an immutable snapshot behind a pointer."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import command_text
from tidewell.operators import claims, evidence, gate, sessions
from tidewell.sources import compaction, eventlog
from tidewell.sources.keyed import Keyed, Merge
from tidewell.sources.segments import decoded
from tidewell.sources.shared import stored


def content_id(table: DataFrame) -> str:
    """A name for a table's rows: the same rows in any order have the same name."""
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns))), 256)
    hashes = table.select(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)").alias("a"), F.conv(F.substring(row, 16, 15), 16, 10).cast("decimal(38,0)").alias("b"))
    got = hashes.agg(F.count("*").alias("n"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    return f"{got.n:x}-{int(got.a) % (1 << 61):x}-{int(got.b) % (1 << 61):x}"


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _pointers(spark: SparkSession, root: str) -> list[str]:
    """Complete pointers, the oldest first: current-<number>-<unique>."""
    fs, at = _fs(spark, f"{root}/current-*/_SUCCESS")
    return sorted(f.getPath().getParent().getName() for f in fs.globStatus(at) or [])


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str) -> str:
    """Write tables, name them by their content and add a pointer to the name; equal content is not kept twice.

    Tables are computed once, into a folder of their own that gets its name when it is
    complete.  Pointers are only added, and readers take the newest complete one, so there
    is no moment without one.
    """
    made = f"{root}/writing-{uuid.uuid4().hex}"
    for label, t in tables.items():
        t.write.parquet(f"{made}/{label}")
    name = "_".join(content_id(spark.read.parquet(f"{made}/{label}"))[:40] for label in sorted(tables))
    fs, at = _fs(spark, f"{root}/{name}")
    if fs.exists(at):
        fs.delete(_fs(spark, made)[1], True)
    else:
        fs.rename(_fs(spark, made)[1], at)
    last = _pointers(spark, root)
    if not last or spark.read.parquet(f"{root}/{last[-1]}").first()[0] != name:
        number = int(last[-1].split("-")[1]) + 1 if last else 1
        spark.createDataFrame([(name,)], "name string").coalesce(1).write.parquet(f"{root}/current-{number:012d}-{uuid.uuid4().hex}")
    return name


def snapshots(spark: SparkSession, root: str) -> list[tuple[str, dict[str, int]]]:
    """Names of published snapshots, the newest first, each with its tables and the rows that each was published with."""
    out = []
    for pointer in reversed(_pointers(spark, root)):
        name = spark.read.parquet(f"{root}/{pointer}").first()[0]
        fs, at = _fs(spark, f"{root}/{name}/*")
        labels = sorted(f.getPath().getName() for f in fs.globStatus(at) or [])
        counts = [int(part.split("-")[0], 16) for part in name.split("_")]
        if len(labels) == len(counts):
            out.append((name, dict(zip(labels, counts, strict=True))))
    return out


def opened(spark: SparkSession, root: str, label: str) -> DataFrame:
    """A table of the snapshot that the newest pointer names."""
    name = spark.read.parquet(f"{root}/{_pointers(spark, root)[-1]}").first()[0]
    return spark.read.parquet(f"{root}/{name}/{label}")


#: Version of a digest row; sessions with an older one are digested again.
DIGEST = 2


class Report(NamedTuple):
    """What a run of the chain did."""

    compacted: list[compaction.Compacted]
    digests: Merge
    decisions: dict[str, int]
    events: int  #: appended to the claim log
    claims: Merge
    snapshot: str


def flat(envelopes: DataFrame) -> DataFrame:
    """Envelopes with the columns that session operators read; a tool with several paths has a row more for each further one."""
    e = envelopes.select(
        "session_id", "event_id", "emitted_at", "event_type", "cwd", "git_sha", F.col("tool.name").alias("tool_name"), F.when(F.col("tool").isNotNull(), command_text(F.col("tool.input"), F.col("tool.name"))).alias("command"),
        F.col("tool.exit_code").cast("long").alias("exit_code"), *[F.col(f"usage.{c}").alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cost_usd")], F.posexplode_outer("tool.paths").alias("_n", "path"),
    )
    own = F.coalesce("_n", F.lit(0)) == 0
    always = ("session_id", "event_id", "emitted_at", "path")
    return e.select(*[F.col(c) if c in always else F.when(own, F.col(c)).alias(c) for c in e.columns if c != "_n"])


def digests(envelopes: DataFrame) -> DataFrame:
    """Full digest rows: the digest with its summary, commands, files, friction and all kinds of tokens.

    Records are decoded once, and each part of the digest reads its columns of what that gave.
    Friction is found once, and so are the digests that summaries tell of.
    """
    e = stored(flat(envelopes), "digest-events")
    found = stored(sessions.friction(e), "digest-friction")
    main = stored(sessions.digest(e, found), "digest-rows")
    tight = found.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("rank", "kind", "subject", "count"))).alias("friction"))
    more = e.groupBy("session_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("output_tokens", "cache_read_tokens", "cache_write_tokens")])
    out = main.join(sessions.summaries(e, found, main), "session_id", "left").join(more, "session_id", "left")
    for part in (sessions.command_lists(e), sessions.files_touched(e), tight):
        out = out.join(part, "session_id", "left")
    return out


def digest_table(spark: SparkSession, root: str) -> Keyed:
    return Keyed(spark, f"{root}/digests", ["session_id"])


def claim_table(spark: SparkSession, root: str) -> Keyed:
    return Keyed(spark, f"{root}/claims-state", ["claim_id"])


def run_digests(spark: SparkSession, root: str) -> Merge:
    """Digest sealed sessions that have no digest of what they hold now; the others are not read."""
    table = digest_table(spark, root)
    have = compaction.seals(spark, root).read()
    if have is None:
        return Merge(0, {}, 0, 0, 0)
    of = have.select("session_id", F.concat_ws("/", "ended_at", F.col("events").cast("string")).alias("content")).groupBy("session_id").agg(F.max("content").alias("content"))
    done = table.read()
    todo = stored(of if done is None else sessions.pending(of, done.select("session_id", "content", "version"), DIGEST), "pending")
    if todo.isEmpty():
        return Merge(table.version(), {}, 0, 0, of.count())
    e = compaction.read_compacted(spark, root).join(todo, "session_id", "left_semi")
    return table.upsert(digests(decoded(e)).join(todo, "session_id").withColumn("version", F.lit(DIGEST)))


def run_gate(spark: SparkSession, root: str, at: str) -> tuple[dict[str, int], int]:
    """Demote claims of quarantined agents, decide on candidates, and append what was decided; decisions by kind and events appended."""
    log = stored(eventlog.read_events(spark, root), "claim-log")
    state = stored(claims.state(log), "claims")
    held = stored(claims.quarantined(log), "quarantined")
    fallen = claims.demoted(state, held)
    inputs = stored(evidence.gate_inputs(compaction.compacted_envelopes(spark, root)), "gate-inputs")
    asked = stored(evidence.checked(state.where("status = 'candidate'"), inputs).drop("evidence").withColumn("trust", F.lit(None).cast("double")), "candidates")
    standing = state.where("status = 'promoted'").join(fallen.select("claim_id"), "claim_id", "left_anti")
    decided = stored(gate.sequential_gate(asked, standing, held), "decisions")
    told = gate.decision_events(decided, at).join(decided.where("decision = 'promote'").select("claim_id", "independent_count", "confidence"), "claim_id", "left")
    told = told.unionByName(fallen.select("claim_id", F.lit("contested").alias("kind"), F.lit(at).alias("at"), "reason"), allowMissingColumns=True)
    # A claim that was promoted in this run may be contested in it, and never the other way round.
    told = told.withColumn("agent_id", F.lit("gate")).withColumn("step", F.when(F.col("kind") == "promoted", 0).otherwise(1))
    n = eventlog.append(told, root)
    return {r.decision: r["count"] for r in decided.groupBy("decision").count().collect()}, n


def run(spark: SparkSession, root: str, at: str, *, reads_enabled: bool = True, part_bytes: int = compaction.PART_BYTES) -> Report:
    """The chain over the lake below ``root``: compact, digest, gate, publish claim state and a snapshot.

    ``root`` has sessions (segments), seals and events (the claim log).  Each step takes up
    only what changed: dates by their seals, sessions by their digest's content and version,
    claims by their row.  A run over an unchanged lake writes no data and keeps the snapshot.
    """
    compacted = compaction.compact(spark, root, part_bytes=part_bytes)
    digested = run_digests(spark, root)
    decisions, events = run_gate(spark, root, at)
    state = claims.state(stored(eventlog.read_events(spark, root), "claim-log"))
    shown = state.withColumn("visible_to_agents", (F.col("status") == "promoted") & F.lit(reads_enabled))
    merged = claim_table(spark, root).upsert(shown)
    tables = {"claims": claim_table(spark, root).read(), "sessions": digest_table(spark, root).read()}
    name = publish(spark, {k: t for k, t in tables.items() if t is not None}, f"{root}/snapshot")
    return Report(compacted, digested, decisions, events, merged, name)
