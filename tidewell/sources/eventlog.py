"""The claim-event log: an append-only folder of JSON lines by date and agent, in which each event stands once."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tidewell.functions.redaction import scrub
from tidewell.functions.text import capped, visible
from tidewell.operators.claims import parsed_events
from tidewell.operators.transcripts import problems
from tidewell.sources import records
from tidewell.sources.shared import stored

#: Fields of a claim event; a kind has some of them.
EVENT = (
    "claim_id string, at string, kind string, agent_id string, claim string, claim_type string, subject string, scope string, "
    "evidence array<struct<session_id: string, message_id: string, excerpt_hash: string, observed_at: string>>, embedding array<float>, resolves_at string, "
    "independent_count long, confidence double, conflicts_with string, reason string"
)
#: Characters of a proposed claim and of its subject.
CLAIM_CHARS, SUBJECT_CHARS = 2000, 200


class Written(WriterCommitMessage):
    """Files that a task wrote aside, and where they belong."""

    def __init__(self, files: list[tuple[str, str]]) -> None:
        self.files = files


class LogWriter(DataSourceWriter):
    """Each task writes a file a date and agent aside; the commit moves those of the tasks that count.

    A file's name is a digest of its keys, so the same rows give the same file.  What other
    attempts left goes with the folder they wrote to, and an aborted job leaves nothing.
    """

    def __init__(self, root: str) -> None:
        self.root, self.aside = root.rstrip("/"), f"_writing-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")

    def write(self, iterator: Iterator[Row]) -> Written:
        groups: dict[tuple[str, str], list[tuple[str, str]]] = {}
        for r in iterator:
            groups.setdefault((r.dt, r.agent), []).append((r.key, r.value))
        store, base = self._store()
        files = []
        for (dt, agent), lines in groups.items():
            lines.sort()
            name = hashlib.sha256("\n".join(k for k, _ in lines).encode()).hexdigest()[:40]
            at = f"{base}/{self.aside}/{uuid.uuid4().hex}"
            store.create_dir(at)
            with store.open_output_stream(f"{at}/{name}.log") as out:
                out.write("".join(f"{k}\t{v}\n" for k, v in lines).encode())
            files.append((f"{at}/{name}.log", f"dt={dt}/agent={agent}/{name}.log"))
        return Written(files)

    def _drop(self) -> None:
        store, base = self._store()
        if store.get_file_info(f"{base}/{self.aside}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.aside}")

    def commit(self, messages: list[Written | None]) -> None:
        store, base = self._store()
        for made, name in [f for m in messages if m for f in m.files]:
            to = f"{base}/events/{name}"
            if store.get_file_info(to).type == fs.FileType.NotFound:
                store.create_dir(to.rpartition("/")[0])
                store.move(made, to)
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()


class EventLog(DataSource):
    """``df.write.format("tidewell_events").option("path", folder)`` of dt, agent, key and value."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_events"

    def schema(self) -> str:
        return "dt string, agent string, key string, value string"

    def writer(self, schema: object, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"])


def keyed(events: DataFrame) -> DataFrame:
    """``events`` (fields of EVENT) with dt, agent, value and a key by time, step and content; events that are equal have one key.

    A column ``step`` orders events of one time, as the log goes by (at, key).
    """
    have = set(events.columns)
    record = F.to_json(F.struct(*[f.name for f in StructType.fromDDL(EVENT).fields if f.name in have]))
    safe = lambda c: F.coalesce(F.nullif(F.regexp_replace(c, r"[^A-Za-z0-9_.@-]", "_"), F.lit("")), F.lit("none"))
    step = F.coalesce(F.col("step").cast("string"), F.lit("0")) if "step" in have else F.lit("0")
    rows = events.withColumn("value", record).withColumn("key", F.concat(F.coalesce("at", F.lit("")), F.lit("-"), step, F.lit("-"), F.substring(F.sha2("value", 256), 1, 32)))
    return rows.select(safe(F.substring("at", 1, 10)).alias("dt"), safe(F.col("agent_id")).alias("agent"), "key", "value").dropDuplicates(["key"])


def lines(spark: SparkSession, root: str) -> DataFrame:
    """(key, value, dt) of the log; one row a key, whoever wrote it how often."""
    store, at = records.store_of(spark, f"{root}/events/dt=*")
    if not store.globStatus(at):
        return spark.createDataFrame([], "key string, value string, dt string")
    text = spark.read.schema("value string, dt string, agent string").option("basePath", f"{root}/events").option("pathGlobFilter", "*.log").text(f"{root}/events")
    rows = text.where(F.instr("value", "\t") > 0).select(F.expr("substring(value, 1, instr(value, '\t') - 1)").alias("key"), F.expr("substring(value, instr(value, '\t') + 1)").alias("value"), "dt")
    return rows.dropDuplicates(["key"])


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """Events of the log with their keys; lines that are no event are skipped."""
    return parsed_events(lines(spark, root).select("key", "value"), EVENT)


def append(events: DataFrame, root: str) -> int:
    """Add events that the log does not hold yet; how many.

    The log is read only in the dates that ``events`` have.
    """
    spark = events.sparkSession
    spark.dataSource.register(EventLog)
    rows = stored(keyed(events), "events")
    dates = rows.select("dt").distinct()
    known = lines(spark, root).join(dates, "dt", "left_semi").select("key")
    new = stored(rows.join(known, "key", "left_anti"), "new-events")
    n = new.count()
    if n:
        new.select("dt", "agent", "key", "value").repartition("dt", "agent").write.format(EventLog.name()).option("path", root).mode("append").save()
    return n


def propose(proposals: DataFrame, root: str, at: str) -> DataFrame:
    """Append valid proposals as events of kind ``proposed``; all proposals with ``problem``, null for those that went in.

    ``proposals``: agent_id, claim, claim_type, subject, evidence.  Texts are bounded first,
    then scrubbed, as what is written is read by others; a claim's id is a digest of its type,
    subject and text, so that a proposal made again is the same claim.
    """
    bound = lambda c, n: visible(capped(F.col(c)), n)
    p = problems(proposals).withColumns({"claim": bound("claim", CLAIM_CHARS), "subject": bound("subject", SUBJECT_CHARS)})
    p = stored(p.withColumns({"claim": scrub(F.col("claim"))["text"], "subject": scrub(F.col("subject"))["text"]}), "proposals")
    claim_id = F.concat(F.lit("c-"), F.substring(F.sha2(F.concat_ws("\x00", "claim_type", "subject", "claim"), 256), 1, 24))
    append(p.where("problem is null").select(claim_id.alias("claim_id"), F.lit(at).alias("at"), F.lit("proposed").alias("kind"), "agent_id", "claim", "claim_type", "subject", "evidence"), root)
    return p.withColumn("claim_id", F.when(F.col("problem").isNull(), claim_id))
