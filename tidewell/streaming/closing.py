"""Sessions that close, open again and close again, and agents that come and go, as state that outlives batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidewell.sources import compaction
from tidewell.sources.segments import ENVELOPE
from tidewell.streaming.spool import DONE, LOST

#: The state store that state with timers needs.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Minutes after its last heartbeat that an agent counts as gone.
PRESENCE_MS = 5 * 60_000

_CHANGE = "fleet_id string, session_id string, kind string, first_at string, ended_at string, events long, bytes long, lost long, seals long"
_SESSION = "fleet string, first_at string, ended_at string, ended boolean, sealed boolean, events long, bytes long, total long, lost long, seals long"


class Sealing(StatefulProcessor):
    """A session's seals: one when it has ended and all its bytes were seen, another each time it ends again after new events."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", _SESSION, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        fleet, first, last, ended, sealed, events, n_bytes, total, lost, seals = self.state.get() if self.state.exists() else (None, None, None, False, False, 0, 0, None, 0, 0)
        was = sealed
        for r in rows:
            if r.rotation == DONE:
                total = max(total or 0, r.at)
                continue
            n_bytes += r.size
            if r.rotation == LOST:
                lost += r.size
            if r.event_id is None:
                continue
            events += 1
            fleet = fleet or r.fleet_id
            if r.emitted_at:
                first, last = min(first or r.emitted_at, r.emitted_at), max(last or r.emitted_at, r.emitted_at)
            # An event after the seal opens the session again, whatever its type.
            sealed, ended = False, r.event_type == "session_end" or (ended and not sealed)
        kinds = ["reopened"] if was and not sealed else []
        if ended and not sealed and total is not None and n_bytes >= total:
            sealed, seals = True, seals + 1
            kinds.append("sealed")
        self.state.update((fleet, first, last, ended, sealed, events, n_bytes, total, lost, seals))
        for kind in kinds:
            yield Row(fleet_id=fleet, session_id=key[1], kind=kind, first_at=first, ended_at=last, events=events, bytes=n_bytes, lost=lost, seals=seals)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from ()

    def close(self) -> None:
        pass


def session_changes(lines: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Seals and reopenings of the sessions whose spool ``lines`` (see SpoolSource) come in.

    fleet_id, session_id, kind (``sealed`` or ``reopened``), first_at, ended_at, events,
    bytes, lost bytes and the number of seals so far.  A session is sealed in the batch in
    which it has a session_end and as many bytes as its done mark tells; lines may come in
    any order and over many batches.  An event after the seal tells ``reopened``, and the
    next session_end seals anew.  State stays for ever, or for ``ttl_ms`` after a session's
    last row; a session that goes on after that begins again with no events.
    """
    e = lines.select("runtime", F.col("session_id").alias("file_session"), "rotation", "at", "size", F.from_json("value", ENVELOPE).alias("e"))
    rows = e.select("runtime", "file_session", "rotation", "at", "size", "e.event_id", "e.emitted_at", "e.event_type", "e.fleet_id")
    lines.sparkSession.conf.set(*STORE)
    return rows.groupBy("runtime", "file_session").transformWithState(Sealing(ttl_ms), _CHANGE, "append", "processingTime" if ttl_ms else "none")


def to_seals(lines: DataFrame, root: str, checkpoint: str, ttl_ms: int | None = None, **trigger: object) -> StreamingQuery:
    """Keep the seals of a lake (see compaction.seals()) as sessions close.

    A batch that is run again puts in what is there already, which changes nothing.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        compaction.seal(batch.sparkSession, root, batch.where("kind = 'sealed'"))

    return session_changes(lines, ttl_ms).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Presence(StatefulProcessor):
    """An agent is there from its first heartbeat until the watermark is ``ttl_ms`` past its last one."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at long, runtime string")

    def _row(self, key: tuple, kind: str, at: int, runtime: str | None) -> Row:
        return Row(agent_id=key[0], kind=kind, at_ms=at, runtime=runtime)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        now, runtime = self.last.get() if self.last.exists() else (None, None)
        before = now
        for r in rows:
            if now is None or r.at_ms >= now:
                now, runtime = r.at_ms, r.runtime
        if before is None:
            yield self._row(key, "came", now, runtime)
        elif now > before:
            self.handle.deleteTimer(before + self.ttl_ms)
        if now != before:
            self.handle.registerTimer(now + self.ttl_ms)
        self.last.update((now, runtime))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.last.exists():
            at, runtime = self.last.get()
            if at + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield self._row(key, "gone", at, runtime)

    def close(self) -> None:
        pass


def presence_changes(envelopes: DataFrame, ttl_ms: int = PRESENCE_MS, late: str = "1 minute") -> DataFrame:
    """agent_id, kind (``came`` or ``gone``), at_ms of the last heartbeat, runtime: as agents come and go.

    Any event is a heartbeat.  An agent goes when the watermark (``late`` behind the newest
    event) passes its last heartbeat by ``ttl_ms``, and its state with it.  Events later
    than the watermark wake nobody.
    """
    e = envelopes.withColumn("ts", F.try_to_timestamp("emitted_at")).where("ts is not null and agent_id is not null").withWatermark("ts", late)
    rows = e.select("agent_id", "runtime", "ts", F.unix_millis("ts").alias("at_ms"))
    envelopes.sparkSession.conf.set(*STORE)
    return rows.groupBy("agent_id").transformWithState(Presence(ttl_ms), "agent_id string, kind string, at_ms long, runtime string", "append", "eventTime")


def spool_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines, marks and losses of a spool as a stream."""
    from tidewell.streaming.spool import SpoolSource

    spark.dataSource.register(SpoolSource)
    return spark.readStream.format(SpoolSource.name()).option("path", path).load()
