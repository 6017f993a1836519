"""The capture spool as a stream: NDJSON files that hosts append to, rotate and clear, read by byte offset.

A spool holds ``<runtime>/<session>.ndjson`` and, rotated away, ``<session>.ndjson.<number>``;
``<session>.done`` says that the session has ended.  The query's checkpoint keeps, for each
file, how many bytes of complete lines were read, with digests of the first and the last of
them, so a file that was renamed is known by what it holds, two files that begin alike are
two, and a new file under an old name is new.  Only complete lines are read; one that is
being written is left for the next batch.

When a session is done and all bytes of all its files are planned, one more row comes with
them: rotation ``done``, at the session's bytes, no value.  A file that was cleared after it
was read is forgotten.  One that went before its planned bytes were read gives a row with
rotation ``lost`` and their number as size; the query goes on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes that are looked at together, and bytes of a digest.
BLOCK, DIGESTED = 1 << 16, 1 << 12
_NAME = re.compile(r"([^.][^/]*?)\.(?:ndjson(?:\.([0-9]+))?|(done))")
SCHEMA = "runtime string, session_id string, rotation string, at long, size long, value string"
DONE, LOST = "done", "lost"


class SpoolFile(NamedTuple):
    path: str
    runtime: str
    session_id: str
    rotation: str  #: the number of a rotated file, empty for the one that is appended to, ``done`` for the mark
    size: int
    changed: int

    @property
    def order(self) -> tuple:
        """By session, rotated files by number before the one that is appended to, the mark last."""
        return self.runtime, self.session_id, self.rotation == DONE, not self.rotation, int(self.rotation or 0) if self.rotation != DONE else 0

    @property
    def name(self) -> str:
        return f"{self.runtime}/{self.path.rsplit('/', 1)[-1]}"


class Entry(NamedTuple):
    """How far a file is complete, and digests of its first and last bytes up to there."""

    end: int
    head: str
    tail: str


def _listing(root: str) -> list[SpoolFile]:
    store, base = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
    out = []
    for f in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
        parts = f.path.removeprefix(base).strip("/").split("/")
        name = _NAME.fullmatch(parts[-1])
        if f.type == fs.FileType.File and name and len(parts) == 2:
            out.append(SpoolFile(f.path, parts[0], name[1], name[3] or name[2] or "", f.size, f.mtime_ns or 0))
    return sorted(out, key=lambda f: f.order)


def spool_files(root: str) -> list[SpoolFile]:
    """Files of events in a spool; others in its folders (marks, sizes, states) are no spool files."""
    return [f for f in _listing(root) if f.rotation != DONE]


class Range(InputPartition):
    """Bytes of a file; a mark or lost bytes if ``path`` is None."""

    def __init__(self, path: str | None, runtime: str, session_id: str, rotation: str, begin: int, end: int) -> None:
        self.path, self.runtime, self.session_id, self.rotation, self.begin, self.end = path, runtime, session_id, rotation, begin, end


class SpoolReader(DataSourceStreamReader):
    """Offsets are {runtime/file: entry}, and {runtime/session.done: [bytes, when the mark was made]}."""

    def __init__(self, root: str) -> None:
        self.root = root
        self._entries: dict[str, tuple[int, int, Entry]] = {}  # of files as they were when last looked at
        self.opened = 0

    def _open(self, path: str):  # noqa: ANN202
        self.opened += 1
        return fs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")[0].open_input_file(path)

    def _digests(self, s, end: int) -> Entry:  # noqa: ANN001
        parts = []
        for at in (0, max(0, end - DIGESTED)):
            s.seek(at)
            parts.append(hashlib.sha256(s.read(min(DIGESTED, end))).hexdigest()[:24])
        return Entry(end, *parts)

    def _entry(self, f: SpoolFile) -> Entry | None:
        """Up to a file's last complete line; files that are as they were are not opened."""
        known = self._entries.get(f.path)
        if known and known[:2] == (f.size, f.changed):
            return known[2]
        try:
            with self._open(f.path) as s:
                end = size = min(f.size, s.size())
                at = -1
                while end and at < 0:
                    lo = max(0, end - BLOCK)
                    s.seek(lo)
                    at = s.read(end - lo).rfind(b"\n")
                    end = lo if at < 0 else lo + at + 1
                entry = self._digests(s, end)
        except FileNotFoundError:  # rotated or cleared meanwhile; the next batch sees it
            return None
        self._entries[f.path] = (size, f.changed, entry)
        return entry

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _listing(self.root)
        self._entries = {f.path: self._entries[f.path] for f in files if f.path in self._entries}
        out: dict[str, list] = {}
        whole: dict[tuple[str, str], list[bool]] = {}
        total: dict[tuple[str, str], int] = {}
        for f in files:
            own = f.runtime, f.session_id
            if f.rotation == DONE:
                if all(whole.get(own, [])):
                    out[f.name] = [total.get(own, 0), f.changed]
            else:
                entry = self._entry(f)
                whole.setdefault(own, []).append(entry is not None and entry.end == f.size)
                if entry and entry.end:
                    out[f.name], total[own] = list(entry), total.get(own, 0) + entry.end
        return out

    def _holds(self, path: str, entry: Entry) -> bool:
        """Whether a file begins with the bytes that ``entry`` tells of."""
        try:
            with self._open(path) as s:
                return s.size() >= entry.end and self._digests(s, entry.end) == entry
        except FileNotFoundError:
            return False

    def partitions(self, start: dict, end: dict) -> list[Range]:
        new = {name: x for name, x in end.items() if start.get(name) != x}
        if not new:
            return []
        files, there = {}, {}
        for f in _listing(self.root):
            files.setdefault((f.runtime, f.session_id), []).append(f)
            there[f.name] = f
        out = []
        left = {name: Entry(*x) for name, x in start.items() if not name.endswith(f".{DONE}") and (name not in end or name in new)}
        marks = []
        for name, x in new.items():
            runtime, _, last = name.partition("/")
            part = _NAME.fullmatch(last)
            session, rotation = part[1], part[3] or part[2] or ""
            if rotation == DONE:
                marks.append(Range(None, runtime, session, DONE, x[0], x[0]))
                continue
            entry = Entry(*x)
            # The file may have been renamed since it was planned.
            path = next((f.path for f in [there.get(name), *files.get((runtime, session), [])] if f and f.rotation != DONE and f.size >= entry.end and self._holds(f.path, entry)), None)
            mine = [n for n in left if _NAME.fullmatch(n.partition("/")[2])[1] == session and n.startswith(f"{runtime}/") and left[n].end <= entry.end]
            mine.sort(key=lambda n: (n != name, -left[n].end))
            if path:
                before = next((n for n in mine if self._holds(path, left[n])), None)
            else:
                before = next((n for n in mine if n == name), None)
            begin = left.pop(before).end if before else 0
            if begin < entry.end:
                out.append(Range(path, runtime, session, rotation if path else LOST, begin, entry.end))
        return out + marks

    def read(self, partition: Range) -> Iterator[tuple]:
        own = partition.runtime, partition.session_id, partition.rotation
        if partition.path is None:
            yield *own, partition.begin, partition.end - partition.begin, None
            return
        try:
            with self._open(partition.path) as s:
                at, rest = partition.begin, b""
                s.seek(at)
                left = partition.end - at
                while left:
                    block = s.read(min(left, BLOCK))
                    if not block:
                        raise EOFError(f"{partition.path} is shorter than it was")
                    left -= len(block)
                    *lines, rest = (rest + block).split(b"\n")
                    for line in lines:
                        yield *own, at, len(line) + 1, line.decode("utf-8", "replace")
                        at += len(line) + 1
        except FileNotFoundError:  # cleared since the batch was planned
            yield partition.runtime, partition.session_id, LOST, partition.begin, partition.end - partition.begin, None


class SpoolBatch(DataSourceReader):
    """All complete lines that are there."""

    def __init__(self, root: str) -> None:
        self.stream = SpoolReader(root)

    def partitions(self) -> list[Range]:
        return self.stream.partitions({}, self.stream.latestOffset())

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.stream.read(partition)


class SpoolSource(DataSource):
    """``spark.readStream.format("tidewell_spool").option("path", folder)``; also for batches."""

    @classmethod
    def name(cls) -> str:
        return "tidewell_spool"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> SpoolBatch:
        return SpoolBatch(self.options["path"])

    def streamReader(self, schema: object) -> SpoolReader:  # noqa: N802
        return SpoolReader(self.options["path"])
