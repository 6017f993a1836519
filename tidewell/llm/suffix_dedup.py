"""Removal of long repeats by prefix-free parsing.

A byte string of ``length`` that starts at two places is cut out of both.  The corpus is
parsed by triggers: in every window of ``length`` bytes, the gram of GRAM bytes with the
least rolling hash (the last of equals) is the window's trigger.  Neighbouring windows
with one trigger make a phrase, from the first byte of the first window to the last byte
of the last.  Phrases overlap by length - 1 bytes, so each window lies in just one of
them, and a trigger depends on the window's bytes alone: equal windows have equal
triggers at equal places, in whatever document they stand.

* The parse: every occurrence of a phrase sends its trigger's hash and its own to a range
  of hashes, packed in arrays; what a task has several times it sends once and settles
  itself.  There the parse is sorted by phrase: its suffix array to a depth of one phrase,
  which is as deep as a string of ``length`` bytes can see.  Intervals of equal phrases
  tell which occur once and which more often, which is all that the cut asks.  A trigger
  seen once ends there: its windows are unique.  A phrase seen twice is repeated in all its
  windows, whatever surrounds it.
* The dictionary: phrases that occur once but share their trigger with others send their
  bytes, and of those that occur more often one does.  By trigger, their suffixes are sorted by prefix
  doubling to a depth of ``length`` bytes.
* Corpus order: a run of equal dictionary suffixes stands for one place of the corpus or
  for several, by the intervals of their phrases, counted to two (corpus_places()).  The
  order is that of each trigger's suffixes; triggers are not ordered among themselves.
* The windows of a trigger with very many phrases are dealt out as phrases of one window
  each, which go through the same parse, so that their bytes never stand in one task.
  That a trigger is such a one is seen where its phrases' hashes have come together: about
  30 bytes for each distinct phrase of a trigger are in one range before.

Both answers go back to the texts, whose bytes are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import U64, apart, frugal, mix, partitions, powers, stored, text_buffer, whole_groups
from tidewell.llm.url_filters import parted

#: Bytes of a repeat, and of a trigger.
LENGTH, GRAM = 200, 64
#: Windows looked at together, occurrences that a task gathers before it deals them out, bytes of a dictionary
#: sorted together, and phrases of a trigger from which its windows are dealt out one by one.
PIECE, FLUSH, SORTED, HOT = 1 << 19, 1 << 19, 1 << 20, 1 << 10
#: Words of the Bloom filter at most, 64 bits each.
MOST_BLOCKS = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = powers(max(n, PIECE + 4096), base)
    return _POWERS[base][:n]


def _sums(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * _powers(len(raw), _BASE), dtype=U64, out=out[1:])
    return out


def _spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    back = _powers(len(sums), pow(_BASE, -1, 1 << 64))
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def _window_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(v) - width + 1
    full = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, U64)
    full[: len(v)] = v
    blocks = full.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def phrases(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, trigger's hash, phrase's hash) of each phrase of the texts in a buffer.

    Windows are numbered from the beginning of their text.
    """
    none = np.zeros(0, np.int64)
    counts = np.maximum(np.diff(off) - length + 1, 0)
    if not counts.sum():
        return none, none, none, none.view(U64), none.view(U64)
    sums = _sums(raw)
    n = len(raw) - gram + 1
    h = mix((sums[gram:] - sums[:-gram]) * _powers(n, pow(_BASE, -1, 1 << 64)))
    # 28 bits of place under 36 bits of hash: of equals the last is least
    least = _window_min((h & ~U64((1 << 28) - 1)) | (U64((1 << 28) - 1) - np.arange(n, dtype=U64)), length - gram + 1)
    own = np.repeat(np.arange(len(counts)), counts)
    p = np.arange(len(own)) + np.repeat(off[:-1] - (np.cumsum(counts) - counts), counts)
    at = (U64((1 << 28) - 1) - (least[p] & U64((1 << 28) - 1))).astype(np.int64)
    new = np.ones(len(p), bool)
    new[1:] = (at[1:] != at[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(p)))
    start = p[first]
    return own[first], start - off[own[first]], size, h[at[first]], _spans(sums, start, start + size + length - 1)


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, row numbers, first window) of texts, PIECE windows at a time; long texts come in several."""
    raw, off = text_buffer(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE, "right")) - 1)
        if off[hi] - off[lo] <= PIECE + length - 1:
            yield raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], np.arange(lo, hi), 0
        else:
            for a in range(0, off[hi] - off[lo] - length + 1, PIECE):
                part = raw[off[lo] + a : min(off[hi], off[lo] + a + PIECE + length - 1)]
                yield part, np.array([0, len(part)]), np.array([lo]), a
        lo = hi


_SENT = "part int, trigger binary, phrase binary, t1 binary, first binary, size binary, seen binary"
_NAMES = ["trigger", "phrase", "t1", "first", "size", "seen"]
_KINDS = ("<u8", "<u8", "<i8", "<u4", "u1", "u1")
#: ``seen``: once or more often in the sending task, or an occurrence of a phrase that is known to be repeated.
_ONCE, _TWICE, _KNOWN = 1, 2, 0


def _packed(columns: list[np.ndarray], kinds: tuple[str, ...], names: list[str], to: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """One row a range, its columns as arrays of bytes."""
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(parts + 1))
    columns = [np.ascontiguousarray(c[order].astype(k)) for c, k in zip(columns, kinds, strict=True)]
    for p in range(parts):
        a, b = cuts[p], cuts[p + 1]
        if a < b:
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([c[a:b].tobytes()], pa.binary()) for c in columns]], ["part", *names])


def _deal(columns: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """Occurrences to the range of their trigger: of equal phrases the first, the others to their text's range as known.

    So a range gets a phrase once from each hand-out of a task, however often it occurs.
    """
    trigger, phrase, t1, first, size = columns
    order = np.argsort(phrase, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = phrase[order][1:] != phrase[order][:-1]
    n = np.diff(np.append(np.flatnonzero(new), len(order)))
    seen = np.full(len(order), _KNOWN, np.uint8)
    seen[order[new]] = np.where(n > 1, _TWICE, _ONCE)
    # occurrences in copies of a text are one
    rest = order[~new]
    if len(rest):
        rest = rest[np.lexsort((first[rest], t1[rest]))]
        again = np.zeros(len(rest), bool)
        again[1:] = (t1[rest][1:] == t1[rest][:-1]) & (first[rest][1:] == first[rest][:-1])
        rest = rest[~again]
        order = np.concatenate([order[new], rest])
        trigger, phrase, t1, first, size, seen = (c[order] for c in (trigger, phrase, t1, first, size, seen))
    to = np.where(seen == _KNOWN, _range_of(mix(t1.view(U64)), parts), _range_of(mix(trigger), parts))
    yield from _packed([trigger, phrase, t1, first, size, seen], _KINDS, _NAMES, to, parts)


def _range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> U64(48)) * U64(parts) >> U64(16)).astype(np.uint32 if parts > 65535 else np.uint16)


def _send(parts: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            t1 = batch.column(0).to_numpy()
            for raw, off, rows, base in _pieces(batch.column(1), length):
                own, first, n, trigger, phrase = phrases(raw, off, length, gram)
                held.append((trigger, phrase, t1[rows[own]], first + base, n))
                size += len(own)
                if size >= FLUSH:
                    yield from _deal([np.concatenate(c) for c in zip(*held, strict=True)], parts)
                    held, size = [], 0
        if size:
            yield from _deal([np.concatenate(c) for c in zip(*held, strict=True)], parts)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], names: list[str], kinds: tuple[str, ...]) -> list[np.ndarray]:
    held = [b for b in batches if b.num_rows]
    if not held:
        return [np.zeros(0, k) for k in kinds]
    table = pa.Table.from_batches(held)
    return [np.concatenate([np.frombuffer(x, k) for x in table.column(c).to_pylist()]) for c, k in zip(names, kinds, strict=True)]


def _runs(*sorted_: np.ndarray) -> np.ndarray:
    """Number of the run of equal rows that each row is in."""
    new = np.zeros(len(sorted_[0]), np.int64)
    for c in sorted_:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


_FULL, _OPEN, _SPELT, _HOT, _HOT_FULL = 0, 1, 2, 3, 4
_REPLY = "part int, t1 binary, first binary, size binary, kind binary, trigger binary"
_REPLY_NAMES = ["t1", "first", "size", "kind", "trigger"]
_REPLY_KINDS = ("<i8", "<u4", "u1", "u1", "<u8")


def parse_order(trigger: np.ndarray, phrase: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of a parse to the depth of one phrase: its order, for each place there the times of its
    phrase, whether it is the first of its interval, and how many phrases share its trigger."""
    order = np.lexsort((phrase, trigger))
    by_trigger, by_phrase = _runs(trigger[order]), _runs(trigger[order], phrase[order])
    new = np.ones(len(order), bool)
    new[1:] = by_phrase[1:] != by_phrase[:-1]
    n = np.bincount(by_phrase, times[order])[by_phrase]
    return order, n, new, np.bincount(by_trigger[new])[by_trigger]


def _match(parts: int, hot: int):
    """What the parse knows of each occurrence: _FULL repeated in all windows, _SPELT so too and its bytes
    are asked for, _OPEN once and its bytes; _HOT and _HOT_FULL once or repeated, and its windows' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigger, phrase, t1, first, size, seen = _gathered(batches, _NAMES, _KINDS)
        if not len(trigger):
            return
        known = seen == _KNOWN
        kept = [c[known] for c in (t1, first, size, np.full(len(seen), _FULL, np.uint8), trigger)]
        trigger, phrase, t1, first, size, seen = (c[~known] for c in (trigger, phrase, t1, first, size, seen))
        if len(trigger):
            order, n, new, spellings = parse_order(trigger, phrase, seen)
            kind = np.where(n > 1, _FULL, _OPEN).astype(np.uint8)
            kind[(n > 1) & new & (spellings > 1)] = _SPELT
            kind[(kind == _OPEN) & (spellings > hot)] = _HOT
            kind[(kind == _SPELT) & (spellings > hot)] = _HOT_FULL
            keep = (n > 1) | (spellings > 1)
            asked = [*(c[order][keep] for c in (t1, first, size)), kind[keep], trigger[order][keep]]
            kept = [np.concatenate(c) for c in zip(kept, asked, strict=True)]
        yield from _packed(kept, _REPLY_KINDS, _REPLY_NAMES, _range_of(mix(kept[0].view(U64)), parts), parts)

    return run


_ASKED = "t1 long, full binary, spell binary, hot binary"
_SPELL = np.dtype([("first", "<u4"), ("size", "u1"), ("kind", "u1"), ("trigger", "<u8")])


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a text: windows known to be repeated, phrases to spell out, phrases whose windows to hash."""
    t1, first, size, kind, trigger = _gathered(batches, _REPLY_NAMES, _REPLY_KINDS)
    # of equal occurrences in copies of a text, the one that asks for most
    order = np.lexsort((-kind.astype(int), first, t1))
    t1, first, size, kind, trigger = (c[order] for c in (t1, first, size, kind, trigger))
    if not len(t1):
        return
    new = np.ones(len(t1), bool)
    new[1:] = (t1[1:] != t1[:-1]) | (first[1:] != first[:-1])
    t1, first, size, kind, trigger = (c[new] for c in (t1, first, size, kind, trigger))
    spell = np.empty(len(t1), _SPELL)
    for name, c in zip(_SPELL.names, (first, size, kind, trigger), strict=True):
        spell[name] = c
    cut = np.append(np.flatnonzero(np.concatenate([[True], t1[1:] != t1[:-1]])), len(t1))
    rows = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        k = kind[a:b]
        full = np.stack([first[a:b], first[a:b] + size[a:b]], 1)[(k == _FULL) | (k == _SPELT) | (k == _HOT_FULL)].astype("<u4")
        rows.append((t1[a], full.tobytes(), spell[a:b][(k == _OPEN) | (k == _SPELT)].tobytes(), spell[a:b][k >= _HOT].tobytes()))
        if len(rows) == 2048:
            yield _rows(rows, _ASKED)
            rows = []
    if rows:
        yield _rows(rows, _ASKED)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [f for f, _ in fields])


_DICTIONARY = "trigger long, t1 long, first long, kind int, bytes binary"


def _spelt(length: int):
    """Bytes of the phrases that the dictionary asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t1, text, spell in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                for first, size, kind, trigger in np.frombuffer(spell, _SPELL).tolist():
                    rows.append((trigger - (1 << 64) if trigger >> 63 else trigger, t1, first, kind, bytes(raw[first : first + size + length - 1])))
                if len(rows) > 4096:
                    yield _rows(rows, _DICTIONARY)
                    rows = []
            if rows:
                yield _rows(rows, _DICTIONARY)

    return run


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix of ``text`` by its first ``depth`` bytes, by prefix doubling; equal prefixes share a rank.

    Bytes beyond the end count as less than all others.
    """
    n = len(text)
    full = np.concatenate([text.astype(np.int64) + 1, np.zeros(7, np.int64)])
    packed, have = np.zeros(n, U64), min(7, depth)
    for j in range(have):  # 9 bits a byte, so that the end differs from byte 0
        packed = (packed << U64(9)) | full[j : n + j].astype(U64)
    rank = _ranked(packed)
    while have < depth:
        step = min(have, depth - have)
        # a prefix of have + step bytes: that of this suffix and that of the suffix step bytes on
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = _ranked((rank.astype(U64) << U64(32)) | after.astype(U64))
        have += step
    return rank


def _ranked(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    s = keys[order]
    new = np.zeros(len(s), np.int64)
    new[1:] = s[1:] != s[:-1]
    out = np.empty(len(s), np.int64)
    out[order] = np.cumsum(new)
    return out


def corpus_places(spellings: list[bytes], times: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each phrase, the places of the corpus where its string starts.

    Equal suffixes of the dictionary are one run of the corpus's order; the run is as long as
    the parse's intervals of their phrases (``times``) together.
    """
    sizes = np.array([len(s) for s in spellings])
    ranks = suffix_ranks(np.frombuffer(b"".join(spellings), np.uint8), length)
    begins = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    p = np.arange(windows.sum()) + np.repeat(begins - (np.cumsum(windows) - windows), windows)
    r = ranks[p]
    places = np.bincount(r, np.repeat(times, windows), minlength=1).astype(np.int64)[r]
    return np.split(places, np.cumsum(windows)[:-1])


def _sorted_dictionary(parts: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["trigger"]):
            t1, first, kind = (table.column(c).to_numpy() for c in ("t1", "first", "kind"))
            spellings = table.column("bytes").to_pylist()
            total = np.concatenate([[0], np.cumsum([len(s) for s in spellings])])[at]
            lo = 0
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            while lo < len(at) - 1:
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + SORTED, "right")) - 1)
                rows = np.arange(at[lo], at[hi])
                times = np.where(kind[rows] == _OPEN, 1, 2)
                for i, places in zip(rows, corpus_places([spellings[i] for i in rows], times, length), strict=True):
                    many = places > 1
                    if kind[i] == _OPEN and many.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], many.view(np.int8), [0]])))
                        out.append((np.full(len(edge) // 2, t1[i]), first[i] + edge[::2], edge[1::2] - edge[::2]))
                lo = hi
            if out:
                t, f, s = (np.concatenate(c) for c in zip(*out, strict=True))
                yield from _found(t, f, s, parts)

    return run


def _found(t1: np.ndarray, first: np.ndarray, size: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    none = np.zeros(len(t1))
    yield from _packed([t1, first, size, none, none], _REPLY_KINDS, _REPLY_NAMES, _range_of(mix(t1.view(U64)), parts), parts)


def _send_windows(parts: int, length: int):
    """The windows of phrases with hot triggers, as phrases of one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for batch in batches:
            for t1, text, hot in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                for first, size, _, trigger in np.frombuffer(hot, _SPELL).tolist():
                    sums = _sums(raw[first : first + size + length - 1])
                    starts = np.arange(size)
                    h = _spans(sums, starts, starts + length)
                    held.append((mix(h ^ U64(trigger)), h, np.full(size, t1), first + starts, np.ones(size, np.int64)))
                    n += size
                if n >= FLUSH:
                    yield from _deal([np.concatenate(c) for c in zip(*held, strict=True)], parts)
                    held, n = [], 0
        if held:
            yield from _deal([np.concatenate(c) for c in zip(*held, strict=True)], parts)

    return run


_COVERED = "t1 long, found binary"


def _found_by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t1, first, size, kind = _gathered(batches, _REPLY_NAMES[:4], _REPLY_KINDS[:4])
    t1, first, size = (c[(kind == _FULL) | (kind == _SPELT)] for c in (t1, first, size))
    order = np.lexsort((first, t1))
    t1, first, size = t1[order], first[order], size[order]
    if not len(t1):
        return
    span = np.stack([first, first + size], 1).astype("<u4")
    cut = np.append(np.flatnonzero(np.concatenate([[True], t1[1:] != t1[:-1]])), len(t1))
    yield _rows([(t1[a], span[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)], _COVERED)


_CUT = "t1 long, n_removed long, n_spans long, kept_sha256 string, kept string"


def removed_spans(windows: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Maximal byte spans [start, end) that runs of windows [first, last) cover."""
    if not len(windows):
        return np.zeros((0, 2), np.int64)
    w = windows[np.argsort(windows[:, 0], kind="stable")].astype(np.int64)
    end = np.maximum.accumulate(w[:, 1] + length - 1)
    new = np.concatenate([[True], w[1:, 0] > end[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(w) - 1)
    return np.stack([w[new, 0], end[last]], 1)


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t1, text, full, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                windows = np.frombuffer((full or b"") + (found or b""), "<u4").reshape(-1, 2)
                if not len(windows):
                    continue
                raw = memoryview(text.as_buffer())
                spans = removed_spans(windows, length)
                sha, kept, at = hashlib.sha256(), [], 0
                for a, b in [*spans.tolist(), [len(raw), len(raw)]]:
                    sha.update(raw[at:a])
                    if with_text:
                        kept.append(bytes(raw[at:a]))
                    at = b
                rows.append((t1, int((spans[:, 1] - spans[:, 0]).sum()), len(spans), sha.hexdigest(), b"".join(kept).decode("utf-8", "ignore") if with_text else None))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(c[4], pa.string())], [f.split()[0] for f in _CUT.split(", ")])

    return run


def suffix_dedup(docs: DataFrame, *, text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """Add n_bytes, n_removed, n_spans, kept_sha256 (and kept) to ``docs``.

    Each byte of a text's UTF-8 form that a string of ``length`` bytes covers which also
    starts anywhere else, in the same text or another, is removed; strings are judged on
    the input.  With ``with_text``, ``kept`` holds the text that is left, without the
    rest of characters that a cut fell into.

    Texts are known by a 64-bit hash; copies of a text are cut once.  Null and empty texts
    have 0 bytes and nothing removed (``kept`` of a null text is null); repeated rows are
    copies of each other; an empty table gives an empty one.  A very long text is looked at
    PIECE windows at a time.  Columns of ``docs`` with the names made here are replaced, all
    others stay, whatever their names.
    """
    if not 0 < length - gram <= 255 or gram < 1:
        raise ValueError("gram must be from length - 255 to length - 1")
    spark = docs.sparkSession
    parts = partitions(spark)
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    docs, names = apart(docs)
    bare = F.col(names[text]).cast("string")
    t = F.coalesce(bare, F.lit(""))
    rows = docs.select(F.xxhash64(t).alias("t1"), t.alias("text")).where(F.octet_length("text") >= length)
    parse = rows.mapInArrow(frugal(_send(parts, length, gram)), _SENT).repartitionById(parts, "part").mapInArrow(frugal(_match(parts, hot)), _REPLY)
    asked = stored(parse.repartitionById(parts, "part").mapInArrow(frugal(_by_text), _ASKED), "dedup-parse")

    maybe = parted(rows, asked.select("t1"), "t1", MOST_BLOCKS)[1]
    texts = maybe.dropDuplicates(["t1"]).join(asked, "t1")
    spelt = texts.where(F.octet_length("spell") > 0).select("t1", "text", "spell").mapInArrow(frugal(_spelt(length)), _DICTIONARY)
    dictionary = spelt.repartition(parts, "trigger").sortWithinPartitions("trigger").mapInArrow(frugal(_sorted_dictionary(parts, length)), _REPLY)
    windows = texts.where(F.octet_length("hot") > 0).select("t1", "text", "hot").mapInArrow(frugal(_send_windows(parts, length)), _SENT)
    windows = windows.repartitionById(parts, "part").mapInArrow(frugal(_match(parts, hot)), _REPLY)
    found = dictionary.union(windows).repartitionById(parts, "part").mapInArrow(frugal(_found_by_text), _COVERED)
    cut = texts.join(found, "t1", "left").select("t1", "text", "full", "found").mapInArrow(frugal(_cut(length, with_text)), _CUT)
    cut = stored(cut, "dedup-cut").withColumnsRenamed({c.split()[0]: f"_{c.split()[0]}" for c in _CUT.split(", ")})

    out = docs.withColumn("_t1", F.xxhash64(t)).withColumn("n_bytes", F.octet_length(t).cast("long")).withColumn("_sha", F.sha2(t.cast("binary"), 256))
    sure, others = parted(out, cut.select("_t1"), "_t1", MOST_BLOCKS)
    out = others.join(cut, "_t1", "left").unionByName(sure, allowMissingColumns=True)
    none = F.lit(0).cast("long")
    out = out.withColumn("n_removed", F.coalesce("_n_removed", none)).withColumn("n_spans", F.coalesce("_n_spans", none)).withColumn("kept_sha256", F.coalesce("_kept_sha256", "_sha"))
    if with_text:
        out = out.withColumn("kept", F.coalesce("_kept", bare))
    return out.select(*[F.col(c).alias(name) for name, c in names.items() if name not in made], *made)


def cut_documents(docs: DataFrame, *, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with what suffix_dedup() keeps of each text; n_chars, where there is one, follows.

    All columns stay, whatever their names; null texts stay null.  See suffix_dedup() for
    empty texts, repeated rows and empty tables.
    """
    docs, names = apart(docs)
    out = suffix_dedup(docs, text=names[text], length=length, with_text=True).withColumn(names[text], F.col("kept"))
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.char_length(names[text]).cast(docs.schema[names["n_chars"]].dataType))
    return out.select(*[F.col(c).alias(name) for name, c in names.items()])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
