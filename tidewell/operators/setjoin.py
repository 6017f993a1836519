"""Sets of words as short codes, and the kernel that compares blocks of them."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.sources.shared import stored

#: Sets of a block, sets that are indexed together in it; words with a code of their own; codes that all other words share by hash.
BLOCK, CHUNK, KNOWN, SHARED = 1 << 15, 1 << 12, (1 << 16) - (1 << 12), 1 << 12
#: Tasks that a few large groups are cut into at least, and sets that a block then has at least.
TASKS, LEAST = 36, 1 << 11
#: Sets that the order of words is taken from.
SAMPLED = 20_000
#: What a set is sent as: its size, sorted two-byte codes of its known words and hashes of the others.
SET = "n int, codes binary, rare binary"

Needs = Callable[[np.ndarray], np.ndarray]


def known_words(sets: DataFrame, count: int) -> np.ndarray:
    """Hashes of the most frequent words, the rarest first, as about SAMPLED of ``count`` sets (id, words) have them.

    They only decide in which order words are looked at, so no result hangs on the sample.
    """
    some = sets.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, count // SAMPLED))) == 0)
    top = some.select(F.explode(_hashes()).alias("h")).groupBy("h").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "h").limit(KNOWN).toPandas()
    return top["h"].to_numpy(np.int64)[::-1].copy()


def _hashes() -> Column:
    return F.transform("words", lambda w: F.xxhash64(w))


def encoded(sets: DataFrame, by: list[str], known: np.ndarray, *, once: bool = False) -> DataFrame:
    """``by``, id, the ``name`` if there is one, and SET of the sets (id, words) that have words.

    ``once``: rows of a group with one id hold the same set, and a task sends it again only
    under a lesser name, so that copies aren't shuffled; those of several tasks are left to only().
    """
    order = np.argsort(known, kind="stable")
    ascending, code = known[order], (order + SHARED).astype(np.int64)
    fields = [sets.schema[c] for c in [*by, "id", "name"] if c in sets.columns]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[tuple, object] = {}
        for batch in batches:
            if once:
                batch = batch.take(pa.array(_fresh(batch, len(by) + 1, sent), pa.int64()))  # noqa: PLW2901
            lists = batch.column(len(fields))
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            if len(ascending):
                at = np.minimum(np.searchsorted(ascending, h), len(ascending) - 1)
                has = ascending[at] == h
                codes = np.sort(row[has] << 16 | code[at[has]])
            else:
                has, codes = np.zeros(len(h), bool), np.zeros(0, np.int64)
            packed = [_binary((codes & 0xFFFF).astype("<u2"), codes >> 16, len(n)), _binary(h[~has].astype("<i8"), row[~has], len(n))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array(n.astype(np.int32)), *packed], names=[*batch.schema.names[: len(fields)], "n", "codes", "rare"])

    have = sets.where(F.size("words") > 0)
    for c in by:
        have = have.where(F.col(c).isNotNull())
    return have.select(*[f.name for f in fields], _hashes().alias("h")).mapInArrow(encode, StructType([*fields, *StructType.fromDDL(SET).fields]))


def _fresh(batch: pa.RecordBatch, keys: int, sent: dict[tuple, object]) -> list[int]:
    """Rows of a batch that tell more than ``sent``, which has the least name of each key so far: the best row of a key that is new or has a lesser name."""
    names = batch.column("name").to_pylist() if "name" in batch.schema.names else [None] * len(batch)
    rows: dict[tuple, int] = {}
    for row, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True)):
        if key not in sent or names[row] is not None and (sent[key] is None or names[row] < sent[key]):
            sent[key], rows[key] = names[row], row
    return sorted(rows.values())


def only(block: pd.DataFrame) -> pd.DataFrame:
    """One row of each group and id, the one of the least name if there are names."""
    if "name" in block:
        block = block.sort_values("name", kind="stable")
    return block.drop_duplicates(["group", "id"], ignore_index=True)


def _binary(values: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """The values of each row, which stand together, as bytes."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def met(left: DataFrame, right: DataFrame, by: list[str], sizes: DataFrame, keep: Callable, need: Needs, reach: Callable, *, once: bool = False) -> DataFrame:
    """(by, a, b, inter, na, nb) of the encoded sets of a group that ``keep`` takes, given inter, na, nb and both ids; ``once``: each id counts once.

    A pair that counts has at least ``need(na)`` words in common, and nb is from one to the
    other of the two numbers that ``reach(na)`` gives.  Groups are cut into blocks
    of about BLOCK sets by ``sizes`` (by, blocks_a, blocks_b), and each block of the one side
    meets each of the other in a task that holds these two.
    """
    group = [left.schema[c] for c in by]
    ids = [left.schema["id"].dataType, right.schema["id"].dataType]
    schema = StructType(group).add("a", ids[0]).add("b", ids[1]).add("inter", "integer").add("na", "integer").add("nb", "integer")

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if once:
            one, two = only(one), only(two)
        got = _compare(one, two, keep, need, reach)
        return _frame(one, got.pop("at", []), by, got, schema)

    return together(*dealt(left, right, by, sizes), [*by, "block_a", "block_b"], compare, schema)


def _frame(one: pd.DataFrame, at: np.ndarray | list[int], by: list[str], got: dict, schema: StructType) -> pd.DataFrame:
    """What was found for the left sets at the places ``at``, with their groups."""
    return pd.DataFrame({**{c: one[c].to_numpy()[at] for c in by}, **got}) if got else pd.DataFrame(columns=schema.names, dtype=object)


def whole(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches as frames of whole groups, which ``group`` numbers: many of a few rows together, so that none costs a call of its own, and a large one as it is."""
    held: list[pd.DataFrame] = []

    def numbered() -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        held.clear()
        new = np.zeros(len(rows), bool)
        for c in by:
            values = rows[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return rows.assign(group=np.cumsum(new))

    for batch in filter(len, batches):
        other = np.zeros(len(batch), bool)
        for c in by:
            other |= batch[c].to_numpy() != batch[c].iloc[-1]
        begin = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if begin:
            held.append(batch[:begin])
        if held and (begin or any(held[-1][c].iloc[-1] != batch[c].iloc[-1] for c in by)):
            yield numbered()
        held.append(batch[begin:])
    if held:
        yield numbered()


def together(a: DataFrame, b: DataFrame, keys: list[str], compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: StructType) -> DataFrame:
    """``compare`` of the rows of both sides in frames of whole groups by ``keys``, with ``group``; a frame that one side has no row of is passed over."""
    sides = [a.columns, b.columns]
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)), allowMissingColumns=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in whole(batches, keys):
            one, two = (rows.loc[rows["side"] == i, [*columns, "group"]].reset_index(drop=True) for i, columns in enumerate(sides))
            if len(one) and len(two):
                yield compare(one, two)

    return both.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def met_least(left: DataFrame, right: DataFrame, by: list[str], sizes: DataFrame, keep: Callable, need: Needs, reach: Callable) -> DataFrame:
    """(by, a, least): the least ``name`` of the right sets that met() would pair with a left one, each id once, whose pairs are not listed."""
    schema = StructType([left.schema[c] for c in by]).add("a", left.schema["id"].dataType).add("least", right.schema["name"].dataType)

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        one, two = only(one), only(two)
        rank = two["n"].argsort(kind="stable").to_numpy()  # place by name of the set at each place by size
        best = np.full(len(one), len(two))
        for i, _, _, hits, _ in _hits(one, two, keep, need, reach):
            best[i] = min(best[i], rank[hits].min())
        some = np.flatnonzero(best < len(two))
        got = {"a": one["id"].to_numpy()[some], "least": two["name"].to_numpy()[best[some]]} if len(some) else {}
        return _frame(one, some, by, got, schema)

    out = together(*dealt(left, right, by, sizes), [*by, "block_a", "block_b"], compare, schema)
    return out.groupBy(*by, "a").agg(F.min("least").alias("least"))


def met_lists(left: DataFrame, right: DataFrame, by: list[str], sizes: DataFrame, keep: Callable, need: Needs, reach: Callable) -> DataFrame:
    """(by, a, found): the right sets that met() would pair with a left one, of each block of theirs packed in one value; see listed().  Their ids are numbers from 0."""
    schema = StructType([left.schema[c] for c in by]).add("a", left.schema["id"].dataType).add("found", "binary")

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        own: dict[int, list[np.ndarray]] = {}
        for i, _, right, hits, _ in _hits(one, two, keep, need, reach):
            own.setdefault(i, []).append(right.ids[hits])
        got = {"a": one["id"].to_numpy()[list(own)], "found": [packed(np.concatenate(x)) for x in own.values()]} if own else {}
        return _frame(one, list(own), by, got, schema)

    return together(*dealt(left, right, by, sizes), [*by, "block_a", "block_b"], compare, schema)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as steps from one to the next, compressed, so that many of a few numbers cost less than a byte each."""
    return zlib.compress(np.diff(np.sort(numbers), prepend=0).astype("<u4").tobytes(), 1)


def listed(found: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(found), "<u4").astype(np.int64))


def dealt(left: DataFrame, right: DataFrame, by: list[str], sizes: DataFrame, *, same: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides with block_a and block_b, a row for each task that it is in; of two blocks of the ``same`` table the smaller number is a's."""
    sized = lambda x: x.join(sizes, by) if by else x.crossJoin(F.broadcast(sizes))
    own = lambda s: F.pmod(F.xxhash64("id"), F.col(f"blocks_{s}")).cast("int").alias(f"block_{s}")
    every = lambda s, low, high: F.explode(F.sequence(low, high)).alias(f"block_{s}")
    last = lambda s: F.col(f"blocks_{s}") - 1
    a = sized(left).select("*", own("a")).select("*", every("b", F.col("block_a") if same else F.lit(0), last("b")))
    b = sized(right).select("*", own("b")).select("*", every("a", F.lit(0), F.col("block_b") if same else last("a")))
    fresh = lambda x: x.select(*[F.col(c).alias(c) for c in x.columns if not c.startswith("blocks_")])
    return fresh(a), fresh(b)


class _Sets:
    """The codes and hashes of a block's sets, each in one array, where the sets begin, and a number that sets the codes of their group apart."""

    def __init__(self, frame: pd.DataFrame) -> None:
        self.ids, self.n = frame["id"].to_numpy(), frame["n"].to_numpy(np.int64)
        self.codes, self.codes_at = self._joined(frame["codes"], "<u2")
        self.rare, self.rare_at = self._joined(frame["rare"], "<i8")
        self.shared = (self.rare & (SHARED - 1)).astype(np.uint16)
        self.group = frame["group"].to_numpy(np.int64)
        self.apart = (self.group * 40503).astype(np.uint16)

    @staticmethod
    def _joined(column: pd.Series, kind: str) -> tuple[np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, column), np.int64, len(column)) // np.dtype(kind).itemsize
        return np.frombuffer(b"".join(column), kind), np.concatenate([[0], np.cumsum(size)])

    def inverted(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of sets, counted from ``begin``, by code, and where each code's places begin."""
        spans = [(at[begin : end + 1], values) for at, values in ((self.rare_at, self.shared), (self.codes_at, self.codes))]
        tokens = np.concatenate([values[at[0] : at[-1]] + np.repeat(self.apart[begin:end], np.diff(at)) for at, values in spans])
        docs = np.concatenate([np.repeat(np.arange(end - begin, dtype=np.int32), np.diff(at)) for at, _ in spans])
        return docs[np.argsort(tokens, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=1 << 16))])

    def of(self, values: np.ndarray, at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of some sets, and the place in ``some`` that each belongs to."""
        parts = [values[at[i] : at[i + 1]] for i in some]
        return np.concatenate(parts), np.repeat(np.arange(len(some)), at[some + 1] - at[some])


def _hits(one: pd.DataFrame, two: pd.DataFrame, keep: Callable, need: Needs, reach: Callable) -> Iterator[tuple[int, _Sets, _Sets, np.ndarray, np.ndarray]]:
    """Place of a left set, both blocks, places by size of right sets that ``keep`` takes with it, and the words in common; a left set may come several times.

    Of a set of n words, of which ``need`` are to be common, the n - need + k rarest hold at
    least k common ones.  These are counted over inverted indexes of the other block's sets,
    CHUNK of them in order of size so that sets out of reach are passed over; words without
    a code count as common if their shared codes are, so no pair is lost; what is left is
    compared word by word.  A block may hold several groups, whose codes are shifted apart.
    """
    left, right = _Sets(one), _Sets(two.sort_values("n", kind="stable"))
    needs = np.maximum(1, need(left.n))
    low, high = reach(left.n)
    marked = np.zeros(1 << 16, bool)
    for begin in range(0, len(right.n), CHUNK):
        end = min(begin + CHUNK, len(right.n))
        docs, starts = right.inverted(begin, end)
        for i in np.flatnonzero((needs <= left.n) & (low <= right.n[end - 1]) & (high >= right.n[begin])):
            k = 1 + int(needs[i]) // 6
            prefix = int(left.n[i] - needs[i]) + k
            own, rare = left.codes[left.codes_at[i] : left.codes_at[i + 1]], left.rare[left.rare_at[i] : left.rare_at[i + 1]]
            first = np.concatenate([left.shared[left.rare_at[i] : left.rare_at[i + 1]], own])[:prefix] + left.apart[i]
            first = first.astype(np.int64)
            found = [docs[s:e] for s, e in zip(starts[first].tolist(), starts[first + 1].tolist(), strict=True) if s < e]
            if not found:
                continue
            hits = np.flatnonzero(np.bincount(np.concatenate(found), minlength=end - begin) >= k) + begin
            hits = hits[right.group[hits] == left.group[i]]
            if not len(hits):
                continue
            marked[own] = True
            values, at = right.of(right.codes, right.codes_at, hits)
            inter = np.bincount(at[marked[values]], minlength=len(hits))
            marked[own] = False
            values, at = right.of(right.rare, right.rare_at, hits)
            inter += np.bincount(at[np.isin(values, rare)], minlength=len(hits))
            fine = keep(inter, left.n[i], right.n[hits], left.ids[i], right.ids[hits])
            if fine.any():
                yield int(i), left, right, hits[fine], inter[fine]


def _compare(one: pd.DataFrame, two: pd.DataFrame, keep: Callable, need: Needs, reach: Callable) -> dict[str, np.ndarray]:
    """All pairs of two blocks that ``keep`` takes, with the left set's place."""
    out: dict[str, list] = {c: [] for c in ("at", "a", "b", "inter", "na", "nb")}
    for i, left, right, hits, inter in _hits(one, two, keep, need, reach):
        for c, v in (("at", np.full(len(hits), i)), ("a", np.repeat(left.ids[i : i + 1], len(hits))), ("b", right.ids[hits]), ("inter", inter), ("na", np.repeat(left.n[i], len(hits))), ("nb", right.n[hits])):
            out[c].append(v)
    return {c: np.concatenate(v) for c, v in out.items() if v}


def blocks_of(left: DataFrame, right: DataFrame, by: list[str], block: int | None = None, groups: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(by, blocks_a, blocks_b) of the groups that both sides, and ``groups`` if there are any, have, and how many rows the right side has then."""
    count = lambda x, c: x.groupBy(*by).agg(F.count("*").alias(c)) if by else x.agg(F.count("*").alias(c))
    a, b = count(left, "sets_a"), count(right, "sets_b")
    both = (a.join(b, by) if by else a.crossJoin(b)).where("sets_a > 0 and sets_b > 0")
    both = stored(both if groups is None else both.join(groups, by, "left_semi"), "set-blocks")
    total, groups = both.agg(F.coalesce(F.sum("sets_b"), F.lit(0)), F.count("*")).first()
    parts = math.ceil(math.sqrt(TASKS / max(1, groups)))
    size = [F.greatest(F.ceil(F.col(f"sets_{s}") / (block or BLOCK)), F.least(F.lit(parts), F.ceil(F.col(f"sets_{s}") / LEAST))).cast("int").alias(f"blocks_{s}") for s in "ab"]
    return both.select(*by, *size), total
