"""N-gram Jaccard join by count vectors in an R-tree, and the components that its links make.

A document's set holds the 64-bit hashes of its distinct word n-grams.  Four steps:

1. One pass over the text sends half of every set, by hash, to ranges of hashes, packed
   in arrays.  A range knows which of its hashes two different sets have.  A set with too
   many hashes of its own cannot reach the threshold with any other; it is done.
2. The sets that are left are sent whole in the same way, and get back how many sets have
   each hash.  In the order of that count, rarest first, two linked sets share a hash
   among the first few of each (the prefix bound), so passages that many documents share
   bring nobody together.
3. Sets that share such a hash are candidates.  First each set is held against the pivot
   that it meets most often; verified links give components, so that a group of near
   copies costs one test a copy, not one a pair.  Then, where a hash still joins different
   components, the sets' count vectors are packed into an R-tree: hashes fall into groups,
   a vector has the count of each group, a node the greatest counts and the least size
   below it, and the sum of coordinate minima bounds the overlap.  Pairs that survive the
   bound go on.
4. Surviving pairs are verified on the sets themselves.

That gives components, and links enough to join them.  Where every link is asked for, the
sets of a component then meet all others of it: the component is cut into blocks, each two
blocks meet in a cell, and there an R-tree of one label a set and the sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import U64, apart, chunks, component_table, frugal, lowered, mix, partitions, span_hashes, stored, whole_groups, word_spans
from tidewell.llm.url_filters import parted

#: Words of a shingle; Jaccard similarity as a fraction.
WORDS, SIMILARITY = 5, (3, 4)
#: Hashes that a task gathers before it deals them out, children of an R-tree node, and rows of a block of a hot hash.
FLUSH, FANOUT, BLOCK = 1 << 21, 16, 2048
#: Times that sets are held against pivots before all that is left is.
TURNS = 2
#: Hashes of a block of a component whose links are all asked for.
BLOCK_HASHES = 1 << 20
#: Words of the Bloom filter at most, 64 bits each.
MOST_BLOCKS = 1 << 20

_M = U64(0x9E3779B97F4A7C15)


def shingle_sets(raw: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text end to end, and len+1 offsets.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    raw = lowered(raw)
    starts, ends = word_spans(raw, off)
    w = span_hashes(raw, starts, ends)
    at = np.searchsorted(starts, off)  # words before each text
    n = np.diff(at)
    m = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(m)])
    first = np.repeat(at[:-1] - bounds[:-1], m) + np.arange(bounds[-1])
    length = np.repeat(np.minimum(n, words), m)
    sums = np.zeros(len(first), U64)
    for j in range(words):
        there = length > j
        sums[there] = sums[there] * _M + w[first[there] + j]
    out = mix(sums + length.astype(U64))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][m > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def set_ids(keys: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set, 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(keys ^ _M), dtype=U64)])
    n = np.diff(off)
    out = mix(sums[off[1:]] - sums[off[:-1]] + n.astype(U64) * _M)
    out[n == 0] = 0
    return out.view(np.int64)


def _range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> U64(48)) * U64(parts) >> U64(16)).astype(np.uint32 if parts > 65535 else np.uint16)


def _narrow(own: np.ndarray, n: int) -> np.ndarray:
    return own.astype(np.uint16 if n <= 65536 else np.uint32)


def _pack(keys: np.ndarray, own: np.ndarray, ids: np.ndarray, at: np.ndarray, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(range, keys, number of its set for each key, ids of sets) by ascending range; keys go by ``at``."""
    order = np.argsort(at, kind="stable")
    keys, own = keys[order], own[order]
    cuts = np.searchsorted(at[order], np.arange(parts + 1))
    for p in range(parts):
        k, o = keys[cuts[p] : cuts[p + 1]], own[cuts[p] : cuts[p + 1]]
        if not len(k):
            continue
        if len(k) < len(ids):
            used, o = np.unique(o, return_inverse=True)
            yield p, k.tobytes(), _narrow(o, len(used)).tobytes(), ids[used].tobytes()
        else:
            yield p, k.tobytes(), _narrow(o, len(ids)).tobytes(), ids.tobytes()


def _unpack(batch: pa.RecordBatch | pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the rows and the id of the set of each."""
    keys, owners = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for k, o, t in zip(*(batch.column(c).to_pylist() for c in ("keys", "own", "ids")), strict=True):
        if k is None:
            continue
        k, t = np.frombuffer(k, kind), np.frombuffer(t, np.int64)
        keys.append(k)
        owners.append(t[np.frombuffer(o, np.uint16 if len(o) == 2 * len(k) else np.uint32)])
    return np.concatenate(keys), np.concatenate(owners)


def _shared(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, id) pairs by key, and how many ids have the key."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, ids = keys[new], ids[new]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    n = np.diff(np.append(cut, len(keys)))
    return keys, ids, np.repeat(n, n)


_SENT = "part int, keys binary, own binary, ids binary, doc_ids array<bigint>, t1 array<bigint>, t2 array<bigint>, sid array<bigint>, n array<bigint>, n_half array<bigint>"
_FIRST = "sid long, n_shared long, doc_id long, t1 long, t2 long, n long, n_half long, is_doc boolean"
_COLUMNS = ["doc_ids", "t1", "t2", "sid", "n", "n_half"]


def _half(keys: np.ndarray) -> np.ndarray:
    return (keys >> U64(40)) & U64(1) == 0


def _send(parts: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            docs = pa.concat_tables([h[0] for h in held])
            keys, n, n_half = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            sid = np.concatenate([h[4] for h in held])
            own = np.repeat(np.arange(len(n_half)), n_half)
            home = _range_of(mix(sid.view(U64)), parts)
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(parts + 1))
            docs = docs.take(order)
            columns = [docs.column(i).combine_chunks() for i in range(3)] + [pa.array(x[order].astype(np.int64)) for x in (sid, n, n_half)]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            packed = {p: x for p, *x in _pack((keys & U64(0xFFFFFFFF)).astype(np.uint32), own, sid, _range_of(keys, parts), parts)}
            for p in range(parts):
                if p not in packed and cuts[p] == cuts[p + 1]:
                    continue
                blobs = [pa.array([x], pa.binary()) for x in packed.get(p, (None, None, None))]
                lists = [pa.ListArray.from_arrays(pa.array([0, cuts[p + 1] - cuts[p]], pa.int32()), c.slice(cuts[p], cuts[p + 1] - cuts[p])) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *blobs, *lists], ["part", "keys", "own", "ids", *_COLUMNS])

        for batch, raw, off in chunks(batches):
            keys, bounds = shingle_sets(raw, off, words)
            half = _half(keys)
            n_half = np.concatenate([[0], np.cumsum(half)])[bounds]
            held.append((pa.Table.from_batches([batch.select(["doc_id", "t1", "t2"])]), keys[half], np.diff(bounds), np.diff(n_half), set_ids(keys, bounds)))
            size += int(half.sum()) + batch.num_rows
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set, how many of its hashes in this range other sets have; and the documents' rows."""
    held = []
    empty = lambda n, kind=pa.int64(): pa.nulls(n, kind)
    for batch in batches:
        held.append(batch.select(["keys", "own", "ids"]))
        flat = [batch.column(batch.schema.get_field_index(c)).flatten() for c in _COLUMNS]
        if n := len(flat[0]):
            yield pa.RecordBatch.from_arrays([flat[3], empty(n), flat[0], flat[1], flat[2], flat[4], flat[5], pa.array(np.ones(n, bool))], [f.split()[0] for f in _FIRST.split(", ")])
    if not held:
        return
    keys, ids = _unpack(pa.Table.from_batches(held), "<u4")
    keys, ids, df = _shared(keys, ids)
    sid, n = np.unique(ids[df > 1], return_counts=True)
    if len(sid):
        yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(n.astype(np.int64)), *[empty(len(sid)) for _ in range(5)], pa.array(np.zeros(len(sid), bool))], [f.split()[0] for f in _FIRST.split(", ")])


_SETS = "part int, keys binary, own binary, ids binary, n binary"


def _send_sets(parts: int, words: int):
    """Whole sets to ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            keys, n = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            sid = np.concatenate([h[2] for h in held])
            sizes = dict(zip(sid.tolist(), n.tolist(), strict=True))
            for p, k, o, t in _pack(keys, np.repeat(np.arange(len(n)), n), sid, _range_of(keys, parts), parts):
                sizes_of = np.array([sizes[x] for x in np.frombuffer(t, np.int64).tolist()], np.uint32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([x], pa.binary()) for x in (k, o, t, sizes_of)]], [f.split()[0] for f in _SETS.split(", ")])

        for _, raw, off in chunks(batches):
            keys, bounds = shingle_sets(raw, off, words)
            held.append((keys, np.diff(bounds), set_ids(keys, bounds)))
            size += len(keys)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


_REPLY = "part int, ids binary, n binary, counts binary, keys binary, df binary"


def _reply(parts: int):
    """To each set, its hashes of this range that other sets have, with the number of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        sizes: dict[int, int] = {}
        for t, n in zip(table.column("ids").to_pylist(), table.column("n").to_pylist(), strict=True):
            sizes.update(zip(np.frombuffer(t, np.int64).tolist(), np.frombuffer(n, np.uint32).tolist(), strict=True))
        keys, ids, df = _shared(*_unpack(table, "<u8"))
        keep = df > 1
        keys, ids, df = keys[keep], ids[keep], df[keep]
        to = _range_of(mix(ids.view(U64)), parts)
        order = np.lexsort((keys, ids, to))
        keys, ids, df, to = keys[order], ids[order], df[order], to[order]
        cuts = np.searchsorted(to, np.arange(parts + 1))
        for p in range(parts):
            a, b = cuts[p], cuts[p + 1]
            if a == b:
                continue
            sid, n = np.unique(ids[a:b], return_counts=True)
            row = [sid.tobytes(), np.array([sizes[x] for x in sid.tolist()], np.uint32).tobytes(), n.astype(np.uint32).tobytes(), keys[a:b].tobytes(), df[a:b].astype(np.uint32).tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([x], pa.binary()) for x in row]], [f.split()[0] for f in _REPLY.split(", ")])

    return run


_CANDIDATES = "sid long, n long, keys binary, lonely long, prefix array<bigint>, vector binary"


def groups_of(n: int) -> int:
    """Groups of a count vector for a set of n hashes: the next power of two, one hash a group or fewer."""
    return max(8, 1 << (n - 1).bit_length())


def count_vector(keys: np.ndarray, groups: int) -> np.ndarray:
    out = np.bincount((keys & U64(groups - 1)).astype(np.int64), minlength=groups)
    return out.astype(np.uint8 if out.max() < 128 else np.uint32)


def _vector(raw: bytes, n: int) -> np.ndarray:
    """A stored vector; it has groups_of(n) counts of one byte or four, which a fold can't overflow."""
    return np.frombuffer(raw, np.uint8 if len(raw) == groups_of(int(n)) else np.uint32)


def _choose(similarity: tuple[int, int]):
    """Sets that may still reach the threshold, with their shared hashes, prefix and count vector."""
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        ids, sizes, counts, keys, df = ([np.frombuffer(x, k) for x in table.column(c).to_pylist()] for c, k in (("ids", np.int64), ("n", np.uint32), ("counts", np.uint32), ("keys", "<u8"), ("df", np.uint32)))
        own = np.concatenate([np.repeat(i, c) for i, c in zip(ids, counts, strict=True)])
        keys, df = np.concatenate(keys), np.concatenate(df)
        size = dict(zip(np.concatenate(ids).tolist(), np.concatenate(sizes).tolist(), strict=True))
        order = np.lexsort((keys, own))
        own, keys, df = own[order], keys[order], df[order]
        cut = np.append(np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])), len(own))
        rows: list[tuple] = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            sid, n = int(own[a]), size[int(own[a])]
            lonely = n - (b - a)
            p = n - -(-num * n // den) + 1 - lonely
            if p <= 0:
                continue
            k = keys[a:b]
            first = np.lexsort((k, df[a:b]))[:p]
            rows.append((sid, n, k.tobytes(), lonely, k[first].view(np.int64), count_vector(k, groups_of(n)).tobytes()))
            if len(rows) == 512:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    sid, n, keys, lonely, prefix, vector = zip(*rows, strict=True)
    cols = [pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(lonely, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(vector, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _CANDIDATES.split(", ")])


class RTree:
    """A packed R-tree of count vectors.

    Points stand by the coordinates that vary most, FANOUT to a node; a node keeps the
    greatest count of each group, the least set size and the only label below it, if any.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> None:
        self.order = self._packed(vectors)
        self.levels = [(vectors[self.order], sizes[self.order], labels[self.order], np.ones(len(sizes), bool))]
        while len(self.levels[-1][1]) > FANOUT:
            v, s, lab, one = self.levels[-1]
            at = np.arange(0, len(s), FANOUT)
            same = np.minimum.reduceat(lab, at) == np.maximum.reduceat(lab, at)
            self.levels.append((np.maximum.reduceat(v, at), np.minimum.reduceat(s, at), lab[at], same & np.logical_and.reduceat(one, at)))

    def _packed(self, v: np.ndarray) -> np.ndarray:
        todo, out = [np.arange(len(v))], []
        while todo:
            part = todo.pop()
            if len(part) <= FANOUT:
                out.append(part)
                continue
            c = int(np.argmax(np.var(v[part].astype(np.float32), axis=0)))
            part = part[np.argsort(v[part, c], kind="stable")]
            half = -(-(len(part) // 2) // FANOUT) * FANOUT
            todo += [part[half:], part[:half]]
        return np.concatenate(out) if out else np.zeros(0, int)

    def pairs(self, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
        """(i, j) with i < j, different labels and a bound on the overlap that reaches the threshold."""
        num, den = similarity
        v, s, labels, _ = self.levels[0]
        found = [np.zeros((0, 2), np.int64)]
        step = max(1, (1 << 22) // max(1, v.shape[1] * FANOUT))
        for lo in range(0, len(s), step):
            top = len(self.levels[-1][1])
            q = np.repeat(np.arange(lo, min(len(s), lo + step)), top)
            node = np.tile(np.arange(top), min(len(s), lo + step) - lo)
            for level in range(len(self.levels) - 1, -1, -1):
                nv, nsize, nlabel, one = self.levels[level]
                keep = ~(one[node] & (nlabel[node] == labels[q]))
                # what stands wholly before the query in the packed order meets it from there
                keep &= (node + 1) * FANOUT**level > q + (level == 0)
                q, node = q[keep], node[keep]
                ok = np.zeros(len(q), bool)
                for a in range(0, len(q), step * FANOUT):
                    b = slice(a, a + step * FANOUT)
                    bound = np.minimum(v[q[b]], nv[node[b]]).sum(1, dtype=np.int64)
                    ok[b] = (num + den) * bound >= num * (s[q[b]] + nsize[node[b]])
                q, node = q[ok], node[ok]
                if level:
                    child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    q = np.repeat(q, FANOUT)
                    there = child < len(self.levels[level - 1][1])
                    q, node = q[there], child[there]
            found.append(np.stack([self.order[q], self.order[node]], 1))
        out = np.sort(np.concatenate(found), axis=1)
        return np.unique(out[out[:, 0] != out[:, 1]], axis=0)


def tree_pairs(sizes: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """Pairs of rows that one R-tree for each number of groups lets through.

    Vectors are folded to a common number of groups by adding halves; a set meets those of
    its own number of groups and, since similar sets differ little in size, of the next.
    """
    width = np.array([len(v) for v in vectors])
    found = [np.zeros((0, 2), np.int64)]
    for g in np.unique(width):
        rows = np.flatnonzero((width == g) | (width == 2 * g))
        if len(rows) < 2:
            continue
        folded = np.stack([v if len(v) == g else v[:g] + v[g:] for v in (vectors[i] for i in rows)])
        found.append(rows[RTree(folded, sizes[rows], labels[rows]).pairs(similarity)])
    return np.unique(np.concatenate(found), axis=0)


def _may_begin(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Pairs whose first common hash may stand at these places: what comes before it is in one set only."""
    num, den = similarity
    need = -(-num * (n[i] + n[j]) // (num + den))
    return (at[i] <= n[i] - need) & (at[j] <= n[j] - need)


def _pairs_of_keys(similarity: tuple[int, int], with_vectors: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["key", "cell"]):
            sid, n, label, at = (table.column(c).to_numpy() for c in ("sid", "n", "label", "at"))
            raw = table.column("vector").to_pylist() if with_vectors else None
            size = np.diff(bounds)
            out = []
            if with_vectors:
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    if b - a > 1 and (label[a:b] != label[a]).any():
                        out.append(tree_pairs(n[a:b], label[a:b], [_vector(raw[i], n[i]) for i in range(a, b)], similarity) + a)
            else:
                for step in range(1, int(size.max(initial=1))):  # each row with the one ``step`` rows on in its group
                    left = np.arange(table.num_rows)[np.arange(table.num_rows) - np.repeat(bounds[:-1], size) + step < np.repeat(size, size)]
                    out.append(np.stack([left, left + step], 1))
            if not out:
                continue
            pairs = np.concatenate(out)
            i, j = pairs[:, 0], pairs[:, 1]
            pairs = pairs[(label[i] != label[j]) & (sid[i] != sid[j]) & _may_begin(n, at, i, j, similarity)]
            both = np.unique(np.sort(np.stack([sid[pairs[:, 0]], sid[pairs[:, 1]]], 1), axis=1), axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    return run


def _verify(similarity: tuple[int, int]):
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            overlap = np.array([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(c["ka"].to_pylist(), c["kb"].to_pylist(), strict=True)], np.int64)
            both = c["na"].to_numpy() + c["nb"].to_numpy()
            ok = (num + den) * overlap >= num * both
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(ok)) for x in (c["a"], c["b"])] + [pa.array(overlap[ok])], ["a", "b", "overlap"])

    return run


def overlaps(keys: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Number of common hashes of each pair of rows; the pairs stand by their first row."""
    n = np.array([len(k) for k in keys])
    off = np.concatenate([[0], np.cumsum(n)])
    used, number = np.unique(np.concatenate(keys), return_inverse=True)
    there = np.zeros(len(used), bool)
    out = np.zeros(len(pairs), np.int64)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])), len(pairs)) if len(pairs) else np.zeros(1, int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = number[off[pairs[a, 0]] : off[pairs[a, 0] + 1]]
        there[own] = True
        sums = np.concatenate([[0], np.cumsum(n[pairs[a:b, 1]])])
        at = np.repeat(off[pairs[a:b, 1]] - sums[:-1], n[pairs[a:b, 1]]) + np.arange(sums[-1])
        hits = np.concatenate([[0], np.cumsum(there[number[at]])])
        out[a:b] = hits[sums[1:]] - hits[sums[:-1]]
        there[own] = False
    return out


def _links_of_cells(similarity: tuple[int, int], counted: bool):
    """Links between the sets of each cell, or how many of them each set has; two sets meet in one cell only."""
    num, den = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["label", "cell"]):
            sid, n, block, alone = (table.column(c).to_numpy() for c in ("sid", "n", "block", "alone"))
            raw = table.column("keys")
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                label = np.arange(b - a) if alone[a] else block[a:b]
                if (label == label[0]).all():
                    continue
                keys = [np.frombuffer(x, "<u8") for x in raw.slice(a, b - a).to_pylist()]
                size = n[a:b]
                pairs = tree_pairs(size, label, [count_vector(k, groups_of(int(m))) for k, m in zip(keys, size, strict=True)], similarity)
                overlap = overlaps(keys, pairs)
                ok = (num + den) * overlap >= num * (size[pairs[:, 0]] + size[pairs[:, 1]])
                pairs, overlap = pairs[ok], overlap[ok]
                if not len(pairs):
                    continue
                if counted:
                    m = np.bincount(pairs.ravel(), minlength=b - a)
                    yield pa.RecordBatch.from_arrays([pa.array(sid[a:b][m > 0]), pa.array(m[m > 0].astype(np.int64))], ["sid", "n_links"])
                    continue
                both = np.sort(np.stack([sid[a + pairs[:, 0]], sid[a + pairs[:, 1]]], 1), axis=1)
                for lo in range(0, len(both), FLUSH):
                    yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + FLUSH].copy()) for x in (both[:, 0], both[:, 1], overlap)], ["a", "b", "overlap"])

    return run


def _every_link(sets: DataFrame, links: DataFrame, similarity: tuple[int, int], parts: int, counted: bool = False) -> DataFrame:
    """(a, b, overlap) of all linked sets, or (sid, n_links) of each that has links, from links that join the components."""
    labelled = sets.select("sid", "n", "keys").join(_components(links), "sid")
    weight = F.ceil(F.sum("n") / BLOCK_HASHES).cast("int")
    blocks = labelled.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / BLOCK).cast("int"), weight).alias("blocks"))
    mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    cut = labelled.join(blocks, "label").withColumn("block", mine)
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.greatest("block", "other").cast("long") * F.col("blocks") + F.least("block", "other")
    met = met.select("label", cell.alias("cell"), "block", (F.col("block") == F.col("other")).alias("alone"), "sid", "n", "keys")
    dealt = met.repartition(parts, "label", "cell").sortWithinPartitions("label", "cell")
    return dealt.mapInArrow(frugal(_links_of_cells(similarity, counted)), "sid long, n_links long" if counted else "a long, b long, overlap long")


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(a, b, overlap) of the pairs of sets that reach the threshold."""
    side = lambda x: sets.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("keys").alias(f"k{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ka", "kb").mapInArrow(frugal(_verify(similarity)), "a long, b long, overlap long")


def text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(11), text)


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (t1, t2, doc_id) ``wanted`` has: a Bloom filter of bounded size, then an exact join."""
    maybe = parted(docs, wanted.select("t1").distinct(), "t1", MOST_BLOCKS)[1]
    # an inner join: a semi join would be pushed below the filter
    w = wanted.select(F.col("t1").alias("_1"), F.col("t2").alias("_2"), F.col("doc_id").alias("_3"))
    return maybe.join(w, (F.col("t1") == F.col("_1")) & (F.col("t2") == F.col("_2")) & F.col("doc_id").eqNullSafe(F.col("_3"))).drop("_1", "_2", "_3")


def _star(met: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Verified links of each set with the one pivot that it meets most."""
    times = met.groupBy("sid", "pivot").agg(F.count("*").alias("m"))
    best = times.groupBy("sid").agg(F.max(F.struct("m", "pivot")).alias("x"))
    pairs = best.select(F.least("sid", "x.pivot").alias("a"), F.greatest("sid", "x.pivot").alias("b")).distinct()
    return verified(pairs, sets, similarity)


def _components(links: DataFrame) -> DataFrame:
    """(sid, label, size): the component of each linked set so far and how many sets it has."""
    roots = component_table(links.select("a", "b"))
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    return stored(roots.join(sizes, "root").select(F.col("node").alias("sid"), F.col("root").alias("label"), "size"), "join-labels")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")).withColumn("size", F.coalesce("size", F.lit(1).cast("long")))


def _torn(named: DataFrame, *by: str) -> DataFrame:
    """Keys whose sets are in different components, and how many sets (m) they have."""
    return named.groupBy(*by).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo <> hi").drop("lo", "hi")


def ngram_join(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, links): the class of each document, and verified links between classes.

    documents: doc_id, t1 (a hash of the text), sid, n.  Documents with the same set are one class ``sid``, so
    copies are never paired.  links: a, b (sids, a < b), overlap.  Links inside a component
    that is already joined are not listed one by one, unless ``every`` asks for them; every
    two classes that reach the threshold are in one component of the links.

    Null, empty and wordless texts have the empty set (sid 0, n 0), linked with nothing.
    Repeated rows stay rows, null ids stay null, an empty table gives two empty ones; other
    columns, whatever their names, are not read.
    """
    documents, sets, links = _joined(docs, text, key, words, similarity)
    if every:
        links = _every_link(sets, links, similarity, partitions(docs.sparkSession))
    return documents, links


def _joined(docs: DataFrame, text: str, key: str, words: int, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, the sets that can be linked, and links that join their components; see ngram_join()."""
    if not words > 0 or not similarity[1] <= 2 * similarity[0] <= 2 * similarity[1]:
        raise ValueError("words must be positive and similarity from 1/2 to 1")
    parts = partitions(docs.sparkSession)
    t1, t2 = text_hashes(F.col("text"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("t1", F.coalesce(t1, F.lit(0))).withColumn("t2", F.coalesce(t2, F.lit(0)))
    first = stored(rows.mapInArrow(frugal(_send(parts, words)), _SENT).repartitionById(parts, "part").mapInArrow(frugal(_count), _FIRST), "join-first")
    documents = first.where("is_doc").select("doc_id", "sid", "n", "n_half", "t1", "t2")
    num, den = similarity
    shared = first.where("not is_doc").groupBy("sid").agg(F.sum("n_shared").alias("n_shared"))
    classes = documents.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("n_half").alias("n_half"), F.min(F.struct("doc_id", "t1", "t2")).alias("one"))
    # A set that reaches num / den with another has that share of its hashes in it.
    lonely = F.col("n_half") - F.coalesce("n_shared", F.lit(0))
    left = classes.join(shared, "sid", "left").where(lonely * den <= (den - num) * F.col("n")).select("one.*")
    left = stored(left, "join-left")
    text_of = _only(rows, left).select("text")
    asked = text_of.mapInArrow(frugal(_send_sets(parts, words)), _SETS).repartitionById(parts, "part")
    sets = stored(asked.mapInArrow(frugal(_reply(parts)), _REPLY).repartitionById(parts, "part").mapInArrow(frugal(_choose(similarity)), _CANDIDATES), "join-sets")
    c = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("int")
    postings = lambda x, *more: x.select("sid", "n", c.alias("c"), *more, "lonely", F.posexplode("prefix").alias("pos", "key")).withColumn("at", F.col("lonely") + F.col("pos")).drop("lonely", "pos")

    # Each set against the pivot that it meets most, among sets of about its size.
    first_of = postings(sets).groupBy("key", "c").agg(F.min("sid").alias("pivot"), F.max("sid").alias("other")).where("pivot <> other").select("key", "c", "pivot")
    links = stored(_star(postings(sets).select("key", "c", "sid").join(first_of, ["key", "c"]).where("sid <> pivot"), sets, similarity), "join-links")
    labels = _components(links)

    # Hashes that still join different components; again with pivots from the largest of them.
    named = postings(_labelled(sets.select("sid", "n", "lonely", "prefix"), labels), "label")
    open_ = stored(named.join(_torn(named, "key").select("key"), "key").select("key", "c", "sid", "n", "at"), "join-open")
    for turn in range(TURNS):
        named = _labelled(open_, labels)
        pivot = F.max(F.struct("size", F.xxhash64("sid", F.lit(turn)).alias("h"), F.col("sid").alias("pivot"), F.col("label").alias("to"))).alias("p")
        pivots = named.groupBy("key", "c").agg(pivot, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key", "c", "p.pivot", "p.to")
        near = stored(_star(named.join(pivots, ["key", "c"]).where("label <> to"), sets, similarity), "join-links")
        if near.isEmpty():
            break
        links = links.union(near)
        labels = _components(links)

    # All that is left: few sets to a hash in pairs, many in an R-tree.
    named = _labelled(open_, labels)
    torn = _torn(named, "key")
    small = named.join(torn.where(F.col("m") <= FANOUT), "key").withColumn("cell", F.lit(0)).select("key", "cell", "sid", "n", "label", "at")
    large = named.join(torn.where(F.col("m") > FANOUT), "key").join(sets.select("sid", "vector"), "sid")
    cells = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("sid"), cells).cast("int")
    # A hash of more than BLOCK sets is cut into blocks, and each two blocks meet in a cell.
    spread = F.transform(F.sequence(F.lit(0), cells - 1), lambda o: F.greatest(mine, o) * cells + F.least(mine, o))
    large = large.withColumn("cell", F.explode(spread)).select("key", "cell", "sid", "n", "label", "at", "vector")
    dealt = lambda x: x.repartition(parts, "key", "cell").sortWithinPartitions("key", "cell")
    pairs = dealt(small).mapInArrow(frugal(_pairs_of_keys(similarity, False)), "a long, b long").union(dealt(large).mapInArrow(frugal(_pairs_of_keys(similarity, True)), "a long, b long")).distinct()
    links = links.union(verified(pairs, sets, similarity))
    return documents.select("doc_id", "t1", "sid", "n"), sets, links


def class_links(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, class_id, n_links of each row: the least doc_id with the same set, and how many other classes reach the threshold with it.

    Links are counted where sets meet and never stand as rows.  See ngram_components() for
    texts without words, repeated rows and null ids.
    """
    documents, sets, links = _joined(docs, text, key, words, similarity)
    counts = _every_link(sets, links, similarity, partitions(docs.sparkSession), True).groupBy("sid").agg(F.sum("n_links").alias("n_links"))
    classes = documents.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("class_id")).join(counts, "sid", "left")
    n_links = F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    out = documents.where("n > 0").join(classes, "sid").select("doc_id", F.col("n").alias("n_shingles"), "class_id", n_links)
    return out.union(documents.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def _rooted(docs: DataFrame, **options: object) -> DataFrame:
    """doc_id, t1, n and the component's root of each document."""
    documents, links = ngram_join(docs, **options)
    roots = component_table(stored(links.select("a", "b"), "join-all"))
    return documents.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "t1", "n", F.coalesce("root", "sid").alias("root"))


def ngram_components(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id of each row: the least doc_id that links reach.

    See ngram_join() for texts without words, repeated rows and null ids.  A component
    whose ids are all null has a null component_id.
    """
    named = _rooted(docs, text=text, key=key, words=words, similarity=similarity)
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = named.where("n > 0").join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return out.union(named.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def distinct_documents(docs: DataFrame, *, text: str = "text", key: str = "doc_id", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each component, that of the least doc_id (null last), with all its columns.

    Texts without words are in no group, so all of them stay.  Columns may have any names.
    """
    docs, names = apart(docs)
    text, key = names[text], names[key]
    named = stored(_rooted(docs, text=text, key=key, words=words, similarity=similarity).where("n > 0"), "join-named")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1")
    one = named.groupBy("root").agg(F.min(order).alias("one"))
    # Rows to go, and rows that stand there several times, of which one stays.
    rows = named.groupBy("root", "doc_id", "t1").agg(F.count("*").alias("m")).join(one, "root").select("doc_id", "t1", "m", (order != F.col("one")).alias("_j_go"))
    asked = stored(rows.where("_j_go or m > 1").select(F.col("doc_id").alias("_j_d"), F.col("t1").alias("_j_1"), "_j_go"), "join-asked")
    marked = docs.withColumn("_j_1", F.coalesce(text_hashes(F.col(text).cast("string"))[0], F.lit(0))).withColumn("_j_k", F.col(key).cast("long"))
    sure, maybe = parted(marked, asked.select("_j_1").distinct(), "_j_1")
    found = asked.withColumnRenamed("_j_1", "_j_t")
    tested = maybe.join(found, (F.col("_j_1") == F.col("_j_t")) & F.col("_j_k").eqNullSafe(F.col("_j_d")), "left").drop("_j_t", "_j_d")
    alone = tested.where("_j_go is null").drop("_j_go")
    again = tested.where("not _j_go").drop("_j_go").dropDuplicates(["_j_1", "_j_k"])
    return sure.unionByName(alone).unionByName(again).select(*[F.col(c).alias(name) for name, c in names.items()])


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def op1_class_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_links(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
