"""Document fingerprints by consistent weighted sampling: equal samples occur at the rate of generalised Jaccard similarity."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import CHUNK_BYTES, U64, chunks, frugal, lowered, mix, partitions, span_hashes, text_buffer, word_spans

#: Words of a term, and samples of a fingerprint (8 hexadecimal digits each).
WORDS, SAMPLES = 5, 64
#: Terms that one vectorised pass looks at: its arrays stay in a core's cache.
BLOCK = 1 << 15
#: Documents of a chunk at most, as their number takes 12 bits of a sort key.
DOCUMENTS = 1 << 12
#: Rows sampled for each range of documents.
SAMPLED = 64
SEED = 20240613

U32 = np.uint32
_NONE = U64(0xFFFFFFFFFFFFFFFF)
_M = U64(0x9E3779B97F4A7C15)


def weighted_terms(raw: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each text as (number of the text in 12 bits, hash in 52), ascending, and their counts.

    Terms are runs of ``words`` lower-cased words; a text of fewer words is one term.
    """
    starts, ends = word_spans(raw, off)
    w = span_hashes(lowered(raw), starts, ends)
    at = np.searchsorted(starts, off)
    n = np.diff(at)
    m = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    first = np.repeat(at[:-1] - np.cumsum(m) + m, m) + np.arange(m.sum())
    length = np.repeat(np.minimum(n, words), m)
    sums = length.astype(U64)
    for j in range(words):
        there = slice(None) if n.size and n[n > 0].min(initial=words) >= words else length > j
        sums[there] = sums[there] * _M + w[first[there] + j]
    keys = np.repeat(np.arange(len(n), dtype=U64) << U64(52), m) | (mix(sums) >> U64(12))
    keys.sort()
    new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.diff(np.append(new, len(keys)))


class Sampler:
    """For each sample, the term and step that win it in each text.

    A term of weight w has, for every sample, r and c of a gamma distribution (2, 1) and a
    uniform b, all from its hash; t = floor(ln w / r + b), and the term of least
    ln c - r (t - b + 1) wins.  The chance that two texts agree on (term, t) is the sum of
    least weights over the sum of greatest.  Logarithms are arithmetic on floats' bits, so
    that all machines get the same samples.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = SEED):
        self.samples = samples
        self.odd = np.random.default_rng(seed).integers(0, 1 << 32, (3, samples), np.uint64).astype(U32) | U32(1)

    @staticmethod
    def _ln(x: np.ndarray, out: np.ndarray, spare: np.ndarray) -> None:
        """Natural logarithm of positive floats to about 1e-4."""
        bits, m = x.view(np.int32), spare.view(np.int32)
        np.bitwise_and(bits, 0x7FFFFF, out=m)
        np.bitwise_or(m, 0x3F000000, out=m)
        np.copyto(out, bits, casting="unsafe")
        np.multiply(out, np.float32(0.6931471805599453 / (1 << 23)), out=out)
        np.multiply(spare, np.float32(1.498030302 * 0.6931471805599453), out=x)
        np.subtract(out, x, out=out)
        np.add(spare, np.float32(0.3520887068), out=spare)
        np.divide(np.float32(1.72587999 * 0.6931471805599453), spare, out=spare)
        np.subtract(out, spare, out=out)
        np.subtract(out, np.float32(124.22551499 * 0.6931471805599453), out=out)

    def winners(self, terms: np.ndarray, weights: np.ndarray, starts: np.ndarray, shared: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """[sample, text] least (value, term and step), over all terms and over ``shared`` ones; texts begin at ``starts``."""
        out = np.full((self.samples, len(starts)), _NONE)
        also = out.copy() if shared is not None else None
        hashes = mix(terms << U64(12))
        low, high, log_w = hashes.astype(U32), (hashes >> U64(32)).astype(U32), np.log(weights).astype(np.float32)
        name = low ^ (high * U32(0x9E3779B1))
        for a in range(0, len(terms), BLOCK):
            b = min(len(terms), a + BLOCK)
            lo, hi = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b)
            cuts = np.maximum(starts[lo:hi], a) - a
            drop = None if shared is None else np.where(shared[a:b], U64(0), _NONE)
            self._block(low[a:b], high[a:b], log_w[a:b], name[a:b], cuts, drop, out[:, lo:hi], None if also is None else also[:, lo:hi])
        return out, also

    def _block(self, low: np.ndarray, high: np.ndarray, log_w: np.ndarray, name: np.ndarray, cuts: np.ndarray, drop: np.ndarray | None, out: np.ndarray, also: np.ndarray | None) -> None:
        n = len(low)
        x, y, z, s = (np.empty(n, U32) for _ in range(4))
        f, g, r, c = (np.empty(n, np.float32) for _ in range(4))
        key, some = np.empty(n, U64), np.empty(n, U64)
        halves = key.view(U32).reshape(-1, 2)  # little-endian: the value is the greater half

        def scatter(v: np.ndarray) -> None:
            for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
                np.right_shift(v, U32(shift), out=s)
                np.bitwise_xor(v, s, out=v)
                np.multiply(v, U32(factor), out=v)
            np.right_shift(v, U32(16), out=s)
            np.bitwise_xor(v, s, out=v)

        def gamma(v: np.ndarray, to: np.ndarray) -> None:
            """-ln of the product of two uniforms, from the halves of ``v``."""
            np.right_shift(v, U32(16), out=s)
            np.copyto(f, s.view(np.int32), casting="unsafe")
            np.bitwise_and(v, U32(0xFFFF), out=s)
            np.copyto(g, s.view(np.int32), casting="unsafe")
            np.add(f, np.float32(0.5), out=f)
            np.add(g, np.float32(0.5), out=g)
            np.multiply(f, g, out=f)
            np.multiply(f, np.float32(2.0**-32), out=f)
            self._ln(f, to, g)
            np.negative(to, out=to)
            np.maximum(to, np.float32(1e-5), out=to)

        for k in range(self.samples):
            np.multiply(low, self.odd[0, k], out=x)
            np.add(x, high, out=x)
            scatter(x)
            np.multiply(high, self.odd[1, k], out=y)
            np.add(y, low, out=y)
            scatter(y)
            np.multiply(x, self.odd[2, k], out=z)
            np.add(z, y, out=z)
            np.right_shift(z, U32(15), out=s)
            np.bitwise_xor(z, s, out=z)
            np.multiply(z, U32(0x2C1B3C6D), out=z)
            np.right_shift(z, U32(8), out=z)
            gamma(x, r)
            gamma(y, c)
            self._ln(c, f, g)
            np.copyto(c, f)
            np.copyto(f, z.view(np.int32), casting="unsafe")
            np.multiply(f, np.float32(2.0**-24), out=f)
            np.divide(log_w, r, out=g)
            np.add(g, f, out=g)
            np.floor(g, out=g)  # t
            np.copyto(s.view(np.int32), g, casting="unsafe")
            np.subtract(g, f, out=g)
            np.add(g, np.float32(1), out=g)
            np.multiply(g, r, out=g)
            np.subtract(c, g, out=c)
            np.add(c, np.float32(64), out=c)  # positive, so that its bits order it
            np.multiply(s, U32(0x85EBCA6B), out=s)
            np.bitwise_xor(s, name, out=s)
            halves[:, 0], halves[:, 1] = s, c.view(U32)
            np.minimum(out[k], np.minimum.reduceat(key, cuts), out=out[k])
            if drop is not None:
                np.bitwise_or(key, drop, out=some)
                np.minimum(also[k], np.minimum.reduceat(some, cuts), out=also[k])

    @staticmethod
    def _spread(found: np.ndarray, keys: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """[text, sample] of ``n`` texts, of which those at ``starts`` have terms; the others stay _NONE."""
        out = np.full((n, len(found)), _NONE)
        out[(keys[starts] >> U64(52)).astype(np.int64)] = found.T
        return out

    def texts(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """[text, sample] winners."""
        keys, counts = weighted_terms(raw, off)
        starts = np.flatnonzero(np.append(True, np.diff(keys >> U64(52)) > 0)) if len(keys) else np.zeros(0, np.int64)
        found, _ = self.winners(keys, counts, starts)
        return self._spread(found, keys, starts, len(off) - 1)

    def pairs(self, raw: np.ndarray, off: np.ndarray, other: np.ndarray, other_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winners of texts and of their other versions; terms that both have with one weight are looked at once."""
        n = len(off) - 1
        keys, counts = weighted_terms(raw, off)
        more, times = weighted_terms(other, other_off)
        at = np.searchsorted(keys, more)
        at[at == len(keys)] = 0
        same = (keys[at] == more) & (counts[at] == times) if len(keys) else np.zeros(len(more), bool)
        shared = np.zeros(len(keys), bool)
        shared[at[same]] = True
        begins = lambda k: np.flatnonzero(np.append(True, np.diff(k >> U64(52)) > 0)) if len(k) else np.zeros(0, np.int64)
        starts, rest, rest_counts = begins(keys), more[~same], times[~same]
        mine, both = self.winners(keys, counts, starts, shared)
        rest_starts = begins(rest)
        theirs, _ = self.winners(rest, rest_counts, rest_starts)
        return self._spread(mine, keys, starts, n), np.minimum(self._spread(both, keys, starts, n), self._spread(theirs, rest, rest_starts, n))


def written(found: np.ndarray) -> list[str]:
    """Hexadecimal fingerprints: the term and step of each sample; '' of a text without terms."""
    return ["" if row[0] == _NONE else row.astype(">u4").tobytes().hex() for row in found]


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples of each row; two texts without terms are alike."""
    return (a.astype(U32) == b.astype(U32)).mean(axis=-1) * ((a[..., 0] == _NONE) == (b[..., 0] == _NONE))


def likeness(a: str, b: str) -> Column:
    """Share of equal samples of two fingerprint columns, 0 to 1; '' is like '' alone."""
    same = F.expr(f"size(filter(sequence(1, greatest(length({a}), 8), 8), i -> substring({a}, i, 8) = substring({b}, i, 8)))")
    return F.when(F.col(a) == F.col(b), 1.0).when(F.length(a) != F.length(b), 0.0).otherwise(same / (F.length(a) / 8))


def fingerprints(docs: DataFrame, *, text: str = "text", samples: int = SAMPLES, name: str = "fingerprint") -> DataFrame:
    """``docs`` with a column ``name``: the fingerprint of the whole text.

    Terms are runs of five words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased), weighted by their
    count in the text; a text of fewer words is one term.  Equal texts have equal
    fingerprints, and likeness() of two estimates the generalised Jaccard similarity of
    their weighted terms with a standard error of at most 0.5 / sqrt(samples).

    Null and empty texts, and those without words, have the fingerprint ''.  Rows stay as
    they are, repeated ones too; a column of that name is replaced; an empty table gives
    an empty one.  A task holds about 50 bytes for each byte of its longest text.
    """
    sampler = Sampler(samples)

    @F.arrow_udf("string")
    def printed(column: pa.Array) -> pa.Array:
        out: list[str] = []
        for batch, raw, off in chunks([pa.RecordBatch.from_arrays([column], ["text"])]):
            for a in range(0, batch.num_rows, DOCUMENTS):
                part = off[a : a + DOCUMENTS + 1]
                out += written(sampler.texts(raw[part[0] : part[-1]], part - part[0]))
        return pa.array(out, pa.string())

    return docs.withColumn(name, printed(F.col(text)))


def _edited(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    """Rows by descending id to fingerprints of texts and edited texts; the last row of a range is the next range's first."""
    sampler, names = Sampler(samples), ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    ids: list[int | None] = []
    texts: list[str] = []
    size, held, own, ended = 0, [], None, False  # held: the last finished row, own: its samples

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def buffer(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return text_buffer(pa.array(rows, pa.large_string()))

    def solve(last: bool) -> list[tuple]:
        """Rows that are complete; the last text only lends its beginning, and its likeness at the end."""
        nonlocal ids, texts, size, held, own
        n, edited = len(texts) - 1, []
        for t, following in zip(texts, texts[1:], strict=False):
            cut = len(t) // 3
            edited.append(t[: len(t) - cut] + following[:cut])
        mine, other = sampler.pairs(*buffer(texts[:n]), *buffer(edited))
        prints, others, near = written(mine), written(other), _alike(mine, other).tolist()
        rows = [[i, len(t), hashlib.sha256(e.encode()).hexdigest(), p, o, x] for i, t, e, p, o, x in zip(ids, texts, edited, prints, others, near, strict=False)]
        rows, all_ = held + rows, mine if own is None else np.concatenate([own, mine])
        if last:
            all_ = np.concatenate([all_, sampler.texts(*buffer(texts[n:]))])
        following = _alike(all_[:-1], all_[1:]).tolist()
        held, own = ([], None) if last else (rows[-1:], all_[-1:])
        ids, texts, size = ([], [], 0) if last else (ids[n:], texts[n:], len(texts[n]))
        return [(*r, x) for r, x in zip(rows, following, strict=False)]

    part = None
    for batch in batches:
        for p, extra, key, text in zip(*(batch.column(c).to_pylist() for c in ("part", "extra", "key", "text")), strict=True):
            if p != part:
                part, ended = p, False
            if ended:
                continue  # another copy of the first row of the next range
            ids.append(key)
            texts.append(text)
            size += len(text)
            ended = bool(extra)
            if ended and len(texts) > 1 or len(texts) > 1 and (size > CHUNK_BYTES or len(texts) > DOCUMENTS):
                if rows := solve(ended):
                    yield batch_of(rows)
            elif ended and held:
                # The row before is finished but for its likeness to this one.
                rows = [(*held[0], float(_alike(own[0], sampler.texts(*buffer(texts))[0])))]
                ids, texts, size, held, own = [], [], 0, [], None
                yield batch_of(rows)


def edited_fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    Rows stand by descending key (nulls last, ties by a hash of the text), and after the last
    comes the first again.  The edited text of a row has its last floor(n_chars / 3) code
    points replaced by as many (or all) from the start of the next row's text.
    ``near_edited`` and ``near_next`` are the likeness of the row's fingerprint to those of
    the edited text and of the next row; see fingerprints() for terms and empty texts.

    Rows are dealt into ranges, whose first keys are rows of a sample, so that ties of a
    hot key are split too; the first row of each range goes to the range before as well.
    The driver sees SAMPLED keys a range.  Each text is shuffled once.  Repeated rows have
    a result each, their next being each other; a single row is its own next; an empty table
    gives an empty one.  Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    text_or_none = F.coalesce(F.col(text).cast("string"), F.lit(""))
    read = docs.select(F.col(key).cast("long").alias("key"), text_or_none.alias("text"))
    read = read.select(F.col("key").isNull().cast("int").alias("none"), F.coalesce(F.bitwise_not("key"), F.lit(0)).alias("down"), F.xxhash64("text").alias("hash"), "key", "text")
    keys, parts = read.select("none", "down", "hash"), partitions(spark)
    found = keys.agg(F.count("*").alias("n"), F.min(F.struct("none", "down", "hash")).alias("first")).first()
    made = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not found.n:
        return spark.createDataFrame([], made)
    sample = sorted(tuple(r) for r in keys.sample(fraction=min(1.0, SAMPLED * parts / found.n), seed=SEED).collect())
    bounds = sorted({tuple(found.first), *(sample[len(sample) * i // parts] for i in range(1, parts) if sample)})

    @F.arrow_udf("array<int>")
    def ranges(none: pa.Array, down: pa.Array, hash_: pa.Array) -> pa.Array:
        out = []
        for row in zip(none.to_pylist(), down.to_pylist(), hash_.to_pylist(), strict=True):
            at = bisect.bisect_right(bounds, row) - 1
            out.append([at, (at - 1) % len(bounds)] if bounds[at] == row else [at])
        return pa.array(out, pa.list_(pa.int32()))

    dealt = read.select("*", F.posexplode(ranges("none", "down", "hash")).alias("extra", "part"))
    dealt = dealt.repartitionById(len(bounds), "part").sortWithinPartitions("part", "extra", "none", "down", "hash")
    return dealt.select("part", "extra", "key", "text").mapInArrow(frugal(lambda batches: _edited(batches, samples)), made)


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
