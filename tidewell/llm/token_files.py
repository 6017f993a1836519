"""Token ids as wavelet matrices, one a shard, written and read as Parquet files.

A wavelet matrix keeps ids of b bits as b bit-planes.  The first plane holds the top bit
of each id in order; ids with a 0 there come before those with a 1 in the next plane's
order, and so on.  With counts of ones before every 512 bits this is all that access,
counting and occurrence lookup need, in the space of the ids themselves.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import frugal, shared_dir
from tidewell.llm.tokens import END, encoded

#: Ids at which a shard is closed, after the document that reaches it.
SHARD_IDS = 1 << 20
#: Bits between counts of ones.
_STEP = 512

FILE = "part int, shard int, doc_ids array<bigint>, doc_tokens array<bigint>, n long, bits int, zeros array<bigint>, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    """Rank, select, access and full decoding over bit-planes, top bit first."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]) -> None:
        self.n, self.zeros, self.bits = n, zeros, len(zeros)
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for level in range(bits - 1, -1, -1):
            ones = (now & now.dtype.type(1 << level)) != 0
            plane = np.packbits(ones)
            full = np.zeros(-(-len(plane) // 64) * 64, np.uint8)
            full[: len(plane)] = plane
            counts = np.bitwise_count(full.view(np.uint64)).reshape(-1, _STEP // 64).sum(1, dtype=np.int64)
            planes.append(plane.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes())
            low = np.compress(~ones, now)
            zeros.append(len(low))
            now = np.concatenate([low, np.compress(ones, now)])
        return cls(len(ids), zeros, planes, ranks)

    def parts(self) -> tuple[list[int], list[bytes], list[bytes]]:
        return self.zeros, [p.tobytes() for p in self.planes], [r.tobytes() for r in self.ranks]

    def decode(self) -> np.ndarray:
        """All ids in order, planes joined from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            now = np.empty(self.n, kind)
            now[np.flatnonzero(~ones)] = out[: self.zeros[level]]
            now[np.flatnonzero(ones)] = out[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            out = now
        return out

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before place i."""
        block = i // _STEP
        plane, n = self.planes[level], int(self.ranks[level][block])
        n += int(np.bitwise_count(plane[block * (_STEP // 8) : i >> 3]).sum())
        return n + (int(plane[i >> 3]) >> (8 - (i & 7))).bit_count() if i & 7 else n

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = 2 * value + bit
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where occurrences of value before place i stand after the last plane."""
        lo, hi = 0, i
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if value >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, value: int, i: int) -> int:
        """Occurrences of value before place i."""
        if value >> self.bits:
            return 0
        lo, hi = self._range(value, i)
        return hi - lo

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of value."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        i = self._range(value, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]


def write_token_files(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, end: int = END, shard_ids: int = SHARD_IDS) -> None:
    """Write all documents' ids, each with the end id, in ascending order of their ids.

    Documents are dealt out by range of id, a null id first, and sorted; a task closes a shard at about
    ``shard_ids`` ids, whole documents only, and writes it as one row of FILE.  Spark's
    writer commits the files, so a lost task leaves nothing behind and is run again.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), 0
        last = np.array([end], "<u4").tobytes()
        names: list = []
        held: list[bytes] = []
        size = 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            wm = WaveletMatrix.build(ids)
            zeros, planes, ranks = wm.parts()
            row = [part, shard, names, [len(h) // 4 for h in held], len(ids), wm.bits, zeros, planes, ranks]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in FILE.split(", ")])

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), tokenizer), strict=True):
                names.append(doc)
                held.append(ids + last)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield closed()
                    names, held, size, shard = [], [], 0, shard + 1
        if held:
            yield closed()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # Bounds from the ids alone, so that no text is read for them.
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    at = F.size(F.filter(F.lit(sorted(set(cuts))), lambda c: c < F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", F.coalesce(F.when(F.col("doc_id").isNotNull(), at), F.lit(0)).cast("int"))
    rows = rows.repartitionById(n, "part").sortWithinPartitions("doc_id", "text").drop("part")
    rows.mapInArrow(frugal(shards), FILE).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids = memoryview(WaveletMatrix(r["n"], r["zeros"], r["planes"], r["ranks"]).decode().astype("<u4"))
                n = np.array(r["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(ids[b - k : b]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * k, pa.int32()), pa.array([r["shard"]] * k, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(FILE).parquet(path)
    docs = files.mapInArrow(frugal(decoded), "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    # Running counts in two steps: over a part's shards, then over the parts.
    size = files.select("part", "shard", "n")
    parts = size.groupBy("part").agg(F.sum("n").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("a"))
    shards = size.select("part", "shard", (F.sum("n").over(Window.partitionBy("part").orderBy("shard")) - F.col("n")).alias("b"))
    at = shards.join(parts, "part").select("part", "shard", (F.col("a") + F.col("b")).alias("first"))
    return docs.join(at, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null text is empty; null ids come first; repeated ids are ordered by text; long texts are encoded in parts."""
    import uuid

    path = f"{shared_dir(spark)}/tidewell/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read_token_files(spark, path)
