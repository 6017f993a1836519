"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised pass looks at; arrays of 8 bytes a byte stay small.
CHUNK_BYTES = 1 << 20

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (tests, a laptop) gets a local folder;
    on a cluster, whose executors could not read each other's folders, it is an error.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tidewell.shared.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewell-shared-")
        spark.conf.set("tidewell.shared.dir", path)
    return path.rstrip("/")


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with numbered columns c0, c1, ..., which clash with no name made here, and the number of each name."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def partitions(spark: SparkSession) -> int:
    """Ranges that packed arrays are dealt into: the session's number of shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Paths that stored() wrote in each scratch() block that is open, the innermost last.
_scratches: list[list[str]] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor re-reads files instead of recomputing.  The files stay,
    as results read them, but for those written in a scratch() block.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "tidewell", f"{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    if _scratches:
        _scratches[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what stored() wrote inside it, and nothing else; for steps whose results are written there."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            delete(spark, path)


def frugal(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` for mapInArrow, after which its worker gives freed memory back.

    Workers outlive tasks and wait for the next stage; what they keep counts against the executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
            pool.release_unused()

    return run


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column end to end, and len+1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        raw, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            lo = hi


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, from batches that are sorted by ``keys``.

    Yields a table and the row numbers at which its groups begin, the end included.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        if table.num_rows:
            new[0] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        at = cut(table)
        if len(at) > 2:
            yield table.slice(0, at[-2]), at[:-1]
            rest = table.slice(at[-2])
            held = rest.combine_chunks().to_batches()
            rows = rest.num_rows
        else:
            held = table.to_batches()
        least = max(4096, 2 * rows)
    if rows:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte span, finalised with its length."""
    sums = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * powers(len(raw)), dtype=U64, out=sums[1:])
    value = (sums[ends] - sums[starts]) * powers(len(raw) + 1, _INVERSE)[starts]
    return mix(value + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of ``[^\\x20\\x09-\\x0D]+`` in each text of the buffer."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[off] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def lowered(raw: np.ndarray) -> np.ndarray:
    return _LOWER[raw]


def component_table(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a long, b long); root is the component's least node.

    Alternates large-star and small-star steps; each is two aggregations by key, so no
    component is gathered in a task and the number of rounds grows with the log of a
    component's diameter.  Rounds go on until one changes nothing.
    """
    from pyspark.sql import functions as F

    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        now = stored(small, "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
