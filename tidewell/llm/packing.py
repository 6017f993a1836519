"""Packing by shortest-pack-first over the histogram of piece lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import frugal, stored
from tidewell.llm.tokens import END, encoded

#: Ids of a sequence.
SEQUENCE = 1024
#: Pieces that a bucket of pieces of all lengths aims at.
BUCKET_ROWS = 4096

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = SEQUENCE, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Every document's ids with the end id, cut into runs of ``size`` and what is left."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1).to_pylist(), tokenizer), strict=True):
                ids += last
                n = len(ids) // 4
                for a in range(0, n, size):
                    b = min(n, a + size)
                    rows.append((doc, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), n))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)], names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(cut), _PIECES)


def shortest_pack_first(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, lengths in them): packing patterns for a histogram of lengths.

    Lengths come longest first.  Each goes onto the shortest patterns that have room, one
    to a sequence; where a pattern has more sequences than pieces are left, it splits in
    two.  Pieces that fit on none open patterns of their own length, filled as far as they go.
    """
    open_: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
    for length in sorted(counts, reverse=True):
        left, used = counts[length], 0
        while left and used + length <= size:
            if not open_[used]:
                used += 1
                continue
            n, pattern = open_[used].pop()
            take = min(n, left)
            if n > take:
                open_[used].append((n - take, pattern))
            open_[used + length].append((take, (*pattern, length)))
            left -= take
        deep = size // length
        for n, times in ((left // deep, deep), (1 if left % deep else 0, left % deep)):
            if n:
                open_[times * length].append((n, (length,) * times))
    return [x for row in open_ for x in row]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first, offset) of each slot."""
    out, rank, sequence = [], {}, 0
    for n, lengths in patterns:
        at = 0
        for length in lengths:
            lo = rank.get(length, 0)
            out.append((length, lo, lo + n, sequence, at))
            rank[length] = lo + n
            at += length
        sequence += n
    return out


def pack(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = SEQUENCE, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are cut into full sequences and one shorter piece.  The histogram of lengths
    (``size`` counts at most, which is all that the driver sees) is packed shortest pack
    first; pieces of a length are ranked, and patterns are joined back by rank.  Ranks come
    from small buckets of equal lengths and their running counts, so a length that many
    pieces share is in no task whole.  The same rows give the same sequences.

    Null text is empty and has the end id alone; so each row gives a piece.  Null ids stay
    null.  Repeated rows are packed as often as they occur.  An empty table gives none.
    Other columns of ``docs``, whatever their names, are not read.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, text=text, key=key, size=size, tokenizer=tokenizer, end=end), "pieces")
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(1, sum(counts.values()) // BUCKET_ROWS)
    dealt = made.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = dealt.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = before.select("length", "_b", (F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("_within", within).join(before, ["length", "_b"]).withColumn("_rank", F.col("_within") + F.col("_before"))
    table = spark.createDataFrame(slots(shortest_pack_first(counts, size)) or [(0, 0, 0, 0, 0)], "length long, _lo long, _hi long, _first long, offset long")
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).drop(table["length"])
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
