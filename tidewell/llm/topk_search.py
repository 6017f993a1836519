"""Exact top-k inner-product search by term-at-a-time accumulation over blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a candidate block and of a query block: dense scores take 8 bytes for each pair.
CANDIDATES, QUERIES = 8192, 512


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id long, w array<long>): floor(scale * x) of each finite vector; others go."""
    x = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("w"))


def _dense(column: pa.ListArray) -> np.ndarray:
    """Rows of weights, short vectors filled with zeros."""
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(off)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    at = np.arange(off[0], off[-1]) - np.repeat(off[:-1], size)
    out[np.repeat(np.arange(len(size)), size), at] = flat[off[0] : off[-1]]
    return out


def scores_by_term(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense integer scores [query, candidate].

    One term (dimension) after another: its postings are the candidates with a weight
    there, and each query with a weight scatters query weight times posting weight into
    its row of the score array.
    """
    terms = min(queries.shape[1], candidates.shape[1])
    top = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(terms, 1)
    scores = np.zeros((len(queries), len(candidates)), np.int64 if top < 1 << 62 else object)
    for t in range(terms):
        rows, ids = np.flatnonzero(queries[:, t]), np.flatnonzero(candidates[:, t])
        if not len(rows) or not len(ids):
            continue
        q, w = queries[rows, t].astype(scores.dtype), candidates[ids, t].astype(scores.dtype)
        if len(ids) == len(candidates) and len(rows) == len(queries):
            scores += q[:, None] * w
        else:
            scores[np.ix_(rows, ids)] += q[:, None] * w
    return scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best candidates, ties to the smaller id; ``ids`` ascend."""
    open_ = np.flatnonzero(ids != own)
    s = scores[open_]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > least)
        ties = np.flatnonzero(s == least)[: k - len(above)]
        pick = np.concatenate([above, ties])
    else:
        pick = np.arange(len(s))
    return open_[pick[np.lexsort((ids[open_[pick]], -s[pick]))]]


def _search(k: int):
    def run(left: Iterator[pa.RecordBatch], right: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, c = pa.Table.from_batches(list(left)), pa.Table.from_batches(list(right))
        q, c = q.combine_chunks(), c.combine_chunks().sort_by("vec_id")
        qid, cid = q.column("vec_id").to_numpy(), c.column("vec_id").to_numpy()
        if len(qid) and len(cid):
            scores = scores_by_term(_dense(q.column("w").combine_chunks()), _dense(c.column("w").combine_chunks()))
            got = [best(scores[i], cid, own, k) for i, own in enumerate(qid)]
            n = [len(g) for g in got]
            at = np.concatenate(got) if got else np.zeros(0, int)
            row = np.repeat(np.arange(len(qid)), n)
            value = scores[row, at]
            if value.dtype == object:
                value = np.clip(value, -(1 << 63), (1 << 63) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(cid[at]), pa.array(value)], ["query_id", "vec_id", "score"])

    def grouped(left: pa.Table, right: pa.Table) -> pa.Table:
        out = list(run(iter(left.to_batches()), iter(right.to_batches()))) if left.num_rows and right.num_rows else []
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        return pa.Table.from_batches(out, schema) if out else schema.empty_table()

    return grouped


def topk_search(vectors: DataFrame, queries: DataFrame | None = None, *, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each query.

    Queries are the rows of ``queries``, or else those whose id is divisible by ``every``.
    Both sides are dealt into blocks; every query block meets every candidate block in one
    task that holds CANDIDATES x QUERIES scores, whatever the number of rows.  Each task
    sends on k rows a query, and a window merges those.

    A null id, a null vector, or one with null or non-finite components takes no part.
    Ties go to the smaller id.  A query with fewer candidates than k gets them all; rows
    with the query's own id are not its candidates.  Repeated rows of a candidate count
    once each; repeated query rows give one answer.  Missing components of short vectors
    count as zero.  Scores beyond a long are cut to its range.  Other columns of the
    inputs, whatever their names, are not read.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(queries, id_col, vector_col, scale) if queries is not None else rows.where(F.col("vec_id") % every == 0)
    asked = asked.dropDuplicates(["vec_id"])
    n_rows, n_asked = rows.count(), asked.count()
    blocks, parts = max(1, -(-n_rows // CANDIDATES)), max(1, -(-n_asked // QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    c = rows.select("vec_id", "w", deal(blocks).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("qb"))
    q = asked.select("vec_id", "w", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"), deal(parts).alias("qb"))
    found = q.groupBy("cb", "qb").cogroup(c.groupBy("cb", "qb")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
