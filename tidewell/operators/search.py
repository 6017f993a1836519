"""Ranked search over claims: BM25 by an inverted index, a hashed vector, and both together."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scores import BUCKETS, bucket_of
from tidewell.sources.index import Index, bucket, tokens
from tidewell.sources.shared import stored

K1, B = 1.2, 0.75
#: Ranges of scores in which ranks are counted apart.
RANGES = 200


def query_terms(query: str) -> list[str]:
    return sorted(set(re.findall(r"[^\W_]+", query.lower())))


def bm25(docs: DataFrame, query: str) -> DataFrame:
    """(id, score, rank) of all documents (id, text) with any term of the query, ties by id.

    Lengths come from one pass; only tokens that the query names are exploded.  An idf
    that is not positive counts as 1e-6.
    """
    wanted = query_terms(query)
    sized = tokens(docs).select("id", F.size("t").alias("n"), F.filter("t", lambda t: t.isin(*wanted) if wanted else F.lit(False)).alias("hits"))
    whole = sized.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    tf = sized.select("id", "n", F.explode("hits").alias("term")).groupBy("id", "n", "term").agg(F.count("*").alias("tf"))
    return _scored(tf, whole)


def bm25_over(index: Index, query: str) -> DataFrame:
    """bm25() over a stored index: it reads the buckets of the query's terms and no document."""
    return _scored(index.of_terms(query_terms(query)), index.stats)


def _scored(tf: DataFrame, whole: DataFrame) -> DataFrame:
    """From postings (term, id, tf, n) of a query's terms and the table's (docs, mean)."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(whole)).groupBy("id").agg(F.round(F.sum(part), 9).alias("score"))
    return ranked(stored(scored, "bm25"))


def ranked(scored: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Add the rank of each row of (id, score) by score, ties by id.

    Rows are counted in ranges between quantiles of the score, so that no task sorts all of
    them; a rank is the rows of better ranges and the place in the own one.
    """
    edges = scored.agg(F.percentile_approx("score", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 10_000).alias("edges"))
    dealt = scored.join(F.broadcast(edges)).withColumn("range", F.size(F.filter("edges", lambda e: e > F.col("score")))).drop("edges")
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("score"), "id"))
    return dealt.withColumn("place", place).join(F.broadcast(before), "range").select("id", "score", (F.col("before") + F.col("place")).alias("rank"))


def hashed_cosine(docs: DataFrame, query: str, buckets: int = 256) -> DataFrame:
    """(id, cosine) between hashed bags of words of documents and query, where it is above 0."""
    spark = docs.sparkSession
    split = lambda t: F.filter(F.split(F.lower(t), r"(?U)\s+"), lambda w: w != "")
    q = spark.createDataFrame([(query,)], "q string").select(F.explode(split("q")).alias("w")).groupBy(bucket_of(F.col("w"), buckets).alias("bucket")).agg(F.count("*").alias("qn"))
    qnorm = q.agg(F.sqrt(F.sum(F.col("qn") * F.col("qn"))).alias("qnorm"))
    counts = docs.select("id", F.explode(split("text")).alias("w")).groupBy("id", bucket_of(F.col("w"), buckets).alias("bucket")).agg(F.count("*").alias("n"))
    both = counts.join(F.broadcast(q), "bucket", "left").groupBy("id").agg(F.sum(F.col("n") * F.coalesce("qn", F.lit(0))).alias("dot"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm")).where("dot > 0")
    return both.join(F.broadcast(qnorm)).select("id", (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("cosine"))


def cosine_over(index: Index, query: str) -> DataFrame:
    """hashed_cosine() over a stored index: it reads the dimensions of the query's words."""
    words = [w for w in re.split(r"\s+", query.lower()) if w]
    asked = Counter(bucket(w, BUCKETS) for w in words)
    norm = math.sqrt(sum(n * n for n in asked.values()))
    weight = F.create_map(*[F.lit(x) for pair in asked.items() for x in pair])[F.col("dim")]
    return index.of_words(words).groupBy("id", "norm").agg(F.sum(F.col("n") * weight).alias("dot")).select("id", (F.col("dot") / (F.col("norm") * norm)).alias("cosine"))


def hybrid(docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """(id, score, rank) of the k + 1 best by 1 / BM25 rank plus cosine, ties by id; the extra row tells of more.

    A blank query returns the first k + 1 ids, all with score 0.
    """
    if not query.strip():
        return _best(docs.select("id", F.lit(0.0).alias("score")), k)
    return _fused(bm25(docs, query), hashed_cosine(docs, query), k)


def hybrid_over(index: Index, query: str, k: int = 10) -> DataFrame:
    """hybrid() over a stored index."""
    if not query.strip():
        return _best(index.ids.select("id", F.lit(0.0).alias("score")), k)
    return _fused(bm25_over(index, query), cosine_over(index, query), k)


def _fused(lexical: DataFrame, cosine: DataFrame, k: int) -> DataFrame:
    both = lexical.select("id", (1 / F.col("rank")).alias("lexical")).join(cosine, "id", "full_outer")
    return _best(both.select("id", F.round(F.coalesce("lexical", F.lit(0.0)) + F.coalesce("cosine", F.lit(0.0)), 6).alias("score")).where("score > 0"), k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    top = scored.orderBy(F.desc("score"), "id").limit(k + 1)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))
