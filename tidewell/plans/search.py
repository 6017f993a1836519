"""Queries of search: vectors, BM25, and both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import claims as M
from tidewell.operators import search as R
from tidewell.operators import similarity as S
from tidewell.plans.catalog import query
from tidewell.sources import index as I
from tidewell.sources.shared import new_folder
from tidewell.sources.tables import document_claims, table

QUERY = "the ing und worthless est"

_COS = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"


@query("topk_cosine", f"WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE vec_id = 0), s AS (SELECT vec_id, round({_COS.format(a='e', b='q')}, 6) AS score FROM v, q) SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 20")
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return S.top_by_cosine(v, v.where("vec_id = 0").select(F.col("embedding").alias("q")), 20)


@query("cosine_pairs", f"WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) SELECT x.vec_id AS a, y.vec_id AS b, round({_COS.format(a='x.e', b='y.e')}, 6) AS cosine FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE {_COS.format(a='x.e', b='y.e')} >= 0.3")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cosine_pairs(table(spark, sf_dir, "embeddings"), 0.3, "label").withColumn("cosine", F.round("cosine", 6))


_TERMS = ", ".join(f"'{t}'" for t in R.query_terms(QUERY))
_BM25 = rf"""t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS t FROM documents),
tf AS (SELECT id, len(t) AS n, unnest(list_filter(t, lambda w: w IN ({_TERMS}))) AS term FROM t),
f AS (SELECT id, n, term, count(*) AS tf FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM f GROUP BY ALL),
w AS (SELECT count(*) AS docs, avg(len(t)) AS mean FROM t),
b AS (SELECT id, round(sum(CASE WHEN ln((docs - df + 0.5) / (df + 0.5)) > 0 THEN ln((docs - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 9) AS score FROM f JOIN df USING (term), w GROUP BY ALL),
ranked AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM b)"""


@query("bm25_search", f"WITH {_BM25} SELECT id, round(score, 6) AS score, rank FROM ranked")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.bm25(docs, QUERY).withColumn("score", F.round("score", 6))


@query(
    "hybrid_search",
    rf"""WITH {_BM25},
hw AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM documents),
hc AS (SELECT id, ('0x' || md5(w)[1:8])::BIGINT % 256 AS bucket, count(*) AS n FROM hw GROUP BY ALL),
hq AS (SELECT ('0x' || md5(w)[1:8])::BIGINT % 256 AS bucket, count(*) AS qn FROM (SELECT unnest(string_split('{QUERY}', ' ')) AS w) GROUP BY ALL),
c AS (SELECT id, sum(n * coalesce(qn, 0)) / (sqrt(sum(n * n)) * (SELECT sqrt(sum(qn * qn)) FROM hq)) AS cosine FROM hc LEFT JOIN hq USING (bucket) GROUP BY ALL),
s AS (SELECT c.id, round(coalesce(1 / rank, 0) + cosine, 6) AS score FROM c LEFT JOIN ranked ON ranked.id = c.id)
SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 11""",
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.hybrid(docs, QUERY, 10)


def _indexed(spark: SparkSession, docs: DataFrame) -> I.Index:
    root = new_folder(spark, "index")
    I.write_index(docs, root)
    return I.open_index(spark, root)


@query("bm25_indexed", f"WITH {_BM25} SELECT id, round(score, 6) AS score, rank FROM ranked")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks from postings that were stored."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return R.bm25_over(_indexed(spark, docs), QUERY).withColumn("score", F.round("score", 6))


_CLAIMS = "WITH documents AS (SELECT doc_id, text || ' ' || lang || (doc_id % 10) AS text FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 17 <> 1), "


@query(
    "claim_search",
    rf"""{_CLAIMS}{_BM25},
hw AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS w FROM documents),
hc AS (SELECT id, ('0x' || md5(w)[1:8])::BIGINT % 256 AS bucket, count(*) AS n FROM hw GROUP BY ALL),
hq AS (SELECT ('0x' || md5(w)[1:8])::BIGINT % 256 AS bucket, count(*) AS qn FROM (SELECT unnest(string_split('{QUERY}', ' ')) AS w) GROUP BY ALL),
c AS (SELECT id, sum(n * coalesce(qn, 0)) / (sqrt(sum(n * n)) * (SELECT sqrt(sum(qn * qn)) FROM hq)) AS cosine FROM hc LEFT JOIN hq USING (bucket) GROUP BY ALL),
s AS (SELECT c.id, round(coalesce(1 / rank, 0) + cosine, 6) AS score FROM c LEFT JOIN ranked ON ranked.id = c.id),
r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s WHERE score > 0 QUALIFY rank <= 201)
SELECT r.rank, lpad(id::VARCHAR, 12, '0') AS claim_id, score, source AS observed_by, rank = 201 AS more FROM r JOIN (SELECT doc_id, source FROM documents_all) d ON d.doc_id = r.id""".replace("documents_all", "main.documents"),
)
def claim_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best visible claims by text and subject, from a stored index, joined with what they are; the last row tells of more."""
    c = M.visible(document_claims(spark, sf_dir))
    index = _indexed(spark, c.select(F.col("claim_id").alias("id"), F.concat_ws(" ", "claim", "subject").alias("text")))
    found = R.hybrid_over(index, QUERY, 200)
    return found.join(c.select(F.col("claim_id").alias("id"), "observed_by"), "id").select("rank", F.col("id").alias("claim_id"), "score", "observed_by", (F.col("rank") == 201).alias("more"))


@query("near_vectors", f"WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) SELECT x.vec_id AS a, y.vec_id AS b, round({_COS.format(a='x.e', b='y.e')}, 6) AS cosine FROM v x JOIN v y ON x.label = y.label AND x.vec_id % 2 = 0 AND y.vec_id % 2 = 1 WHERE {_COS.format(a='x.e', b='y.e')} >= 0.35")
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an even and an odd vector of a label that are near, by the join with pivot bounds."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    return S.near_vectors(v.where("id % 2 = 0"), v.where("id % 2 = 1"), 0.35, ["label"]).select("a", "b", F.round("cosine", 6).alias("cosine"))
