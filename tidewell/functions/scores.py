"""Column expressions for similarity, trust, confidence and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of calibration: prior weight, low sample, and the similarity of a contradiction.
PRIOR_WEIGHT, LOW_SAMPLE = 12.0, 10
COSINE_CONFLICT, WORDS_CONFLICT = 0.85, 0.6
#: Buckets of the hashed bag of words.
BUCKETS = 256


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of zeros or of different lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / norm)


def word_share(a: Column, b: Column) -> Column:
    """Share of the distinct words ``a`` that are in ``b``; 0 if there are none."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def bucket_of(word: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def hash_embedding(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key``, bucket and value: the unit vector of each text's word counts in hashed buckets, zeros left out."""
    word = texts.select(*key, F.explode(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")).alias("w"))
    counts = word.groupBy(*key, bucket_of(F.col("w")).alias("bucket")).agg(F.count("*").alias("n"))
    norm = counts.groupBy(*key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, key).select(*key, "bucket", (F.col("n") / F.col("norm")).alias("value"))


def trust_multiplier(resolved: Column, brier: Column) -> Column:
    """0.7 to 1.3 by how often an agent was right, drawn to 1 while little is known."""
    n = resolved.cast("double")
    return F.when(resolved == 0, F.lit(1.0)).otherwise(0.7 + 0.6 * ((PRIOR_WEIGHT * 0.5 + n * (1.0 - brier)) / (PRIOR_WEIGHT + n)))


def confidence(independent: Column, trust: Column) -> Column:
    raw = F.least(0.5 + 0.15 * independent.cast("double"), F.lit(0.95)) * F.coalesce(trust, F.lit(1.0))
    return F.greatest(F.least(raw, F.lit(0.95)), F.lit(0.05))


def brier(correct: Column, incorrect: Column) -> Column:
    return F.when(correct + incorrect == 0, F.lit(0.5)).otherwise(incorrect / (correct + incorrect))


def instant_of_epoch(seconds: Column) -> Column:
    """RFC 3339 text with milliseconds, null for what no clock shows."""
    fine = seconds.isNotNull() & ~F.isnan(seconds) & (F.abs(seconds) < 1e12)
    return F.when(fine, F.date_format(F.timestamp_millis(F.floor(F.when(fine, seconds) * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def instant(text: Column) -> Column:
    return F.try_to_timestamp(text)
