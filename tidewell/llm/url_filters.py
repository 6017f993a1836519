"""URL filters: rules by host and path, and a list of URLs behind a blocked Bloom filter.

Everything is a DataFrame expression or join; nothing leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import apart


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

#: Labels of junk hosts, whose pages are on the block list of the queries; some are on hosts that no rule decides.
JUNK_LABELS = ("ads-track", "spam-farm", "adult-x", "casino-win", "cheap-pills", "free-bets")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path as written; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without slashes at its end, and query without ``utm_`` and ``ref`` fields."""
    query = F.regexp_replace(F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit("")), r"(?<=[?&])(utm_[^&=]*|ref)(=[^&]*)?(&|$)", "")
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), F.regexp_replace(query, "[?&]+$", ""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Longest rule (then least text) that fits, as struct(rule, verdict), or null.

    Rules are configuration: a few hundred at most, tried from the longest down.
    """
    tries = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ]
    return F.coalesce(*tries) if tries else F.lit(None).cast("struct<rule:string,verdict:string>")


def _probe(key: Column, blocks: int, bits: int) -> tuple[Column, Column]:
    """Block number and the bits a key sets in its 64-bit block."""
    h = F.xxhash64(key)
    mask = F.lit(0).cast("long")
    for k in range(bits):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * k).bitwiseAND(63).cast("int")))
    return F.pmod(F.xxhash64(h, F.lit(17)), F.lit(blocks)).cast("int"), mask


def bloom_blocks(keys: DataFrame, key: str, blocks: int = 1 << 16, bits: int = 5) -> DataFrame:
    """(block int, word long): the filter, at most ``blocks`` rows whatever the list holds."""
    block, mask = _probe(F.col(key), blocks, bits)
    return keys.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def parted(rows: DataFrame, keys: DataFrame, key: str, most: int = 1 << 20, bits: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows whose long column ``key`` is surely none of ``keys`` (same column), and the others.

    The filter has at most ``most`` words, so its size is bounded; rows that it settles need
    no shuffle.  Null keys are among the first.
    """
    blocks = min(most, 1 << max(10, (keys.count() // 4).bit_length()))
    block, mask = _probe(F.col(key), blocks, bits)
    words = F.broadcast(bloom_blocks(keys, key, blocks, bits).select(F.col("block").alias("_p_b"), F.col("word").alias("_p_w")))
    tested = rows.withColumn("_p_b", block).join(words, "_p_b", "left").withColumn("_p_m", F.coalesce(F.col("_p_w").bitwiseAND(mask) == mask, F.lit(False)))
    kept = lambda x: x.drop("_p_b", "_p_w", "_p_m").select(*rows.columns)
    return kept(tested.where(~F.col("_p_m"))), kept(tested.where("_p_m"))


def url_filter(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES, *, url: str = "url", blocks: int = 1 << 16, bits: int = 5) -> DataFrame:
    """Add host, path, rule and verdict to ``pages``; its other columns stay.

    A fitting rule decides.  Else the page is blocked if its canonical URL is that of a
    row of ``listed`` (column ``url``), and allowed if not.  The list goes into a blocked
    Bloom filter: one 64-bit word a block, ``blocks`` words in all, so that what is
    broadcast has a fixed size however long the list is.  Pages that the filter passes go
    on to an exact hash join with the list, which removes false positives; all others are
    decided in the scan, without a shuffle.

    A null or malformed URL has an empty host and path, fits no rule, is never on the
    list and is allowed.  Repeated pages and repeated list entries do not multiply rows.
    An empty list or empty ``pages`` give what the rules alone give.  Columns of ``pages``
    called host, path, rule or verdict are replaced; all others stay, whatever their names.
    A URL is looked at as a whole, however long; what is kept of it besides is of its length.
    """
    pages, names = apart(pages)
    keys = listed.select(canonical(F.col("url")).alias("_url_key")).where("_url_key <> ''").distinct()
    u = F.col(names[url])
    made = pages.withColumn("_url_h", host_of(u)).withColumn("_url_p", path_of(u))
    made = made.withColumn("_url_r", best_rule(F.col("_url_h"), F.col("_url_p"), rules)).withColumn("_url_key", canonical(u))
    block, mask = _probe(F.col("_url_key"), blocks, bits)
    made = made.withColumn("_url_b", F.when(F.col("_url_r").isNull() & (F.col("_url_key") != ""), block)).withColumn("_url_m", mask)
    tested = made.join(F.broadcast(bloom_blocks(keys, "_url_key", blocks, bits)).withColumnRenamed("block", "_url_b").withColumnRenamed("word", "_url_w"), "_url_b", "left")
    maybe = F.coalesce(F.col("_url_w").bitwiseAND(F.col("_url_m")) == F.col("_url_m"), F.lit(False))
    sure = tested.where(~maybe).withColumn("_url_v", F.lit("allow"))
    found = keys.withColumn("_url_hit", F.lit(True))
    hits = tested.where(maybe).join(found.hint("shuffle_hash"), "_url_key", "left").withColumn("_url_v", F.when(F.col("_url_hit"), "block").otherwise("allow")).drop("_url_hit")
    rest = [F.col(c).alias(name) for name, c in names.items() if name not in ("host", "path", "rule", "verdict")]
    return sure.unionByName(hits).select(
        *rest,
        F.col("_url_h").alias("host"),
        F.col("_url_p").alias("path"),
        F.col("_url_r.rule").alias("rule"),
        F.coalesce(F.col("_url_r.verdict"), F.col("_url_v")).alias("verdict"),
    )


def listed_urls(pages: DataFrame, labels: Sequence[str] = JUNK_LABELS) -> DataFrame:
    """The query's block list: URLs of pages on hosts with a listed label."""
    return pages.where(host_of(F.col("url")).rlike(r"(^|\.)(" + "|".join(labels) + r")\.")).select("url")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


def op3_junk_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the list of all junk hosts named; some of its pages no rule fits, and the list blocks them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, listed_urls(pages, JUNK_LABELS)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
best AS (
  SELECT page_id, rhost || rpath AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM p JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)),
c AS (
  SELECT page_id, host,
    host || regexp_replace(path, '/+$', '') || regexp_replace(regexp_replace(regexp_replace(query, '(utm_[^&=]*|\bref)=[^&]*(&|$)', '', 'g'), '&+$', ''), '[?&]+$', '') AS key
  FROM p),
l AS (SELECT DISTINCT key FROM c WHERE regexp_matches(host, '(^|\.)(ads-track|spam-farm|adult-x|casino-win|cheap-pills|free-bets)\.'))
SELECT p.page_id, p.host, p.path, best.rule,
  coalesce(best.verdict, CASE WHEN c.key <> '' AND c.key IN (SELECT key FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM p JOIN c USING (page_id) LEFT JOIN best ON best.page_id = p.page_id AND best.k = 1
"""
JUNK_ORACLE = ORACLE
