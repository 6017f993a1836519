"""Source divergence audit: how far each source's words stand from the other sources of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import partitions, stored

#: Runs of ASCII letters and of anything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents of a language that keep a term, the unit of a share, and the ranks of part ``term``.
LEAST_DOCUMENTS, UNIT, RANKS = 3, 1_000_000_000, 200
#: Groups up to which their table is broadcast (about 100 bytes each); beyond, it is dealt by salted language.
BROADCAST_GROUPS = 20_000


def terms(text: Column) -> Column:
    """All terms of a text, in order of their bytes, with only A to Z lower-cased."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, CAPITALS.lower()))
    return F.sort_array(F.regexp_extract_all(low, F.lit(TERM), F.lit(0)))


def group_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, d documents) of ``docs`` (lang, source, text).

    The terms of a document stand sorted, so one is counted as a document's first where it
    differs from the one before; both counts come from one aggregation.
    """
    rows = docs.select("lang", "source", terms(F.col("text")).alias("terms"))
    pair = F.arrays_zip(F.col("terms").alias("term"), F.concat(F.array(F.lit("")), F.col("terms")).alias("before"))
    rows = rows.select("lang", "source", F.inline(pair).alias("term", "before")).where("term is not null")
    return rows.groupBy("lang", "source", "term").agg(F.count("*").alias("n"), F.count_if(F.col("term") != F.col("before")).alias("d"))


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + kept)), exact for any long."""
    wide = f"(cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({total} + {kept} as decimal(20,0))"
    return F.expr(f"1 + case when {count} < 9000000000 then {UNIT} * ({count} + 1) div ({total} + {kept}) else {wide} end")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _with_groups(rows: DataFrame, groups: DataFrame, n_groups: int, deal: list[str]) -> DataFrame:
    """``rows`` with each group of their language: broadcast if few, else dealt by language and salt, so that no language is one task's."""
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), "lang")
    salts = partitions(rows.sparkSession)
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(*deal), F.lit(salts)).cast("int")).join(salted, ["lang", "_salt"]).drop("_salt")


def source_audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): divergence of every (lang, source) group.

    A language keeps the V terms that at least ``least`` of its documents have.  A group, and
    each language, gives every kept term the share p = 1 + floor(UNIT * (count + 1) / (N + V)),
    where N sums its counts of kept terms.  Part ``pair``: for each other source of the
    language, with shares q, the sum of floor((p - q)^2 / q) over all kept terms, all ranks.
    Part ``term``: for each kept term that the group has and whose p is above the language's
    q, floor((p - q)^2 / q), to rank ``ranks``.  Ranks begin at 1, values descend, ties go by
    the item's bytes.

    Matches are exploded and counted by group (combined before the shuffle), kept terms meet
    the language's groups so that terms without a count have a row too, and this dense table
    is joined with itself by (lang, term).  It has V rows a group and V / 2 for each pair of
    sources, dealt by term, so neither a hot language nor a hot source gathers in a task.

    Null text, lang and source are read as ''.  A group without terms has count 0 of each
    kept term; with V = 0 all its pairs have value 0; a language of one source has no pairs.
    Repeated rows are documents of their own.  An empty table gives an empty one.  Other
    columns, whatever their names, are not read.  A task holds the terms of one text at a
    time, about 100 bytes each.
    """
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    read = docs.select(empty(lang, "lang"), empty(source, "source"), empty(text, "text"))
    by_term = Window.partitionBy("lang", "term")
    kept = group_counts(read).select("lang", "source", "term", "n", F.sum("d").over(by_term).alias("d"), F.sum("n").over(by_term).alias("in_lang"), (F.row_number().over(by_term.orderBy("source")) == 1).alias("first"))
    kept = stored(kept.where(F.col("d") >= least).drop("d"), "audit-terms")

    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.sum("n").alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = read.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = stored(groups, "audit-groups")
    n_groups = groups.count()

    # Zeros and counts meet in one aggregation, dealt by (lang, term) as the join of the dense table with itself asks for.
    zeros = _with_groups(kept.where("first").select("lang", "term"), groups.where("v > 0").select("lang", "source", "total", "v"), n_groups, ["term"]).withColumn("n", F.lit(0).cast("long"))
    both = zeros.unionByName(kept.select("lang", "term", "source", "n"), allowMissingColumns=True).repartition("lang", "term")
    dense = both.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.max("total").alias("total"), F.max("v").alias("v"))
    dense = dense.select("lang", "term", "source", _share("n", "total", "v").alias("p"))

    one, two = dense, dense.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"))
    sums = one.join(two, ["lang", "term"]).where("source < other").groupBy("lang", "source", "other").agg(F.sum(_apart("p", "q")).alias("there"), F.sum(_apart("q", "p")).alias("back"))
    ways = F.array(F.struct("source", F.col("other").alias("item"), F.col("there").alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    pairs = sums.select("lang", F.inline(ways))
    bare = groups.where("v = 0").select("lang", "source")
    pairs = pairs.unionByName(bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long")))

    own = kept.join(F.broadcast(groups) if n_groups <= BROADCAST_GROUPS else groups, ["lang", "source"])
    own = own.select("lang", "source", F.col("term").alias("item"), _share("n", "total", "v").alias("p"), _share("in_lang", "lang_total", "v").alias("q")).where("p > q")
    own = own.select("lang", "source", "item", _apart("p", "q").alias("value"))

    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", ranked)
    return named(pairs, "pair").unionByName(named(own, "term").where(F.col("rank") <= ranks))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row_id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
held AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (
  SELECT x.lang, x.source, coalesce(s.total, 0) AS total, coalesce(l.v, 0) AS v, coalesce(l.total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM held GROUP BY lang, source) s USING (lang, source)
  LEFT JOIN langs l USING (lang)),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 1)) // (g.total + g.v) AS HUGEINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (k.n + 1)) // (g.lang_total + g.v) AS HUGEINT) AS q
  FROM g JOIN kept k USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
own AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM dense WHERE n > 0 AND p > q),
r AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS k FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM own)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM r WHERE part = 'pair' OR k <= 200
"""
