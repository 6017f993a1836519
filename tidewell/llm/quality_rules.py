"""Quality rules as a short-circuit cascade, ordered by rejection per cost.

Statistics are array and string expressions over a document's own words and lines, so no
row is exploded, shuffled or handed to Python.  Those that the caller wants, and those of
the base rules, are computed for every row; the others stand inside the cascade's CASE and
are computed only for rows that no rule before has rejected.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import apart, stored

#: Rows on which costs and rejections are estimated; they only set the order of rules.
SAMPLE_ROWS = 2000

_GAP = r"[\x20\x09-\x0D]+"
_GAPS = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    name: str
    fails: str  #: SQL over statistics


BASE = (
    Rule("short", "n_words < 50"),
    Rule("repetitive", "100 * n_repeat_words > 50 * n_words"),
)
RULES = (
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_dup_lines > 0 and 2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    Rule("capitals", "2 * n_capitals > word_chars"),
)
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_repeat_words")
#: Statistics as SQL over the text, for use inside the cascade, and how often each goes over the text's characters.
_LINES = r"filter(split(_q_t, '\n'), x -> x rlike r'[^\x20\x09-\x0D]')"
INLINE = {
    "word_chars": (r"char_length(regexp_replace(_q_t, r'[\x20\x09-\x0D]+', ''))", 2),
    "n_symbols": ("regexp_count(_q_t, '[#*$%&|<>]')", 1),
    "n_lines": (f"size({_LINES})", 2),
    "n_dup_lines": (f"transform(array({_LINES}), l -> size(l) - size(array_distinct(l)))[0]", 3),
    "n_capitals": ("regexp_count(_q_t, '[A-Z]')", 1),
}


def names_in(sql: str) -> set[str]:
    """Statistics that a rule reads."""
    return {name for name in STATISTICS if re.search(rf"\b{name}\b", sql)}


def _inlined(sql: str, eager: set[str]) -> Column:
    for name, (made, _) in INLINE.items():
        if name not in eager:
            sql = re.sub(rf"\b{name}\b", lambda _, made=made: f"({made})", sql)
    return F.expr(sql)


def _without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def with_statistics(docs: DataFrame, text: str = "text", only: tuple[str, ...] = STATISTICS) -> DataFrame:
    """Add the statistics named in ``only``; null text counts as empty.

    n_repeat_words marks words inside a three-word window that occurs twice or more.
    Windows are hashed to 64 bits; only documents whose hashes repeat sort them with
    their places, and neighbours in that order show which windows repeat, so the work is
    n log n however long the text is.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out, made = docs.withColumn("_q_t", t), []
    if {"n_words", "n_repeat_words"} & set(only):
        out = out.withColumn("_q_w", F.filter(F.split("_q_t", _GAP), lambda w: w != ""))
        made.append(F.size("_q_w").cast("long").alias("n_words"))
    if {"n_lines", "n_dup_lines"} & set(only):
        out = out.withColumn("_q_l", F.filter(F.split("_q_t", "\n"), lambda x: F.char_length(F.translate(x, _GAPS, "")) > 0))
        made += [F.size("_q_l").cast("long").alias("n_lines"), (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("n_dup_lines")]
    if "word_chars" in only:
        made.append(_without(F.col("_q_t"), _GAPS).cast("long").alias("word_chars"))
    if "n_symbols" in only:
        made.append((F.char_length("_q_t") - _without(F.col("_q_t"), _SYMBOLS)).cast("long").alias("n_symbols"))
    if "n_capitals" in only:
        made.append((F.char_length("_q_t") - _without(F.col("_q_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_capitals"))
    keep = list(docs.columns)
    if "n_repeat_words" not in only:
        return out.select(*keep, *made)
    made.append(F.when(F.size("_q_w") >= 3, F.expr("transform(sequence(0, size(_q_w) - 3), i -> xxhash64(_q_w[i], _q_w[i + 1], _q_w[i + 2]))")).otherwise(F.array().cast("array<bigint>")).alias("_q_h"))
    out = out.select(*keep, *made)
    stats = [c for c in out.columns if c not in (*keep, "_q_h")]
    out = out.select(*keep, *stats, F.expr("if(size(array_distinct(_q_h)) < size(_q_h), array_sort(transform(_q_h, (x, i) -> struct(x as h, i as i))), cast(array() as array<struct<h: bigint, i: int>>))").alias("_q_s"))
    out = out.select(*keep, *stats, F.expr("array_sort(transform(filter(_q_s, (e, j) -> coalesce(get(_q_s, j - 1).h = e.h, false) or coalesce(get(_q_s, j + 1).h = e.h, false)), e -> e.i))").alias("_q_p"))
    return out.select(*keep, *stats, F.expr("aggregate(transform(_q_p, (p, k) -> coalesce(least(3, get(_q_p, k + 1) - p), 3)), 0L, (a, x) -> a + x)").alias("n_repeat_words"))


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", rows: int = SAMPLE_ROWS, *, base: tuple[Rule, ...] = BASE, eager: set[str] | None = None) -> list[tuple[Rule, float, float]]:
    """Rules by rejection per cost, with both figures, from about ``rows`` rows that a hash picks.

    Rejection: the share of sampled rows, among those that pass the base rules, that the
    rule rejects.  Cost: the characters that it goes over a row beyond the statistics in
    ``eager``, which are there anyway, and one for its comparison.  Both depend on the rows
    alone, so the order is the same in each run; it changes what is computed, never which
    documents are kept.
    """
    eager = _eager(rules, base, ()) if eager is None else eager
    share = min(1.0, rows / max(1, docs.count()))
    plain = [c for c, kind in docs.dtypes if kind in ("string", "bigint", "int")]
    sample = docs.where(F.pmod(F.xxhash64(*plain), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(F.col(text))
    seen = with_statistics(sample, text, tuple(eager)).withColumn("_q_t", F.coalesce(F.col(text), F.lit("")))
    # written first: a filter would be pushed into the statistics and repeat them
    seen = stored(seen.withColumn("_q_n", F.char_length("_q_t")), "rules-sample")
    got = seen.where(~_any(base)).agg(F.avg("_q_n"), *[F.avg(_inlined(r.fails, eager).cast("double")) for r in rules]).first()
    cost = lambda r: 1 + sum(INLINE[n][1] for n in names_in(r.fails) - eager) * (got[0] or 0.0)
    found = [(r, got[i + 1] or 0.0, cost(r)) for i, r in enumerate(rules)]
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def _any(rules: tuple[Rule, ...]) -> Column:
    return F.expr(" or ".join(f"({r.fails})" for r in rules) or "false")


def _eager(rules: tuple[Rule, ...], base: tuple[Rule, ...], wanted: tuple[str, ...]) -> set[str]:
    """Statistics for every row: those wanted, those of the base rules and those that can't stand inside a CASE."""
    return {*wanted}.union(*(names_in(r.fails) for r in base), *(names_in(r.fails) - INLINE.keys() for r in rules))


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, text: str = "text", base: tuple[Rule, ...] = BASE, statistics: tuple[str, ...] = STATISTICS) -> DataFrame:
    """Add ``statistics``, base_failed, failed_rule and kept to ``docs``.

    A row that fails a base rule is not kept.  Others meet ``rules`` one after another in
    the order of order_rules(), as one CASE expression that stops at the first failure
    (failed_rule); statistics that are not asked for are computed there, for the rows that
    get so far.  Null or empty text has no words and fails the base; long texts are gone
    over as a whole.  Columns of ``docs`` with the names made here are replaced, all others
    stay; each input row, repeated or not, gives one row, an empty table none.
    """
    made = [*statistics, "base_failed", "failed_rule", "kept"]
    docs, names = apart(docs)
    eager = _eager(rules, base, statistics)
    out = with_statistics(docs, names[text], tuple(eager)).withColumn("base_failed", _any(base)).withColumn("_q_t", F.coalesce(F.col(names[text]), F.lit("")))
    case = F.when(F.col("base_failed"), F.lit("base"))
    for rule, _, _ in order_rules(docs, rules, names[text], base=base, eager=eager):
        case = case.when(_inlined(rule.fails, eager), F.lit(rule.name))
    out = out.withColumn("failed_rule", case).withColumn("kept", F.col("failed_rule").isNull())
    return out.select(*[F.col(c).alias(name) for name, c in names.items() if name not in made], *made)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return quality_cascade(docs, statistics=columns).select("doc_id", *columns, "base_failed", "kept")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM b WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM k, (VALUES (0), (1), (2)) o(j) WHERE c > 1 GROUP BY doc_id),
s AS (
  SELECT b.doc_id, len(w) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM b LEFT JOIN r ON r.doc_id = b.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
       OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR 2 * n_capitals > word_chars) AS kept
FROM f
"""
