"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import apart, stored

#: Words of a block at most, words that a shard aims at, and the most (source, shard) quotas.
BLOCK_WORDS, SHARD_WORDS, MOST_QUOTAS = 256, 200_000, 400_000
#: Blocks that the smallest target is at least cut into.
LEAST_BLOCKS = 16
#: A document is repeated this many times at most.
REPEATS = 3
SEED = 20240607
MADE = ("size", "source_size", "target", "taken", "whole", "cuts")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shared_targets(sizes: list[int], weights: list[float], most: float = REPEATS) -> list[float]:
    """Targets that share the sum of sizes by weight, none above ``most`` times its size.

    What a full source leaves is shared again by weight among the others until none is above.
    """
    total, full = float(sum(sizes)), [False] * len(sizes)
    out = [0.0] * len(sizes)
    left = total
    while True:
        open_ = [i for i in range(len(sizes)) if not full[i]]
        weight = sum(weights[i] for i in open_)
        if not open_ or weight <= 0:
            return out
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight
            return out
        for i in over:
            out[i], full[i] = float(most * sizes[i]), True
            left -= out[i]


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotient votes / (2 * held + 1), at most ``most`` each; ties to the first.

    A divisor found by halving gives nearly all seats at once; the heap deals the rest one by one.
    """
    votes, most = np.asarray(votes, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[votes > 0].sum()))
    held = np.zeros(len(votes), np.int64)
    if seats <= 0:
        return held
    give = lambda d: np.minimum(np.floor(votes / d + 0.5), most).astype(np.int64)
    low, high = 0.0, 2.0 * float(votes.max()) + 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if give(mid).sum() <= seats:
            high, held = mid, give(mid)
        else:
            low = mid
    heap = [(-votes[i] / (2 * held[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and held[i] < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(held.sum())):
        _, i = heapq.heappop(heap)
        held[i] += 1
        if held[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * held[i] + 1), i))
    return held


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), text: str = "text", source: str = "source", key: str = "doc_id", block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Add size, source_size, target, taken, whole and cuts to ``docs``.

    Sources, by code point with null last, take ``weights`` in turn and share the sum of
    all sizes; a target stops at three times its source's size.  Documents go to shards
    by a hash of their id.  Sainte-Laguë gives each source whole blocks of equal length,
    then divides a source's blocks among its shards in the same way.  In a shard the
    source's documents stand in seeded order and are cut into equal blocks; a quota takes
    all blocks as often as it can and the rest as a run of blocks from a seeded start.

    ``taken``: words that the mix takes, repeats counted; ``whole``: how often all of the
    document is taken; ``cuts``: word ranges [from, to) that are taken once more.  No
    document is taken more than three times.  The same rows give the same mix.

    A block has ``block_words`` words, fewer where the smallest target would else have less
    than LEAST_BLOCKS of them, so that small sources come near their targets too.

    Null or empty text has size 0 and is never taken; a null source is a source; rows with
    null ids go to shards by their text; repeated rows count as rows of their own; an empty
    table gives an empty one.  Columns with the names made here are replaced, all others
    stay.  The driver sees one number a source and shard, at most MOST_QUOTAS of them; more
    than half as many sources are an error, found before any number is fetched.
    """
    docs, names = apart(docs)
    sized = sized_rows(docs, text=names[text], key=names[key], seed=seed)
    out = _mixed(sized, weights, names[source], block_words, seed)
    return out.select(*[F.col(c).alias(name) for name, c in names.items() if name not in MADE], *MADE)


def sized_rows(docs: DataFrame, *, text: str = "text", key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``docs`` with size, the hash that deals rows to shards and the seeded order."""
    by = F.when(F.col(key).isNotNull(), F.xxhash64(F.col(key), F.lit(seed))).otherwise(F.xxhash64(F.lit(seed), F.col(text)))
    rows = docs.withColumn("size", n_words(F.col(text))).withColumn("_m_h", by)
    return rows.withColumn("_m_o", F.xxhash64(F.col("_m_h"), F.col(text)))


def _mixed(sized: DataFrame, weights: tuple[float, ...], source: str, block_words: int, seed: int) -> DataFrame:
    spark = sized.sparkSession
    per = stored(sized.groupBy(F.col(source).alias("s")).agg(F.sum("size").alias("n")), "mix-sources")
    if per.count() > MOST_QUOTAS // 2:
        raise ValueError(f"more than {MOST_QUOTAS // 2} sources")
    per = sorted(per.collect(), key=lambda r: (r.s is None, (r.s or "").encode("utf-32-be")))
    sizes = [int(r.n) for r in per]
    targets = shared_targets(sizes, [weights[i % len(weights)] for i in range(len(per))])
    shards = max(1, min(sum(sizes) // SHARD_WORDS, MOST_QUOTAS // max(1, len(per))))
    block_words = max(1, min(block_words, int(min([t for t in targets if t > 0], default=1)) // LEAST_BLOCKS))
    table = spark.createDataFrame([(i, r.s, sizes[i], targets[i]) for i, r in enumerate(per)], "_m_i int, _m_s string, source_size long, target double")
    rows = sized.join(F.broadcast(table), F.col(source).eqNullSafe(F.col("_m_s"))).drop("_m_s").withColumn("_m_k", F.pmod("_m_h", F.lit(shards)).cast("int"))
    cells = rows.groupBy("_m_i", "_m_k").agg(F.sum("size").alias("n")).where("n > 0").collect()
    cells.sort(key=lambda r: (r._m_i, r._m_k))
    quotas = _quotas(cells, targets, block_words, seed)
    plan = spark.createDataFrame(quotas or [(-1, -1, 1, 0, 0, 0)], "_m_i int, _m_k int, _m_n long, _m_whole long, _m_from long, _m_to long")
    rows = rows.join(F.broadcast(plan), ["_m_i", "_m_k"], "left")
    w = Window.partitionBy("_m_i", "_m_k").orderBy("_m_o", "_m_h", "size")
    rows = rows.withColumn("_m_at", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    # The run [from, to) may pass the end of the shard and go on at its start.
    cut = lambda lo, hi: F.struct(F.greatest(F.lit(0).cast("long"), lo - F.col("_m_at")).alias("start"), F.least(F.col("size"), hi - F.col("_m_at")).alias("end"))
    none = F.lit(0).cast("long")
    lo, hi, n = F.coalesce("_m_from", none), F.coalesce("_m_to", none), F.coalesce("_m_n", none)
    rows = rows.withColumn("cuts", F.filter(F.array(cut(none, hi - n), cut(lo, F.least(hi, n))), lambda c: c["end"] > c["start"]))
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.coalesce("_m_whole", none)).otherwise(none))
    rows = rows.withColumn("taken", F.col("whole") * F.col("size") + F.aggregate("cuts", none, lambda a, c: a + c["end"] - c["start"]))
    return rows.drop(*[c for c in rows.columns if c.startswith("_m_")])


def _quotas(cells: list, targets: list[float], block: int, seed: int) -> list[tuple]:
    """(source, shard, words, whole, from, to) of each cell; from its words and the sources' targets."""
    if not cells:
        return []
    src = np.array([r._m_i for r in cells])
    words = np.array([r.n for r in cells], np.int64)
    blocks = np.maximum(1, (words + block // 2) // block)
    out, goal = np.zeros(len(cells), np.int64), np.array(targets)
    per_source = np.bincount(src, blocks, len(goal)).astype(np.int64)
    seats = sainte_lague(goal, round(goal.sum() / block), REPEATS * per_source)
    for i in np.unique(src):
        at = np.flatnonzero(src == i)
        # A source of a few short shards has blocks of another length than most.
        n = round(seats[i] * block / (words[at].sum() / blocks[at].sum()))
        out[at] = sainte_lague(words[at], n, REPEATS * blocks[at])
    made = []
    for j, r in enumerate(cells):
        whole, rest = divmod(int(out[j]), int(blocks[j]))
        at = (seed * 0x9E3779B1 + r._m_i * 7919 + r._m_k * 104729) % int(blocks[j])
        edge = lambda b, j=j: int(words[j]) * b // int(blocks[j])
        end = at + rest
        made.append((r._m_i, r._m_k, int(words[j]), whole, edge(at), edge(end) if end <= blocks[j] else int(words[j]) + edge(end - int(blocks[j]))))
    return made


def mixed_documents(docs: DataFrame, *, weights: tuple[float, ...] = (1, 2, 3), text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix itself: ``docs`` with each document as often, and with those words, as taken.

    Whole copies keep their text; a cut holds the text from its first word to its last.
    All columns stay, whatever their names; n_chars, where there is one, follows the text.
    See mix_sources() for null and empty values, repeated rows and empty tables.
    """
    docs, names = apart(docs)
    mixed = mix_sources(docs, weights=weights, text=names[text], source=names[source], key=names[key])
    copies = F.when(F.col("whole") > 0, F.array_repeat(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")), F.col("whole").cast("int"))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    spans = mixed.withColumn("span", F.explode(F.concat(copies, F.col("cuts"))))
    t, lo, hi = F.col(names[text]), F.col("span.start"), F.col("span.end")
    words = F.split(F.regexp_replace(t, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?![\x20\x09-\x0D])")
    part = F.array_join(F.slice(words, (lo + 1).cast("int"), (hi - lo).cast("int")), "")
    spans = spans.withColumn(names[text], F.when((lo == 0) & (hi == F.col("size")), t).otherwise(part))
    if "n_chars" in names:
        spans = spans.withColumn(names["n_chars"], F.char_length(names[text]).cast(docs.schema[names["n_chars"]].dataType))
    return spans.select(*[F.col(c).alias(name) for name, c in names.items()])


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    # Sizes are written once, without the text, as three steps read them.
    sized = stored(sized_rows(docs).drop("text"), "mix-sizes")
    return _mixed(sized, (1, 2, 3), "source", BLOCK_WORDS, SEED).select("doc_id", "size", "source_size", "target", "taken")
