"""Exact set-similarity joins over blocks of coded sets, and vector search."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tidewell.functions.scores import cosine
from tidewell.operators import setjoin as X

#: Vectors of a block, pivots that distances are taken to, and rows and columns of a product of matrices.
BLOCK, PIVOTS, ROWS, COLUMNS = 1 << 14, 6, 256, 4096


def containment_pairs(left: DataFrame, right: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """(by, a, b, overlap) where a share ``threshold`` or more of a left set's words is in a right set of the same group.

    left, right: id, words and the columns ``by``.  Rows of a side and group with the same id
    hold the same set and count once.  Sets go to their tasks as codes, not as words.
    """
    pairs = X.met(*_containment(left, right, threshold, by), once=True)
    return pairs.select(*by, "a", "b", (F.col("inter") / F.col("na")).alias("overlap"))


def _containment(left: DataFrame, right: DataFrame, threshold: float, by: list[str], numbers: DataFrame | None = None, groups: DataFrame | None = None, *, others: bool = False) -> tuple:
    """Both sides coded, and how they meet, in ``groups`` (by) if there are any.  ``numbers`` (by, id, number) take the place of ids, ``others``: sets of one id do not meet, and of the right ones the least name stays."""
    sizes, count = X.blocks_of(left, right, by, groups=groups)
    known = X.known_words(right, count)

    def once(x: DataFrame) -> DataFrame:
        sets = X.encoded(x, by, known, once=True)
        if numbers is None:  # equal ids are in one block, which takes them once
            return sets
        sets = sets.groupBy(*by, "id").agg(*[F.first(c).alias(c) for c in ("n", "codes", "rare")])
        return sets.join(numbers, [*by, "id"]).drop("id").withColumnRenamed("number", "id")

    share = lambda inter, na: inter / na >= threshold
    keep = (lambda inter, na, nb, a, b: share(inter, na) & (b != a)) if others else (lambda inter, na, nb, a, b: share(inter, na))
    need = lambda n: np.ceil(n * threshold - 1e-9).astype(np.int64)
    return once(left), once(right), by, sizes, keep, need, lambda n: (need(n), np.full(len(n), np.iinfo(np.int64).max))


def least_containing(left: DataFrame, right: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """(by, a, least): for each left set the least ``name`` of a right set of another id that containment_pairs() has with it.

    What goes on from a task is a row a left set and block, however many sets it is in.
    """
    return X.met_least(*_containment(left, right, threshold, by, others=True))


def containing_lists(left: DataFrame, right: DataFrame, threshold: float, by: list[str], numbers: DataFrame, groups: DataFrame) -> DataFrame:
    """(by, a, found): containment_pairs() of different ids in ``groups`` (by), as ``numbers`` (by, id, number) has them, the right ones packed for setjoin.listed()."""
    return X.met_lists(*_containment(left, right, threshold, by, numbers, groups, others=True))


def jaccard_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of a < b with at least ``threshold``.

    Of two sets the smaller one, of n words, has at least 2 t n / (1 + t) of them in common,
    so each pair is looked for from its smaller set, by id where they are as large.
    """
    sizes, count = X.blocks_of(sets, sets, [])
    coded = X.encoded(sets, [], X.known_words(sets, count))
    keep = lambda inter, na, nb, a, b: (inter / (na + nb - inter) >= threshold) & ((nb > na) | (nb == na) & (b > a))
    need = lambda n: np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64)
    pairs = X.met(coded, coded, [], sizes, keep, need, lambda n: (n, n / threshold + 1e-6))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))).alias("jaccard"))


def top_by_cosine(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """The k rows (vec_id, embedding) nearest to the one row of ``query`` (q), ties to the smaller id, with rank."""
    scored = vectors.join(F.broadcast(query)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    top = scored.orderBy(F.desc("score"), "vec_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).cast("long"))


def near_vectors(left: DataFrame, right: DataFrame, threshold: float, by: list[str], pivots: int = PIVOTS) -> DataFrame:
    """(by, a, b, cosine) of vectors in the same group with a cosine of at least ``threshold``, which is above 0.

    left, right: id, embedding and the columns ``by``.  Unit vectors that near are at most
    r = sqrt(2 - 2 threshold) apart, so by the triangle inequality their distances to any
    pivot differ by r at most; blocks of vectors meet, each a few rows at a time with the
    range of the other block that this bound leaves.  Pivots are a few of the right vectors;
    vectors of other lengths than theirs, which no bound is known for, meet by length.

    Null vectors, those of zeros and those with null or non-finite components are near to none.
    """

    def fine(x: DataFrame) -> DataFrame:
        e = F.col("embedding")
        ok = e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
        return x.where(ok & F.exists(e, lambda v: v != 0))

    some = [r.embedding for r in fine(right).select("embedding", F.xxhash64("id").alias("h")).orderBy("h").limit(pivots).collect()]
    some = np.array([p for p in some if len(p) == len(some[0])], np.float64)
    return _vector_pairs(fine(left), fine(right), threshold, by, some, same=False)


def cosine_pairs(vectors: DataFrame, threshold: float, by: str) -> DataFrame:
    """(a, b, cosine) of a < b in the same group ``by``, at least ``threshold``; norms are computed once.

    A group is cut into blocks of about BLOCK vectors, and each two blocks meet in a task of
    their own, so that no task compares a whole group with itself.
    """
    v = vectors.select(F.col("vec_id").alias("id"), F.col(by).alias("_by"), "embedding").where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull()))
    return _vector_pairs(v, v, threshold, ["_by"], np.zeros((0, 0)), same=True).select("a", "b", "cosine")


def _vector_pairs(left: DataFrame, right: DataFrame, threshold: float, by: list[str], pivots: np.ndarray, *, same: bool) -> DataFrame:
    """(by, a, b, cosine) of two sides, or of one side with itself (``same``), where a < b."""
    for c in by:
        left, right = left.where(F.col(c).isNotNull()), right.where(F.col(c).isNotNull())
    kind = "array<float>" if {x.schema["embedding"].dataType.elementType.typeName() for x in (left, right)} == {"float"} else "array<double>"
    keys = [*by, "dims"]
    left, right = (x.select("id", *by, F.size("embedding").alias("dims"), F.col("embedding").cast(kind).alias("e")) for x in (left, right))
    sizes, _ = X.blocks_of(left, right, keys, BLOCK)
    a, b = X.dealt(left, right, keys, sizes, same=same)
    ids = [left.schema["id"].dataType, right.schema["id"].dataType]
    schema = StructType([left.schema[c] for c in by]).add("a", ids[0]).add("b", ids[1]).add("cosine", DoubleType())

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {c: [] for c in (*by, "a", "b", "cosine")}
        others = dict(iter(two.groupby("group", sort=False)))
        for group, mine in one.groupby("group", sort=False):
            if group not in others or not (got := _near(mine, others[group], threshold, pivots)):
                continue
            x, y, cos = [np.concatenate(c) for c in zip(*got, strict=True)]
            if same:
                swap = x > y
                keep = (x != y) & ~swap if mine["block_a"].iloc[0] == mine["block_b"].iloc[0] else np.ones(len(x), bool)
                x, y, cos = np.where(swap, y, x)[keep], np.where(swap, x, y)[keep], cos[keep]
            for c, v in ((*((c, np.repeat(mine[c].to_numpy()[:1], len(cos))) for c in by), ("a", x), ("b", y), ("cosine", cos))):
                found[c].append(v)
        return pd.DataFrame({c: np.concatenate(v) for c, v in found.items()}) if found["a"] else pd.DataFrame(columns=schema.names, dtype=object)

    return X.together(a, b, [*keys, "block_a", "block_b"], compare, schema)


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in order of the components."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[:, d]
    return out


@np.errstate(all="ignore")
def _near(one: pd.DataFrame, two: pd.DataFrame, threshold: float, pivots: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and cosines of near vectors of two blocks.  A product of matrices, which sums in another order, finds them with a margin."""
    sides = []
    for frame in (one, two):
        e = np.stack(frame["e"].to_numpy()).astype(np.float64) if len(frame["e"].iloc[0]) else np.zeros((len(frame), 0))
        norm = np.sqrt(_dots(e, e))
        # NaN compares as greater than all numbers, as it does in SQL.
        ok = (norm > 0) | np.isnan(norm)
        e, norm, ids = e[ok], norm[ok], frame["id"].to_numpy()[ok]
        unit = np.where(np.isfinite(norm)[:, None], e / norm[:, None], np.nan)
        far = np.zeros((len(e), 0))
        if len(pivots) and pivots.shape[1] == e.shape[1]:
            p = pivots / np.sqrt((pivots * pivots).sum(1))[:, None]
            far = np.sqrt(np.maximum(0.0, 2 - 2 * (unit @ p.T)))
            order = np.argsort(far[:, 0], kind="stable")
            e, norm, ids, unit, far = e[order], norm[order], ids[order], unit[order], far[order]
        sides.append((e, norm, ids, unit, far))
    (e, norm, ids, unit, far), (f, norm2, ids2, unit2, far2) = sides
    r = math.sqrt(2 - 2 * threshold) + 1e-6
    out = []
    for i in range(0, len(e), ROWS):
        rows = slice(i, i + ROWS)
        near = np.arange(len(f))
        if far.shape[1] and far2.shape[1]:
            low, high = far[rows].min(0) - r, far[rows].max(0) + r
            near = near[slice(*np.searchsorted(far2[:, 0], [low[0], high[0]]))]
            near = near[((far2[near] >= low) & (far2[near] <= high)).all(1)]
        for j in range(0, len(near), COLUMNS):
            some = near[j : j + COLUMNS]
            x, y = np.nonzero(~(unit[rows] @ unit2[some].T < threshold - 1e-9))
            x, y = x + i, some[y]
            cos = _dots(e[x], f[y]) / (norm[x] * norm2[y])
            keep = ~(cos < threshold)
            if keep.any():
                out.append((ids[x[keep]], ids2[y[keep]], cos[keep]))
    return out
