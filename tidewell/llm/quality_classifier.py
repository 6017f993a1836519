"""Quality scores: random Fourier features of document statistics, ridge and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import apart, chunks, frugal, span_hashes, stored, word_spans
from tidewell.llm.ngram_join import shingle_sets
from tidewell.llm.url_filters import parted

#: Labelled rows that the model is fitted on at most; a hash of the id picks them, evenly.
MOST_LABELLED = 400_000
#: Random features, width of the kernel over the root of the number of statistics, ridge a row, tasks of the fit.
FEATURES, WIDTH, RIDGE, TASKS = 256, 1.0, 1e-4, 16
#: Steps of the raw score that calibration tells apart, and the score from which a document is good.
STEPS, GOOD = 4096, 0.7
SEED = 11

_CLASSES = 16
_CLASS = np.full(256, 15, np.int64)  # other ASCII characters
_CLASS[0x80:] = 14
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"'\"()-", b"#*", b"$%&", b"|", b"<>{}[]=/\\", b"@_~^`+")):
    _CLASS[list(_chars)] = _i


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row a text: sizes, shares of kinds of bytes and words, repetition.  Nothing else about it is read."""
    n = len(off) - 1
    size = np.diff(off)
    per = lambda at, weights=None: np.bincount(at, weights, n).astype(float)
    own = np.repeat(np.arange(n), size)
    kinds = np.bincount(own * _CLASSES + _CLASS[raw], minlength=n * _CLASSES).reshape(n, _CLASSES)
    starts, ends = word_spans(raw, off)
    doc = own[starts]
    length = ends - starts
    words = per(doc)
    some, many = np.maximum(words, 1), np.maximum(size, 1)
    first, last = _CLASS[raw[starts]], _CLASS[raw[ends - 1]]
    # lines
    edge = np.concatenate([off[:-1][size > 0], np.flatnonzero(raw == 10) + 1])
    edge = np.unique(edge[edge < len(raw)])
    stop = np.append(edge[1:], len(raw))
    stop = np.minimum(stop, off[1:][own[edge]] if len(edge) else stop)
    line = span_hashes(raw, edge, stop)
    line_doc = own[edge]
    order = np.lexsort((line, line_doc))
    again = np.zeros(len(line), bool)
    again[1:] = (line[order][1:] == line[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    lines = per(line_doc)
    distinct = [np.diff(shingle_sets(raw, off, k)[1]) for k in (1, 3)]
    sums = per(doc, length)
    columns = [
        np.log1p(size), np.log1p(words), sums / some, np.sqrt(np.maximum(per(doc, length.astype(float) ** 2) / some - (sums / some) ** 2, 0)),
        np.log1p(lines), np.log1p(words / np.maximum(lines, 1)), per(line_doc[order][again]) / np.maximum(lines, 1),
        distinct[0] / some, distinct[1] / np.maximum(words - 2, 1),
        per(doc[length <= 3]) / some, per(doc[length >= 13]) / some,
        per(doc[first == 1]) / some, per(doc[last >= 5]) / some, per(doc[last == 5]) / some, per(doc[(first >= 2) & (first < 14)]) / some,
        *(kinds / many[:, None]).T,
    ]
    return np.stack(columns, 1)


N_STATISTICS = 15 + _CLASSES


def document_statistics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text_hash, x array<double>) of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in chunks(batches):
            x = statistics(raw, off)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["doc_id", "text_hash", "x"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), _hash(text).alias("text_hash"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, text_hash long, x array<double>")


def _hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  #: of the random features and of 1
    knots: np.ndarray  #: raw scores, ascending
    values: np.ndarray  #: calibrated scores there

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, 1 / (WIDTH * np.sqrt(x.shape[1])), (x.shape[1], FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Ascending values nearest to y at ascending x, by pooling neighbours that violate the order."""
    blocks: list[list[float]] = []
    for value, weight in zip(y, w, strict=True):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, k = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * n) / (blocks[-1][1] + n), blocks[-1][1] + n, blocks[-1][2] + k]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fold_of(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)).cast("int")


def fit(x: DataFrame, labels: DataFrame, *, label: str = "quality", held_out: int = 2, most: int = MOST_LABELLED) -> Model:
    """Model from document_statistics() and labels (doc_id, ``label``) outside the fold ``held_out``.

    Each task sums Z'Z and Z'y of its rows, fold by fold; the driver adds TASKS such sums
    of a fixed size and solves for ridge weights: one set for each fold left out, whose
    scores are what calibration sees, and one from all folds.  Null labels and ids are
    skipped; without any label, or with one class only, every score is the share of ones
    (0.5 without labels).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null").withColumn("fold", fold_of(F.col("doc_id"))).where(F.col("fold") != held_out)
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # ``most`` labels are a table of bounded size, so the statistics stay where they are
    rows = stored(x.join(F.broadcast(known), "doc_id").select("fold", "y", "x").repartition(TASKS), "labelled")
    flat = rows.select("fold", "y", *[F.col("x")[i].alias(f"x{i}") for i in range(N_STATISTICS)])
    got = flat.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[f(f"x{i}").alias(f"{f.__name__}{i}") for i in range(N_STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    if not got.n or got.y in (0.0, 1.0):
        value = 0.5 if not got.n else got.y
        zero = np.zeros(N_STATISTICS)
        return Model(zero, zero + 1, np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([value, value]))
    mean = np.array([got[f"avg{i}"] for i in range(N_STATISTICS)])
    scale = np.array([got[f"stddev_pop{i}"] for i in range(N_STATISTICS)])
    bare = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            fold, y, z = batch.column(0).to_numpy(), batch.column(1).to_numpy(), bare.features(_matrix(batch.column(2)))
            for k in np.unique(fold).tolist():
                at = fold == k
                now = [z[at].T @ z[at], z[at].T @ y[at], int(at.sum())]
                sums[k] = [a + b for a, b in zip(sums[k], now, strict=True)] if k in sums else now
        for k, (a, b, n) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([a.tobytes()]), pa.array([b.tobytes()]), pa.array([n], pa.int64())], ["fold", "a", "b", "n"])

    folds: dict[int, list] = {}
    for r in rows.coalesce(TASKS).mapInArrow(frugal(normal), "fold int, a binary, b binary, n long").collect():
        now = [np.frombuffer(r.a).reshape(FEATURES + 1, -1), np.frombuffer(r.b), r.n]
        folds[r.fold] = [a + b for a, b in zip(folds[r.fold], now, strict=True)] if r.fold in folds else now

    def ridge(but: int | None) -> np.ndarray:
        used = [v for k, v in folds.items() if k != but] or list(folds.values())
        a, b, n = (sum(v[i] for v in used) for i in range(3))
        return np.linalg.solve(a + RIDGE * n * np.diag(np.append(np.ones(FEATURES), 1e-9)), b)

    without = {k: bare._replace(weights=ridge(k)) for k in folds}
    low, high = -0.5, 1.5
    width = (high - low) / STEPS

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, x_ = batch.column(0).to_numpy(), _matrix(batch.column(2))
            out = np.zeros(len(fold))
            for k in np.unique(fold).tolist():
                out[fold == k] = without[k].raw(x_[fold == k])
            step = np.clip((out - low) / width, 0, STEPS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), batch.column(1)], ["step", "y"])

    steps = rows.mapInArrow(frugal(left_out), "step int, y double").groupBy("step").agg(F.count("*").alias("n"), F.avg("y").alias("y")).collect()
    steps.sort(key=lambda r: r.step)
    at = np.array([low + (r.step + 0.5) * width for r in steps])
    value = isotonic(at, np.array([r.y for r in steps]), np.array([float(r.n) for r in steps]))
    return bare._replace(weights=ridge(None), knots=at, values=value)


def scored(x: DataFrame, model: Model, good: float = GOOD) -> DataFrame:
    """(doc_id, text_hash, score double, predicted int) for each row of document_statistics()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= good).astype(np.int32))], ["doc_id", "text_hash", "score", "predicted"])

    return x.select("doc_id", "text_hash", "x").mapInArrow(frugal(run), "doc_id long, text_hash long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``.

    The text alone gives the score.  Labels of documents with crc32(id as text) mod 4 = 2
    are never read.  Empty and null texts are scored as empty; a null id is not held out;
    repeated rows are scored each; empty tables give none.  Other columns are not read.
    """
    x = stored(document_statistics(docs, text, key), "statistics")
    out = scored(x, fit(x, labels, most=most))
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, with all their columns.

    A score depends on the text alone, so rows are matched by a hash of it.  See
    quality_scores() for nulls, empty texts and repeated rows.
    """
    x = stored(document_statistics(docs, text, key), "statistics")
    bad = stored(scored(x, fit(x, labels)).where("predicted = 0").select(F.col("text_hash").alias("_q_h")).distinct(), "rejected")
    # most rows are settled by a filter of bounded size, in place; the others by an exact join
    docs, names = apart(docs)
    sure, maybe = parted(docs.withColumn("_q_h", _hash(names[text])), bad, "_q_h")
    return sure.unionByName(maybe.join(bad, "_q_h", "left_anti")).select(*[F.col(c).alias(name) for name, c in names.items()])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
