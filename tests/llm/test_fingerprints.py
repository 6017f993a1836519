import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewell.llm import fingerprints as prints
from tidewell.llm.common import text_buffer

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def buffer(texts):
    return text_buffer(pa.array(texts, pa.large_string()))


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in low.translate({ord(c): " " for c in "\x09\x0a\x0b\x0c\x0d"}).split(" ") if w]
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def jaccard(a, b):
    a, b = terms(a), terms(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard():
    """Exact rate within four standard errors, for whole and broken weights."""
    rng = np.random.default_rng(3)
    sampler = prints.Sampler(4096)
    for n in (2, 10, 60, 1000):
        keys = np.sort(rng.integers(0, 1 << 52, n, dtype=np.uint64))
        a, b = rng.integers(0, 4, n) * rng.choice([1, 0.3, 2.5], n), rng.integers(0, 4, n) * rng.choice([1, 0.3], n)
        a[0] = b[0] = 1.0
        found = [sampler.winners(keys[w > 0], w[w > 0], np.zeros(1, np.int64))[0][:, 0].astype(np.uint32) for w in (a, b)]
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((found[0] == found[1]).mean() - want) < 4 * np.sqrt(max(want * (1 - want), 0.01) / 4096)


def test_terms_and_counts_are_those_of_plain_python():
    texts = ["a b c d e f", "", "  \n", "x", "A b C d e a b c D e a B c d e", "ein\x0bzwei drei", "été École a b c", "w " * 3000]
    keys, counts = prints.weighted_terms(*buffer(texts))
    for i, text in enumerate(texts):
        own = counts[(keys >> np.uint64(52)) == i]
        assert sorted(own.tolist()) == sorted(terms(text).values())
    same = prints.weighted_terms(*buffer(["A b c", "a B\tC"]))[0] & np.uint64((1 << 52) - 1)
    assert same[0] == same[1]


@pytest.fixture
def docs():
    rng = np.random.default_rng(5)
    words = ["w" + str(i) for i in range(400)]
    rows = [(int(i), " ".join(rng.choice(words, rng.integers(1, 400)))) for i in rng.permutation(300)]
    copy = dict(rows)
    rows += [(1000 - i, copy[7]) for i in range(30)] + [(None, "no id here"), (None, copy[9]), (5, None), (6, ""), (4, "short"), (2000, "é🙂" * 50), (12, copy[12]), (12, copy[12])]
    return [(i, t) for i, t in rows if not (t and i in (5, 6, 4))]


@pytest.mark.parametrize(("chunk", "block", "documents"), [(1 << 20, 1 << 15, 1 << 12), (300, 50, 3)])
def test_edited_texts_and_likeness(spark, docs, monkeypatch, chunk, block, documents):
    monkeypatch.setattr(prints, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(prints, "BLOCK", block)
    monkeypatch.setattr(prints, "DOCUMENTS", documents)
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, fingerprint string, part int").repartition(5)
    keyed = df.selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()
    rows = sorted(((r.doc_id, r.text, r.h) for r in keyed), key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    got = prints.edited_fingerprints(df, samples=32)
    assert got.columns == COLUMNS
    got = got.collect()
    sampler = prints.Sampler(32)
    key = lambda r: (r[0] is None, r[0] or 0, r[3], r[4])
    want = []
    for (i, text, _), (_, following, _) in zip(rows, rows[1:] + rows[:1], strict=True):
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        three = sampler.texts(*buffer([text, edited, following]))
        near = [float((three[0].astype(np.uint32) == three[j].astype(np.uint32)).mean()) if bool(terms(text)) == bool(terms(x)) else 0.0 for j, x in ((1, edited), (2, following))]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints.written(three)[:2], *near))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    errors = [near - jaccard(text, text[: len(text) - len(text) // 3] + following[: len(text) // 3]) for (i, text, _), (_, following, _), (*_, near, _) in zip(rows, rows[1:] + rows[:1], want, strict=True)]
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.12


def test_small_tables(spark):
    schema = "doc_id long, text string"
    assert prints.edited_fingerprints(spark.createDataFrame([], schema)).collect() == []
    one = prints.edited_fingerprints(spark.createDataFrame([(3, "a b c d e f")], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()
    same = prints.edited_fingerprints(spark.createDataFrame([(1, "x y"), (1, "x y"), (1, "x y")], schema)).collect()
    assert [r.near_next for r in same] == [1.0] * 3


def test_fingerprint_column_and_likeness(spark, docs):
    df = prints.fingerprints(spark.createDataFrame([(*r, "old") for r in docs], "doc_id long, text string, fingerprint string"), samples=32)
    got = {(r.doc_id, r.text): r.fingerprint for r in df.collect()}
    sampler = prints.Sampler(32)
    assert all(f == prints.written(sampler.texts(*buffer([t or ""])))[0] for (_, t), f in got.items())
    pair = df.where("doc_id = 7").selectExpr("fingerprint a").crossJoin(df.where("doc_id in (1000, 8, 6)").selectExpr("doc_id", "fingerprint b"))
    near = {r.doc_id: r.n for r in pair.select("doc_id", prints.likeness("a", "b").alias("n")).collect()}
    assert near[1000] == 1.0 and near[6] == 0.0 and near[8] < 0.3


def test_very_long_text(spark):
    text = " ".join(f"word{i % 70_000}" for i in range(400_000))
    got = prints.edited_fingerprints(spark.createDataFrame([(2, text), (1, text), (0, "end")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[2].fingerprint == got[1].fingerprint and got[2].near_next == 1.0 and 0.3 < got[2].near_edited < 1 and got[0].near_next == 0.0
