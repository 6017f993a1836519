import hashlib
import random
from collections import Counter

import numpy as np

from tidewell.llm import suffix_dedup as S


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[p : p + length] for t in raw for p in range(len(t) - length + 1))
    out = []
    for t in raw:
        cut = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                cut[p : p + length] = b"\1" * length
        kept = bytes(c for c, x in zip(t, cut) if not x)
        out.append((len(t), sum(cut), sum(1 for i in range(len(t)) if cut[i] and (i == 0 or not cut[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choices("abé 🙂", k=rng.randrange(5, 60))) for _ in range(6)]
    out = ["".join(rng.choice(parts) if rng.random() < 0.4 else "".join(rng.choices("abcdefgé", k=rng.randrange(30))) for _ in range(rng.randrange(6))) for _ in range(25)]
    return [*out, None, "", "a" * 300, "ab" * 100, out[0], out[0], "x" * 19]


def check(spark, rows, length, gram, **more):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(rows)], "doc_id long, text string, t1 int, n_bytes string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(df, length=length, gram=gram, **more).collect()}
    want = brute(rows, length)
    assert [got[i] for i in range(len(rows))] == want


def test_removal_agrees_with_all_windows(spark):
    check(spark, texts(1), 20, 6)
    check(spark, texts(2), 12, 5, hot=2)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 64)
    rng = random.Random(3)
    p = "".join(rng.choices("abcdef", k=400))
    check(spark, [p, "q" + p[50:300], "".join(rng.choices("xyz", k=500)), p[100:] + "é" * 80], 20, 6)


def test_what_is_left(spark):
    p = "0123456789" * 3
    df = spark.createDataFrame([(1, f"é{p}x", 2), (2, f"{p}é", 3), (3, "z", 1)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in S.cut_documents(df, length=200).collect()}
    assert got[1] == (f"é{p}x", 32)
    long = "".join(random.Random(1).choices("abcdefgh ", k=260))
    df = spark.createDataFrame([(1, f"é{long}x", 2), (2, f"{long}é", 3)], "doc_id long, text string, n_chars long")
    assert {r.doc_id: (r.text, r.n_chars) for r in S.cut_documents(df).collect()} == {1: ("éx", 2), 2: ("é", 1)}
    assert S.cut_documents(df.limit(0)).count() == 0


def test_suffix_ranks_are_the_order_of_suffixes():
    rng = np.random.default_rng(4)
    for depth in (1, 5, 7, 8, 20, 50):
        t = rng.integers(0, 3, 120).astype(np.uint8)
        ranks = S.suffix_ranks(t, depth)
        raw = t.tobytes()
        cut = [raw[i : i + depth] for i in range(len(raw))]
        order = sorted(set(cut))
        assert [order[r] for r in ranks] == cut


def test_phrases_part_the_windows():
    rng = random.Random(5)
    rows = ["".join(rng.choices("ab", k=rng.randrange(0, 300))).encode() for _ in range(9)]
    raw = np.frombuffer(b"".join(rows), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    own, first, size, trigger, _ = S.phrases(raw, off, 20, 6)
    place = {}
    for o, f, n, t in zip(own, first, size, trigger, strict=True):
        for p in range(f, f + n):
            assert (o, p) not in place
            place[o, p] = t
    assert len(place) == sum(max(0, len(r) - 19) for r in rows)
    same = {}
    for (o, p), t in place.items():
        assert same.setdefault(rows[o][p : p + 20], t) == t


def test_ranges_are_even_and_a_frequent_phrase_is_sent_once_a_task():
    rng = random.Random(6)
    common = "".join(rng.choices("abcdefgh ", k=700))
    rows = ["".join(rng.choices("abcdefgh ", k=1500)) + common for _ in range(120)]
    raw = np.frombuffer("".join(rows).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    own, first, size, trigger, phrase = S.phrases(raw, off)
    sent = {b.column(0)[0].as_py(): len(b.column(1)[0].as_py()) // 8 for b in S._deal([trigger, phrase, own.astype("<i8"), first, size], 16)}
    assert len(sent) == 16 and max(sent.values()) < 3 * sum(sent.values()) / 16
    asked = 0
    for b in S._deal([trigger, phrase, own.astype("<i8"), first, size], 16):
        seen = np.frombuffer(b.column(6)[0].as_py(), "u1")
        asked += int((seen != S._KNOWN).sum())
    assert asked == len(np.unique(phrase)) < len(phrase)


def test_places_in_the_corpus():
    rng = random.Random(9)
    spellings = ["".join(rng.choices("ab", k=rng.randrange(12, 30))).encode() for _ in range(20)]
    times = np.array([rng.choice([1, 1, 2]) for _ in spellings])
    want = Counter()
    for s, n in zip(spellings, times, strict=True):
        for p in range(len(s) - 11):
            want[s[p : p + 12]] += n
    for s, places in zip(spellings, S.corpus_places(spellings, times, 12), strict=True):
        assert places.tolist() == [want[s[p : p + 12]] for p in range(len(s) - 11)]


def test_names_and_nulls_of_what_is_left(spark):
    p = "".join(random.Random(2).choices("abcdefgh ", k=230))
    df = spark.createDataFrame([(1, p + "x", "USER", 777, "s"), (2, "y" + p, "USER", 777, "s"), (3, None, None, None, None)], "doc_id long, text string, kept string, n_bytes int, _s_t1 string")
    got = {r.doc_id: r for r in S.cut_documents(df).collect()}
    assert S.cut_documents(df).columns == df.columns
    assert [tuple(got[i]) for i in (1, 2, 3)] == [(1, "x", "USER", 777, "s"), (2, "y", "USER", 777, "s"), (3, None, None, None, None)]
    full = S.suffix_dedup(df, with_text=True).where("doc_id = 3").first()
    assert (full.n_bytes, full.n_removed, full.kept) == (0, 0, None)
