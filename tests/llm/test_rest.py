import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewell.llm import packing, source_mixing, token_counts, token_files, topk_search, url_filters

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain():
    t = Tokenizer.from_file(PATH)
    return t


ROWS = [(3, "hello  world\n"), (1, "a b " * 3000), (None, "no id"), (2, None), (5, ""), (2, "zwei"), (7, "été 🙂\nline two")]


def test_token_files_give_back_all_ids(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, part int")
    from tidewell.llm.common import shared_dir

    path = f"{shared_dir(spark)}/test-token-files"
    token_files.write_token_files(df, path, shard_ids=50)
    at = 0
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    for r, (i, t) in zip(got, sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")), strict=True):
        ids = [*plain().encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_packing_places_every_id_once(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS * 3], "doc_id long, text string, length int")
    got = packing.pack(df, size=64).collect()
    total = 3 * sum(len(plain().encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert sum(r.length for r in got) == total
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert sorted(by) == list(range(len(by))) and len(by) < 1.1 * total / 64 + 2
    assert packing.pack(df.limit(0)).count() == 0


def test_section_counts_add_up(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for rule in ("start", "end", "most"):
        got = token_counts.token_counts(df, rule=rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
        want = {}
        for i, t in ROWS:
            want[i] = want.get(i, 0) + len(plain().encode(t or "", add_special_tokens=False).ids)
        assert {r.doc_id: r.n for r in got} == want


def test_urls(spark):
    cases = {
        "http://Example.com/en/x": ("example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/?q": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"), "ftp://x.com": ("x.com", "", None, "allow"), "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "nothing": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://spam.org/a/": ("spam.org", "/a/", None, "block"), "http://spam.org/b": ("spam.org", "/b", None, "allow"),
    }
    pages = spark.createDataFrame([(u, "mine", 1) for u in [*cases, "http://spam.org/a/"]], "url string, verdict string, word int")
    listed = spark.createDataFrame([("http://spam.org/a?utm_x=1",), ("http://spam.org/a?utm_x=1",), (None,)], "url string")
    got = url_filters.url_filter(pages, listed, blocks=2).collect()
    assert len(got) == len(cases) + 1 and all(r.word == 1 for r in got)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url], r.url
    assert {r.verdict for r in url_filters.url_filter(pages, listed.limit(0)).where("host = 'spam.org'").collect()} == {"allow"}
    assert url_filters.url_filter(pages.limit(0), listed).count() == 0


def test_search_agrees_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "CANDIDATES", 7)
    monkeypatch.setattr(topk_search, "QUERIES", 2)
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)] + [(100, None), (200, [1.0, None, 0.0, 0.0]), (300, [float("nan")] * 4), (400, [float("inf")] * 4), (None, [1.0] * 4), (500, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in topk_search.topk_search(df, k=5, every=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in [i for i in fine if i % 10 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(fine[q], v, strict=True)), i) for i, v in fine.items() if i != q))[:5]
        assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not got
    assert topk_search.topk_search(df.limit(0)).count() == 0


def test_mixing_stays_near_its_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "a", "a", "b", None])) for i in range(600)] + [(9000, None, "a"), (9001, "w " * 500, "c")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, target double")
    got = source_mixing.mix_sources(df, block_words=16).collect()
    assert len(got) == len(rows)
    total = {}
    for r in got:
        assert r.taken <= 3 * r.size and r.size == len((r.text or "").split())
        n, t, k = total.get(r.source, (0, r.target, 0))
        total[r.source] = (n + r.taken, r.target, k + r.size)
    assert abs(sum(t for _, t, _ in total.values()) - sum(k for _, _, k in total.values())) < 1e-6
    for taken, target, _ in total.values():
        assert abs(taken - target) <= 32
    assert sorted(map(str, got)) == sorted(map(str, source_mixing.mix_sources(df, block_words=16).collect()))
    mixed = source_mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert source_mixing.mix_sources(df.limit(0)).count() == 0


def test_sainte_lague_gives_the_highest_quotients():
    rng = np.random.default_rng(1)
    for _ in range(50):
        votes, most, seats = rng.random(6) * 100, rng.integers(0, 20, 6), int(rng.integers(0, 60))
        held = np.zeros(6, int)
        for _ in range(min(seats, most.sum())):
            q = np.where(held < most, votes / (2 * held + 1), -1)
            held[int(np.argmax(q))] += 1
        assert source_mixing.sainte_lague(votes, seats, most).tolist() == held.tolist()


def test_packed_pieces_are_those_of_plain_encoding(spark):
    df = spark.createDataFrame([(i, t) for i, t in ROWS if i not in (None, 2)], "doc_id long, text string")
    got = {(r.doc_id, r.start): r for r in packing.pack(df, size=64).collect()}
    for i, t in df.collect():
        ids = [*plain().encode(t or "", add_special_tokens=False).ids, 0]
        for a in range(0, len(ids), 64):
            r = got.pop((i, a))
            part = ids[a : a + 64]
            assert (r.length, r.doc_tokens, r.ids_crc32) == (len(part), len(ids), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert not got


def test_sections_agree_with_the_offsets_of_the_library(spark):
    rows = [(1, "one line\ntwo  words\n\nthree"), (2, "été 🙂\nligne\n"), (3, ""), (4, None), (5, "a\n" * 50), (6, "x" * 3000 + "\n" + "y")]
    df = spark.createDataFrame([(i, t, 9, "z") for i, t in rows], "doc_id long, text string, section int, n_tokens string")
    got = {}
    for r in token_counts.token_counts(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        t = t or ""
        begins = [0] + [k + 1 for k, c in enumerate(t) if c == "\n" and k + 1 < len(t)]
        n, crossing = [0] * len(begins), [0] * len(begins)
        for a, b in plain().encode(t, add_special_tokens=False).offsets:
            at = max(k for k, x in enumerate(begins) if x <= a)
            n[at] += 1
            crossing[at] += at != max(k for k, x in enumerate(begins) if x <= max(a, b - 1))
        mine = sorted(got[i], key=lambda r: r.section)
        assert [(r.section, r.start_char, r.end_char) for r in mine] == [(k, x, y) for k, (x, y) in enumerate(zip(begins, [*begins[1:], len(t)], strict=True))]
        assert [r.n_tokens for r in mine] == n and [r.n_crossing for r in mine] == crossing
    assert token_counts.token_counts(df.limit(0)).count() == 0


def test_token_files_of_no_documents_and_other_columns(spark):
    from tidewell.llm.common import shared_dir

    df = spark.createDataFrame([(4, "a b", 3, "x")], "doc_id long, text string, shard int, planes string")
    token_files.write_token_files(df, f"{shared_dir(spark)}/test-other")
    assert [(r.doc_id, r.start, r.n_tokens) for r in token_files.read_token_files(spark, f"{shared_dir(spark)}/test-other").collect()] == [(4, 0, 3)]
    token_files.write_token_files(df.limit(0), f"{shared_dir(spark)}/test-none")
    assert token_files.read_token_files(spark, f"{shared_dir(spark)}/test-none").count() == 0


def test_small_sources_come_near_their_targets_and_cut_texts_are_words_of_the_text(spark):
    df = spark.createDataFrame([(1, "one two three", "a", "u", 1), (2, " four\tfive\n six ", "b", "u", 2), (None, "w " * 3000, "c", "u", 3), (None, None, None, "u", 4)], "doc_id long, text string, source string, taken string, size int")
    got = {r.source: r for r in source_mixing.mix_sources(df.drop("taken", "size")).collect()}
    for r in got.values():
        assert abs(r.taken - r.target) <= max(1, r.target / 8), r
    mixed = source_mixing.mixed_documents(df)
    rows = mixed.collect()
    assert mixed.columns == df.columns and {r.taken for r in rows} == {"u"}
    text = {r.source: (r.text or "").split() for r in df.collect()}
    words = {}
    for r in rows:
        w = r.text.split()
        assert " ".join(w) in " ".join(text[r.source]) and w
        words[r.source] = words.get(r.source, 0) + len(w)
    assert words == {s: r.taken for s, r in got.items() if r.taken}
