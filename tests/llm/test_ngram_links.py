import numpy as np
from test_ngram_join import corpus, shingles

from tidewell.llm import ngram_join as J


def brute_links(rows, num=3, den=4):
    """Sizes and overlap of all linked pairs of distinct sets, and how many links the set of each document has."""
    sets = {d: frozenset(shingles(t)) for d, t in rows}
    distinct = sorted({s for s in sets.values() if s}, key=sorted)
    links, n = [], dict.fromkeys(distinct, 0)
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if den * len(x & y) >= num * len(x | y):
                links.append((*sorted((len(x), len(y))), len(x & y)))
                n[x] += 1
                n[y] += 1
    return sorted(links), {d: n.get(s, 0) for d, s in sets.items()}


def near_copies(n=40):
    base = [f"w{k}" for k in range(120)]
    return [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(n)]


def check(spark, texts):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links, counts = brute_links(rows)
    documents, got = J.ngram_join(df, every=True)
    size = {r.sid: r.n for r in documents.collect()}
    found = got.collect()
    assert len({(r.a, r.b) for r in found}) == len(found) and all(r.a < r.b for r in found)
    assert sorted((*sorted((size[r.a], size[r.b])), r.overlap) for r in found) == links
    assert {r.doc_id: r.n_links for r in J.class_links(df).collect()} == counts
    return len(links)


def test_every_link_of_a_group_of_near_copies_is_listed(spark):
    texts = near_copies() + ["", None, near_copies()[3], "w1 w2"] + corpus(1, 30)
    assert check(spark, texts) >= 40 * 39 // 2


def test_blocks_of_a_component_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "FANOUT", 3)
    check(spark, near_copies(30) + corpus(5, 30, 12))


def test_overlaps():
    rng = np.random.default_rng(1)
    keys = [np.unique(rng.integers(0, 50, rng.integers(1, 30)).astype(np.uint64)) for _ in range(20)]
    pairs = np.array([(i, j) for i in range(20) for j in range(i + 1, 20)])
    assert J.overlaps(keys, pairs).tolist() == [len(np.intersect1d(keys[i], keys[j])) for i, j in pairs]
    assert J.overlaps(keys, pairs[:0]).tolist() == []
