import re
from collections import Counter, defaultdict

import pytest

from tidewell.llm import source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans(source_audit.CAPITALS, source_audit.CAPITALS.lower())


def brute(rows, least=3, ranks=200):
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = TERM.findall(text.translate(LOW))
        groups[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {r[0] for r in rows}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        mine = {s: {t: n for t, n in c.items() if t in kept} for (at, s), c in groups.items() if at == lang}
        whole = Counter()
        for c in mine.values():
            whole.update(c)
        share = lambda c, t, kept=kept: 1 + 10**9 * (c.get(t, 0) + 1) // (sum(c.values()) + len(kept))
        away = lambda p, q: (p - q) ** 2 // q
        for s, c in mine.items():
            pairs = [(o, sum(away(share(c, t), share(x, t)) for t in kept)) for o, x in mine.items() if o != s]
            own = [(t, away(share(c, t), share(whole, t))) for t in c if share(c, t) > share(whole, t)]
            for part, items, most in (("pair", pairs, None), ("term", own, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items[:most])]
    return sorted(out)


ROWS = [
    ("en", "a", "The cat, the CAT and the dog"), ("en", "a", "the cat's dog\nrun"), ("en", "b", "Dog dog dog THE cat"), ("en", "b", "the cat"), ("en", None, None), ("en", "c", ""), ("en", "c", "the \x00 1234 !?"),
    ("fr", "a", "École École école été"), ("fr", "b", "école ÉTÉ école"), ("fr", "b", "École, ÉTÉ ÉTÉ"), (None, "a", "x y z"), (None, "b", "x"), (None, None, "z"), ("de", "a", "allein"), ("en", "a", "The cat, the CAT and the dog"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "mine") for r in rows], "lang string, source string, text string, term int, value string")


@pytest.mark.parametrize("limit", [source_audit.BROADCAST_GROUPS, 0])
def test_agrees_with_plain_python(spark, monkeypatch, limit):
    monkeypatch.setattr(source_audit, "BROADCAST_GROUPS", limit)
    rows = [*ROWS, ("en", "long", "the dog cat " * 20000)]
    got = source_audit.source_audit(frame(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert {(r.source, r.value) for r in got if r.lang == "" and r.part == "pair"} == {(s, 0) for s in ("", "a", "b")}


def test_other_bounds_and_empty_tables(spark):
    got = source_audit.source_audit(frame(spark, ROWS), least=1, ranks=2).collect()
    assert sorted(map(tuple, got)) == brute(ROWS, 1, 2)
    assert source_audit.source_audit(frame(spark, ROWS).limit(0)).count() == 0


def test_shares_are_exact_beyond_a_long_product(spark):
    rows = spark.createDataFrame([(10**12, 3 * 10**12 + 7, 11), (3, 17, 5)], "n long, total long, v long")
    got = [r.p for r in rows.select(source_audit._share("n", "total", "v").alias("p")).collect()]
    assert got == [1 + 10**9 * (10**12 + 1) // (3 * 10**12 + 18), 1 + 10**9 * 4 // 22]
