import hashlib
import itertools
import random
import zlib

import pytest

from tidewell.llm import conversation_repair as repair

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
AFTER = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NEEDS = {"": "user", "s": "user", "u": "assistant", "a": "user"}


def solve(rows):
    """(cost, audit, lines) of the cheapest edits of (role, text, fault) rows, ties to the least audit, from the end."""
    best = {("", 0): (0, "", ()), ("a", 0): (0, "", ()), ("u", 0): (5, "I", ("assistant:",)), ("s", 0): (10, "II", ("user:", "assistant:"))}
    now = {s: best[s, 0] for s in ("", "s", "u", "a")}
    for role, text, fault in reversed(rows):
        own = {}
        for s in now:
            ways = [(2 + now[s][0], "D" + now[s][1], now[s][2])]
            if fault in (None, "truncated"):
                more = 5 * (fault == "truncated")
                to = AFTER.get((s, role[:1]))
                if to is not None:
                    ways.append((more + now[to][0], "K" + now[to][1], (f"{role}:{text}", *now[to][2])))
                new = NEEDS[s]
                ways.append((1 + more + now[new[0]][0], "R" + now[new[0]][1], (f"{new}:{text}", *now[new[0]][2])))
            own[s] = min(ways, key=lambda w: w[:2])
        for _ in range(2):
            own = {s: min(own[s], (5 + own[NEEDS[s][0]][0], "I" + own[NEEDS[s][0]][1], (f"{NEEDS[s]}:", *own[NEEDS[s][0]][2])), key=lambda w: w[:2]) for s in own}
        now = own
    return now[""]


def brute(rows):
    """From (conv, turn, role, text) rows after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r or " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in own:
            solid = text.rstrip(SPACES)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        cost, audit, lines = solve(marked)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), "\n".join(lines))
    return out


def made(seed, convs, most):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        role = rng.choice(["user", "system"])
        for t in range(rng.randint(1, most)):
            text = rng.choice(["One.", "Two!", "Three?", "cut", " \n", "", None, "mid. way", f"own {t}.", f"Own {t}? \t", "été."])
            shown = rng.choice([role, role, role, "user", "assistant", "system", "tool", "", None])
            rows.append((None if c == 0 else c, rng.choice([t, t, t, t, None, t + rng.randint(0, 3)]), shown, text))
            role = "assistant" if role == "user" else "user"
    return rows


@pytest.mark.parametrize(("seed", "convs", "most", "piece"), [(1, 200, 9, 1024), (2, 12, 60, 7), (3, 3, 2500, 256), (4, 1, 1, 4)])
def test_agrees_with_plain_python(spark, monkeypatch, seed, convs, most, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    rows = made(seed, convs, most)
    rows += rows[:3]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(df).collect()}
    assert got == brute(rows)


def test_edits_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE", 2)
    orders = ["".join(o) for n in range(1, 7) for o in itertools.product("sua", repeat=n)][::3]
    rows = [(o, t, {"s": "system", "u": "user", "a": "assistant"}[c], f"{t}{'.' if (t * 7 + i) % 3 else ''}") for i, o in enumerate(orders) for t, c in enumerate(o)]
    got = repair.repair_conversations(spark.createDataFrame(rows, "c string, t int, r string, x string"), conv="c", turn="t", role="r", text="x").collect()
    assert {r.c: tuple(r)[1:] for r in got} == brute(rows)


def test_query_over_damaged_rows(spark, tmp_path):
    rows = made(9, 60, 8) + [(77, 3, "user", "Gone.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    left = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else text.translate(str.maketrans("", "", ".!?")) if k == 2 else text
        left += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    want = {c: v[:-1] for c, v in brute(left).items()}
    for c in {r[0] for r in rows} - set(want):
        want[c] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = repair.op13_conversation_repair(spark, str(tmp_path))
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == want
    assert repair.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_very_long_text(spark):
    text = "word " * 400_000 + "end."
    got = repair.repair_conversations(spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text[:-1])], "conv_id long, turn long, role string, text string")).first()
    assert (got.audit, got.cost, got.truncated) == ("DD", 4, 1) and got.repaired == ""
