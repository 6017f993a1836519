"""Conversation structure repair: least edits to a legal order of roles, by dynamic programming on tensors with time as first axis."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.common import frugal, stored

#: States of a repaired conversation: empty, after system, after user, after assistant; 4 is none.
EMPTY, SYSTEM, USER, ASSISTANT, NOWHERE = range(5)
#: State after a user or assistant turn, whichever the state before asks for.
RIGHT = np.array([USER, USER, ASSISTANT, USER])
#: State after a turn is kept, by the code of its role's initial (s, u, a, other) and the state before.
KEPT = np.array([[SYSTEM, NOWHERE, NOWHERE, NOWHERE], [USER, USER, NOWHERE, USER], [NOWHERE, NOWHERE, ASSISTANT, NOWHERE], [NOWHERE] * 4])
#: Pairs of initials that may stand together: su, ua, au.
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True
#: Costs of edits; a truncated turn that stays costs CUT besides.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
FAR = 1 << 50
#: Cost of ending in a state, by inserting what is missing.
END = np.array([0, 2 * INSERT, INSERT, 0])
#: A turn's first fault.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Turns of a piece at most, and turns that are solved together.
PIECE, TOGETHER = 1024, 1 << 15
SPACES = "\\u0020\\u0009\\u000A\\u000B\\u000C\\u000D"

_STATS = ["n", "low", "high", "turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal", "first_code", "last_code"]


def _extra(fault: np.ndarray) -> np.ndarray:
    """What keeping a turn costs besides: FAR for those that must go."""
    return np.where((fault == BLANK) | (fault == DUPLICATE), FAR, np.where(fault == TRUNCATED, CUT, 0))


def backward(code: np.ndarray, fault: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs [time, conversation, end, state] from a state before a turn to the end.

    ``code`` and ``fault`` are [time, conversation]; ``end`` [conversation, end, state] has the
    costs after the last turn.  One step back in time updates all conversations, ends and
    states together.
    """
    steps, extra = len(code), _extra(fault)
    out = np.empty((steps + 1, *end.shape), np.int64)
    out[steps] = end
    for t in range(steps - 1, -1, -1):
        after, more = out[t + 1], extra[t][:, None, None]
        there = np.concatenate([after, np.full((*after.shape[:2], 1), FAR)], axis=2)
        keep = np.take_along_axis(there, np.broadcast_to(KEPT[code[t]][:, None, :], after.shape), axis=2) + more
        least = np.minimum(np.minimum(after + DELETE, keep), after[:, :, RIGHT] + (REROLE + more))
        out[t] = np.minimum(np.minimum(least, least[:, :, RIGHT] + INSERT), least[:, :, RIGHT[RIGHT]] + 2 * INSERT)
    return out


def trace(code: np.ndarray, fault: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edits and states after them [time, conversation, 3], and the last states.

    ``costs`` is [time, conversation, state].  At each turn all conversations take the edit
    whose initial is least among those that keep to the least cost; up to two inserts stand
    before a turn's own edit, and unused places are 0.
    """
    steps, n = code.shape
    edits, after = np.zeros((steps, n, 3), np.uint8), np.zeros((steps, n, 3), np.uint8)
    rows, state, extra = np.arange(n), state.copy(), _extra(fault)
    d, i, k, r = b"DIKR"
    for t in range(steps):
        open_ = np.ones(n, bool)
        for slot in range(3):
            cost = costs[t, rows, state]
            deleted = costs[t + 1, rows, state] + DELETE == cost
            inserted = costs[t, rows, RIGHT[state]] + INSERT == cost
            to = KEPT[code[t], state]
            kept = (to < NOWHERE) & (costs[t + 1, rows, np.minimum(to, 3)] + extra[t] == cost)
            edit = np.select([deleted, inserted, kept], [d, i, k], r)
            new = np.select([edit == d, edit == k], [state, to], RIGHT[state])
            edits[t, open_, slot], after[t, open_, slot] = edit[open_], new[open_]
            state[open_] = new[open_]
            open_ &= edit == i
            if not open_.any():
                break
    return edits, after, state


def _text(edits: np.ndarray, after: np.ndarray, roles: list[str], texts: list[str], last: int | None) -> tuple[str, str]:
    """(audit, lines) of one conversation; ``last`` is its last state if it ends here."""
    audit, lines = edits[edits > 0].tobytes().decode(), []
    for own, to, role, text in zip(edits.tolist(), after.tolist(), roles, texts, strict=True):
        for edit, state in zip(own, to, strict=True):
            if edit == 73 or edit == 82:  # I, R
                lines.append(("user:" if state == USER else "assistant:") + (text if edit == 82 else ""))
            elif edit == 75:  # K
                lines.append(f"{role}:{text}")
    if last in (SYSTEM, USER):
        missing = ["user:", "assistant:"][last - SYSTEM :]
        audit, lines = audit + "I" * len(missing), lines + missing
    return audit, "\n".join(lines)


def _by_length(lengths: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the runs, their row numbers [time, run]) for each length."""
    order = np.argsort(lengths, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        yield some, starts[some] + np.arange(lengths[some[0]])[:, None]


def _pieces(schema: pa.Schema, keep_text: bool):
    """Sorted turns to one row a conversation that stands inside the task, or a piece of one that may not."""

    def solved(rows: pa.Table, fault: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray, part: int, no: int) -> pa.RecordBatch:
        code = rows.column("code").to_numpy().astype(np.int64)
        turn, none = rows.column("turn").fill_null(0).to_numpy(), rows.column("turn").is_null().to_numpy(zero_copy_only=False)
        inner = np.ones(len(code), bool)  # rows that follow another of their run
        inner[starts] = False
        other = ~inner | none | np.roll(none, 1) | (turn != np.roll(turn, 1))
        apart = inner & ~LEGAL[np.roll(code, 1), code]
        total = lambda x: np.add.reduceat(x.astype(np.int64), starts).tolist()
        roles, texts = rows.column("role").to_pylist(), rows.column("text").to_pylist()
        turns = rows.column("turn").to_pylist()
        firsts = (starts + np.add.reduceat(none.astype(np.int64), starts)).tolist()  # nulls stand first
        out: dict[str, list] = {name: [None] * len(starts) for name in schema.names}
        out["n"], out["turns"] = (ends - starts).tolist(), total(other & ~none)
        out["low"] = [turns[f] if f < e else None for f, e in zip(firsts, ends.tolist(), strict=True)]
        out["high"] = out["last_turn"] = [turns[e - 1] for e in ends.tolist()]
        out["first_turn"] = [turns[s] for s in starts.tolist()]
        out["blank"], out["duplicate"], out["truncated"], out["illegal"] = total(fault == BLANK), total(fault == DUPLICATE), total(fault == TRUNCATED), total(apart)
        out["first_code"], out["last_code"] = code[starts].tolist(), code[ends - 1].tolist()
        out["part"], out["no"], out["whole"] = [part] * len(starts), list(range(no, no + len(starts))), whole.tolist()
        for some, at in _by_length(ends - starts, starts):
            c, f = code[at], fault[at]
            if (entire := np.flatnonzero(whole[some])).size:
                cw, fw = c[:, entire], f[:, entire]
                costs = backward(cw, fw, np.broadcast_to(END, (len(entire), 1, 4)))[:, :, 0]
                edits, after, last = trace(cw, fw, costs, np.zeros(len(entire), np.int64))
                for j, g in enumerate(some[entire].tolist()):
                    lo, hi = starts[g], ends[g]
                    audit, body = _text(edits[:, j], after[:, j], roles[lo:hi], texts[lo:hi], int(last[j]))
                    out["cost"][g], out["audit"][g], out["sha256"][g] = int(costs[0, j, 0]), audit, hashlib.sha256(body.encode()).hexdigest()
                    out["repaired"][g] = body if keep_text else None
            if (cut := np.flatnonzero(~whole[some])).size:
                free = np.where(np.eye(4, dtype=bool), 0, FAR)
                to = backward(c[:, cut], f[:, cut], np.broadcast_to(free, (len(cut), 4, 4)))[0]
                for j, g in enumerate(some[cut].tolist()):
                    lo, hi = starts[g], ends[g]
                    out["matrix"][g] = to[j].ravel().tolist()  # [end, state before]
                    out["codes"][g], out["faults"][g] = code[lo:hi].astype(np.uint8).tobytes(), fault[lo:hi].astype(np.uint8).tobytes()
                    out["roles"][g], out["texts"][g] = roles[lo:hi], texts[lo:hi]
        arrays = [rows.column("conv").take(pa.array(starts)).combine_chunks() if name == "conv" else pa.array(out[name], schema.field(name).type) for name in schema.names]
        return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, rows, before, at_edge = TaskContext.get().partitionId(), 0, None, None, True

        def cut(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal no, rows, before, at_edge
            table = rows.combine_chunks()
            conv = table.column("conv").combine_chunks().dictionary_encode()
            conv = (conv.chunk(0) if isinstance(conv, pa.ChunkedArray) else conv).indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.ones(table.num_rows, bool)
            new[1:] = conv[1:] != conv[:-1]
            again = np.zeros(table.num_rows, bool)  # equal to the turn before in all respects
            same = ~new[1:]
            for name in ("turn", "role", "text"):
                c = table.column(name)
                a, b = c.slice(1), c.slice(0, table.num_rows - 1)
                same &= pc.fill_null(pc.equal(a, b), False).to_numpy() | (a.is_null().to_numpy() & b.is_null().to_numpy())
            again[1:] = same
            again[0] = before is not None and before == tuple(table.column(c)[0].as_py() for c in ("conv", "turn", "role", "text"))
            flag = lambda c: table.column(c).to_numpy()
            fault = np.select([flag("blank"), flag("later") | again, flag("cut")], [BLANK, DUPLICATE, TRUNCATED], FINE)
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], table.num_rows)
            edge = np.zeros(len(starts), bool)
            edge[0], edge[-1] = at_edge, True
            long = (ends - starts > PIECE) | edge
            lo, hi, whole = [], [], []
            for s, e, split in zip(starts.tolist(), ends.tolist(), long.tolist(), strict=True):
                open_ = e == table.num_rows and not last
                if open_ and e - s < PIECE:
                    break
                for a in range(s, e, PIECE):
                    if open_ and a + PIECE > e:
                        break
                    lo, hi, whole = [*lo, a], [*hi, min(e, a + PIECE)], [*whole, not split]
            if not lo:
                return
            yield solved(table.slice(0, hi[-1]), fault[: hi[-1]], np.array(lo), np.array(hi), np.array(whole), part, no)
            # What is held goes on with the conversation of the last row, or begins another.
            no += len(lo)
            at_edge = hi[-1] > starts[-1]
            before = tuple(table.column(c)[hi[-1] - 1].as_py() for c in ("conv", "turn", "role", "text"))
            rows = table.slice(hi[-1])

        for batch in batches:
            if batch.num_rows:
                batch = pa.Table.from_batches([batch])
                rows = batch if rows is None or not rows.num_rows else pa.concat_tables([rows, batch])
                if rows.num_rows >= TOGETHER or rows.nbytes > 1 << 26:
                    yield from cut(False)
        if rows is not None and rows.num_rows:
            yield from cut(True)

    return run


def _rows(names: list[str], rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table({n: pa.array(list(c), schema.field(n).type) for n, c in zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True)})


def _ends(pieces: pa.Table) -> pa.Table:
    """For each piece of one conversation, its least costs after it by state; its figures on its first piece."""
    t = pieces.sort_by([("part", "ascending"), ("no", "ascending")]).to_pylist()
    cost, ends = END, []
    for p in reversed(t):
        ends.append(cost.tolist())
        cost = (np.array(p["matrix"]).reshape(4, 4) + cost[:, None]).min(axis=0)
    ends.reverse()
    pairs = list(zip(t, t[1:], strict=False))
    low = [p["low"] for p in t if p["low"] is not None]
    high = [p["high"] for p in t if p["high"] is not None]
    distinct = sum(p["turns"] for p in t) - sum(a["last_turn"] is not None and a["last_turn"] == b["first_turn"] for a, b in pairs)
    sums = [sum(p[c] for p in t) for c in ("blank", "duplicate", "truncated", "illegal")]
    sums[3] += sum(not LEGAL[a["last_code"], b["first_code"]] for a, b in pairs)
    gaps = max(high) - min(low) + 1 - distinct if low else 0
    out = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("end", pa.list_(pa.int64())), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]])
    rows = [(p["part"], p["no"], e, *((gaps, *sums, int(cost[EMPTY])) if i == 0 else [None] * 6)) for i, (p, e) in enumerate(zip(t, ends, strict=True))]
    return _rows(out.names, rows, out)


def _piece(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, faults and costs of a piece with known end."""
    code, fault = (np.frombuffer(batch.column(c)[i].as_py(), np.uint8).astype(np.int64)[:, None] for c in ("codes", "faults"))
    return code, fault, backward(code, fault, np.array(batch.column("end")[i].as_py()).reshape(1, 1, 4))[:, :, 0]


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which the trace of a piece leaves it, for each state in which it may enter."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            code, fault, costs = _piece(batch, i)
            four = lambda x: np.repeat(x, 4, axis=1)
            rows.append(trace(four(code), four(fault), four(costs), np.arange(4))[2].tolist())
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), batch.column("no"), pa.array(rows, pa.list_(pa.int64()))], ["conv", "part", "no", "exits"])


def _entries(pieces: pa.Table) -> pa.Table:
    rows, state = [], EMPTY
    for p in (t := pieces.sort_by([("part", "ascending"), ("no", "ascending")]).to_pylist()):
        rows.append((p["part"], p["no"], state, p is t[-1], t[0]["part"], t[0]["no"]))
        state = p["exits"][state]
    out = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("entry", pa.int64()), ("last", pa.bool_()), ("head_part", pa.int32()), ("head_no", pa.int32())])
    return _rows(out.names, rows, out)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            code, fault, costs = _piece(batch, i)
            edits, after, last = trace(code, fault, costs, np.array([batch.column("entry")[i].as_py()]))
            rows.append(_text(edits[:, 0], after[:, 0], batch.column("roles")[i].as_py(), batch.column("texts")[i].as_py(), int(last[0]) if batch.column("last")[i].as_py() else None))
        audit, body = zip(*rows, strict=True) if rows else ([], [])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("head_part", "head_no", "part", "no")), pa.array(audit, pa.string()), pa.array(body, pa.string())], ["head_part", "head_no", "part", "no", "audit", "body"])


def _joined(keep_text: bool):
    """Sorted bodies of pieces to one row a conversation; the hash takes piece after piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, audit, body = None, None, [], []
        names = ["part", "no", "audit", "sha256", "repaired"]

        def out() -> pa.RecordBatch:
            values = [head[0], head[1], "".join(audit), digest.hexdigest(), "\n".join(body) if keep_text else None]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], names)

        for batch in batches:
            for r in batch.to_pylist():
                own = (r["head_part"], r["head_no"])
                if own != head:
                    if head:
                        yield out()
                    head, digest, audit, body, begun = own, hashlib.sha256(), [], [], False
                audit.append(r["audit"])
                if r["body"]:
                    digest.update((("\n" if begun else "") + r["body"]).encode())
                    begun = True
                    if keep_text:
                        body.append(r["body"])
        if head:
            yield out()

    return run


def faults(turns: DataFrame) -> DataFrame:
    """``turns`` (conv, turn, role, text) with code, blank, cut and later: role and text stand at an earlier turn too.

    First turns of repeated texts come from one aggregation by conversation and hashes, which
    combines before it shuffles; the join is an ordinary one, which the engine may broadcast
    or split where a text is in most turns.
    """
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).cast("int")
    solid = F.expr(f"trim(TRAILING '{SPACES}' FROM text)")
    order = lambda c: F.struct(F.col(c).isNotNull().alias("there"), F.col(c).alias("turn"))
    rows = turns.withColumns({"code": code, "blank": solid == "", "cut": ~F.substring(solid, -1, 1).isin(".", "!", "?"), "h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit(1), "role")})
    many = rows.groupBy(F.col("conv").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.min(order("turn")).alias("least"), F.count("*").alias("times")).where("times > 1")
    met = rows.join(many, F.col("conv").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    return met.withColumn("later", F.coalesce(order("turn") > F.col("least"), F.lit(False))).select("conv", "turn", "role", "text", "code", "blank", "cut", "later")


def repair_conversations(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", keep_text: bool = True) -> DataFrame:
    """One row a conversation: its faults, the cheapest edits and the repaired turns.

    Turns go by ``turn`` (nulls first, ties by role and text).  A turn's fault is blank (only
    spaces), else duplicate (role and text stand earlier), else truncated (the last character
    that is no space is none of ``.!?``).  Edits give the roles' initials ``(s?(ua)+)?``: Keep
    is free, Rerole to user or assistant costs REROLE, Delete DELETE (blank and duplicate
    turns must go), Insert of an empty turn INSERT; truncated turns that stay cost CUT more.
    Columns: the conversation's id, gaps, blank, duplicate, truncated, illegal, cost, audit
    (initials of the cheapest edits, ties to the least string), repaired_sha256, and repaired
    (``role:text`` lines) if ``keep_text``.

    Turns are dealt into ranges of (conversation, turn) and sorted.  Conversations inside a
    range are bucketed by length and solved together: one step of the tensor is one turn of
    all of them.  Longer ones than PIECE turns, and those at the edges of ranges, are cut in
    pieces.  A piece is a 4 x 4 matrix of least costs between states; products of matrices
    give the costs after each piece, traces of pieces the states between them, and the hash
    takes piece after piece.  So no conversation, however long, is in a task whole, but for
    its matrices and its audit.

    Null role and text are read as one space, so such a text is blank; null turns stand
    first and don't count for gaps; null ids are one conversation.  Repeated rows are
    duplicates.  Empty roles and others than s, u, a fit nowhere unless changed.  An empty
    table gives an empty one.  Other columns, whatever their names, are not read.  A task
    holds a few copies of its longest text.
    """
    spark = turns.sparkSession
    named = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(name) for c, name in ((role, "role"), (text, "text"))])
    dealt = faults(named).repartitionByRange("conv", F.asc_nulls_first("turn"), "role", "text").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "text")
    long, many = T.LongType(), T.ArrayType(T.StringType())
    kinds = {"conv": named.schema["conv"].dataType, "part": T.IntegerType(), "no": T.IntegerType(), "whole": T.BooleanType(), **dict.fromkeys([*_STATS, "cost"], long), "matrix": T.ArrayType(long)}
    kinds |= {"audit": T.StringType(), "sha256": T.StringType(), "repaired": T.StringType(), "codes": T.BinaryType(), "faults": T.BinaryType(), "roles": many, "texts": many}
    schema = T.StructType([T.StructField(k, v) for k, v in kinds.items()])
    from pyspark.sql.pandas.types import to_arrow_schema

    solved = stored(dealt.mapInArrow(frugal(_pieces(to_arrow_schema(schema), keep_text)), schema), "conversations")
    figures = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = solved.where("whole").select("conv", gaps, *figures[1:], "audit", "sha256", "repaired")

    split = solved.where("not whole")
    cost_after = split.select("conv", "part", "no", *_STATS, "matrix").groupBy("conv").applyInArrow(_ends, "part int, no int, end array<long>, " + ", ".join(f"{c} long" for c in figures))
    cost_after = stored(cost_after, "conversation-ends")
    with_end = split.select("conv", "part", "no", "codes", "faults").join(cost_after.select("part", "no", "end"), ["part", "no"])
    exits = with_end.select("conv", "part", "no", "codes", "faults", "end").mapInArrow(_exits, T.StructType([T.StructField("conv", kinds["conv"]), T.StructField("part", T.IntegerType()), T.StructField("no", T.IntegerType()), T.StructField("exits", T.ArrayType(long))]))
    entries = exits.groupBy("conv").applyInArrow(_entries, "part int, no int, entry long, last boolean, head_part int, head_no int")
    traced = split.select("part", "no", "codes", "faults", "roles", "texts").join(cost_after.select("part", "no", "end"), ["part", "no"]).join(entries, ["part", "no"])
    bodies = traced.mapInArrow(frugal(_bodies), "head_part int, head_no int, part int, no int, audit string, body string")
    bodies = bodies.repartition("head_part", "head_no").sortWithinPartitions("head_part", "head_no", "part", "no")
    joined = bodies.mapInArrow(frugal(_joined(keep_text)), "part int, no int, audit string, sha256 string, repaired string")
    heads = split.select("conv", "part", "no").join(cost_after.where("cost is not null").drop("end"), ["part", "no"])
    parts = heads.join(joined, ["part", "no"]).select("conv", *figures, "audit", "sha256", "repaired")

    out = whole.unionByName(parts).select(F.col("conv").alias(conv), *figures, "audit", F.col("sha256").alias("repaired_sha256"), "repaired")
    return out if keep_text else out.drop("repaired")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` after faults that the crc32 of ``conv_id:turn`` (nulls: one space) plants, mod 20.

    0 drops the row, 1 empties the text, 2 removes its ``.!?``, 3 repeats the row, 4 sets role
    user.  Null role and text become one space; null conv_id and turn stay null in the rows.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text: Column = F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    rows = conversations.select("conv_id", "turn", "role", "text", kind.alias("_k")).where("_k <> 0")
    rows = rows.select("conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), "_k")
    return rows.withColumn("_n", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_k", "_n")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    repaired = repair_conversations(damaged(rows), keep_text=False)
    every = rows.select(F.col("conv_id").alias("c")).distinct()
    met = every.join(repaired, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select(F.col("c").alias("conv_id"), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
