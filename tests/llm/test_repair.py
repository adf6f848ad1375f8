import hashlib
import itertools
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duefold.llm import conversation_repair as repair
from duefold.llm.queries import QUERIES

MIDDLE = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\f\r"


def legal(initials):
    body = initials[1:] if initials.startswith("s") else initials
    return initials == "" or (body and body == "ua" * (len(body) // 2))


def cheapest(rows):
    """(cost, audit, lines) over all edits, by a plain search; rows are (role, text, fault)."""
    # Only the place in the pattern matters for what follows: '', 's', 'u' or 'a'.
    best = {"": (0, "", ())}

    def better(table, place, way):
        if place not in table or way < table[place]:
            table[place] = way

    def follows(place, role):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[place].find(role[:1]) >= 0 and role[:1] != ""

    def with_inserts(table):
        out = dict(table)
        for _ in range(3):
            for place, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    if follows(place, role):
                        better(out, role[0], (cost + 3, audit + "I", lines + (f"{role}:",)))
        return out

    for role, text, fault in rows:
        after = {}
        extra = 3 * (fault == "truncated")
        for place, (cost, audit, lines) in with_inserts(best).items():
            better(after, place, (cost + 4, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            if follows(place, role):
                better(after, role[0], (cost + extra, audit + "K", lines + (f"{role}:{text}",)))
            for new in ("user", "assistant"):
                if follows(place, new):
                    better(after, new[0], (cost + 3 + extra, audit + "R", lines + (f"{new}:{text}",)))
        best = after
    return min(way for place, way in with_inserts(best).items() if place in ("", "a"))


def report(rows):
    """The contract's columns for rows (turn, role, text) of one conversation, in order."""
    rows = sorted(
        rows,
        key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()),
    )
    seen, faulty = set(), []
    for _, role, text in rows:
        end = text.strip(BLANKS)
        fault = "" if end[-1:] in (".", "!", "?") else "truncated"
        fault = "blank" if not end else "duplicate" if (role, text) in seen else fault
        seen.add((role, text))
        faulty.append((role, text, fault))
    cost, audit, lines = cheapest(faulty)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[1][:1] for r in rows]
    kinds = [f for _, _, f in faulty]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_damage_and_report(spark):
    table = spark.read.parquet(f"{MIDDLE}/conversations.parquet")
    damaged = defaultdict(list)
    for conv, turn, role, text in table.collect():
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = {1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(kind, text)
        row = (turn, "user" if kind == 4 else role, text)
        damaged[conv] += [row] * {0: 0, 3: 2}.get(kind, 1)
    found = QUERIES["op11_conversation_repair"](spark, MIDDLE).collect()
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found} == {
        conv: report(rows) for conv, rows in damaged.items()
    }


ROWS = [("system", "x."), ("user", "x."), ("assistant", "x."), ("tool", "x."), ("user", "y"), ("system", "")]


def test_every_short_conversation(spark):
    """All sequences of up to four of six kinds of rows, in pieces of two and whole."""
    kinds = [k for n in range(1, 5) for k in itertools.product(range(len(ROWS)), repeat=n)]
    rows = [(c, t, *ROWS[x]) for c, kind in enumerate(kinds) for t, x in enumerate(kind)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    expected = {
        c: report([(t, *ROWS[x]) for t, x in enumerate(kind)]) for c, kind in enumerate(kinds)
    }
    for piece in (2, repair.PIECE):
        found = repair.repair_report(turns, piece=piece).collect()
        assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found} == expected


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 8), st.integers(1, 300)), min_size=1, max_size=9),
    st.integers(1, 7),
)
def test_pieces_and_powers_agree_with_single_rows(runs, cut):
    runs = repair.collapsed(iter(runs))
    end = [c for c, _ in repair._END]
    single = [(sym, 0) for sym, length in runs for _ in range(length)]
    whole, state = repair.unrolled(repair.blocks_of(runs), 0, end)
    assert (whole, state) == repair.unrolled(single, 0, end)
    # The same in pieces that know only their summaries.
    pieces = [single[k : k + cut * 40] for k in range(0, len(single), cut * 40)]
    sums = [repair.summary(p) for p in pieces]
    to_go, after = end, []
    for costs, _ in reversed(sums):
        after.append(to_go)
        to_go = [min(costs[4 * i + j] + to_go[j] for j in range(4)) for i in range(4)]
    state, parts = 0, ""
    for piece, (costs, ranks), rest in zip(pieces, sums, reversed(after)):
        edits, reached = repair.unrolled(piece, state, rest)
        state = min((costs[4 * state + j] + rest[j], ranks[4 * state + j], j) for j in range(4))[2]
        assert reached == state
        parts += edits
    assert parts == whole


def test_a_hot_conversation_of_copies(spark):
    """Half of the rows in one conversation, most of them equal; pieces of any size agree."""
    hot = [(1, t, "user" if t % 3 else "assistant", f"t{t % 7}.") for t in range(900)]
    hot += [(1, 5, "user", "again and again.")] * 3000
    rest = [(c, t, "ua"[t % 2] + "x", "fine.") for c in range(2, 400) for t in range(4)]
    turns = spark.createDataFrame(hot + rest, "conv_id long, turn long, role string, text string")
    by_piece = [
        {r.conv_id: tuple(r) for r in repair.repair_report(turns, piece=p).collect()} for p in (16, 4096)
    ]
    assert by_piece[0] == by_piece[1] and len(by_piece[0]) == 399
    assert by_piece[0][1][1:] == report([r[1:] for r in hot])


def test_repaired_rows(spark):
    rows = [(7, 0, "system", "s."), (7, 1, "assistant", "a."), (7, 2, "user", "b."), (7, 3, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = sorted(repair.repaired_turns(turns).collect(), key=lambda r: r.place)
    assert [tuple(r) for r in found] == [
        (7, 0, "K", 0, "system", "s."), (7, 1, "I", None, "user", ""), (7, 2, "K", 1, "assistant", "a."),
        (7, 3, "K", 2, "user", "b."), (7, 4, "I", None, "assistant", ""),
    ]
    assert repair.repair_report(turns).first().audit == "KIKKDI"


def test_odd_and_empty_tables(spark):
    schema = "conv_id string, turn int, role string, text string, key string, kind int, edits string, conv int"
    extra = ("k", 1, "e", 2)
    rows = [
        (None, None, None, None), (None, None, "user", "q?"), (None, 3, "assistant", "yes. "),
        (None, 9, "user", None), ("", 1, "", "x"), (" ", 1, "user", "é" * 300000 + "."),
        ("a", 1, "user", "same."), ("a", 1, "user", "same."), ("a", None, "user", "same."),
    ]
    turns = spark.createDataFrame([r + extra for r in rows], schema)
    others = spark.createDataFrame([("none",), ("a",), (None,), ("",), (" ",)], "conv_id string").selectExpr(
        "conv_id", "1 AS turn", "'' AS role", "'' AS text"
    )
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair_report(turns, others).collect()}
    spaced = [(t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows]
    for conv in (None, "", " ", "a"):
        assert found[conv] == report([s for s, r in zip(spaced, rows) if r[0] == conv])
    assert found["none"] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_report(turns.limit(0)).count() == 0
    assert repair.repaired_turns(turns.limit(0)).count() == 0


@pytest.mark.parametrize("column", ["conv_id", "turn", "role", "text"])
def test_null_parts_of_the_damage(spark, column):
    rows = [(c, t, "user", "hello. there") for c in range(30) for t in range(3)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    table = table.withColumn(column, F.lit(None).cast(dict(table.dtypes)[column]))
    found = repair.damaged(table)
    kept = [
        (c, t)
        for c, t, _, _ in rows
        for _ in range({0: 0, 3: 2}.get(zlib.crc32(f"{' ' if column == 'conv_id' else c}:{' ' if column == 'turn' else t}".encode()) % 20, 1))
    ]
    assert found.count() == len(kept)
    assert found.where("role IS NULL OR text IS NULL").isEmpty()
