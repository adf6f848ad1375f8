"""Conversation structure repair by a run-length dynamic program.

A conversation is a sequence of symbols, one a row: the initial of its role and its fault. The cheapest
edits that lead to ``(s?(ua)+)?`` are paths through four states (nothing yet, after s, after u,
after a). A symbol is a min-plus matrix over the states; with each entry goes the ASCII-least
string of edits that has its cost. Equal consecutive symbols are a run; a run is crossed by the
binary powers of its matrix, which are made once and cached, so ten thousand copies cost fourteen
steps. Costs to go are found from the end, choices from the start: at each power the least string
among those on a cheapest path. Strings between the same states hold equally many row edits and end
with one, so none is a prefix of another, and least parts make the least whole.

Spark's work: equal rows of a turn are counted before any shuffle by key; the narrow rows
(digests in place of texts) are sorted by range, so a conversation with a third of all rows
is dealt over many tasks as pieces of at most ``PIECE`` rows. A piece that may be only part of its conversation
is summed up as one matrix; matrices of a conversation are chained, and each piece then unrolls
its own choices. Texts are shuffled once, by conversation, to meet the edits. That last step streams a
conversation through one task in order, as a checksum of it must, and holds one batch, the audit and
a hash state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duefold.llm.common import column, crc32_of_id, written

#: Rows of a piece, equal rows counted once.
PIECE = 4096
BLANKS = "\t\n\x0b\f\r "

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3

_FAR = 1 << 60
_STATES = range(4)
#: State after keeping a row whose role begins with the letter.
_KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: State after a row of the role that is due.
_DUE = (2, 2, 3, 2)
#: Cost and edits that end a conversation from each state.
_END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
#: Symbol of rows that must go. The others are 1 + 2 * (place of the initial in s, u, a, else 3) + truncated.
GONE = 0


def _least(options):
    return min(options, default=(_FAR, ""))


@lru_cache(maxsize=4096)
def power(sym: int, k: int) -> tuple:
    """For 2^k rows of a symbol: [from][to] -> (cost, least string of edits)."""
    if k:
        half = power(sym, k - 1)
        return tuple(
            tuple(
                _least(
                    (half[i][m][0] + half[m][j][0], half[i][m][1] + half[m][j][1])
                    for m in _STATES
                    if half[i][m][0] < _FAR and half[m][j][0] < _FAR
                )
                for j in _STATES
            )
            for i in _STATES
        )
    rows = []
    for start in _STATES:
        found: dict[int, list] = {j: [] for j in _STATES}
        state, paid, edits = start, 0, ""
        # More than two inserted rows come back to a state that has been there.
        for _ in range(3):
            found[state].append((paid + DELETE, edits + "D"))
            if sym != GONE:
                letter, more = "sua-"[(sym - 1) // 2], TRUNCATED * ((sym - 1) % 2)
                if letter in _KEPT[state]:
                    found[_KEPT[state][letter]].append((paid + KEEP + more, edits + "K"))
                found[_DUE[state]].append((paid + REROLE + more, edits + "R"))
            state, paid, edits = _DUE[state], paid + INSERT, edits + "I"
        rows.append(tuple(_least(found[j]) for j in _STATES))
    return tuple(rows)


def blocks_of(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(symbol, length) runs as (symbol, k) blocks of 2^k rows, large ones first."""
    return [
        (sym, k) for sym, length in runs for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1
    ]


def collapsed(symbols: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for sym, length in symbols:
        if runs and runs[-1][0] == sym:
            runs[-1][1] += length
        elif length:
            runs.append([sym, length])
    return [(sym, length) for sym, length in runs]


def summary(blocks: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Costs [from][to] of a piece, and the rank of its least strings among those from one state."""
    costs, ranks = [], []
    for start in _STATES:
        reached = {start: (0, 0)}  # state: cost, rank of its string
        for sym, k in blocks:
            table = power(sym, k)
            options: dict[int, tuple] = {}
            for m, (paid, rank) in reached.items():
                for j in _STATES:
                    cost, edits = table[m][j]
                    if cost < _FAR:
                        option = (paid + cost, rank, edits)
                        options[j] = min(options.get(j, option), option)
            order = sorted((rank, edits) for _, rank, edits in options.values())
            reached = {j: (c, order.index((rank, edits))) for j, (c, rank, edits) in options.items()}
        costs += [reached.get(j, (_FAR, 0))[0] for j in _STATES]
        ranks += [reached.get(j, (_FAR, 0))[1] for j in _STATES]
    return costs, ranks


def unrolled(blocks: list[tuple[int, int]], state: int, to_go: list[int]) -> tuple[str, int]:
    """The edits of the blocks from ``state`` on, given the costs after them, and the last state."""
    costs = [to_go]
    for sym, k in reversed(blocks):
        table = power(sym, k)
        costs.append([min(table[i][j][0] + costs[-1][j] for j in _STATES) for i in _STATES])
    out = []
    for (sym, k), after in zip(blocks, reversed(costs[:-1])):
        table = power(sym, k)
        _, edits, state = min(
            (table[state][j][0] + after[j], table[state][j][1], j) for j in _STATES
        )
        out.append(edits)
    return "".join(out), state


_ROW_TYPE = "struct<turn:bigint,role:string,digest:binary,n:bigint,sym:int,fault:int>"


def _symbols(rows: list[dict]) -> Iterator[tuple[int, int]]:
    for row in rows:
        yield row["sym"], 1
        yield GONE, row["n"] - 1


def _edited(rows: list[dict], edits: str) -> Iterator[str]:
    """The edits of each entry of a piece: inserts belong to the row that follows them."""
    at = 0
    for row in rows:
        start, left = at, row["n"]
        while left:
            left -= edits[at] != "I"
            at += 1
        yield edits[start:at]


_PIECE = pa.schema(
    [
        ("key", pa.string()),
        ("piece", pa.int64()),
        ("costs", pa.list_(pa.int64())),
        ("ranks", pa.list_(pa.int64())),
        (
            "rows",
            pa.list_(
                pa.struct(
                    [
                        ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()),
                        ("n", pa.int64()), ("sym", pa.int32()), ("fault", pa.int32()),
                    ]
                )
            ),
        ),
    ]
)


def _pieces(most: int):
    """Sorted rows -> pieces; those that may be part of a longer conversation have a summary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33

        def piece(key, rows, whole):
            nonlocal number
            number += 1
            found = (None, None) if whole else summary(blocks_of(collapsed(_symbols(rows))))
            return {"key": key, "piece": number, "costs": found[0], "ranks": found[1], "rows": rows}

        # The first conversation of a task may have begun in the one before, the last may go on.
        out, held, key, rows, partial = [], 0, None, [], True
        for batch in batches:
            for row in batch.to_pylist():
                own = row.pop("key")
                if rows and (own != key or len(rows) == most):
                    partial = partial or own == key
                    out.append(piece(key, rows, not partial))
                    held += len(rows)
                    partial = own == key
                    rows = []
                    if held >= 1 << 14:
                        yield pa.RecordBatch.from_pylist(out, _PIECE)
                        out, held = [], 0
                key = own
                rows.append(row)
        if rows:
            out.append(piece(key, rows, False))
        if out:
            yield pa.RecordBatch.from_pylist(out, _PIECE)

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of conversations in order -> state before each piece and costs after it."""

    def solved(key, pieces):
        to_go = [cost for cost, _ in _END]
        after = []
        for _, costs, _ in reversed(pieces):
            after.append(to_go)
            to_go = [min(costs[4 * i + j] + to_go[j] for j in _STATES) for i in _STATES]
        state = 0
        for at, ((number, costs, ranks), rest) in enumerate(zip(pieces, reversed(after))):
            yield {
                "key": key, "piece": number, "state": state, "to_go": rest, "last": at == len(pieces) - 1,
            }
            state = min(
                (costs[4 * state + j] + rest[j], ranks[4 * state + j], j) for j in _STATES
            )[2]

    schema = pa.schema(
        [
            ("key", pa.string()), ("piece", pa.int64()), ("state", pa.int32()),
            ("to_go", pa.list_(pa.int64())), ("last", pa.bool_()),
        ]
    )
    key, pieces = None, []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["key"] != key:
                out += solved(key, pieces)
                key, pieces = row["key"], []
            pieces.append((row["piece"], row["costs"], row["ranks"]))
        yield pa.RecordBatch.from_pylist(out, schema)
    yield pa.RecordBatch.from_pylist(list(solved(key, pieces)), schema)


def _unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with their start and end -> one row an entry, with its edits."""
    schema = pa.schema(
        [
            ("key", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()),
            ("n", pa.int64()), ("fault", pa.int32()), ("edits", pa.string()),
        ]
    )
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            rows, to_go = x["rows"], x["to_go"] or [cost for cost, _ in _END]
            edits, state = unrolled(blocks_of(collapsed(_symbols(rows))), x["state"] or 0, to_go)
            parts = list(_edited(rows, edits))
            if x["last"] is not False:
                parts[-1] += _END[state][1]
            for row, part in zip(rows, parts):
                out.append(
                    {
                        "key": x["key"], "turn": row["turn"], "role": row["role"], "digest": row["digest"],
                        "n": row["n"], "fault": row["fault"], "edits": part,
                    }
                )
        yield pa.RecordBatch.from_pylist(out, schema)


#: Faults of an entry: that of its first row. Copies of a row beyond the first are duplicates.
SOUND, BLANK, DUPLICATE, SHORT = range(4)


def _named(turns: DataFrame, conv_column: str, turn_column: str, role_column: str, text_column: str):
    conv = column(conv_column)
    text = F.coalesce(column(text_column), F.lit(" "))
    return turns.select(
        # A null conversation is one of its own, apart from any other value.
        F.coalesce(F.concat(F.lit("="), conv.cast("string")), F.lit("")).alias("key"),
        conv.alias("conv"),
        column(turn_column).cast("long").alias("turn"),
        F.coalesce(column(role_column), F.lit(" ")).alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )


def row_edits(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """(key, turn, role, digest, n, fault, edits): the cheapest edits of each different row.

    ``rows`` has (key, turn, role, text, digest); ``n`` equal rows are one entry. Edits are K, R, D, and I for
    rows inserted before; those inserted at the end of a conversation go with its last row.
    """
    trimmed = F.rtrim("text", F.lit(BLANKS))
    end = F.substring(trimmed, -1, 1)
    seen = (
        F.when(F.length(trimmed) == 0, BLANK).when(end.isin(".", "!", "?"), SOUND).otherwise(SHORT)
    )
    counted = written(
        rows.select("key", "turn", "role", "digest", seen.alias("seen"))
        .groupBy("key", "turn", "role", "digest", "seen")
        .agg(F.count("*").alias("n")),
        "turns",
    )
    first = (
        counted.where(F.col("seen") != BLANK)
        .groupBy("key", "role", "digest")
        .agg(F.min(F.struct("turn")).alias("first"))
    )
    fault = (
        F.when(F.col("seen") == BLANK, BLANK)
        .when(F.col("first.turn").eqNullSafe(F.col("turn")), F.col("seen"))
        .otherwise(DUPLICATE)
    )
    initial = F.substring("role", 1, 1)
    letter = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    goes = F.col("fault").isin(BLANK, DUPLICATE)
    order = ["key", "turn", "role", "digest"]
    narrow = written(
        counted.join(first, ["key", "role", "digest"], "left")
        .withColumn("fault", fault.cast("int"))
        .withColumn(
            "sym",
            F.when(goes, GONE).otherwise(letter * 2 + 1 + (F.col("fault") == SHORT).cast("int")),
        )
        .select(*order, "n", "sym", "fault"),
        "symbols",
    )
    pieces = written(
        narrow.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(
            _pieces(piece),
            f"key string, piece long, costs array<long>, ranks array<long>, rows array<{_ROW_TYPE}>",
        ),
        "pieces",
    )
    states = (
        pieces.where("costs IS NOT NULL")
        .select("key", "piece", "costs", "ranks")
        .repartition("key")
        .sortWithinPartitions("key", "piece")
        .mapInArrow(_chained, "key string, piece long, state int, to_go array<long>, last boolean")
    )
    return (
        pieces.select("key", "piece", "rows")
        .join(states, ["key", "piece"], "left")
        .select("key", "rows", "state", "to_go", "last")
        .mapInArrow(
            _unrolled,
            "key string, turn long, role string, digest binary, n long, fault int, edits string",
        )
    )


class _Conversation:
    """What a walk along the rows of one conversation has met."""

    def __init__(self, conv):
        self.conv, self.state, self.lines = conv, 0, 0
        self.faults, self.illegal, self.cost = [0] * 4, 0, 0
        self.low = self.high = None
        self.turns, self.initial = 0, None
        self.audit, self.hash = [], hashlib.sha256()

    def meet(self, row) -> Iterator[tuple]:
        """Count an entry; its (edit, turn, role) in order, role None for a row that keeps its own."""
        n, turn = row["n"], row["turn"]
        initial = row["role"][:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        self.illegal += n - 1
        self.faults[row["fault"]] += 1 if row["fault"] != BLANK else n
        self.faults[DUPLICATE] += n - 1 if row["fault"] != BLANK else 0
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.audit.append(row["edits"])
        for edit in row["edits"]:
            if edit == "D":
                self.cost += DELETE
            elif edit == "I":
                self.cost += INSERT
                yield edit, None, self._due()
            else:
                self.cost += (edit == "R") * REROLE + (row["fault"] == SHORT) * TRUNCATED
                if edit == "R":
                    yield edit, turn, self._due()
                else:
                    self.state = _KEPT[self.state][initial]
                    yield edit, turn, row["role"]

    def _due(self) -> str:
        self.state = _DUE[self.state]
        return "assistant" if self.state == 3 else "user"

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def report(self) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return {
            "conv": self.conv, "gaps": gaps, "blank": self.faults[BLANK],
            "duplicate": self.faults[DUPLICATE], "truncated": self.faults[SHORT],
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit),
            "repaired_sha256": self.hash.hexdigest(),
        }


def _walk(batches: Iterator[pa.RecordBatch], conversations: bool) -> Iterator[list[dict]]:
    """Rows in order -> reports of conversations, or their repaired rows."""
    now, waiting = None, []
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if now and conversations:
                    out.append(now.report())
                now, waiting = _Conversation(row["conv"]), []
                continue
            if row["kind"] == 1:
                waiting = list(now.meet(row))
                text = None if any(e != "I" for e, _, _ in waiting) else ""
            else:
                text = row["text"]
            if waiting and text is not None:
                for edit, turn, role in waiting:
                    own = text if edit != "I" else ""
                    if not conversations:
                        out.append(
                            {
                                "conv": now.conv, "place": now.lines, "edit": edit, "turn": turn,
                                "role": role, "text": own,
                            }
                        )
                    now.line(role, own)
                waiting = []
        if out:
            yield out
    if now and conversations:
        yield [now.report()]


def _with_texts(
    turns: DataFrame, conversations: DataFrame | None, names: tuple, piece: int
) -> DataFrame:
    """Heads, edits and texts of each conversation, together and in order."""
    rows = _named(turns, *names)
    asked = rows if conversations is None else _named(conversations, *names)
    heads = asked.groupBy("key").agg(F.first("conv").alias("conv"))
    edits = row_edits(rows, piece)
    order = ["key", "turn", "role", "digest", "kind"]

    def line(frame: DataFrame, kind: int) -> DataFrame:
        wanted = {
            "conv": heads.schema["conv"].dataType, "key": "string", "turn": "long", "role": "string",
            "digest": "binary", "n": "long", "fault": "int", "edits": "string", "text": "string",
        }
        have = [
            (F.col(c) if c in frame.columns and not (c == "conv" and kind) else F.lit(None)).cast(t).alias(c)
            for c, t in wanted.items()
        ]
        return frame.select(*have, F.lit(kind).alias("kind"))

    whole = line(heads, 0).unionByName(line(edits, 1)).unionByName(line(rows, 2))
    return whole.repartition("key").sortWithinPartitions(*order)


def _schema(frame: DataFrame, fields: str) -> str:
    return f"conv {frame.schema['conv'].dataType.simpleString()}, {fields}"


def _run(conversations: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        conv = first.schema.field("conv")
        longs = pa.int64()
        types = {"edit": pa.string(), "role": pa.string(), "text": pa.string()}
        types |= {"audit": pa.string(), "repaired_sha256": pa.string(), "conv": conv.type}
        schema = pa.schema([(name, types.get(name, longs)) for name in names])

        def again():
            yield first
            yield from batches

        for rows in _walk(again(), conversations):
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def repaired_turns(
    turns: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    piece: int = PIECE,
) -> DataFrame:
    """The rows of repaired conversations: the id, place (from 0), edit (K, R or I), turn, role, text.

    Rows are taken by turn, nulls first, then role and SHA-256 of the text. Inserted rows have a null
    turn and an empty text. See ``repair_report`` for what is a fault and how odd input counts.
    """
    names = (conv_column, turn_column, role_column, text_column)
    whole = _with_texts(turns, None, names, piece)
    fields = ["conv", "place", "edit", "turn", "role", "text"]
    found = whole.mapInArrow(
        _run(False, fields),
        _schema(whole, "place long, edit string, turn long, role string, text string"),
    )
    return found.withColumnRenamed("conv", conv_column)


def repair_report(
    turns: DataFrame,
    conversations: DataFrame | None = None,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    piece: int = PIECE,
) -> DataFrame:
    """One row per conversation of ``conversations`` (default: ``turns``).

    Columns: the id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. ``gaps``
    is the number of turns missing between the least and the largest; ``illegal`` counts adjacent rows
    whose role initials are not su, ua or au; ``audit`` is the ASCII-least string of the cheapest edits.

    * A null role or text counts as one space, a null conversation as one of its own; null turns
      come first and count for no gap.
    * Rows of one turn are ordered by role and SHA-256 of the text; equal rows stand side by side, and
      all but the first are duplicates, as are equal role and text at a later turn.
    * A blank row is no duplicate, a duplicate is not counted as truncated.
    * A conversation without rows has zeros, an empty audit and the hash of nothing. An empty
      table gives no rows.
    * Texts of any length are whole in one row; other columns are ignored, clashing names too.
    """
    names = (conv_column, turn_column, role_column, text_column)
    whole = _with_texts(turns, conversations, names, piece)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = ["conv", *counts, "audit", "repaired_sha256"]
    found = whole.mapInArrow(
        _run(True, fields),
        _schema(whole, ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string"),
    )
    return found.withColumnRenamed("conv", conv_column)


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults put in by a checksum of conversation and turn.

    Remainders by 20: 0 drops the row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it,
    4 makes its role user. Null parts of the key, roles and texts count as one space.
    """

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(crc32_of_id(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))), F.lit(20))
    text = (
        F.when(F.col("kind") == 1, "")
        .when(F.col("kind") == 2, F.translate(spaced("text"), ".!?", ""))
        .otherwise(spaced("text"))
    )
    times = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        turns.select("conv_id", "turn", "role", "text", kind.alias("kind"))
        .where("kind != 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(spaced("role")).alias("role"),
            text.alias("text"),
            F.explode(times).alias("copy"),
        )
        .drop("copy")
    )
