"""Repair of the structure of conversations by dynamic programming.

A conversation is well formed if its roles' initials read s?(ua)+ or nothing. Each row may be kept, given
another role or deleted, and rows may be inserted; the cheapest edits are wanted, and of those the ones
whose initials are least in ASCII order. The cost to go from each grammar state is worked out from the last
row back; a walk from the first row then takes the least letter among the edits that lose nothing.

Rows are dealt out by ranges of (conversation, turn), so a task works through whole short conversations in
order. A conversation that is longer than a chunk, or lies across two tasks, is worked off in chunks: each
gives the least cost between any two states, these are combined from the last chunk back (costs to go) and
from the first one on (states), and the chunks are then walked side by side. No task holds more than a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.llm.common import materialize

CHUNK = 4096  # rows of a chunk
START, SYSTEM, USER, ASSISTANT = range(4)  # grammar states: nothing yet, or the initial that came last
NEXT = (USER, USER, ASSISTANT, USER)  # the state after the row that each state may be followed by
ROLE = {USER: "user", ASSISTANT: "assistant"}
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
DONE = (0, 10, 5, 0)  # cost to go after the last row: what is open is closed by insertions
RIGHT, CUT, BAD = range(3)  # kinds of rows: nothing wrong, truncated, to be deleted
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5  # costs
FAR = 1 << 60  # no way

BLANKS = " \t\n\x0b\x0c\r"
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_CHUNKS = pa.schema([
    ("conv_id", pa.int64()), ("chunk", pa.int64()), ("whole", pa.bool_()),
    *[(c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal", "n_turns", "first_turn", "last_turn")], ("first_initial", pa.string()), ("last_initial", pa.string()),
    ("cost", pa.int64()), ("edits", pa.string()), ("turns", _TURNS), ("ways", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("copies", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
_DDL = "conv_id long, chunk long, whole boolean, n long, blank long, duplicate long, truncated long, illegal long, n_turns long, first_turn long, last_turn long, first_initial string, last_initial string, cost long, edits string, turns array<struct<role:string,text:string>>, ways array<long>, kinds array<int>, copies array<long>, roles array<string>, texts array<string>"

Row = tuple[int, int, str, str]  # kind, copies (all but the first are to be deleted, and all of a BAD row), role, text


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: every twentieth row or so dropped (copies 0), emptied, robbed of its marks, repeated, or made a user's.

    Nulls count as one space.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.encode(F.concat(named("conv_id"), F.lit(":"), named("turn")), "UTF-8")) % 20
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    return conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.when(case == 4, "user").otherwise(named("role")).alias("role"),
        text.alias("text"), F.when(case == 0, 0).when(case == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def costs_to_go(rows: list[Row], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each row, and after the last, the least cost of the rest from each state; ``end`` holds after the last row."""
    out, v = [end], end
    for kind, _, role, _ in reversed(rows):
        if kind != BAD:
            more, best = TRUNCATED if kind == CUT else 0, []
            for q in range(4):
                kept = MOVES.get((q, role[:1]))
                best.append(min(DELETE + v[q], RELABEL + more + v[NEXT[q]], FAR if kept is None else more + v[kept]))
            v = tuple(min(best[q], INSERT + best[NEXT[q]], 2 * INSERT + best[NEXT[NEXT[q]]]) for q in range(4))
        out.append(v)
    return out[::-1]


def walk(rows: list[Row], to_go: list[tuple[int, ...]], state: int) -> tuple[str, int, list[dict], int]:
    """The cheapest edits from ``state``, ASCII-least among them: their initials, cost, the rows they leave, and the state reached."""
    edits, cost, turns = [], 0, []
    for i, (kind, copies, role, text) in enumerate(rows):
        if kind == BAD:
            edits.append("D" * copies)
            cost += DELETE * copies
            continue
        more, after = TRUNCATED if kind == CUT else 0, to_go[i + 1]
        while True:
            here = to_go[i][state]
            if here == DELETE + after[state]:
                edits.append("D")
                cost += DELETE
                break
            if here == INSERT + to_go[i][NEXT[state]]:
                state = NEXT[state]
                edits.append("I")
                cost += INSERT
                turns.append({"role": ROLE[state], "text": ""})
                continue
            kept = MOVES.get((state, role[:1]))
            if kept is not None and here == more + after[kept]:
                state = kept
                edits.append("K")
                cost += more
                turns.append({"role": role, "text": text})
            else:
                state = NEXT[state]
                edits.append("R")
                cost += RELABEL + more
                turns.append({"role": ROLE[state], "text": text})
            break
        edits.append("D" * (copies - 1))
        cost += DELETE * (copies - 1)
    return "".join(edits), cost, turns, state


def close(state: int) -> tuple[str, int, list[dict]]:
    """What is inserted after the last row."""
    edits, turns = "", []
    while DONE[state]:
        state = NEXT[state]
        edits += "I"
        turns.append({"role": ROLE[state], "text": ""})
    return edits, INSERT * len(edits), turns


class _Gathered:
    """Rows of one conversation that follow each other, up to a chunk, with what is counted on them."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows = conv_id, []
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, role: str, text: str, copies: int, repeated: bool) -> None:
        held = text.rstrip(BLANKS)
        initial = role[:1]
        if not held:
            kind, self.blank = BAD, self.blank + copies
        elif repeated:
            kind, self.duplicate = BAD, self.duplicate + copies
        else:
            kind = RIGHT if held[-1] in ".!?" else CUT
            self.truncated += kind == CUT
            self.duplicate += copies - 1
        self.illegal += copies - 1
        if self.last_initial is not None:
            self.illegal += self.last_initial + initial not in LEGAL
        else:
            self.first_initial = initial
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.n += copies
        self.rows.append((kind, copies, role, text))

    def out(self, chunk: int, whole: bool) -> dict:
        row = {"chunk": chunk, "whole": whole} | {k: v for k, v in vars(self).items() if k != "rows"}
        if whole:
            edits, cost, turns, state = walk(self.rows, costs_to_go(self.rows, DONE), START)
            tail, more, inserted = close(state)
            return row | {"cost": cost + more, "edits": edits + tail, "turns": turns + inserted}
        ends = [tuple(0 if q == r else FAR for q in range(4)) for r in range(4)]
        ways = [costs_to_go(self.rows, e)[0] for e in ends]  # ways[r][q]: from q to r
        kinds, copies, roles, texts = zip(*self.rows, strict=True)
        return row | {"ways": [min(ways[r][q], FAR) for q in range(4) for r in range(4)], "kinds": kinds, "copies": copies, "roles": roles, "texts": texts}


LEGAL = {"su", "ua", "au"}


def _gather(ordered: DataFrame, size: int) -> DataFrame:
    """Chunks of rows ordered by conversation within each partition. A conversation inside one partition, not above ``size`` rows, is finished (whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ready, inner, group = TaskContext.get().partitionId() << 32, [], False, None
        for batch in batches:
            for conv, turn, role, text, copies, repeated in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group is not None and group.conv_id != conv:
                    ready.append(group.out(number, inner))
                    number, inner, group = number + 1, True, _Gathered(conv)
                elif group is None:
                    group = _Gathered(conv)
                elif len(group.rows) >= size:
                    ready.append(group.out(number, False))
                    number, inner, group = number + 1, False, _Gathered(conv)
                group.add(turn, role, text, copies, repeated)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, _CHUNKS)
                ready = []
        if group is not None:  # it may go on in the next partition
            yield pa.RecordBatch.from_pylist([group.out(number, False)], _CHUNKS)

    return ordered.select("conv_id", "turn", "role", "text", "copies", "repeated").mapInArrow(run, _DDL)


def _scan(rows: DataFrame, step: Callable, name: str, many: bool, back: bool = False) -> DataFrame:
    """conv_id, chunk and a result in column ``name`` (many: a list): chunk by chunk through each conversation, with a state carried over.

    step(state, row, whether the conversation begins) gives the state and a result.
    """
    kind = pa.list_(pa.int64()) if many else pa.int64()
    order = F.desc("chunk") if back else F.asc("chunk")
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                state, found = step(state, row, not begun or row["conv_id"] != before)
                before, begun = row["conv_id"], True
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(out, kind)], ["conv_id", "chunk", name])

    return rows.mapInArrow(run, f"conv_id long, chunk long, {name} {'array<long>' if many else 'long'}")


def _rows(row: dict, texts: bool) -> list[Row]:
    return list(zip(row["kinds"], row["copies"], row["roles"], row["texts"] if texts else row["roles"], strict=True))


def repair(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """The repaired chunks of damaged conversations (conv_id, turn, role, text, copies; copies 0: no row).

    Rows are taken by turn, nulls first; rows of one turn by the SHA-256 of role and text, by which rows are also
    compared. A null conversation is one like any other. Each result row has conv_id, chunk (ordered within a
    conversation), whole (whether it is the only one), the counts of faults, the edits' initials, their cost,
    and turns, the repaired rows in order. Equal rows of one turn are counted before they are dealt out.
    """
    name = F.unhex(F.sha2(F.encode(F.concat(F.length("role"), F.lit(":"), "role", "text"), "UTF-8"), 256))
    one = rows.filter("copies > 0").withColumn("name", name).groupBy("conv_id", "turn", "name").agg(F.sum("copies").alias("copies"), F.any_value("role").alias("role"), F.any_value("text").alias("text"))
    one = materialize(one, "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = one.filter(F.trim(F.col("text"), F.lit(BLANKS)) != "").select("conv_id", "turn", "name", place.alias("place"))
    first = said.groupBy(F.col("conv_id").alias("_c"), F.col("name").alias("_n")).agg(F.min("place").alias("_first"), F.count("*").alias("_k")).filter("_k > 1")
    again = said.join(first, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("name") == F.col("_n"))).filter("place > _first").select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("name").alias("_n"), F.lit(True).alias("repeated"))
    marked = one.join(again, one["conv_id"].eqNullSafe(F.col("_c")) & one["turn"].eqNullSafe(F.col("_t")) & (one["name"] == F.col("_n")), "left").select(*[one[c] for c in ("conv_id", "turn", "name", "role", "text", "copies")], F.coalesce("repeated", F.lit(False)).alias("repeated"))
    ordered = marked.repartitionByRange("conv_id", "turn", "name").sortWithinPartitions("conv_id", "turn", "name")
    chunks = materialize(_gather(ordered, size), "chunks")
    done = chunks.filter("whole").select("conv_id", "chunk", "whole", *COUNTS, "cost", "edits", "turns")
    open_ = chunks.filter("NOT whole")

    def back(state, row, begins):
        after = DONE if begins else state
        ways = row["ways"]
        return [min(ways[4 * q + r] + after[r] for r in range(4)) for q in range(4)], list(after)

    def on(state, row, begins):
        here = START if begins else state
        return row["reached"][here], here

    def reached(batch: pa.RecordBatch) -> list:
        out = []
        for row in batch.to_pylist():
            rows_ = _rows(row, False)
            to_go = costs_to_go(rows_, tuple(row["after"]))
            out.append([walk(rows_, to_go, q)[3] for q in range(4)])
        return out

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), pa.array(reached(batch), pa.list_(pa.int32()))], ["conv_id", "chunk", "reached"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost, edits, turns = [], [], []
            for row in batch.to_pylist():
                rows_ = _rows(row, True)
                e, c, t, state = walk(rows_, costs_to_go(rows_, tuple(row["after"])), row["here"])
                if row["is_last"]:
                    tail, more, inserted = close(state)
                    e, c, t = e + tail, c + more, t + inserted
                edits.append(e)
                cost.append(c)
                turns.append(t)
            kept = [batch.column(c) for c in ("conv_id", "chunk", "whole", *COUNTS)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(cost, pa.int64()), pa.array(edits, pa.string()), pa.array(turns, _TURNS)], ["conv_id", "chunk", "whole", *COUNTS, "cost", "edits", "turns"])

    after = materialize(_scan(open_.select("conv_id", "chunk", "ways"), back, "after", many=True, back=True), "after")
    kept = after.drop("conv_id")
    to = open_.select("conv_id", "chunk", "kinds", "copies", "roles").join(kept, "chunk").mapInArrow(ends, "conv_id long, chunk long, reached array<int>")
    here = _scan(to, on, "here", many=False).join(kept, "chunk")
    final = open_.groupBy("conv_id").agg(F.max("chunk").alias("chunk"), F.lit(True).alias("is_last")).drop("conv_id")
    walked = open_.join(here.drop("conv_id"), "chunk").join(final, "chunk", "left").select("conv_id", "chunk", "whole", *COUNTS, "kinds", "copies", "roles", "texts", "after", "here", F.coalesce("is_last", F.lit(False)).alias("is_last"))
    schema = ", ".join(x for x in _DDL.split(", ") if x.split()[0] in ("conv_id", "chunk", "whole", *COUNTS, "cost", "edits", "turns"))
    return done.unionByName(walked.mapInArrow(finish, schema))


COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "n_turns", "first_turn", "last_turn", "first_initial", "last_initial")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its chunks in order. The hash takes them in one after another."""
    names = ["conv_id", *[c.split()[0] for c in _RESULT.split(", ")]]
    types = [pa.int64(), *[pa.int64()] * 6, pa.string(), pa.string()]
    now, digest, edits, begun, low, high, turns, initial = None, None, [], False, None, None, 0, None

    def result() -> list:
        gaps = high - low + 1 - turns if low is not None else 0
        return [now["conv_id"], gaps, *[now[c] for c in ("blank", "duplicate", "truncated", "illegal", "cost")], "".join(edits), digest.hexdigest()]

    for batch in batches:
        ready = []
        for row in batch.to_pylist():
            if now is None or now["conv_id"] != row["conv_id"]:
                if now is not None:
                    ready.append(result())
                now, digest, edits, begun, low, high, turns, initial = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"conv_id": row["conv_id"]}, hashlib.sha256(), [], False, None, None, 0, None
            for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                now[c] += row[c]
            now["illegal"] += initial is not None and initial + row["first_initial"] not in LEGAL
            initial = row["last_initial"]
            if row["first_turn"] is not None:
                turns += row["n_turns"] - (high == row["first_turn"])
                low, high = row["first_turn"] if low is None else low, row["last_turn"]
            edits.append(row["edits"])
            for t in row["turns"]:
                digest.update((("\n" if begun else "") + f"{t['role']}:{t['text']}").encode())
                begun = True
        if ready:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready, strict=True), types, strict=True)], names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(result(), types, strict=True)], names)


def digests(conversations: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per conversation of ``conversations``, after :func:`damage` and :func:`repair`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation without a row after damage gives zeros, an empty audit and the hash of the empty string. gaps counts the
    turns missing between the first and the last; rows without a turn are left out of it. Hashes of a long
    conversation are taken chunk by chunk in order, since the hash is sequential by its definition.
    """
    rows = damage(conversations)
    chunks = repair(rows, size)
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    short = chunks.filter("whole").select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", F.col("edits").alias("audit"), F.sha2(F.encode(spelled, "UTF-8"), 256).alias("repaired_sha256"))
    long = chunks.filter("NOT whole").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "chunk").mapInArrow(_folded, "conv_id long, " + _RESULT)
    gone = rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).filter("n = 0")
    zero = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return short.unionByName(long).unionByName(gone.select("conv_id", *zero, F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256")))
