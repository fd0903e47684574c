"""Repair of conversations against a plain search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from specloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, chunk int, n int"
SMALL = "/root/testdata/sf0.001"


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        case = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if case == 0 else 2 if case == 3 else 1)
    name = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, name(r)))


def _searched(rows):
    """Cheapest first, then the least audit: states are (row, role initials so far stand in the grammar)."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if (i, last) in seen:
            continue
        seen.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        for role in ("user", "assistant"):
            if role[0] in follow[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", i, role[0], (*out, f"{role}:")))
        if i == len(rows):
            continue
        role, text, fault = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        if role[:1] and role[:1] in follow[last]:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
        for new in ("user", "assistant"):
            if new[0] in follow[last]:
                heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, new[0], (*out, f"{new}:{text}")))


def plain(rows):
    """The contract's row for one conversation, row by row."""
    rows, seen, faulty = _damaged(rows), set(), []
    for _, role, text in rows:
        held = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role, text, fault))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, out = _searched(faulty)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = lambda f: sum(x[2] == f for x in faulty)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def _held(spark, rows, size=repair.CHUNK, parts=None):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesce = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    if parts:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair.digests(df, size)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        got = {r[0]: tuple(r)[1:] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert got.keys() == by.keys()
    for conv, own in by.items():
        assert got[conv] == plain(own), (conv, own[:9])


def _random(seed, convs, most, hot=0):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Well. and", "Fine. "] + [f"Text {i}." for i in range(12)]
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            rows.append((c, rng.choice([t, t, t, t + 2, None]), role, rng.choice([*texts, None])))
    rows += [(10**6, rng.randint(0, 400), rng.choice(["user", "assistant"]), f"{rng.choice(texts)} {rng.randint(0, 500)}.") for _ in range(hot)]
    rng.shuffle(rows)
    return rows


def test_random_conversations(spark):
    _held(spark, _random(1, 120, 9) + [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Hello.")])


@pytest.mark.parametrize(("size", "parts"), [(3, 7), (1, 3), (50, 11)])
def test_long_conversations_in_chunks(spark, size, parts):
    _held(spark, _random(size, 12, 14, hot=300), size, parts)


def test_one_row_repeated_very_often(spark):
    _held(spark, [(1, 1, "user", "Again.")] * 3000 + [(1, 2, "assistant", "Yes.")] * 2000 + [(2, t, "user", "Same.") for t in range(700)], 40, 5)


def test_small_tables(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    _held(spark, table)
    dropped = next(c for c in range(10**4) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    _held(spark, [(dropped, 0, "user", "Gone.")])
    assert repair.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_turns_are_real(spark):
    rows = spark.createDataFrame([(1, 1, "user", "Hi.", 1), (1, 2, "tool", "Call.", 1), (1, 3, "user", "More", 1)], "conv_id long, turn long, role string, text string, copies long")
    out = repair.repair(rows).collect()
    assert [(t["role"], t["text"]) for r in out for t in r["turns"]] == [("user", "Hi."), ("assistant", "Call.")] and [r["edits"] for r in out] == ["KRD"]


def test_a_long_text(spark):
    _held(spark, [(1, 1, "user", "word " * 200_000 + "end."), (1, 2, "assistant", "Ok.")])
