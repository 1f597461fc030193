"""Conversation repair: odd rows and the giants' way, held against all edit strings of least cost."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from salescast.llm import conversations

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """conv_id -> result, by a programme over (cost, edit string, repaired rows) themselves."""
    by, out = {}, {}
    for conv, turn, role, text in rows:
        got = by.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, d = (" " if x is None else x for x in (role, text, zlib.crc32(name.encode()) % 20))
        if d == 0:
            continue
        role = "user" if d == 4 else role
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        got += [(turn, role, text)] * (2 if d == 3 else 1)
    for conv, got in by.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        n, seen, faults = [0, 0, 0], set(), []
        for _, role, text in got:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            if fault is not None:
                n[fault] += 1
        letters = [r[1][:1] for r in got]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        best = {"": (0, "", ())}  # by the last two letters that matter

        def insert(best):
            for _ in range(4):
                for s, (c, e, rep) in list(best.items()):
                    for role in ("user", "assistant"):
                        put(best, s, role, (c + 5, e + "I", rep + ((role, ""),)))

        def put(best, s, role, way):
            s2 = {"s": "s" if s == "" else None, "u": "u" if s in ("", "s", "a") else None,
                  "a": "a" if s == "u" else None}.get(role[:1])
            if s2 is not None and (s2 not in best or way < best[s2]):
                best[s2] = way

        for (_, role, text), fault in zip(got, faults):
            insert(best)
            now = {}
            for s, (c, e, rep) in best.items():
                if s not in now or (c + 2, e + "D", rep) < now[s]:
                    now[s] = (c + 2, e + "D", rep)
                if fault in (0, 1):
                    continue
                more = 5 if fault == 2 else 0
                put(now, s, role, (c + more, e + "K", rep + ((role, text),)))
                for r in ("user", "assistant"):
                    put(now, s, r, (c + 1 + more, e + "R", rep + ((r, text),)))
            best = now
        insert(best)
        cost, audit, rep = min(best[s] for s in ("", "a") if s in best)
        turns = [t for t, _, _ in got if t is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n, illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rep).encode()).hexdigest())
    return out


def made(seed, n):
    rng, rows = random.Random(seed), []
    texts = ["Yes.", "No!", "Why?", "and then", " ", "", None, "Fine. ", "x" * 3000 + "."]
    for conv in [None, *range(n)]:
        for turn in range(rng.choice([1, 2, 4, 9, 30])):
            rows.append((conv, rng.choice([turn, turn, turn, None, 2 * turn]),
                         rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
                         rng.choice([*texts, f"t{rng.randrange(9**6)}."])))
    return rows + rows[:3]


@pytest.mark.parametrize("limit", [conversations.ROWS, 3, 0])
def test_against_brute_force(spark, limit):
    rows = made(5, 150)
    df = spark.createDataFrame(rows, ROWS).withColumns({"key": F.lit(1), "same": F.lit("x"), "n": F.lit(None)})
    got = {r[0]: tuple(r)[1:] for r in conversations.repair(df, rows=limit).collect()}
    assert got == brute(rows)


def test_batches_of_few_rows_carry_the_state(spark):
    rows = made(6, 60)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r[0]: tuple(r)[1:] for r in conversations.repair(spark.createDataFrame(rows, ROWS), rows=20).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert got == brute(rows)


def test_chunks_of_few_rows(spark):
    rows = made(7, 40)
    turns = conversations.damaged(spark.createDataFrame(rows, ROWS))
    got = {r[0]: tuple(r)[1:] for r in conversations.repair_giant(turns, turns.schema["conv_id"].dataType, 4).collect()}
    assert got == brute(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in conversations.repair(df).collect()} == brute(rows)


def test_empty(spark):
    assert conversations.repair(spark.createDataFrame([], ROWS)).count() == 0
