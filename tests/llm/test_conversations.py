"""Conversation repair against a plain search over all edits, and at odd inputs."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from peakfield.llm import conversations as C

ROWS = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out += [(conv, turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    return out


def plain_repair(rows):
    """The same results by a memoized search from the last row back: the least (cost, edits) of what remains."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        words = text.strip(" \t\n\x0b\f\r")
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(at, state, inserts):
        found = []
        if at == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        ways = []
        if inserts < 3:
            ways.append((5, "I", follows[state][-1], at, inserts + 1, {"u": "user", "a": "assistant"}[follows[state][-1]] + ":"))
        if at < len(rows):
            _, _, role, text = rows[at]
            ways.append((2, "D", state, at + 1, 0, None))
            if faults[at] not in ("blank", "duplicate"):
                more = 5 * (faults[at] == "truncated")
                if role[:1] and role[:1] in follows[state]:
                    ways.append((more, "K", role[:1], at + 1, 0, f"{role}:{text}"))
                for name in ("user", "assistant"):
                    if name[0] in follows[state]:
                        ways.append((1 + more, "R", name[0], at + 1, 0, f"{name}:{text}"))
        for cost, edit, to, then, n, line in ways:
            rest = best(then, to, n)
            if rest:
                found.append((cost + rest[0], edit + rest[1], ((line,) if line is not None else ()) + rest[2]))
        return min(found) if found else None

    cost, audit, lines = best(0, "", 0)
    turns = {r[1] for r in rows if r[1] is not None}
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    assert LEGAL.fullmatch("".join(x[0] for x in lines))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected(rows, damage=True):
    left = plain_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    return {conv: plain_repair([r for r in left if r[0] == conv]) for conv in {r[0] for r in rows}}


def told(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def conversations(n, seed, lengths):
    rnd, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rnd.choice(lengths)):
            role = rnd.choice(["user", "assistant"]) if rnd.random() < 0.3 else ["user", "assistant"][turn % 2]
            role = rnd.choice(["system", "tool", "", None, "usher"]) if rnd.random() < 0.12 else role
            text = rnd.choice(["Yes.", "No!", "a b?", "cut off", "cut", " \t", "", None, "é. ", "x.\x85", "same.", "Long " * 300 + "."])
            rows.append((conv, None if rnd.random() < 0.05 else turn + rnd.choice([0, 0, 0, 3]), role, text))
    return rows


def test_equals_a_plain_search(spark):
    rows = conversations(60, 1, [0, 1, 2, 3, 5, 8, 13]) + [(None, 0, "user", "Hi."), (None, None, "assistant", "Hello."), (10**15, 5, None, None)]
    df = spark.createDataFrame(rows, ROWS).withColumn("seg", F.lit("clash")).withColumn("idx", F.lit(1))
    assert told(C.repair(C.damaged(df), ids=df)) == expected(rows)


@pytest.mark.parametrize("segment,fan_in", [(1, 2), (3, 2), (4, 64)])
def test_segments_do_not_show(spark, segment, fan_in):
    """Conversations of many segments and rounds, the longest with most of all rows."""
    rows = conversations(12, 2, [2, 9, 30]) + [(99, t, r, x) for _, t, r, x in conversations(1, 3, [150])]
    df = spark.createDataFrame(rows, ROWS)
    assert told(C.repair(df, segment=segment, fan_in=fan_in)) == expected(rows, damage=False)


def test_ties_and_repeated_rows(spark):
    """Equal turns go by role, then text; copies are duplicates; of equally cheap edits the ASCII-least stay."""
    rows = [(1, 0, "user", "b."), (1, 0, "user", "a."), (1, 0, "assistant", "c."), (1, 0, "user", "a."), (2, 0, "user", "x."), (2, 0, "user", "x.")]
    rows += [(3, t, "user", f"{t}.") for t in range(6)]
    assert told(C.repair(spark.createDataFrame(rows, ROWS))) == expected(rows, damage=False)


def test_insertions_where_they_are_cheap(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "assistant", "c.")]
    got = told(C.repair(spark.createDataFrame(rows, ROWS), C.Costs(rerole=9, delete=9, insert=1)))
    assert got[1][5:7] == (2, "KIKI") and got[2][5:7] == (1, "IK")
    assert got[1][7] == hashlib.sha256(b"user:a.\nassistant:\nuser:b.\nassistant:").hexdigest()


def test_long_text_and_empty_table(spark):
    long = "word " * 400_000 + "."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long)]
    assert told(C.repair(spark.createDataFrame(rows, ROWS))) == expected(rows, damage=False)
    assert told(C.repair(spark.createDataFrame([], ROWS))) == {}


def test_a_conversation_that_damage_empties(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], ROWS)
    assert told(C.repair(C.damaged(df), ids=df)) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_as_registered(spark, tmp_path):
    rows = conversations(25, 4, [1, 4, 8])
    spark.createDataFrame(rows, ROWS).write.parquet(f"file://{tmp_path}/conversations.parquet")
    assert told(C.op11_conversation_repair(spark, f"file://{tmp_path}")) == expected(rows)
