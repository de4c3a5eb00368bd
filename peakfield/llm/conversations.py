"""Repair of conversation structure: the cheapest edits that make each conversation a legal one.

Rows of a conversation stand in the order of (turn, role, the first ``HEAD`` characters of the text, its SHA-256), nulls
first. A legal conversation's role initials read ``(s?(ua)+)?``. Rows are kept, get the role that fits, or
are deleted, and empty rows may be inserted; ``Costs`` says what that costs. The result of a conversation is its least cost and the
edits' initials, the ASCII-least ones among the cheapest.

A conversation is cut into segments of ``SEGMENT`` rows. Segments are hash-partitioned, and each batch of whole
segments goes through one recursive query in DuckDB: a recursion advances one row in all segments of the batch at once and keeps
the least (cost, edits) for each grammar state. Segments after a conversation's first are walked from every state, and
the same query then advances segment by segment, ``FAN_IN`` of them a round, so a conversation of any length is many small
walks. Least edits may be kept early, as those of one state and equal cost never begin with each other: an edit has a
cost that depends on the row alone, and an insertion costs more than nothing.

The repaired text is hashed as its rows stream by in order, hash-partitioned by conversation: one task sees a conversation's
rows, as a hash has to, but never holds them.

Nulls: a null role or text, and a null conv_id or turn in the text that the damage hangs on, is one space; rows without a conv_id
are one conversation. Empty and white-space texts are blank. Texts of any length count whole. Rows
with equal turns follow the order above; repeated rows are duplicates. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakfield.llm.common import SPACES, bounded_batches, join_groups, written
from peakfield.operators.ordering import index_within

#: Characters of a text that rows of equal turn and role are ordered by, before its hash.
HEAD = 64
#: Rows of a segment, segments that a round joins, rows that a query advances at a time.
SEGMENT, FAN_IN, BATCH = 128, 64, 20_000
#: Grammar states are the last initial, "-" before any; what may follow each, and where a conversation may end.
FOLLOWS = {"-": "su", "s": "u", "u": "a", "a": "u"}
ENDS = "-a"
KEY = ["nil", "conv"]
ORDER = ["turn", "role", "head", "digest"]
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
STEP = "nil boolean, conv long, seg long, start string, state string, cost long, audit string"


@dataclass(frozen=True)
class Costs:
    """What the edits cost; an insertion must cost something."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def damaged(rows: DataFrame) -> DataFrame:
    """conversations with a fifth of their turns damaged, by a CRC-32 of ``conv_id:turn``: dropped, emptied, without ends of sentences, repeated, or of role user."""
    named = F.concat(*(x if c == ":" else F.coalesce(x.cast("string"), F.lit(" ")) for c, x in (("conv_id", F.col("conv_id")), (":", F.lit(":")), ("turn", F.col("turn")))))
    what = F.crc32(named.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), what.alias("what")).where("what != 0")
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("what") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("_time")).drop("_time")


def keyed(rows: DataFrame) -> DataFrame:
    """(nil, conv, turn, role, head, digest, text): the conversation as a key without nulls, and what rows are ordered by."""
    key = [F.col("conv_id").isNull().alias("nil"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("conv")]
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(*key, F.col("turn").cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, HEAD).alias("head"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))


def faulty(rows: DataFrame) -> DataFrame:
    """keyed -> (nil, conv, turn, idx, n, initial, fault): each row's place, its conversation's size and its first fault. No texts are moved."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    own = F.when(trimmed == "", BLANK).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(NO_FAULT)
    placed = written(index_within(rows.withColumn("own", own).drop("text"), KEY, ORDER), "placed")
    same = [*KEY, "role", "digest"]
    again = written(placed.groupBy(*same).agg(F.min("idx").alias("first"), F.count("*").alias("times")).where("times > 1"), "again")
    met = join_groups(placed.withColumn("doc_id", F.col("idx")), again, same, "times")  # hot groups are broadcast
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("idx") > F.col("first"), DUPLICATE).otherwise(F.col("own"))
    return met.select(*KEY, "turn", "idx", "n", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def insertions(state: str) -> list[tuple[str, int]]:
    """(state, insertions): where inserted rows lead; what may follow by insertion is one role, u or a."""
    found = [(state, 0)]
    for n in (1, 2):  # a third would lead where the first did
        found.append((FOLLOWS[found[-1][0]][-1], n))
    return found


def moves(costs: Costs) -> list[tuple[str, str, int, str, int, str]]:
    """(state, initial, fault, next, cost, edits) for a row; initial "" stands for any that no grammar knows."""
    out = []
    for state in FOLLOWS:
        for initial in ("s", "u", "a", ""):
            for fault in (NO_FAULT, BLANK, DUPLICATE, TRUNCATED):
                for at, n in insertions(state):
                    paid = n * costs.insert
                    out.append((state, initial, fault, at, paid + costs.delete, "I" * n + "D"))
                    if fault in (BLANK, DUPLICATE):
                        continue
                    paid += costs.truncated if fault == TRUNCATED else 0
                    if initial and initial in FOLLOWS[at]:
                        out.append((state, initial, fault, initial, paid + costs.keep, "I" * n + "K"))
                    out.append((state, initial, fault, FOLLOWS[at][-1], paid + costs.rerole, "I" * n + "R"))
    return out


def endings(costs: Costs) -> dict[str, tuple[int, str]]:
    """What ends a conversation in each state."""
    return {state: min((n * costs.insert, "I" * n) for at, n in insertions(state) if at in ENDS) for state in FOLLOWS}


#: items: (part, pos, ...) are counted from 0 in each part; steps: (part, pos, state, next, cost, edits); starts: (part, start, n).
WALK = """
WITH RECURSIVE walk AS (
  SELECT part, start, n, start AS state, CAST(0 AS BIGINT) AS cost, '' AS edits, CAST(0 AS BIGINT) AS pos FROM starts
  UNION ALL
  SELECT part, start, n, state, best.cost, best.edits, pos + 1 FROM (
    SELECT w.part, w.start, w.n, w.pos, s.next AS state, min({'cost': w.cost + s.cost, 'edits': w.edits || s.edits}) AS best
    FROM walk w JOIN steps s ON s.part = w.part AND s.pos = w.pos AND s.state = w.state GROUP BY ALL)
)
SELECT part, start, state, cost, edits FROM walk WHERE pos = n
"""
STEPS = "CREATE VIEW steps AS SELECT i.part, i.pos, m.state, m.next, m.cost, m.edits FROM items i JOIN moves m ON m.initial = i.initial AND m.fault = i.fault"
STEPS_OF_SEGMENTS = "CREATE VIEW steps AS SELECT part, pos, start AS state, state AS next, cost, audit AS edits FROM items"


def _whole_parts(batches: Iterator[pa.RecordBatch], by: list[str], most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows, or 32 MB, that end where a part does; rows come sorted by part."""
    held = None
    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if len(held) < most and held.nbytes < 32 << 20:
            continue
        last = [held[c][len(held) - 1] for c in by]
        cut = len(held)
        same = np.ones(len(held), bool)
        for c, v in zip(by, last, strict=True):
            same &= held[c].to_numpy() == v.as_py()
        cut = int(np.argmax(same))
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut).combine_chunks()
    if held is not None and len(held):
        yield held


def _walked(steps: str, table: list[tuple], columns: list[str]):
    """A task's walk: for each part, the least cost and edits from its start to each state."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        db.sql("SET temp_directory = ''")
        db.sql("CREATE TABLE moves (state VARCHAR, initial VARCHAR, fault INTEGER, next VARCHAR, cost BIGINT, edits VARCHAR)")
        if table:
            db.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", table)
        made = False
        for rows in _whole_parts(batches, ["nil", "conv", "seg"], BATCH):
            keys = [rows[c].to_numpy() for c in ("nil", "conv", "seg")]
            new = np.ones(len(rows), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            part, first = np.cumsum(new) - 1, np.flatnonzero(new)
            items = rows.select(columns).append_column("part", pa.array(part))
            at = rows["pos"].to_numpy()
            size = np.maximum.reduceat(at, first) + 1
            start = [(p, s, int(n)) for p, (seg, n) in enumerate(zip(keys[2][first], size, strict=True)) for s in ("-" if seg == 0 else FOLLOWS)]
            starts = pa.table({"part": [x[0] for x in start], "start": [x[1] for x in start], "n": [x[2] for x in start]})
            db.register("items", items)
            db.register("starts", starts)
            if not made:
                db.sql(steps)
                made = True
            found = db.sql(WALK).to_arrow_table()
            of = first[found["part"].to_numpy()]
            yield from pa.table({
                **{c: pa.array(k[of]) for c, k in zip(("nil", "conv", "seg"), keys, strict=True)},
                "start": found["start"].cast("string"), "state": found["state"].cast("string"), "cost": found["cost"].cast("int64"), "audit": found["edits"].cast("string"),
            }).to_batches()

    return walk


def _dealt(items: DataFrame) -> DataFrame:
    return items.repartition(*KEY, "seg").sortWithinPartitions(*KEY, "seg", "pos")


def walked(rows: DataFrame, costs: Costs = Costs(), segment: int = SEGMENT, fan_in: int = FAN_IN) -> DataFrame:
    """faulty -> (nil, conv, cost, audit): the least cost of each conversation and its edits."""
    bounded_batches(rows.sparkSession)
    longest = rows.agg(F.max("n")).first()[0] or 0
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("")
    items = rows.select(*KEY, F.expr(f"idx div {segment}").alias("seg"), (F.col("idx") % segment).alias("pos"), initial.alias("initial"), "fault", F.expr(f"(n + {segment - 1}) div {segment}").alias("n_segs"))
    sizes = items.where("seg = 0 AND pos = 0").select(*KEY, "n_segs")
    done = [written(_dealt(items).mapInArrow(_walked(STEPS, moves(costs), ["pos", "initial", "fault"]), STEP), "walked")]
    n_segs, per = -(-longest // segment), 1
    while n_segs > 1:
        # only conversations of several segments go on; the first segment of the rest is all of them
        left = done[-1].join(sizes.where(F.col("n_segs") > per), KEY, "left_semi")
        items = left.select(*KEY, F.expr(f"seg div {fan_in}").alias("seg"), (F.col("seg") % fan_in).alias("pos"), "start", "state", "cost", "audit")
        done.append(written(_dealt(items).mapInArrow(_walked(STEPS_OF_SEGMENTS, [], ["pos", "start", "state", "cost", "audit"]), STEP), "walked"))
        n_segs, per = -(-n_segs // fan_in), per * fan_in
    ends, tail, last = endings(costs), F.lit(None).cast("long"), F.lit(None).cast("string")
    for state, (cost, edits) in ends.items():
        tail, last = F.when(F.col("state") == state, cost).otherwise(tail), F.when(F.col("state") == state, edits).otherwise(last)
    best = None
    for k, table in enumerate(done):
        # a conversation's walk is whole in the round that made one segment of it
        low, high = (fan_in ** (k - 1) if k else 0), fan_in**k
        whole = table.where("seg = 0 AND start = '-'").join(sizes.where((F.col("n_segs") > low) & (F.col("n_segs") <= high)), KEY, "left_semi")
        best = whole if best is None else best.unionByName(whole)
    best = best.groupBy(*KEY).agg(F.min(F.struct((F.col("cost") + tail).alias("cost"), F.concat("audit", last).alias("audit"))).alias("best"))
    return best.select(*KEY, "best.cost", "best.audit")


class _Repair:
    """One conversation, row by row: the repaired text's hash, and the neighbours that are not legal."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.last, self.illegal = audit, 0, "-", None, 0
        self.hash, self.begun = hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        if self.begun:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:{text}".encode())
        self.begun, self.state = True, role[:1]

    def fitting(self) -> str:
        return "assistant" if self.state == "u" else "user"

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.put(self.fitting(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in ("su", "ua", "au")
        self.last = initial
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.put(role if edit == "K" else self.fitting(), text)

    def end(self) -> tuple[int, str]:
        self.inserted()
        return self.illegal, self.hash.hexdigest()


def _repairer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, now, out = None, None, []

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate((pa.bool_(), pa.int64(), pa.int64(), pa.string()))], names=["nil", "conv", "illegal", "repaired_sha256"])

    for b in batches:
        for nil, conv, role, text in zip(*(b.column(c).to_pylist() for c in ("nil", "conv", "role", "text")), strict=True):
            if (nil, conv) != key:
                if now:
                    out.append((*key, *now.end()))
                key, now = (nil, conv), _Repair(text)  # the first row of a conversation holds its edits
            else:
                now.row(role, text)
        if len(out) > 5000:
            yield told()
            out = []
    if now:
        out.append((*key, *now.end()))
    yield told()


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """keyed rows and walked -> (nil, conv, illegal, repaired_sha256)"""
    bounded_batches(rows.sparkSession)
    null = lambda kind: F.lit(None).cast(kind)
    edits = audits.select(*KEY, F.lit(0).alias("kind"), null("long").alias("turn"), null("string").alias("role"), null("string").alias("head"), null("binary").alias("digest"), F.col("audit").alias("text"))
    both = edits.unionByName(rows.select(*KEY, F.lit(1).alias("kind"), *ORDER, "text"))
    return both.repartition(*KEY).sortWithinPartitions(*KEY, "kind", *ORDER).select(*KEY, "role", "text").mapInArrow(_repairer, "nil boolean, conv long, illegal long, repaired_sha256 string")


def repair(rows: DataFrame, costs: Costs = Costs(), ids: DataFrame | None = None, segment: int = SEGMENT, fan_in: int = FAN_IN) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation of ``rows``, or of ``ids``.

    rows: (conv_id, turn, role, text). gaps: turns that are missing between the first and the last; blank, duplicate, truncated: rows by their
    first fault; illegal: neighbours whose roles may not follow each other.
    """
    every = (rows if ids is None else ids).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = keyed(rows)
    faults = written(faulty(rows), "faults")
    audits = written(walked(faults, costs, segment, fan_in), "audits")
    wide = lambda f: f("turn").cast("decimal(38,0)")
    turns = faults.groupBy(*KEY, "turn").agg(*(F.sum((F.col("fault") == f).cast("long")).alias(name) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))))
    counts = turns.groupBy(*KEY).agg(F.coalesce((wide(F.max) - wide(F.min) + 1 - F.count("turn")).cast("long"), F.lit(0).cast("long")).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    found = counts.join(audits, KEY).join(repaired(rows, audits), KEY).withColumn("_id", F.when(~F.col("nil"), F.col("conv")))
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair(damaged(rows), ids=rows)


#: CRC-32, bit by bit, of the bytes of a text of ASCII characters.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ord(substr(k, i, 1)) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END)), CAST(4294967295 AS BIGINT)) % 20"""
_MOVES = ", ".join(f"('{s}', '{i}', {f}, '{n}', CAST({c} AS BIGINT), '{e}')" for s, i, f, n, c, e in moves(Costs()))
_ENDS = ", ".join(f"('{s}', CAST({c} AS BIGINT), '{e}')" for s, (c, e) in endings(Costs()).items())
ORACLE_SQL = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hit AS (SELECT *, {_CRC} AS what FROM named
), rows AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN what = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE what != 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed FROM rows
), items AS (
  SELECT *, CASE WHEN trimmed = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed
), counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM items GROUP BY conv_id
), moves (state, initial, fault, next, cost, edits) AS (VALUES {_MOVES}
), ends (state, cost, edits) AS (VALUES {_ENDS}
), walk AS (
  SELECT conv_id, n, '-' AS state, CAST(0 AS BIGINT) AS cost, '' AS edits, CAST(0 AS BIGINT) AS pos FROM counts
  UNION ALL
  SELECT conv_id, n, state, best.cost, best.edits, pos + 1 FROM (
    SELECT w.conv_id, w.n, w.pos, m.next AS state, min({{'cost': w.cost + m.cost, 'edits': w.edits || m.edits}}) AS best
    FROM walk w JOIN items i ON i.conv_id IS NOT DISTINCT FROM w.conv_id AND i.pos = w.pos
    JOIN moves m ON m.state = w.state AND m.fault = i.fault AND m.initial = CASE WHEN i.initial IN ('s', 'u', 'a') THEN i.initial ELSE '' END GROUP BY ALL)
), best AS (
  SELECT conv_id, min({{'cost': w.cost + e.cost, 'audit': w.edits || e.edits}}) AS b FROM walk w JOIN ends e USING (state) WHERE w.pos = w.n GROUP BY conv_id
), letters AS (
  SELECT conv_id, unnest(range(1, length(b.audit) + 1)) AS p, b.audit AS audit FROM best
), edits AS (
  SELECT conv_id, p, substr(audit, p, 1) AS edit, count(*) FILTER (substr(audit, p, 1) != 'I') OVER (PARTITION BY conv_id ORDER BY p) - 1 AS pos FROM letters
), kept AS (
  SELECT e.conv_id, e.p, e.edit, i.role, CASE WHEN e.edit = 'I' THEN '' ELSE i.text END AS text, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.p) AS place,
    first_value(CASE WHEN e.edit = 'K' AND i.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id ORDER BY e.p) AS led
  FROM edits e JOIN items i ON i.conv_id IS NOT DISTINCT FROM e.conv_id AND i.pos = greatest(e.pos, 0) WHERE e.edit != 'D'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS t FROM kept GROUP BY conv_id
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM every LEFT JOIN counts ON every.conv_id IS NOT DISTINCT FROM counts.conv_id LEFT JOIN best ON every.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN texts ON every.conv_id IS NOT DISTINCT FROM texts.conv_id
"""
