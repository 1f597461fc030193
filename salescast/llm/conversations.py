"""Conversation structure repair: a least-cost edit of each conversation's turns, streamed in order.

Rows are repartitioned by conversation and sorted by turn; a task then walks through its conversations and
carries the state of a dynamic programme from one Arrow batch to the next.  The programme's states are what
the repaired conversation may end in so far: nothing, a system turn, a user turn, an assistant turn.  Only
the differences of their costs, and the order of their edit strings, matter for what follows, so all
states together are one of a small number of configurations, and a row costs one look-up in their table.
A row's number in that table is its backpointer (two bytes), from which the edits are read in the end.

A conversation of more rows or bytes than a task should hold (``rows``, ``size``) goes by another way to
the same result: its backpointers are spilled, with its rows, to a table in the shared folder, then walked
from the end, and its repaired text is hashed in a last walk from the start.  Nothing but the duplicates' least
turns, found by a partial aggregate, is kept for it.  One conversation is still one stream, as a hash over
its whole text must be, but of bounded memory.

Inputs: (conv_id, turn, role, text); other columns are ignored.  Nulls count as one space (a null conv_id is a
conversation, returned as null; a null turn comes first); rows of equal turn go by role, then text.  Repeated
rows are duplicates.  A role without a first letter can't be kept.  An empty table gives no rows.
"""

from __future__ import annotations

from array import array
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

# Fixed by the contract: costs of the edits, and what separates words.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}

START, SYSTEM, USER, ASSISTANT = range(4)
THEN = (USER, USER, ASSISTANT, USER)  # the state after the next turn, by state
NEVER = 1 << 30
OTHER, MUST_GO, IS_CUT = 3, 1, 2  # a row's class: 3 * place of its role in "sua" (or OTHER) + what is wrong with it
ROWS, SIZE, CHUNK = 65_536, 16 << 20, 65_536


class Table:
    """The configurations, and for each with each class of row: the next one, its cost, the moves into it.

    A configuration holds per state the least cost, less the least of all, and the place of its edit string in
    ASCII order.  Strings that end in a row's edit are never prefixes of each other, so that order decides.
    """

    def __init__(self):
        self.known, self.next, self.cost, self.moves = {}, [], [], []
        self.configs = [((0, NEVER, NEVER, NEVER), (0, 0, 0, 0))]
        self.known[self.configs[0]] = 0
        k = 0
        while k < len(self.configs):
            for c in range(12):
                config, cost, moves = self.step(*self.configs[k], c)
                if config not in self.known:
                    self.known[config] = len(self.configs)
                    self.configs.append(config)
                self.next.append(self.known[config])
                self.cost.append(cost)
                self.moves.append(moves)
            k += 1
        assert len(self.next) < 1 << 16

    @staticmethod
    def step(costs, order, c):
        letter, wrong = "sua "[c // 3], c % 3
        best = [(NEVER, 0, "", 0)] * 4
        for state in range(4):
            if costs[state] >= NEVER:
                continue
            at, cost, edits = state, costs[state], ""
            for _ in range(3):  # a third insertion would only come back to where it was
                ways = [(at, DELETE, "D")]
                if wrong != MUST_GO:
                    more = CUT if wrong == IS_CUT else 0
                    ways.append((THEN[at], REROLE + more, "R"))
                    if letter == " sua"[THEN[at]]:
                        ways.append((THEN[at], more, "K"))
                    if letter == "s" and at == START:
                        ways.append((SYSTEM, more, "K"))
                for to, extra, edit in ways:
                    best[to] = min(best[to], (cost + extra, order[state], edits + edit, state))
                at, cost, edits = THEN[at], cost + INSERT, edits + "I"
        # a state that another one can stand in for, at less cost, is dropped: an assistant turn may be followed by
        # whatever follows a system turn, and by what follows nothing if a later system turn is deleted
        c = [b[0] for b in best]
        stand_in = min(c[ASSISTANT], c[USER] + INSERT)
        worst = (min(stand_in, c[SYSTEM] + 2 * INSERT) + DELETE, stand_in, c[ASSISTANT] + INSERT, c[USER] + INSERT)
        best = [b if b[0] <= w else (NEVER, 0, "", 0) for b, w in zip(best, worst)]
        least = min(b[0] for b in best)
        by_string = sorted((b[1], b[2], k) for k, b in enumerate(best) if b[0] < NEVER)
        place = {k: i for i, (_, _, k) in enumerate(by_string)}
        config = (tuple(b[0] - least if b[0] < NEVER else NEVER for b in best), tuple(place.get(k, 0) for k in range(4)))
        return config, least, tuple((b[3], b[2]) for b in best)

    def end(self, k):
        """(cost, state, edits) with which a conversation in configuration ``k`` ends best."""
        costs, order = self.configs[k]
        cost, _, state, edits = min((costs[s] + INSERT * n, order[s], s, "I" * n) for s, n in (
            (START, 0), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0)) if costs[s] < NEVER)
        return cost, state, edits


TABLE = Table()


class Repaired:
    """The repaired conversation's hash, edit by edit."""

    def __init__(self):
        self.hash, self.state, self.first = sha256(), START, True

    def put(self, role: str, text: str):
        self.hash.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def row(self, edits: str, role: str, text: str):
        """The edits up to and with the one of this row: insertions, then K, R or D."""
        for e in edits:
            if e == "D":
                continue
            to = SYSTEM if e == "K" and role[:1] == "s" else THEN[self.state]
            if e == "K":
                self.put(role, text)
            else:
                self.put(ROLES[" sua"[to]], text if e == "R" else "")
            self.state = to


class Walk:
    """Counts, configuration and backpointers of one conversation, row by row."""

    def __init__(self):
        self.config = self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.turn = self.last = None

    def row(self, turn, letter: str, blank: bool, seen: bool, cut: bool) -> int:
        """The row's backpointer."""
        if turn is not None:
            self.turns += turn != self.turn
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        if self.last is not None:
            self.illegal += self.last + letter not in ("su", "ua", "au")
        self.last = letter
        if blank:
            self.blank += 1
        elif seen:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        place = "sua".find(letter) if letter else -1
        k = self.config * 12 + 3 * (OTHER if place < 0 else place) + (MUST_GO if blank or seen else IS_CUT if cut else 0)
        self.config, self.cost = TABLE.next[k], self.cost + TABLE.cost[k]
        return k

    def counts(self) -> list[int]:
        """gaps, blank, duplicate, truncated, illegal, cost."""
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + TABLE.end(self.config)[0]]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, with a key that is never null; dropped rows stay, marked ``gone``."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    d = F.crc32(F.concat(conv, F.lit(":"), turn)) % 20
    text = F.coalesce("text", F.lit(" "))
    role = F.when(d == 4, "user").otherwise(F.coalesce("role", F.lit(" ")))
    text = F.when(d == 1, "").when(d == 2, F.translate(text, ".!?", "")).otherwise(text)
    key = F.concat(F.when(F.col("conv_id").isNull(), "-").otherwise("+"), conv)
    rows = conversations.select(
        key.alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), (d == 0).alias("gone"), role.alias("role"),
        F.when(d == 0, "").otherwise(text).alias("text"),
        F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    return rows.withColumn("blank", end == "").withColumn("cut", ~end.isin(".", "!", "?")) \
        .withColumn("letter", F.left("role", F.lit(1))) \
        .withColumn("same", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))))


COLUMNS = ["key", "conv_id", "turn", "gone", "role", "text", "letter", "blank", "cut", "same"]
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def result_schema(conv_id: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv_id)] + [T.StructField(c, T.LongType()) for c in RESULT]
                        + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text")


def repair_bounded(rows: DataFrame, conv_id: T.DataType) -> DataFrame:
    """Conversations that a task may hold one at a time."""
    schema = result_schema(conv_id)
    names = schema.fieldNames()

    def run(batches):
        key = walk = None
        out = {c: [] for c in names}

        def finish():
            _, state, closing = TABLE.end(walk.config)
            edits = [closing]
            for k in reversed(back):
                state, e = TABLE.moves[k][state]
                edits.append(e)
            edits.reverse()
            repaired = Repaired()
            for e, (role, text) in zip(edits, held + [("", "")], strict=True):
                repaired.row(e, role, text)
            for c, v in zip(names, [conv, *walk.counts(), "".join(edits), repaired.hash.hexdigest()], strict=True):
                out[c].append(v)

        def ready():
            got = pa.table([pa.array(out[c], t) for c, t in zip(names, types, strict=True)], names).to_batches()
            for c in names:
                out[c].clear()
            return got

        for batch in batches:
            types = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
            for k, c, turn, gone, role, text, letter, blank, cut, same in zip(
                    *(batch.column(x).to_pylist() for x in COLUMNS), strict=True):
                if k != key:
                    if walk:
                        finish()
                    key, conv, walk, back, held, seen = k, c, Walk(), array("H"), [], set()
                if gone:
                    continue
                back.append(walk.row(turn, letter, blank, same in seen, cut))
                seen.add(same)
                held.append((role, text))
            yield from ready()
        if walk:
            finish()
            yield from ready()

    return in_order(rows.select(*COLUMNS)).mapInArrow(run, schema)


def repair_giant(rows: DataFrame, conv_id: T.DataType, chunk: int = CHUNK) -> DataFrame:
    """The same for conversations of any length, by way of spilled backpointers; a task holds a chunk at most."""
    first = rows.where("not gone").groupBy("key", "same").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
    marked = rows.join(first, ["key", "same"], "left").withColumn(
        "later", F.expr("not gone and first < struct(turn is not null as has, turn)"))
    spill = T.StructType([T.StructField("key", T.StringType()), T.StructField("conv_id", conv_id),
                          T.StructField("n", T.LongType()), T.StructField("back", T.IntegerType()),
                          T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                          T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("config", T.IntegerType())])

    def forth(batches):
        key = walk = before = None
        n = 0

        def last():
            return [key, conv, n, None, None, None, walk.counts(), walk.config]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)],
                                              spill.fieldNames())

        for batch in batches:
            types = [pa.string(), batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.string(),
                     pa.list_(pa.int64()), pa.int32()]
            out = []
            for k, c, turn, gone, role, text, letter, blank, cut, same, later in zip(
                    *(batch.column(x).to_pylist() for x in [*COLUMNS, "later"]), strict=True):
                if k != key:
                    if walk:
                        out.append(last())
                    key, conv, walk, before, n = k, c, Walk(), None, 0
                if gone:
                    continue
                seen = later or before == (turn, same)
                before = turn, same
                out.append([key, conv, n, walk.row(turn, letter, blank, seen, cut), role, text, None, None])
                n += 1
            if out:
                yield batch_of(out)
        if walk:
            yield batch_of([last()])

    spilled = written(in_order(marked.select(*COLUMNS, "later")).mapInArrow(forth, spill), "turns-spilled")

    def back(batches):
        state, edits, at = START, [], None

        def piece():
            return pa.RecordBatch.from_pylist([{"key": at[0], "chunk": at[1], "edits": edits[::-1]}], schema=pa.schema(
                [("key", pa.string()), ("chunk", pa.int64()), ("edits", pa.list_(pa.string()))]))

        for batch in batches:
            for key, n, k, config in zip(*(batch.column(x).to_pylist() for x in ("key", "n", "back", "config")), strict=True):
                if at != (key, n // chunk):
                    if edits:
                        yield piece()
                    at, edits = (key, n // chunk), []
                if config is not None:
                    _, state, e = TABLE.end(config)
                else:
                    state, e = TABLE.moves[k][state]
                edits.append(e)
        if edits:
            yield piece()

    pieces = spilled.select("key", "n", "back", "config").repartition("key").sortWithinPartitions("key", F.desc("n")) \
        .mapInArrow(back, "key string, chunk long, edits array<string>")
    both = spilled.withColumn("chunk", F.expr(f"n div {chunk}")).drop("back", "config").unionByName(
        pieces.withColumn("n", F.lit(-1).cast("long")), allowMissingColumns=True)
    schema = result_schema(conv_id)

    def hashed(batches):
        audit, edits, repaired = [], None, None
        for batch in batches:
            out = []
            for conv, n, role, text, counts, got in zip(
                    *(batch.column(x).to_pylist() for x in ("conv_id", "n", "role", "text", "counts", "edits")), strict=True):
                repaired = repaired or Repaired()
                if got is not None:
                    edits = iter(got)
                    audit.append("".join(got))
                    continue
                repaired.row(next(edits), role or "", text or "")
                if counts is not None:
                    out.append([conv, *counts, "".join(audit), repaired.hash.hexdigest()])
                    audit, repaired = [], None
            if out:
                types = [batch.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types, strict=True)],
                                                 schema.fieldNames())

    return both.repartition("key").sortWithinPartitions("key", "chunk", "n").mapInArrow(hashed, schema)


def repair(conversations: DataFrame, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """One row per conv_id: gaps, counts of faults, cost, audit and hash of the repaired conversation."""
    conv_id = conversations.schema["conv_id"].dataType
    turns = damaged(conversations)
    giant = written(turns.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
                    .where((F.col("n") > rows) | (F.col("b") > size)).select("key"), "turns-giant")
    if giant.isEmpty():
        return repair_bounded(turns, conv_id)
    return repair_bounded(turns.join(giant, "key", "left_anti"), conv_id).union(
        repair_giant(turns.join(giant, "key", "left_semi"), conv_id))


def op12_turn_repair(spark, sf_dir):
    return repair(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
