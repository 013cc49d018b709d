"""Conversation structure repair: cheapest edits to a legal order of roles, by a Viterbi recursion cut into chunks.

The recursion runs backward over the rows of a conversation with a cost for each of four states: nothing put out yet,
last a system row, last a user row, last an assistant row. Chunks of rows start at once from a guessed cost vector; a
chunk whose successor turns out to hand over another vector runs again beside its earlier run, until the two differ
only by a constant. Then every row's best edit from every state is known, and the edits are read off forward.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import stash
from .turns import numbered, turn_order

#: Rows in a chunk, a power of two.
CHUNK = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Faults of a row; the first that holds counts.
NONE, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
#: Initials of roles; any other cannot be kept.
INITIALS = "sua"
BEGUN, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
#: Costs at the end of a conversation: nothing, or an assistant row last, else what must be inserted.
END = (0, 2 * INSERT, INSERT, 0)
GUESS = (0, 0, 0, 0)
#: The state after an inserted or reroled row.
TURN = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: From a state, the state after keeping a row with this initial.
KEPT = {
    0: {BEGUN: SYSTEM},
    1: {BEGUN: USER, SYSTEM: USER, ASSISTANT: USER},
    2: {USER: ASSISTANT},
}
EDITS = "DKR"


@lru_cache(maxsize=1 << 16)
def backward(after: tuple, code: int) -> tuple[tuple, int]:
    """Costs before a row (least one 0) from those after it, and for each state its inserts, edit and next state.

    ``code`` is fault * 4 + initial. The number holds a byte for each state: inserts << 4 | edit << 2 | next state.
    """
    fault, initial = code >> 2, code & 3
    extra = TRUNCATED if fault == CUT else 0
    ways = []
    for state in range(4):
        own = [(DELETE + after[state], 0, state)]
        if fault not in (BLANK, DUPLICATE):
            if state in KEPT.get(initial, {}):
                to = KEPT[initial][state]
                own.append((KEEP + extra + after[to], 1, to))
            own.append((REROLE + extra + after[TURN[state]], 2, TURN[state]))
        ways.append(own)
    least = [min(w)[0] for w in ways]
    one, two = [INSERT + least[TURN[s]] for s in range(4)], [2 * INSERT + least[TURN[TURN[s]]] for s in range(4)]
    costs = [min(x) for x in zip(least, one, two)]
    plan = 0
    for state in range(4):
        at, inserts = state, 0
        while True:
            cost = costs[at]
            if ways[at][0][0] == cost:  # D goes before I, I before K, K before R
                way = ways[at][0]
                break
            if INSERT + costs[TURN[at]] == cost:
                at, inserts = TURN[at], inserts + 1
                continue
            way = next(w for w in ways[at][1:] if w[0] == cost)
            break
        plan |= (inserts << 4 | way[1] << 2 | way[2]) << 8 * state
    low = min(costs)
    return tuple(c - low for c in costs), plan


def run_chunk(codes: list[int], given: tuple) -> tuple:
    """The cost vector, up to a constant, before a chunk from that after it."""
    for code in reversed(codes):
        given = backward(given, code)[0]
    return given


def fix_up(codes: list[int], old: tuple, new: tuple, head: tuple) -> tuple:
    """What ``run_chunk`` gives from ``new``, knowing that it gave ``head`` from ``old``: both run side by side until
    they differ only by a constant, which they do from there on."""
    for code in reversed(codes):
        if old == new:
            return head
        old, new = backward(old, code)[0], backward(new, code)[0]
    return new


def _codes(column: pa.Array) -> list[list[int]]:
    flat = column.values.field("code").to_pylist()
    ends = column.offsets.to_pylist()
    return [flat[a:b] for a, b in zip(ends, ends[1:])]


def _vectors(column: pa.Array) -> list[tuple]:
    return [tuple(v) for v in column.to_pylist()]


def _speculate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [run_chunk(c, g) for c, g in zip(_codes(batch.column("rows")), _vectors(batch.column("given")))]
        columns = [batch.column(n) for n in ("conv", "chunk", "next", "given")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([list(h) for h in heads], pa.list_(pa.int32()))], ["conv", "chunk", "next", "given", "head"])


def _fixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given, new, head = (_vectors(batch.column(n)) for n in ("given", "new", "head"))
        heads = [fix_up(*x) for x in zip(_codes(batch.column("rows")), given, new, head)]
        columns = [batch.column(n) for n in ("conv", "chunk", "next", "new")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([list(h) for h in heads], pa.list_(pa.int32()))], ["conv", "chunk", "next", "given", "head"])


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rids, codes, plans = batch.column("rows").values.field("rid"), [], []
        for own, after in zip(_codes(batch.column("rows")), _vectors(batch.column("given"))):
            found = []
            for code in reversed(own):
                after, plan = backward(after, code)
                found.append(plan)
            plans += reversed(found)
            codes += own
        yield pa.RecordBatch.from_arrays([rids, pa.array(codes, pa.int32()), pa.array(plans, pa.int64())], ["rid", "code", "plan"])


def row_codes(rows: DataFrame) -> DataFrame:
    """(conv, rid, code) of the rows of ``ordered_turns``: the first fault of each and its role's initial."""
    same = rows.groupBy("conv", "role", F.sha2("text", 256).alias("_text")).agg(F.min("rid").alias("rid"))
    firsts = same.select("rid", F.lit(True).alias("_first"))  # one row each: joined by row number, no key is hot
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = (
        F.when(blank, BLANK)
        .when(F.col("_first").isNull(), DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT)
        .otherwise(NONE)
    )
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    initial = F.when((F.length("role") > 0) & (initial >= 0), initial).otherwise(len(INITIALS))
    flagged = rows.join(firsts, "rid", "left")
    return flagged.select("conv", "rid", (fault * 4 + initial).cast("int").alias("code"))


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text, rid) in order of turn within conv (nulls first), ties by role and text."""
    rows = conversations.select(
        F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    return numbered(rows, *turn_order(), "turns")


def settled(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, given): the cost vector after each chunk, up to a constant. ``chunks`` (conv, chunk, rows) is stored."""
    schema = StructType([*chunks.select("conv", "chunk", F.col("chunk").alias("next")).schema.fields])
    vector = chunks.sparkSession.createDataFrame([], "given array<int>, head array<int>").schema.fields
    schema = StructType([*schema.fields[:2], StructField("next", LongType()), *vector])
    following = Window.partitionBy("conv").orderBy("chunk")  # one row for each chunk
    listed = chunks.withColumn("next", F.lead("chunk").over(following))
    guess = F.when(F.col("next").isNull(), F.array(*map(F.lit, END))).otherwise(F.array(*map(F.lit, GUESS)))
    state = stash(listed.withColumn("given", guess).mapInArrow(_speculate, schema), "speculated")
    while True:
        heads = state.select(F.col("conv").alias("_conv"), F.col("chunk").alias("_chunk"), F.col("head").alias("new"))
        met = state["conv"].eqNullSafe(heads["_conv"]) & (state["next"] == heads["_chunk"])
        moved = stash(state.join(heads, met).where(F.col("new") != F.col("given")).drop("_conv", "_chunk"), "moved")
        if moved.isEmpty():
            return state.select("conv", "chunk", "given")
        rows = chunks.select(F.col("conv").alias("_conv"), F.col("chunk").alias("_chunk"), "rows")
        again = moved.join(rows, moved["conv"].eqNullSafe(rows["_conv"]) & (moved["chunk"] == rows["_chunk"])).drop("_conv", "_chunk")
        rest = state.join(moved.select(F.col("conv").alias("_conv"), F.col("chunk").alias("_chunk")), state["conv"].eqNullSafe(F.col("_conv")) & (state["chunk"] == F.col("_chunk")), "left_anti")
        state = stash(rest.unionByName(again.mapInArrow(_fixed, schema)), "fixed")


def _walk(batches: Iterator[pa.RecordBatch], out, close) -> Iterator[pa.RecordBatch]:
    """Follow the plans through rows sorted by conversation and ``rid``; ``out`` takes each conversation's edits."""
    conv, run = None, None
    for batch in batches:
        done = []
        for row in zip(*(batch.column(n).to_pylist() for n in ("conv", "turn", "role", "text", "code", "plan"))):
            if run is None or row[0] != conv:
                if run is not None:
                    done += run.end()
                conv, run = row[0], out(row[0])
            done += run.row(*row[1:])
        if done:
            yield close(done)
    if run is not None and (done := run.end()):
        yield close(done)


class _Edited:
    """Edits of one conversation: (position, edit, role, text), of deleted rows without position."""

    def __init__(self, conv):
        self.conv, self.state, self.position = conv, BEGUN, 0

    def take(self, edit: str, role: str | None, text: str | None) -> tuple:
        self.position += edit != "D"
        return self.conv, None if edit == "D" else self.position, edit, role, text

    def insert(self, times: int) -> list[tuple]:
        out = []
        for _ in range(times):
            self.state = TURN[self.state]
            out.append(self.take("I", ROLES[self.state], ""))
        return out

    def row(self, turn, role: str, text: str, code: int, plan: int) -> list[tuple]:
        own = plan >> 8 * self.state & 0xFF
        out = self.insert(own >> 4)
        edit, self.state = EDITS[own >> 2 & 3], own & 3
        return [*out, self.take(edit, ROLES[self.state] if edit == "R" else role, text)]

    def end(self) -> list[tuple]:
        return self.insert(END[self.state] // INSERT)


class _Report(_Edited):
    """The digest of one conversation; texts go into a running hash."""

    def __init__(self, conv):
        super().__init__(conv)
        self.hash, self.audit, self.cost = hashlib.sha256(), [], 0
        self.faults, self.illegal, self.last = [0, 0, 0, 0], 0, None
        self.low = self.high = None
        self.turns = 0

    def take(self, edit: str, role: str | None, text: str | None) -> tuple:
        self.audit.append(edit)
        self.cost += {"D": DELETE, "I": INSERT, "K": KEEP, "R": REROLE}[edit]
        if edit != "D":
            self.position += 1
            self.hash.update((b"\n" if self.position > 1 else b"") + f"{role}:{text}".encode())
        return ()

    def row(self, turn, role: str, text: str, code: int, plan: int) -> list[tuple]:
        super().row(turn, role, text, code, plan)
        fault, initial = code >> 2, code & 3
        self.faults[fault] += 1
        self.cost += TRUNCATED * (fault == CUT and self.audit[-1] != "D")
        self.illegal += self.last is not None and (self.last, initial) not in ((0, 1), (1, 2), (2, 1))
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        return []

    def end(self) -> list[tuple]:
        super().end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [(self.conv, gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest())]


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _followed(conversations: DataFrame, chunk: int) -> DataFrame:
    """Rows with codes and plans, those of a conversation together and in order."""
    rows = ordered_turns(conversations)
    packed = row_codes(rows).groupBy("conv", F.floor(F.col("rid") / F.lit(chunk)).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("rid", "code"))).alias("rows"))
    chunks = stash(packed, "chunks")
    after = settled(chunks).select(F.col("conv").alias("_conv"), F.col("chunk").alias("_chunk"), "given")
    both = chunks.join(after, chunks["conv"].eqNullSafe(after["_conv"]) & (chunks["chunk"] == after["_chunk"]))
    plans = both.select("rows", "given").mapInArrow(_planned, "rid long, code int, plan long")
    return rows.join(plans, "rid").repartition("conv").sortWithinPartitions("conv", "rid").select("conv", "turn", "role", "text", "code", "plan")


def repair(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edits of every conversation of ``conversations`` (conv_id, turn, role, text) at least cost.

    Returns (conv_id, position, edit, role, text): ``K``ept, ``R``eroled, ``I``nserted rows with their place in the
    repaired conversation, and ``D``eleted ones without. Roles' initials then read ``(s?(ua)+)?``. Keeping costs 0,
    another role or an inserted empty row 3, deleting 4; a truncated row (last visible character not ``.!?``) that stays
    costs 3 more; blank rows and repeats of an earlier role and text must go. Of equally cheap edits those whose
    letters come first are taken. Rows go by turn, nulls first, equal ones by role and text, so rows that
    repeat are duplicates; null roles and texts are one space, which is no role that can be kept, nor is an empty one.
    Rows with a null conv_id are one conversation. An empty table gives an empty result; other columns are ignored.
    """
    kind = conversations.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", kind), StructField("position", LongType()), StructField("edit", StringType()), StructField("role", StringType()), StructField("text", StringType())])
    arrow = _arrow(schema)
    close = lambda done: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)
    return _followed(conversations, chunk).mapInArrow(lambda batches: _walk(batches, _Edited, close), schema)


def structure_report(conversations: DataFrame, ids: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The counts are of rows before the edits: missing turn numbers between the least and the largest, first faults,
    adjacent initials other than su, ua, au. ``audit`` has the edits' letters in order, the digest the repaired
    ``role:text`` lines. Conversations of ``ids`` (conv_id) without rows have zeros, no audit and the empty digest.
    """
    kind = conversations.schema["conv_id"].dataType
    schema = StructType([StructField("conv", kind), *[StructField(c, LongType()) for c in COUNTS], StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    arrow = _arrow(schema)
    close = lambda done: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)
    found = _followed(conversations, chunk).mapInArrow(lambda batches: _walk(batches, _Report, close), schema)
    if ids is None:
        return found.withColumnRenamed("conv", "conv_id")
    ids = ids.select("conv_id").distinct()
    joined = ids.join(found, ids["conv_id"].eqNullSafe(found["conv"]), "left")
    return joined.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults planted by a checksum of ``conv_id:turn`` modulo 20 (nulls count as one space): rows
    dropped (0), emptied (1), without ``.!?`` (2), repeated (3), given to the user (4)."""
    space = F.lit(" ")
    text = F.coalesce(F.col("text").cast("string"), space)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name) % 20
    rows = conversations.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        kind.alias("_kind"),
    )
    times = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("_kind <> 0").withColumn("_copy", F.explode(times)).drop("_kind", "_copy")
