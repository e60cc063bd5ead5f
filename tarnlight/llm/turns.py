"""Conversation structure repair: the cheapest edits that turn a conversation into `(system? (user assistant)+)?`.

Turns are sorted over the cluster by conversation and turn, so a conversation of any length is spread over tasks, and cut into
chunks of bounded size.  In a chunk, cost layers are built from its end: for each cost one bitset a turn tells from which grammar states
the rest of the chunk leads to which state at exactly that cost.  The first layer that has a pair of states gives its cost, and the
bits are traced for the least of its audits.  A conversation's chunks are then read twice as a stream, from the end to learn
what each state still costs, and from the start to choose.  Audits of a chunk's turns are never prefixes of each other, as each ends in
the last turn's edit, so the least audit of a conversation is put together from its chunks' least.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Turns in a chunk at most, as a power of two.
CHUNK_BITS = 6
#: Costs of the edits; deleting is the only one for blank and repeated turns, and keeping truncated ones in any way costs more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after the system turn, after a user's, after an assistant's.  A row that may end has a cost of 0.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Cost and edits from each state to the end.
TO_END = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]
# White space, sentence ends, and a turn's faults.
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
FINE, CUT_OFF, BLANK, REPEATED = range(4)
NOT_FOUND = -1


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, at): turns in the order of ``at`` are sorted by conversation and turn, nulls first; stored.

    Null roles and texts become a space.  Turns of one number are ordered by role and by a hash of the text, so equal ones are adjacent.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    keyed = rows.select("conv_id", "turn", space("role"), space("text")).withColumn("h", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "h", "salt")]
    return common.staged(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("h", "salt").withColumn("at", F.monotonically_increasing_id()), "turns")


def faults(turns: DataFrame) -> DataFrame:
    """``ordered`` rows with their fault: blank, repeated (the same role and text came before in the conversation), cut off or fine."""
    said = F.sha2("text", 256)
    first = turns.groupBy("conv_id", "role", said.alias("said")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(body == "", BLANK).when(F.col("first").isNull(), REPEATED).when(~F.right(body, F.lit(1)).isin(*ENDS), CUT_OFF).otherwise(FINE)
    return turns.join(first, "at", "left").select("conv_id", "turn", "role", "text", "at", fault.alias("fault"))


def layers(initials: list[str], fault: list[int]) -> tuple[list[int], list[str]]:
    """(costs, audits) of a chunk for each pair of states, first and last, at 4 * first + last; NOT_FOUND and "" where none leads there.

    A bitset has bit 4 * last + first: from ``first`` before a turn, the rest of the chunk can end in ``last`` at the layer's cost.
    """
    n = len(initials)
    # bitsets of the states before a letter, from those after it
    before_s = lambda x: x >> 1 & 0x1111
    before_u = lambda x: (x >> 2 & 0x1111) * 0b1011
    before_a = lambda x: x >> 1 & 0x4444
    keep = [{"s": before_s, "u": before_u, "a": before_a}.get(i) for i in initials]
    kept = [TRUNCATED if f == CUT_OFF else 0 for f in fault]
    gone = [f in (BLANK, REPEATED) for f in fault]
    # pairs of states that some edits lead between: the first state comes back only by deleting, the second only so or by a kept turn
    empty, found, costs, wanted = [0] * (n + 1), [], [NOT_FOUND] * 16, 0xFF31 if any(k is before_s and not g for k, g in zip(keep, gone, strict=True)) else 0xFF21
    layer = lambda c: found[c] if c >= 0 else empty
    while wanted:
        c = len(found)
        now = [0] * n + [0x8421 if c == 0 else 0]
        found.append(now)
        inserted, deleted = layer(c - INSERT), layer(c - DELETE)
        for t in range(n - 1, -1, -1):
            x = before_u(inserted[t]) | before_a(inserted[t]) | deleted[t + 1]
            if not gone[t]:
                if keep[t]:
                    x |= keep[t](layer(c - kept[t])[t + 1])
                y = layer(c - kept[t] - REROLE)[t + 1]
                x |= before_u(y) | before_a(y)
            now[t] = x
        new = now[0] & wanted
        wanted &= ~new
        for bit in range(16):
            if new >> bit & 1:
                costs[bit % 4 * 4 + bit // 4] = c
    audits = [""] * 16
    for pair, c in enumerate(costs):
        if c >= 0:
            audits[pair] = _traced(initials, kept, gone, layer, pair // 4, pair % 4, c)
    return costs, audits


def _after(state: int, letter: str) -> int:
    """The state after a turn of that initial, or NOT_FOUND."""
    if letter == "s":
        return SYSTEM if state == START else NOT_FOUND
    if letter == "u":
        return USER if state != USER else NOT_FOUND
    return ASSISTANT if letter == "a" and state == USER else NOT_FOUND


def _next(state: int) -> int:
    """The state after the user's or assistant's turn that the grammar wants in ``state``."""
    return ASSISTANT if state == USER else USER


def _traced(initials, kept, gone, layer, state: int, last: int, cost: int) -> str:
    out, t, n = [], 0, len(initials)
    while t < n:
        has = lambda c, at, s: s >= 0 and layer(c)[at] >> 4 * last + s & 1  # noqa: B023, E731
        if has(cost - DELETE, t + 1, state):
            edit, cost, t = "D", cost - DELETE, t + 1
        elif has(cost - INSERT, t, _next(state)):
            edit, cost, state = "I", cost - INSERT, _next(state)
        elif not gone[t] and has(cost - kept[t], t + 1, to := _after(state, initials[t])):
            edit, cost, t, state = "K", cost - kept[t], t + 1, to
        else:
            edit, cost, t, state = "R", cost - kept[t] - REROLE, t + 1, _next(state)
        out.append(edit)
    return "".join(out)


def edits(marked: DataFrame) -> DataFrame:
    """(at, edits, state, cost) for each row of ``faults``.

    edits: the inserts before the turn and its own edit, for a conversation's last turn also the inserts after it; state: the
    grammar state before them; cost: the whole conversation's.
    """
    initial = F.left("role", F.lit(1))
    chunks = (
        marked.select("conv_id", F.shiftright("at", CHUNK_BITS).alias("chunk"), F.struct("at", initial.alias("initial"), "fault").alias("x"))
        .groupBy("conv_id", "chunk")
        .agg(F.array_sort(F.collect_list("x")).alias("x"))  # at most 1 << CHUNK_BITS rows
        .select("conv_id", "chunk", F.col("x.at").alias("ats"), F.col("x.initial").alias("initials"), F.col("x.fault").alias("faults"))
    )
    schema = f"conv_id {chunks.schema['conv_id'].dataType.simpleString()}, chunk long, ats array<long>, initials array<string>, costs array<int>, audits array<string>"

    def solve(batches):
        for b in batches:
            solved = [layers(i, f) for i, f in common.rows(b, "initials", "faults")]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([c for c, _ in solved], pa.list_(pa.int32())), pa.array([a for _, a in solved], pa.list_(pa.string()))], names=[*b.schema.names[:4], "costs", "audits"])

    def backward(batches):
        """Each chunk, the last of a conversation first, with the cost from each state after it and whether it is the last."""
        current, left = None, None
        for b in batches:
            out = []
            for conv_id, costs in common.rows(b, "conv_id", "costs"):
                last = left is None or conv_id != current
                if last:
                    current, left = conv_id, [c for c, _ in TO_END]
                out.append((last, left))
                left = [min((total for total, _ in _ways(costs, left, s)), default=NOT_FOUND) for s in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in out], pa.bool_()), pa.array([x for _, x in out], pa.list_(pa.int64()))], names=[*b.schema.names, "last", "left"])

    def forward(batches):
        current, state, cost = None, None, 0
        for b in batches:
            out = []
            for conv_id, ats, initials, costs, audits, last, left in common.rows(b, "conv_id", "ats", "initials", "costs", "audits", "last", "left"):
                first = state is None or conv_id != current
                if first:
                    current, state = conv_id, START
                total, audit, end = min((total, audits[4 * state + e], e) for total, e in _ways(costs, left, state))
                cost = total if first else cost
                k = 0
                for at, letter in zip(ats, initials, strict=True):
                    begin, before = k, state
                    while audit[k] == "I":
                        state, k = _next(state), k + 1
                    state = {"D": state, "K": _after(state, letter), "R": _next(state)}[audit[k]]
                    k += 1
                    out.append((at, audit[begin:k], before, cost))
                if last:
                    at, own, before, _ = out[-1]
                    out[-1] = at, own + TO_END[end][1], before, cost
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.string(), pa.int32(), pa.int64()), strict=True)], names=["at", "edits", "state", "cost"])

    def dealt(rows, *order):
        return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)

    known = dealt(chunks.mapInArrow(solve, schema), F.desc("chunk")).mapInArrow(backward, schema + ", last boolean, left array<long>")
    return dealt(known, "chunk").mapInArrow(forward, "at long, edits string, state int, cost long")


def _ways(costs: list[int], left: list[int], state: int) -> list[tuple[int, int]]:
    """(cost to the conversation's end, state after the chunk) for the states that a chunk leads to from ``state``."""
    return [(costs[4 * state + e] + left[e], e) for e in range(4) if costs[4 * state + e] >= 0 and left[e] >= 0]


def edited(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, at, fault, edits, state, cost of conversations (conv_id, turn, role, text); stored.

    Turns that don't begin with s, u or a, empty roles too, can't be kept.  A null conv_id is a conversation of its own; any turns may repeat.
    """
    marked = common.staged(faults(ordered(rows)), "marked")
    return common.staged(marked.join(edits(marked), "at"), "edited")


def _said(role: str, text: str, own: str, state: int):
    """(role, text) of what takes a turn's place."""
    for e in own:
        if e == "K":
            yield role, text
            state = _after(state, role[:1])
        elif e != "D":
            state = _next(state)
            yield ("assistant" if state == ASSISTANT else "user"), ("" if e == "I" else text)


def repaired(done: DataFrame) -> DataFrame:
    """(conv_id, place, at, role, text): the turns of repaired conversations; ``place`` orders those that stem from the turn ``at``."""

    def run(batches):
        for b in batches:
            out = [(conv_id, k, at, r, t) for conv_id, at, role, text, own, state in common.rows(b, "conv_id", "at", "role", "text", "edits", "state") for k, (r, t) in enumerate(_said(role, text, own, state))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (b.schema.field(0).type, pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "at", "role", "text"])

    kind = done.schema["conv_id"].dataType.simpleString()
    return done.select("conv_id", "at", "role", "text", "edits", "state").mapInArrow(run, f"conv_id {kind}, place int, at long, role string, text string")


COUNTED = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
LEGAL = ("su", "ua", "au")


def summary(done: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: a row for each conversation of ``edited``.

    A conversation's digest is that of one byte sequence, so its turns pass one task as a stream; only the audit is held.
    """

    def finish(x):
        turns = x["high"] - x["low"] + 1 - x["distinct"] if x["distinct"] else 0
        return (x["conv_id"], turns, x[BLANK], x[REPEATED], x[CUT_OFF], x["illegal"], x["cost"], "".join(x["audit"]), x["digest"].hexdigest())

    def run(batches):
        x = None
        for b in batches:
            out = []
            for conv_id, turn, role, text, fault, own, state, cost in common.rows(b, "conv_id", "turn", "role", "text", "fault", "edits", "state", "cost"):
                if x is None or conv_id != x["conv_id"]:
                    if x is not None:
                        out.append(finish(x))
                    x = {"conv_id": conv_id, "low": turn, "high": None, "distinct": 0, "illegal": 0, "cost": cost, "audit": [], "digest": hashlib.sha256(), "begun": False, "before": None} | dict.fromkeys(range(4), 0)
                if turn is not None and turn != x["high"]:
                    x["low"], x["high"], x["distinct"] = (turn if x["low"] is None else x["low"]), turn, x["distinct"] + 1
                x[fault] += 1
                if x["before"] is not None and x["before"] + role[:1] not in LEGAL:
                    x["illegal"] += 1
                x["before"] = role[:1]
                x["audit"].append(own)
                for r, t in _said(role, text, own, state):
                    x["digest"].update((b"\n" if x["begun"] else b"") + f"{r}:{t}".encode("utf-8", "surrogatepass"))
                    x["begun"] = True
            kind = b.schema.field(0).type
            if out:
                yield batch(out, kind)
        if x is not None:
            yield batch([finish(x)], kind)

    def batch(out, kind):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kind, *[pa.int64()] * 6, pa.string(), pa.string()), strict=True)], names=["conv_id", *COUNTED, "audit", "repaired_sha256"])

    rows = done.select("conv_id", "at", "turn", "role", "text", "fault", "edits", "state", "cost").repartition("conv_id").sortWithinPartitions("conv_id", "at").drop("at")
    conv = done.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {conv}, " + ", ".join(f"{c} long" for c in COUNTED) + ", audit string, repaired_sha256 string")


def repair(rows: DataFrame, every: DataFrame) -> DataFrame:
    """``summary`` of the conversations of ``rows`` for each conv_id of ``every``: zeros, no audit and the empty text's digest where none is left."""
    found = summary(edited(rows)).withColumnRenamed("conv_id", "c")
    out = every.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTED], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's.

    Nulls are one space, in that key too; conv_id and turn themselves stay null.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    marked = rows.select("conv_id", "turn", "role", "text", kind.alias("kind")).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return marked.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), copies).drop("copy")


def op13_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair(damaged(rows), rows)
