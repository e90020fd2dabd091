"""Conversation structure repair: an auction over prices finds the cheapest edits.

The rows of a conversation (by turn) and the state of what has been told so far
(nothing, system, user, assistant) span a lattice.  Its arcs are edits: Keep a row,
Rerole it to user or assistant, Delete it, or Insert an empty turn before it; a
path from the beginning to an accepting state after the last row is a repair, and
accepting are the empty conversation and ``system? (user assistant)+``.

The auction keeps a price for each node and a path from the source.  At the path's
end, if the price is below the cheapest arc plus the price behind it, it is raised to
that and the path contracts by a node; else the path extends along that arc, until it
reaches the target.  No price ever exceeds arc plus price behind, so once the target
is reached, the source's price is the cheapest cost, and every cheapest path runs
along tight arcs only (price = cost + price behind).  These are traced in the order
of the edits' initials, and what leads nowhere is not entered twice, which gives the
least of all cheapest edit strings.  Costs are whole numbers.

Prices begin at what the rows left cost at least.  An auction slows down with the
length of its path, so a long conversation is cut into segments of SEGMENT rows: from
the last to the first, auctions from a segment's four entry states price them, and
these prices are the costs of leaving the segment before; then, from the first to
the last, each is traced from the state in which the one before was left.  A
segment's edits end with its last row's, so no edit string of one is the beginning of
another, and the least of the whole is made of the least of each.

Rows are dealt by conversation, sorted inside partitions and read as a stream; a
task holds one conversation at a time, as its repaired form is one value.

Defined results: null role or text is one space; rows of one turn are ordered by
role, then text; null turns come first; a null conversation id is a conversation
of its own; repeated rows are duplicates; roles count by their initial, and one other
than s, u, a can't be kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 48
BETWEEN = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: What each state may be followed by, besides a system turn at the start.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5

Arc = tuple[int, int, str]  # cost, step to the next node, initial


@cache
def arcs_of(initial: str, unfit: bool, cut: bool) -> tuple[tuple[Arc, ...], ...]:
    """The arcs of each state before a row, by initial; nodes are 4 * row + state."""
    out = []
    for q in range(4):
        arcs = [(DELETE, 4, "D"), (INSERT, NEXT[q] - q, "I")]
        if not unfit:
            stays = CUT_OFF if cut else 0
            if initial == {USER: "u", ASSISTANT: "a"}[NEXT[q]]:
                arcs.append((stays, 4 + NEXT[q] - q, "K"))
            elif initial == "s" and q == START:
                arcs.append((stays, 4 + SYSTEM - q, "K"))
            arcs.append((stays + REROLE, 4 + NEXT[q] - q, "R"))
        out.append(tuple(arcs))
    return tuple(out)


def lattice(rows: list[tuple[str, bool, bool]], leave: list[int] | None) -> tuple[list[tuple[Arc, ...]], list[int]]:
    """Arcs and first prices of all nodes; the target is the last node.  ``leave``: what leaving costs by state; None after the last row."""
    target = 4 * len(rows) + 4
    arcs = [a for r in rows for a in arcs_of(*r)]
    for q in range(4):
        out = target - (4 * len(rows) + q)
        if leave is not None:
            arcs.append(((leave[q], out, ""),))
        else:
            arcs.append((*([(0, out, "")] if q in (START, ASSISTANT) else []), (INSERT, NEXT[q] - q, "I")))
    left, price = min(leave) if leave else 0, [0]
    price += [left] * 4
    for initial, unfit, cut in reversed(rows):
        left += DELETE if unfit or cut else 0
        price += [left] * 4
    return arcs, price[::-1]


def auction(arcs: list[tuple[Arc, ...]], price: list[int], source: int) -> int:
    """Raises prices until a path of tight arcs leads from the source to the target; the cost of that path."""
    target, path = len(arcs), [source]
    while (i := path[-1]) != target:
        best, to = min((c + price[i + step], step) for c, step, _ in arcs[i])
        if price[i] < best:
            price[i] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(i + to)
    return price[source]


def trace(arcs: list[tuple[Arc, ...]], price: list[int], source: int) -> tuple[str, list[int]]:
    """The least string of initials along tight arcs to the target, and the nodes behind each."""
    target = len(arcs)
    tight = lambda i: iter([(i + step, letter) for c, step, letter in arcs[i] if price[i] == c + price[i + step]])
    path, dead = [(source, "", tight(source))], set()
    while path[-1][0] != target:
        for j, letter in path[-1][2]:
            if j not in dead:
                path.append((j, letter, tight(j) if j != target else iter(())))
                break
        else:
            dead.add(path.pop()[0])
    told = [(j, letter) for j, letter, _ in path if letter]
    return "".join(x for _, x in told), [j for j, _ in told]


def cheapest(rows: list[tuple[str, bool, bool]]) -> tuple[int, str, list[int]]:
    """(cost, edit initials, state after each edit) of rows (role initial, must be deleted, truncated)."""
    parts = [rows[k : k + SEGMENT] for k in range(0, len(rows), SEGMENT)] or [[]]
    leave: list[list[int] | None] = [None]
    for part in parts[:0:-1]:
        arcs, price = lattice(part, leave[-1])
        leave.append([auction(arcs, price, q) for q in range(4)])
    state, cost, told, states = START, 0, [], []
    for k, part in enumerate(parts):
        arcs, price = lattice(part, leave[-1 - k])
        got = auction(arcs, price, state)
        cost = cost if k else got
        letters, nodes = trace(arcs, price, state)
        told.append(letters)
        states += [j % 4 for j in nodes]
        state = states[-1] if states else state
    return cost, "".join(told), states


def repaired(rows: list[tuple[str, str]]) -> tuple[dict[str, int], str, list[tuple[str, str]]]:
    """Counts of faults with the cost, the edits' initials, and the repaired rows, of a conversation's rows (role, text)."""
    n, seen, kinds = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}, set(), []
    for k, row in enumerate(rows):
        role, text = row
        told = text.rstrip(BETWEEN)
        fault = "blank" if not told else "duplicate" if row in seen else "truncated" if told[-1] not in ".!?" else ""
        seen.add(row)
        if fault:
            n[fault] += 1
        if k and rows[k - 1][0][:1] + role[:1] not in ("su", "ua", "au"):
            n["illegal"] += 1
        kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    n["cost"], edits, states = cheapest(kinds)
    out, left = [], iter(rows)
    for edit, state in zip(edits, states, strict=True):
        if edit == "I":
            out.append((ROLES[state], ""))
            continue
        role, text = next(left)
        if edit != "D":
            out.append((role if edit == "K" else ROLES[state], text))
    return n, edits, out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_conversations(rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", absent: Column | None = None) -> DataFrame:
    """One row per conversation: ``conv_col``, gaps, blank, duplicate, truncated, illegal, cost, audit (initials of the edits), repaired (array of role and text).

    ``absent``: rows that only name their conversation.
    """
    blank = F.lit(" ")
    src = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), blank).alias("role"), F.coalesce(F.col(text_col), blank).alias("text"), F.coalesce(absent if absent is not None else F.lit(False), F.lit(False)).alias("absent"))
    src = src.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "turn", "role", "text", "absent")
    kind_ = src.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, turns, own, begun, done, size, kind = None, [], [], False, [], 0, pa.int64()

        def close() -> None:
            numbers = [t for t in turns if t is not None]
            gaps = numbers[-1] - numbers[0] + 1 - len(set(numbers)) if numbers else 0
            n, edits, out = repaired(own)
            done.append((now, *(({"gaps": gaps} | n)[c] for c in COUNTS), edits, [{"role": r, "text": t} for r, t in out]))

        def told() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            types = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv", *COUNTS, "audit", "repaired"])

        for batch in batches:
            kind = batch.column(0).type
            for conv, turn, role, text, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv != now:
                    close()
                    turns, own = [], []
                    if size > 4_000_000:
                        yield told()
                        done, size = [], 0
                now, begun = conv, True
                size += len(text)
                if not gone:
                    turns.append(turn)
                    own.append((role, text))
        if begun:
            close()
            yield told()

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return src.mapInArrow(run, f"conv {kind_}, {counts}, audit string, repaired array<struct<role:string,text:string>>").withColumnRenamed("conv", conv_col)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, absent) spoilt by a hash of conversation and turn: dropped (then absent), emptied, without full stops, repeated, or with another role."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    hit = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    spoilt = F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(text, ".!?", "")).otherwise(text)
    times = F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(hit == 4, F.lit("user")).otherwise(role).alias("role"), spoilt.alias("text"), (hit == 0).alias("absent"), times.alias("copy"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = repair_conversations(rows, absent=F.col("absent"))
    lines = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return found.select("conv_id", *COUNTS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
