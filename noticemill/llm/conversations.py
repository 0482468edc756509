"""Repair of conversation structure by depth-first branch and bound.

The rows of a conversation, by turn with nulls first, are edited until their roles read
``(s?(ua)+)?`` by initials: an optional system row, then user and assistant in turns. Keep costs 0, Rerole
to user or assistant 3, Delete 4, which a blank row and one that repeats an earlier role and text
require, and Insert, anywhere, an empty text of user or assistant 3; a truncated row that stays adds 3. The
repair is the cheapest list of edits; of several, the one whose initials come first in ASCII.

The search walks rows with an explicit stack. A node is (rows done, state), a state what the roles so
far ask for next. Children are tried in the order of their lower bound, then initial. The bound of what is
left comes from a relaxed problem, summed up from the last row: the roles may also end after a system row.
A prefix is dropped where its cost and bound cannot beat the incumbent (cost, audit), or where the
node's dominance table holds a prefix that is no worse; prefixes at one node have the same number of rows,
so one of equal cost is never the beginning of another, and the smaller stays smaller whatever
follows. When the stack is empty the incumbent is proved best.

Conversations of up to ``BLOCK`` rows are searched whole, as sorted runs of a task's rows. A longer one,
which may hold any part of all rows, is never one task's group: its rows are placed by prefix sums over
ranges, first occurrences found by a summed key, and cut into blocks of ``BLOCK`` rows. Each block is
searched from every state to every state; the blocks' tables are joined up from the last block to the
first, as what follows a state does not depend on what led to it; and each block is edited by the
path found through it.

A null role or text counts as one space. Rows that tie in the turn are taken by role, then text; rows equal
in all three are interchangeable. A null conversation is a conversation of its own. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticemill.operators.joins import broadcast_if, is_small
from noticemill.operators.ranges import running_totals
from noticemill.session import written

#: Rows that are searched as one piece.
BLOCK = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
USER, ASSISTANT = "user", "assistant"

#: States: nothing yet, after a system row, after a user, after an assistant. What leads where; where a
#: conversation may end.
START, SYSTEM, ASKED, ANSWERED = range(4)
STATES = range(4)
STEPS = {START: {"s": SYSTEM, "u": ASKED}, SYSTEM: {"u": ASKED}, ASKED: {"a": ANSWERED}, ANSWERED: {"u": ASKED}}
ENDS = (START, ANSWERED)
LEGAL = {"su", "ua", "au"}

SEEN = re.compile(r"[^\x20\x09-\x0D]")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
EDIT = "struct<edit:string,role:string,text:string>"


class Row(NamedTuple):
    """What the search needs of a row."""

    initial: str
    #: whether it has to go, and whether it is cut short
    bad: bool
    cut: bool


class Path(NamedTuple):
    cost: int
    audit: str


def is_blank(text: str) -> bool:
    return not SEEN.search(text)


def is_truncated(text: str) -> bool:
    return text.rstrip(" \t\n\x0b\f\r")[-1:] not in (".", "!", "?")


def _bounds(rows: list[Row], ends: tuple[int, ...]) -> list[dict[int, int]]:
    """Per row, for each state, the least cost of the rows from there on, if a conversation could also
    end after its system row."""
    ask = 0 if set(ends) - {ASKED} else INSERT
    answer = 0 if ASKED in ends else INSERT
    begin = 0 if START in ends else ask
    out = [{START: begin, SYSTEM: ask, ASKED: answer, ANSWERED: ask}]
    for row in reversed(rows):
        stays = TRUNCATED * row.cut
        costs = [DELETE + begin, DELETE + ask, DELETE + answer]
        if not row.bad:
            asks = stays + (KEEP if row.initial == "u" else REROLE) + answer
            costs[0], costs[1] = min(costs[0], asks), min(costs[1], asks)
            costs[2] = min(costs[2], stays + (KEEP if row.initial == "a" else REROLE) + ask)
            if row.initial == "s":
                costs[0] = min(costs[0], stays + KEEP + ask)
        begin = min(costs[0], INSERT + costs[2], 2 * INSERT + costs[1])
        ask, answer = min(costs[1], INSERT + costs[2]), min(costs[2], INSERT + costs[1])
        out.append({START: begin, SYSTEM: ask, ASKED: answer, ANSWERED: ask})
    return out[::-1]


def search(rows: list[Row], start: int = START, ends: tuple[int, ...] = ENDS) -> Path | None:
    """The cheapest edits from a state to one of the ends, the ASCII-least of them; None where there are
    none. A piece's last insertions belong to what follows it, unless it may end a conversation."""
    last = ends == ENDS
    bounds = _bounds(rows, ends)
    n = len(rows)
    best: Path | None = None
    tables: list[dict[int, Path]] = [{} for _ in range(n + 1)]
    stack = [(0, start, Path(0, ""))]
    while stack:
        at, state, path = stack.pop()
        bound = path.cost + bounds[at][state]
        if best and (bound > best.cost or bound == best.cost and path.audit > best.audit[: len(path.audit)]):
            continue
        known = tables[at].get(state)
        if known and known < path:
            continue
        if at == n and state in ends and (best is None or path < best):
            best = path
        ahead = []
        if at < n:
            row = rows[at]
            ahead.append((at + 1, state, Path(path.cost + DELETE, path.audit + "D")))
            if not row.bad:
                stays = path.cost + TRUNCATED * row.cut
                for initial, to in STEPS[state].items():
                    if initial == row.initial:
                        ahead.append((at + 1, to, Path(stays + KEEP, path.audit + "K")))
                    if initial != "s":
                        ahead.append((at + 1, to, Path(stays + REROLE, path.audit + "R")))
        if at < n or last:
            for initial, to in STEPS[state].items():
                if initial != "s":
                    ahead.append((at, to, Path(path.cost + INSERT, path.audit + "I")))
        open_nodes = []
        for node in ahead:
            place, to, reached = node
            known = tables[place].get(to)
            if known is None or reached < known:
                tables[place][to] = reached
                open_nodes.append((reached.cost + bounds[place][to], reached.audit, node))
        # the most promising child is taken from the stack first
        open_nodes.sort(reverse=True)
        stack.extend(node for _, _, node in open_nodes)
    return best


def edited(roles: list[str], texts: list[str], audit: str, state: int = START) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of a piece's edits in order, deleted rows with their own role and text, and the
    state after them."""
    out, at = [], 0
    for edit in audit:
        if edit == "I":
            role, text = (ASSISTANT if state == ASKED else USER), ""
        else:
            role, text = roles[at], texts[at]
            at += 1
            if edit == "R":
                role = ASSISTANT if state == ASKED else USER
        out.append((edit, role, text))
        if edit != "D":
            state = STEPS[state][role[:1]]
    return out, state


def _rows(roles: list[str], texts: list[str], repeated: list[bool]) -> tuple[list[Row], dict[str, int]]:
    """The rows for the search and how many have which fault; each row's first fault counts."""
    rows, faults = [], dict.fromkeys(COUNTS[1:], 0)
    for role, text, again in zip(roles, texts, repeated, strict=True):
        blank = is_blank(text)
        cut = not blank and not again and is_truncated(text)
        rows.append(Row(role[:1], blank or again, cut))
        faults["blank"] += blank
        faults["duplicate"] += again and not blank
        faults["truncated"] += cut
    faults["illegal"] = sum(a.initial + b.initial not in LEGAL for a, b in pairwise(rows))
    return rows, faults


def _repaired(turns: list[int | None], roles: list[str], texts: list[str]) -> dict:
    """The answer for one conversation whose rows are all here."""
    seen: set[tuple[str, str]] = set()
    repeated = []
    for one in zip(roles, texts, strict=True):
        repeated.append(one in seen)
        seen.add(one)
    rows, faults = _rows(roles, texts, repeated)
    best = search(rows)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    edits, _ = edited(roles, texts, best.audit)
    return faults | {"gaps": gaps, "cost": best.cost, "audit": best.audit, "edits": edits}


def _prepared(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, conv, turn, role, text); the key is never null."""
    return rows.select(
        F.concat(F.lit("="), F.col(conv).cast("string")).alias("key"),
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("key", F.coalesce("key", F.lit("")))


class Repaired(NamedTuple):
    """One row per conversation: conv, the ``COUNTS`` and the audit. One row per conversation and block:
    conv, block, n_blocks and its edits in order."""

    conversations: DataFrame
    blocks: DataFrame


def repair(
    rows: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    block: int = BLOCK,
) -> Repaired:
    """Repair every conversation of a table of rows."""
    rows = _prepared(rows, conv_column, turn_column, role_column, text_column)
    kind = rows.schema["conv"].dataType.simpleString()
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    long = written(sizes.where(F.col("n") > block), "long")
    some = not long.isEmpty()
    short = rows.join(broadcast_if(is_small(long), long), "key", "left_anti") if some else rows
    whole = written(
        short.repartition("key")
        .sortWithinPartitions("key", F.col("turn").asc_nulls_first(), "role", "text")
        .mapInArrow(
            _repair_runs,
            f"conv {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, edits array<{EDIT}>",
        ),
        "repaired",
    )
    conversations = whole.select("conv", *COUNTS, "audit")
    blocks = whole.select("conv", F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("n_blocks"), "edits")
    if some:
        more = _repair_long(rows.join(broadcast_if(is_small(long), long.drop("n")), "key", "left_semi"), kind, block)
        conversations, blocks = conversations.unionByName(more.conversations), blocks.unionByName(more.blocks)
    name = {"conv": conv_column}
    return Repaired(conversations.withColumnsRenamed(name), blocks.withColumnsRenamed(name))


def _runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[dict[str, list]]:
    """The columns of each run of rows with equal keys, of sorted rows in batches."""
    held: dict[str, list] | None = None
    mark: tuple | None = None
    for batch in batches:
        columns = batch.to_pydict()
        marks = list(zip(*[columns[k] for k in key], strict=True))
        first = 0
        while first < len(marks):
            last = first
            while last < len(marks) and marks[last] == marks[first]:
                last += 1
            if held is not None and marks[first] == mark:
                for name, values in held.items():
                    values += columns[name][first:last]
            else:
                if held is not None:
                    yield held
                held, mark = {name: values[first:last] for name, values in columns.items()}, marks[first]
            first = last
    if held is not None:
        yield held


#: Conversations of a task whose answers are sent together.
TOGETHER = 256


def _repair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for run in _runs(batches, ["key"]):
        held.append((run["conv"][0], _repaired(run["turn"], run["role"], run["text"])))
        if len(held) == TOGETHER:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


_EDIT = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _edits(found: list[list[tuple[str, str, str]]]) -> pa.Array:
    return pa.array([[dict(zip(("edit", "role", "text"), e, strict=True)) for e in one] for one in found], pa.list_(_EDIT))


def _batch(held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([conv for conv, _ in held]),
            *[pa.array([one[c] for _, one in held], pa.int64()) for c in COUNTS],
            pa.array([one["audit"] for _, one in held], pa.string()),
            _edits([one["edits"] for _, one in held]),
        ],
        ["conv", *COUNTS, "audit", "edits"],
    )


BLOCK_TABLE = (
    "key string, block long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "paths array<struct<start:int,stop:int,cost:long,audit:string>>"
)


def _repair_long(rows: DataFrame, kind: str, block: int) -> Repaired:
    """The same for conversations of many blocks."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = written(running_totals(rows, ["key"], order, {"at": F.lit(1)}, "placed"), "placed")
    named = placed.withColumn("digest", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)).withColumn(
        "block", F.floor(F.col("at") / block)
    )
    # rows equal in role and text are interchangeable, so the first place alone tells which repeat
    first = named.groupBy("key", "digest").agg(F.min("at").alias("first_at"))
    blocked = written(
        named.join(first, ["key", "digest"]).select(
            "key", "conv", "block", "at", "turn", "role", "text", (F.col("at") > F.col("first_at")).alias("again")
        ),
        "blocked",
    )
    pieces = blocked.repartition("key", "block").sortWithinPartitions("key", "block", "at")
    tables = written(pieces.mapInArrow(_search_blocks, BLOCK_TABLE), "tables")
    n_blocks = tables.groupBy("key").agg(F.count("*").alias("n_blocks"))
    joined = written(
        tables.repartition("key")
        .sortWithinPartitions("key", F.col("block").desc())
        .mapInArrow(_join_blocks, "key string, block long, start int, audit string, cost long"),
        "joined",
    )
    turns = rows.where("turn IS NOT NULL").groupBy("key", "turn").agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    edge = tables.select(
        F.col("key").alias("_key"), (F.col("block") + 1).alias("_block"), F.col("last").alias("_before")
    )
    crossed = tables.join(edge, (F.col("key") == F.col("_key")) & (F.col("block") == F.col("_block")), "left")
    across = F.when(F.col("_before").isNotNull(), (~F.concat("_before", "first").isin(*LEGAL)).cast("long")).otherwise(0)
    sums = crossed.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")], F.sum(F.col("illegal") + across).alias("illegal")
    )
    audits = joined.groupBy("key").agg(
        F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda s: s["audit"]), "").alias("audit"),
    )
    convs = rows.groupBy("key").agg(F.first("conv").alias("conv"))
    conversations = (
        convs.join(sums, "key")
        .join(audits, "key")
        .join(gaps, "key", "left")
        .select("conv", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], "audit")
    )
    chosen = joined.join(n_blocks, "key").select("key", "block", "n_blocks", "start", "audit")
    blocks = (
        blocked.select("key", "conv", "block", "at", "role", "text")
        .groupBy("key", "block")
        .cogroup(chosen.groupBy("key", "block"))
        .applyInPandas(_edit_block, f"key string, block long, n_blocks long, edits array<{EDIT}>")
    )
    blocks = written(blocks, "blocks").join(convs, "key").select("conv", "block", "n_blocks", "edits")
    return Repaired(written(conversations, "long-conversations"), blocks)


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    for run in _runs(batches, ["key", "block"]):
        rows, faults = _rows(run["role"], run["text"], run["again"])
        paths = []
        for start in STATES if run["block"][0] else (START,):
            for stop in STATES:
                if found := search(rows, start, (stop,)):
                    paths.append({"start": start, "stop": stop, "cost": found.cost, "audit": found.audit})
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([run["key"][0]]),
                pa.array([run["block"][0]], pa.int64()),
                *[pa.array([faults[c]], pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")],
                pa.array([rows[0].initial]),
                pa.array([rows[-1].initial]),
                pa.array([paths], paths_type),
            ],
            ["key", "block", "blank", "duplicate", "truncated", "illegal", "first", "last", "paths"],
        )


class Rest(NamedTuple):
    """What follows a state at the beginning of a block: cost, this block's edits and the state after
    them, and the rest from there."""

    cost: int
    audit: str
    stop: int
    then: Rest | None


def _letters(rest: Rest | None) -> Iterator[str]:
    while rest:
        yield from rest.audit
        rest = rest.then


def _before(a: Rest, b: Rest) -> bool:
    """Whether a is cheaper, or as cheap and its edits come first in ASCII."""
    if a.cost != b.cost:
        return a.cost < b.cost
    if a.then is b.then:
        return a.audit < b.audit
    left, right = _letters(a), _letters(b)
    for x in left:
        y = next(right, "")
        if x != y:
            return x < y
    return next(right, None) is not None


#: What may be inserted after the last row.
_TAILS = {state: search([], state) for state in STATES}


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the tables of a conversation's blocks, the last one first: each block's state at its
    beginning and its edits on the best path through all, with the cost from there on."""

    def walked(key: str, first: Rest) -> pa.RecordBatch:
        out, rest, state, block = [], first, START, 0
        while rest.then is not None:
            tail = rest.then.audit if rest.then.then is None else ""
            out.append((key, block, state, rest.audit + tail, rest.cost))
            state, rest, block = rest.stop, rest.then, block + 1
        columns = list(zip(*out, strict=True))
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "block", "start", "audit", "cost"]
        )

    key, after = None, {}
    for batch in batches:
        for row in batch.select(["key", "block", "paths"]).to_pylist():
            if row["key"] != key:
                key = row["key"]
                after = {s: Rest(tail.cost, tail.audit, s, None) for s, tail in _TAILS.items() if tail}
            here: dict[int, Rest] = {}
            for path in row["paths"]:
                if then := after.get(path["stop"]):
                    rest = Rest(path["cost"] + then.cost, path["audit"], path["stop"], then)
                    if path["start"] not in here or _before(rest, here[path["start"]]):
                        here[path["start"]] = rest
            after = here
            if row["block"] == 0:
                yield walked(key, after[START])


def _edit_block(key: tuple, rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("at", kind="stable")
    one = chosen.iloc[0]
    edits, _ = edited(rows["role"].tolist(), rows["text"].tolist(), one["audit"], int(one["start"]))
    names = ("edit", "role", "text")
    return pd.DataFrame(
        {
            "key": [key[0]],
            "block": [key[1]],
            "n_blocks": [one["n_blocks"]],
            "edits": [[dict(zip(names, e, strict=True)) for e in edits]],
        }
    )


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32 of ``conv_id:turn`` modulo 20 deals out: 0
    drops a row, 1 empties its text, 2 takes its end signs, 3 repeats it, 4 makes it a user's. Nulls are one
    space, but stay null as conversation and turn."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    dealt = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(dealt == 1, "").when(dealt == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return rows.where(dealt != 0).select(
        "conv_id",
        "turn",
        F.when(dealt == 4, USER).otherwise(spaced("role")).alias("role"),
        text.alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(dealt == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _stays(edits: str | Column) -> Column:
    """The repaired rows of a block, one line each."""
    kept = F.filter(edits, lambda e: e["edit"] != "D")
    return F.transform(kept, lambda e: F.concat(e["role"], F.lit(":"), e["text"]))


def _digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, read block by block."""

    def answer() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "repaired_sha256"])

    key, digest, empty = None, None, True
    for batch in batches:
        for name, lines in zip(batch.column("key"), batch.column("lines"), strict=True):
            if name.as_py() != key:
                if digest:
                    yield answer()
                key, digest, empty = name.as_py(), hashlib.sha256(), True
            for line in lines.as_py():
                digest.update((line if empty else "\n" + line).encode())
                empty = False
    if digest:
        yield answer()


def repaired_digests(blocks: DataFrame, conv_column: str = "conv_id") -> DataFrame:
    """(conv, repaired_sha256): the digest of a conversation's repaired lines. Those of several blocks are
    read in order by one task each, which holds a block at a time."""
    lines = blocks.select(F.col(conv_column).alias("conv"), "block", "n_blocks", _stays(F.col("edits")).alias("lines"))
    whole = lines.where("n_blocks = 1").select("conv", F.sha2(F.array_join("lines", "\n"), 256).alias("repaired_sha256"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    parts = lines.where("n_blocks > 1").withColumn("key", key)
    digests = (
        parts.select("key", "block", "lines")
        .repartition("key")
        .sortWithinPartitions("key", "block")
        .mapInArrow(_digest_runs, "key string, repaired_sha256 string")
    )
    named = parts.where("block = 0").select("key", "conv").join(digests, "key").select("conv", "repaired_sha256")
    return whole.unionByName(named).withColumnRenamed("conv", conv_column)


def damaged_and_repaired(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Damage the rows, repair them, and report every original conversation: conv_id, the ``COUNTS``, the
    audit and the digest of the repaired lines. One without rows after the damage has zeros, an empty audit
    and the digest of nothing."""
    repaired = repair(damage(rows), block=block)
    known = repaired.conversations.withColumnRenamed("conv_id", "_conv")
    digests = repaired_digests(repaired.blocks).select(F.col("conv_id").alias("_d_conv"), "repaired_sha256")
    found = known.join(digests, F.col("_conv").eqNullSafe(F.col("_d_conv")))
    every = rows.select("conv_id").distinct()
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
