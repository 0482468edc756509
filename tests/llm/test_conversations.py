import hashlib
import random
import zlib
from collections import defaultdict
from itertools import pairwise

import pytest

from noticemill.llm.conversations import (
    ANSWERED, COUNTS, ENDS, LEGAL, START, STATES, STEPS, Row, damage, damaged_and_repaired, is_blank, is_truncated, repair, search,
)

SCHEMA = "conv_id long, turn long, role string, text string"


def best_path(rows, start=START, ends=ENDS):
    """The same answer by a table of the best path to every state, row by row."""

    def inserted(paths):
        out, todo = dict(paths), list(paths)
        while todo:
            state = todo.pop()
            cost, audit = out[state]
            for initial, to in STEPS[state].items():
                path = cost + 3, audit + "I"
                if initial != "s" and (to not in out or path < out[to]):
                    out[to] = path
                    todo.append(to)
        return out

    paths = {start: (0, "")}
    for row in rows:
        ahead = {}
        for state, (cost, audit) in inserted(paths).items():
            found = [(state, (cost + 4, audit + "D"))]
            if not row.bad:
                for initial, to in STEPS[state].items():
                    if initial == row.initial:
                        found.append((to, (cost + 3 * row.cut, audit + "K")))
                    if initial != "s":
                        found.append((to, (cost + 3 + 3 * row.cut, audit + "R")))
            for to, path in found:
                ahead[to] = min(path, ahead.get(to, path))
        paths = ahead
    if ends == ENDS:
        paths = inserted(paths)
    return min((paths[e] for e in ends if e in paths), default=None)


def every_path(rows):
    """All lists of edits with at most two insertions between rows, tried out."""
    found = []

    def go(at, state, cost, audit, inserted):
        if at == len(rows) and state in ENDS:
            found.append((cost, audit))
        for initial, to in STEPS[state].items():
            if initial != "s" and inserted < 2:
                go(at, to, cost + 3, audit + "I", inserted + 1)
        if at < len(rows):
            row = rows[at]
            go(at + 1, state, cost + 4, audit + "D", 0)
            if not row.bad:
                for initial, to in STEPS[state].items():
                    if initial == row.initial:
                        go(at + 1, to, cost + 3 * row.cut, audit + "K", 0)
                    if initial != "s":
                        go(at + 1, to, cost + 3 + 3 * row.cut, audit + "R", 0)

    go(0, START, 0, "", 0)
    return min(found)


def some_rows(rng, n, roles="suax "):
    return [Row(rng.choice(roles), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_search_matches_every_list_of_edits():
    rng = random.Random(1)
    for _ in range(300):
        rows = some_rows(rng, rng.randrange(5))
        assert search(rows) == every_path(rows) == best_path(rows)


def test_search_matches_a_table_of_paths():
    rng = random.Random(2)
    for _ in range(3000):
        rows = some_rows(rng, rng.randrange(12))
        assert search(rows) == best_path(rows)
        start, end = rng.choice(STATES), rng.choice(STATES)
        assert search(rows, start, (end,)) == best_path(rows, start, (end,))


@pytest.mark.parametrize("roles", ["suax ", "ua", "u", "s", "us", "sa"])
def test_long_searches(roles):
    rows = some_rows(random.Random(3), 1000, roles)
    assert search(rows) == best_path(rows)


def brute(rows):
    """Damage and repair conversation by conversation, in plain Python."""
    damaged = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if deal == 1:
            text = ""
        if deal == 2:
            text = "".join(c for c in text if c not in ".!?")
        if deal == 4:
            role = "user"
        damaged[conv] += [(turn, role, text)] * (0 if deal == 0 else 2 if deal == 3 else 1)
    out = {}
    for conv, found in damaged.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in found if t is not None}
        seen, searched = set(), []
        blank = duplicate = truncated = 0
        for _, role, text in found:
            again = (role, text) in seen
            seen.add((role, text))
            gone = is_blank(text)
            blank += gone
            duplicate += again and not gone
            cut = not gone and not again and is_truncated(text)
            truncated += cut
            searched.append(Row(role[:1], gone or again, cut))
        illegal = sum(a.initial + b.initial not in LEGAL for a, b in pairwise(searched))
        cost, audit = best_path(searched)
        lines, state, at = [], START, 0
        for edit in audit:
            role, text = ("assistant" if state == 2 else "user"), ""
            if edit != "I":
                if edit == "K":
                    role = found[at][1]
                text = found[at][2]
                at += 1
            if edit != "D":
                lines.append(f"{role}:{text}")
                state = STEPS[state][role[:1]]
        assert state in (START, ANSWERED)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def collected(frame):
    rows = frame.collect()
    out = {r.conv_id: (*[r[c] for c in COUNTS], r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (1, 2, "assistant", "Hello."),
    (2, None, None, None), (2, None, "user", "  x"), (2, 7, "", ""), (2, 3, "Ärzte", "ü."),
    (None, 1, "assistant", "No id."), (None, None, "user", "? "),
    (3, 5, "user", "word " * 30_000), (3, -5, "tool", "\n\t"), (3, 0, "assistant", "a:b\nc."),
    (4, 1, "user", "one"), (4, 1, "user", "two."), (4, 1, "assistant", "two."), (4, 9, "user", "two."),
]


def odd_rows(spark):
    rows = [(*r, "x", 1, 2) for r in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", key string, block int, cost int")


@pytest.mark.parametrize("block", [1024, 2])
def test_odd_rows_match_brute_force(spark, block):
    want = brute(ODD)
    assert collected(damaged_and_repaired(odd_rows(spark), block)) == want


@pytest.mark.parametrize("block", [1024, 3])
def test_conversations_match_brute_force(spark, block):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    want = brute([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    got = collected(damaged_and_repaired(rows, block))
    assert {c: got[c] for c in want} == want
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert all(got[c] == nothing for c in set(got) - set(want))


def test_a_conversation_holds_most_rows(spark):
    rng = random.Random(4)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"{k}.", " "])) for k in range(3000)]
    rows += [(c, k, "user" if k % 2 == 0 else "assistant", f"{c} {k}.") for c in range(100, 200) for k in range(4)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert collected(damaged_and_repaired(frame, 256)) == brute(rows)


def test_edits_of_blocks_are_those_of_the_audit(spark):
    rows = spark.createDataFrame([(1, k, "user", f"{k}.") for k in range(7)], SCHEMA)
    found = repair(rows, block=3)
    audit = found.conversations.first().audit
    blocks = sorted(found.blocks.collect(), key=lambda r: r.block)
    assert "".join(e.edit for b in blocks for e in b.edits) == audit
    assert [b.n_blocks for b in blocks] == [3, 3, 3]
    said = [(e.role, e.text) for b in blocks for e in b.edits if e.edit != "D"]
    assert [r for r, _ in said] == ["user", "assistant"] * (len(said) // 2)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert damaged_and_repaired(none).count() == 0 and damage(none).count() == 0
