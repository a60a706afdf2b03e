"""Conversation repair against a plain search over edit sequences, whatever the partitions."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from filelode.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"


def spoilt(rows):
    """The contract's damage, row by row."""
    out = []
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role), blank(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows):
    """Least (cost, edits) by uniform-cost search over whole edit strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        said = text.strip(c.SPACES)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, roles, kept = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        state = (at, roles if roles in ("", "s") else roles[-1])
        if state in done:
            continue
        done.add(state)
        steps = [("I", 5, 0, r, r + ":") for r in c.ROLES]
        if at < len(rows):
            role, text, fault = rows[at][2], rows[at][3], faults[at]
            late = 5 if fault == "truncated" else 0
            steps.append(("D", 2, 1, "", None))
            if fault not in ("blank", "duplicate"):
                steps += [("K", late, 1, role, f"{role}:{text}")] + [("R", 1 + late, 1, r, f"{r}:{text}") for r in c.ROLES]
        for edit, more, taken, role, line in steps:
            then = roles + role[:1] if line is not None else roles
            if line is not None and not (role[:1] and re.fullmatch("s?(ua)*u?", then)):
                continue
            heapq.heappush(heap, (cost + more, audit + edit, at + taken, then, kept if line is None else (*kept, line)))
    turns = {r[1] for r in rows} - {None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def invented(n, seed, longest=12):
    rnd, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in range(rnd.randrange(1, longest)):
            role = rnd.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = rnd.choice(["Yes.", "No!", "And then", "", " \n", None, "Why? ", "é…", "x" * rnd.randrange(200) + "."])
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn + 3]), role, text))
    return rows


def answers(spark, rows, damaged=True):
    df = spark.createDataFrame(rows, SCHEMA)
    of = df.selectExpr("conv_id AS conv")
    return {r.conv: tuple(r)[1:] for r in c.repair(c.damage(df) if damaged else c.unspoilt(df), of).collect()}


def expected(rows, damaged=True):
    left = spoilt(rows) if damaged else [(a, b, " " if r is None else r, " " if t is None else t) for a, b, r, t in rows]
    return {conv: plain([r for r in left if r[0] == conv]) for conv in {r[0] for r in rows}}


@pytest.mark.parametrize("damaged", [True, False])
def test_against_plain_search(spark, damaged):
    rows = invented(60, 5)
    assert answers(spark, rows, damaged) == expected(rows, damaged)


def test_conversations_over_many_partitions_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 7)
    rnd = random.Random(3)
    rows = [(conv, turn, rnd.choice(["user", "assistant", "system", "x"]), rnd.choice(["A.", "b", "", f"n{turn}."])) for conv in (1, 2) for turn in range(400 if conv == 2 else 40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert len(c.seams(c.ordered(c.damage(spark.createDataFrame(rows, SCHEMA))))) > 5
        assert answers(spark, rows) == expected(rows)
        turns = c.repaired_turns(c.damage(spark.createDataFrame(rows, SCHEMA))).orderBy("conv", "place").collect()
        want = expected(rows)
        for conv in (1, 2):
            own = [r for r in turns if r.conv == conv]
            assert "".join(r.edit for r in own) == want[conv][-2]
            assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D").encode()).hexdigest() == want[conv][-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repeated_rows_are_one_row_with_a_count(spark):
    rows = [(1, 1, "user", "Hello.")] * 500 + [(1, 2, "assistant", "Hello.")]
    got = answers(spark, rows, damaged=False)
    assert got == expected(rows, damaged=False)
    assert got[1][-2] == "K" + "D" * 499 + "K"


def test_nothing_left_empty_table_and_clashing_columns(spark):
    dropped = [(c_, t, "user", "Hi.") for c_ in range(300) for t in range(1) if zlib.crc32(f"{c_}:{t}".encode()) % 20 == 0]
    empty = hashlib.sha256().hexdigest()
    assert set(answers(spark, dropped).values()) == {(0, 0, 0, 0, 0, 0, "", empty)}
    assert answers(spark, []) == {}
    df = spark.createDataFrame([(1, 1, "user", "Hi.", 9, True)], SCHEMA + ", copies long, mark boolean")
    assert c.repair(c.unspoilt(df)).count() == 1


def test_distances_are_least_costs():
    rnd = random.Random(8)
    for _ in range(50):
        symbols = bytes(rnd.randrange(c.GONE + 1) for _ in range(rnd.randrange(0, 9)))
        whole = c.distances(symbols, c.AT_END)[0]
        k = rnd.randrange(len(symbols) + 1)
        assert whole == c.before(c.through(symbols[:k]), c.entry(symbols[k:], c.AT_END))[0] == c.cheapest(symbols)[1]
