"""Repair of the structure of conversations at least cost, with an audit of the edits.

The rows of a conversation are the steps of a layered graph: a node is a place between rows and the state of the roles kept
so far (nothing, ``s``, ``u``, ``a``), an arc an edit. Costs are small integers, so Dial's queue of buckets gives the least
cost from every node to the end; the audit then walks from the start along tight arcs, whose cost is what the distance
falls by, taking the first in ASCII order. From a node each edit leads to one node, so the audit says all of the repair.

=========================  ==========================================================
``K`` keep                 0, and 5 for a truncated row
``R`` rerole               1, to ``user`` or ``assistant``, and 5 for a truncated row
``D`` delete               2; the only edit of a blank or a duplicate row
``I`` insert               5, an empty ``user`` or ``assistant`` turn, anywhere
=========================  ==========================================================

A conversation isn't gathered: all rows are sorted by conversation and turn over the partitions. One that lies within a
partition is repaired there; of one that reaches over several, each partition gives the least costs through its part
from each state to each, at most two such parts a partition, and from these follow the distances at the end of each part and
the state that the walk enters it in. Rows that are equal in every column travel as one row with a count. Only the digest of
such a conversation streams its turns through one task, as SHA-256 must, holding one turn at a time.

Defined cases: a null role or text is one space (so such a text is blank, such a role is reroled or deleted); rows without
a conversation id are one conversation, whose id stays null; rows of one turn (or without turn, which come first) stand
in the order of role and text; an empty table gives no rows. Extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filelode.llm.common import checkpoint

#: States of the roles so far: nothing, s, u, a. The state that the next turn of user or assistant leads to.
START, END = 0, (0, 3)
NEXT = (2, 2, 3, 2)
ROLES = ("user", "assistant")
#: Row symbols: role (s, u, a, another), plus 4 if truncated; or a row that must go.
OTHER, TRUNCATED, GONE = 3, 4, 8
KEEP = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
FAR = 1 << 30
#: Buckets of the queue: more than the largest arc and the widest gap between the distances at an end.
BUCKETS = 64
#: Distances to the end behind the last row: from u one insertion is left, from s two.
AT_END = (0, 2 * INSERT_COST, INSERT_COST, 0)
#: Rows whose nodes are held at a time.
BLOCK = 1 << 16
SPACES = " \t\n\x0b\x0c\r"
#: Letters of a text by which rows of one turn are sorted, before its digest.
HEAD = 64


def _edits(symbol: int, state: int) -> list[tuple[str, int, int, int]]:
    """Edits of a row from a state in ASCII order: initial, cost, rows taken, next state."""
    late = TRUNCATED_COST if TRUNCATED <= symbol < GONE else 0
    out = [("D", DELETE_COST, 1, state), ("I", INSERT_COST, 0, NEXT[state])]
    if symbol < GONE:
        if state in KEEP[symbol & 3]:
            out.append(("K", late, 1, KEEP[symbol & 3][state]))
        out.append(("R", REROLE_COST + late, 1, NEXT[state]))
    return out


EDITS = [[_edits(symbol, state) for state in range(4)] for symbol in range(GONE + 1)]
#: Arcs backward: by symbol and state behind the row, (state before it, cost); and the states that an insertion leaves.
INTO = [[[(p, cost) for p in range(4) for _, cost, rows, q in EDITS[symbol][p] if rows and q == state] for state in range(4)] for symbol in range(GONE + 1)]
INSERTED_FROM = [[p for p in range(4) if NEXT[p] == state] for state in range(4)]


def distances(symbols: bytes, leave: Iterable[int]) -> array:
    """Least costs from every node (row place times 4, plus state) to the end, given those behind the last row."""
    leave, n = list(leave), len(symbols)
    dist = array("i", [FAR]) * (4 * n + 4)
    buckets: list[list[int]] = [[] for _ in range(BUCKETS)]
    now = min(leave)
    waiting = 0
    for state, cost in enumerate(leave):
        if cost < FAR:
            dist[4 * n + state] = cost
            buckets[cost % BUCKETS].append(4 * n + state)
            waiting += 1
    while waiting:
        bucket = buckets[now % BUCKETS]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != now:
                continue
            state = node & 3
            arcs = [(node - state + p, INSERT_COST) for p in INSERTED_FROM[state]]
            if node > 3:
                arcs += [(node - state - 4 + p, cost) for p, cost in INTO[symbols[(node >> 2) - 1]][state]]
            for before, cost in arcs:
                if now + cost < dist[before]:
                    dist[before] = now + cost
                    buckets[(now + cost) % BUCKETS].append(before)
                    waiting += 1
        now += 1
    return dist


def walk(symbols: bytes, dist: array, state: int, last: bool) -> tuple[str, int]:
    """The ASCII-least cheapest edits from a state on, and the state behind them; insertions behind all rows are ``last``'s."""
    at, out = 0, []
    while at < len(symbols):
        here = dist[4 * at + state]
        for initial, cost, rows, then in EDITS[symbols[at]][state]:
            if here == cost + dist[4 * (at + rows) + then]:
                out.append(initial)
                at, state = at + rows, then
                break
    while last and state not in END:
        out.append("I")
        state = NEXT[state]
    return "".join(out), state


def entry(symbols: bytes, leave: Iterable[int]) -> list[int]:
    """Distances before the first row, given those behind the last one, a block at a time."""
    leave = list(leave)
    for at in range((max(len(symbols), 1) - 1) // BLOCK * BLOCK, -1, -BLOCK):
        leave = distances(symbols[at : at + BLOCK], leave)[:4].tolist()
    return leave


def through(symbols: bytes) -> list[list[int]]:
    """Least costs through the rows, from each state to each; composed on the right by ``before``."""
    ends = [entry(symbols, [0 if q == to else FAR for q in range(4)]) for to in range(4)]
    return [[ends[to][state] for to in range(4)] for state in range(4)]


def before(costs: list[list[int]], leave: Iterable[int]) -> list[int]:
    leave = list(leave)
    return [min(FAR, *(c + x for c, x in zip(row, leave))) for row in costs]


def edits(symbols: bytes, leave: Iterable[int], state: int, last: bool) -> tuple[str, int, int]:
    """Audit, cost and the state behind the rows, for a walk that enters in ``state``."""
    leave = list(leave)
    starts = range(0, max(len(symbols), 1), BLOCK)
    behind = [leave]
    for at in reversed(starts[1:]):
        behind.append(distances(symbols[at : at + BLOCK], behind[-1])[:4].tolist())
    audit, cost = [], 0
    for n, (at, out) in enumerate(zip(starts, reversed(behind))):
        final = last and n == len(starts) - 1
        dist = distances(symbols[at : at + BLOCK], out)
        part, then = walk(symbols[at : at + BLOCK], dist, state, final)
        cost += dist[state] - (0 if final else out[then])
        audit.append(part)
        state = then
    return "".join(audit), cost, state


@lru_cache(maxsize=100_000)
def cheapest(symbols: bytes) -> tuple[str, int]:
    """Audit and cost of a whole conversation."""
    return edits(symbols, AT_END, START, True)[:2]


# ---- rows ----


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows spoilt by the CRC-32 of ``conv:turn``, modulo 20: dropped (0), emptied (1), without full stops (2), repeated (3), of the user (4).

    Columns conv, turn, role, text; and ``copies``, how often the row stands there.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn))) % 20
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), kind.alias("kind"))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return out.where("kind != 0").select(
        "conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies")
    )


def unspoilt(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows as they are, in the columns that ``repair`` takes."""
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    out = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), blank(role), blank(text))
    return out.toDF("conv", "turn", "role", "text").withColumn("copies", F.lit(1).cast("long"))


def _symbol() -> Column:
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    cut = F.when(F.substring(end, -1, 1).isin(".", "!", "?"), 0).otherwise(TRUNCATED)
    return F.when(end == "", GONE + role).otherwise(role + cut).cast("int")


def ordered(rows: DataFrame) -> DataFrame:
    """All rows in order over the partitions, equal ones together; before the first row of each role and text stands a mark.

    The marks carry no text and sort right before their row, so first rows are known without joining texts.
    """
    key = ["conv", "turn", "role", "head", "digest"]
    own = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    own = own.withColumns({"head": F.substring("text", 1, HEAD), "digest": F.unhex(F.sha2("text", 256)), "symbol": _symbol(), "mark": F.lit(False)})
    firsts = own.groupBy("conv", "role", "head", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn"))["turn"].alias("turn"))
    marks = firsts.withColumns({"copies": F.lit(0).cast("long"), "symbol": F.lit(0), "mark": F.lit(True), "text": F.lit(None).cast("string")})
    both = own.unionByName(marks).repartitionByRange(*key).sortWithinPartitions(*key, F.col("mark").desc())
    return checkpoint(both.select("conv", "turn", "role", "text", "copies", "symbol", "mark"))


@dataclass
class Part:
    """The rows of one conversation within one partition."""

    conv: object
    turns: list
    roles: list[int]
    symbols: bytes
    counts: tuple[int, int, int]
    copies: list[int]
    payload: list[list]

    def distinct(self) -> int:
        return len({t for t in self.turns if t is not None})

    def illegal(self) -> int:
        pairs = sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(self.roles, self.roles[1:]))
        return pairs + sum(self.copies) - len(self.copies)


def _part(conv: object, rows: list[tuple]) -> Part:
    """``rows``: turn, copies, symbol, mark, and what else is carried."""
    turns, roles, copies, symbols, payload = [], [], [], [], []
    blank = duplicate = truncated = 0
    first = False
    for turn, n, symbol, mark, *more in rows:
        if mark:
            first = True
            continue
        role = symbol & 3
        if symbol >= GONE:
            own, blank = GONE, blank + n
        elif first:
            own, duplicate, truncated = symbol, duplicate + n - 1, truncated + (symbol >= TRUNCATED)
        else:
            own, duplicate = GONE, duplicate + n
        first = False
        turns.append(turn)
        roles.append(role)
        copies.append(n)
        payload.append(more)
        symbols.append(bytes([own]) + bytes([GONE]) * (n - 1))
    return Part(conv, turns, roles, b"".join(symbols), (blank, duplicate, truncated), copies, payload)


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[Part]:
    """The conversations of a partition in order; the first column is the conversation."""
    conv, rows = None, []
    for batch in batches:
        convs, columns = batch.column(0).to_pylist(), [c.to_pylist() for c in batch.columns[1:]]
        for here, row in zip(convs, zip(*columns)):
            if rows and here != conv:
                yield _part(conv, rows)
                rows = []
            conv = here
            rows.append(row)
    if rows:
        yield _part(conv, rows)


@dataclass
class Seam:
    """What a part of a conversation that reaches over several partitions must know of the others."""

    leave: list[int]
    last: bool
    state: int = START
    role: int | None = None
    turn: object = None


def _ends(numbered: Iterable[Part]) -> Iterator[tuple[int, Part]]:
    """The first (0) and the last (1) of the parts of a partition."""
    held = None
    for n, part in enumerate(numbered):
        if n == 0:
            yield 0, part
        else:
            held = part
    if held is not None:
        yield 1, held


def seams(rows: DataFrame) -> dict[tuple[int, int], Seam]:
    """By partition and end (0 its first conversation, 1 its last one), for conversations that reach over partitions.

    Brought to the driver are the first and last parts of each partition, a few numbers each.
    """
    narrow = rows.select("conv", "turn", "copies", "symbol", "mark")
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["part", "end", "conv", "costs", "turn", "until", "role", "final"]
    types = [pa.int32(), pa.int32(), _arrow_type(rows), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        for end, part in _ends(_parts(batches)):
            if not part.roles:  # a mark alone; its row is in the next partition
                raise ValueError("a mark and its row came apart")
            flat = [x for row in through(part.symbols) for x in row]
            row = (here, end, part.conv, flat, part.turns[0], part.turns[-1], part.roles[0], part.roles[-1])
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

    found = narrow.mapInArrow(measured, f"part int, end int, conv {kind}, costs array<int>, turn long, until long, role int, final int").collect()
    found.sort(key=lambda r: (r.part, r.end))
    runs: list[list] = []
    for row in found:
        if runs and runs[-1][-1].conv == row.conv:
            runs[-1].append(row)
        else:
            runs.append([row])
    out: dict[tuple[int, int], Seam] = {}
    for run in (r for r in runs if len(r) > 1):
        leave = list(AT_END)
        for n, row in reversed(list(enumerate(run))):
            prior = run[n - 1] if n else None
            out[row.part, row.end] = Seam(leave, n == len(run) - 1, START, prior and prior.final, prior and prior.until)
            leave = before([row.costs[k : k + 4] for k in range(0, 16, 4)], leave)
    if not out:
        return out

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        if (here, 0) not in out and (here, 1) not in out:
            return
        for end, part in _ends(_parts(batches)):
            if seam := out.get((here, end)):
                then = [edits(part.symbols, seam.leave, state, seam.last)[2] for state in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([end], pa.int32()), pa.array([then], pa.list_(pa.int32()))], ["part", "end", "then"])

    leads = {(r.part, r.end): r.then for r in narrow.mapInArrow(entered, "part int, end int, then array<int>").collect()}
    for run in (r for r in runs if len(r) > 1):
        state = START
        for row in run:
            out[row.part, row.end].state = state
            state = leads[row.part, row.end][state]
    return out


def _arrow_type(rows: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema["conv"].dataType)


def _with_seams(known: dict[tuple[int, int], Seam]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[tuple[Part, Seam | None]]]:
    """The parts of a partition, each with its seam if it has one."""

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Part, Seam | None]]:
        here, held = TaskContext.get().partitionId(), None
        first = True
        for part in _parts(batches):
            if held is not None:
                yield held, known.get((here, 0)) if first else None
                first = False
            held = part
        if held is not None:
            yield held, known.get((here, 0 if first else 1))

    return parts


def _audit(part: Part, seam: Seam | None) -> tuple[str, int]:
    return cheapest(part.symbols) if seam is None else edits(part.symbols, seam.leave, seam.state, seam.last)[:2]


def _repaired(part: Part, audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each edit in order; the payload of ``part`` is role and text."""
    row = left = 0
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield edit, ROLES[state - 2], ""
            continue
        left = left or part.copies[row]
        role, text = part.payload[row]
        if edit == "R":
            state = NEXT[state]
            role = ROLES[state - 2]
        elif edit == "K":
            state = KEEP[part.roles[row]][state]
        yield edit, role, text
        left -= 1
        row += not left


def _line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode("utf-8", "replace")


def turns(rows: DataFrame, known: dict[tuple[int, int], Seam], reaching: bool = False) -> DataFrame:
    """The edits of every conversation of ``ordered`` rows: conv, place (a number that grows along it), edit, role, text.

    What stays is every edit but ``D``. ``reaching``: only of conversations that reach over partitions.
    """
    kind, parts, conv_type = rows.schema["conv"].dataType.simpleString(), _with_seams(known), _arrow_type(rows)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*held), (conv_type, pa.int64(), pa.string(), pa.string(), pa.string()))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv", "place", "edit", "role", "text"])

        for part, seam in parts(batches):
            if reaching and seam is None:
                continue
            for edit, role, text in _repaired(part, _audit(part, seam)[0], seam.state if seam else START):
                held.append((part.conv, at, edit, role, text))
                at += 1
                if len(held) >= 4096:
                    yield batch()
        if held:
            yield batch()

    return rows.select("conv", "turn", "copies", "symbol", "mark", "role", "text").mapInArrow(told, f"conv {kind}, place long, edit string, role string, text string")


def turn_digests(turns_of: DataFrame) -> DataFrame:
    """conv and the SHA-256 of what stays of it (``role:text``, newlines between); turns stream by, one is held."""
    kind, conv_type = turns_of.schema["conv"].dataType.simpleString(), _arrow_type(turns_of)
    line = turns_of.where("edit != 'D'").select("conv", "place", F.concat("role", F.lit(":"), "text").alias("line"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], conv_type), pa.array([sha.hexdigest()], pa.string())], ["conv", "sha"])

        for rows in batches:
            for here, text in zip(rows.column(0).to_pylist(), rows.column(2)):
                data = text.as_py().encode("utf-8", "replace")
                if sha is None or here != conv:
                    if sha is not None:
                        yield batch()
                    conv, sha = here, hashlib.sha256(data)
                else:
                    sha.update(b"\n" + data)
        if sha is not None:
            yield batch()

    return line.repartition("conv").sortWithinPartitions("conv", "place").mapInArrow(digests, f"conv {kind}, sha string")


def summaries(rows: DataFrame, known: dict[tuple[int, int], Seam]) -> DataFrame:
    """A row for each conversation of ``ordered`` rows and partition: counts, cost, audit and, if it is whole, its digest."""
    kind, parts, conv_type = rows.schema["conv"].dataType.simpleString(), _with_seams(known), _arrow_type(rows)
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "least", "most", "numbers", "part"]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = TaskContext.get().partitionId(), []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(x, t) for x, t in zip(zip(*held), [conv_type, *[pa.int64()] * len(names), pa.string(), pa.string()])]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv", *names, "audit", "sha"])

        for part, seam in parts(batches):
            audit, cost = _audit(part, seam)
            numbers = [t for t in part.turns if t is not None]
            illegal, distinct, sha = part.illegal(), part.distinct(), None
            if seam is None:
                stays = (_line(role, text) for edit, role, text in _repaired(part, audit, START) if edit != "D")
                digest = hashlib.sha256(next(stays, b""))
                for data in stays:
                    digest.update(b"\n" + data)
                sha = digest.hexdigest()
            elif seam.role is not None:
                illegal += (seam.role, part.roles[0]) not in ((0, 1), (1, 2), (2, 1))
                distinct -= seam.turn is not None and part.turns[0] == seam.turn
            held.append((part.conv, *part.counts, illegal, cost, min(numbers, default=None), max(numbers, default=None), distinct, here, audit, sha))
            if len(held) >= 4096:
                yield batch()
        if held:
            yield batch()

    schema = f"conv {kind}, {', '.join(f'{n} long' for n in names)}, audit string, sha string"
    return rows.select("conv", "turn", "copies", "symbol", "mark", "role", "text").mapInArrow(summed, schema)


def repair(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """One row a conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows``: conv, turn, role, text, copies, as ``damage`` and ``unspoilt`` give them. ``of`` (conv): conversations that
    have a row in the result even if none of their rows is left.
    """
    kind = rows.schema["conv"].dataType
    rows = ordered(rows)
    known = seams(rows)
    found = checkpoint(summaries(rows, known))
    if of is not None:
        found = found.unionByName(of.select(F.col("conv").cast(kind)).distinct(), allowMissingColumns=True)
    if known:
        found = found.unionByName(turn_digests(turns(rows, known, reaching=True)), allowMissingColumns=True)
    total = lambda name: F.coalesce(F.sum(name), F.lit(0).cast("long"))
    gaps = F.coalesce(F.max("most") - F.min("least") + 1 - F.sum("numbers"), F.lit(0).cast("long"))
    audits = F.array_sort(F.collect_list(F.when(F.col("audit").isNotNull(), F.struct("part", "audit"))))  # one of each partition
    return found.groupBy("conv").agg(
        gaps.alias("gaps"),
        *(total(name).alias(name) for name in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.array_join(F.transform(audits, lambda x: x["audit"]), "").alias("audit"),
        F.coalesce(F.max("sha"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The edits themselves: conv, place, edit, role, text; what is not ``D`` is the repaired conversation."""
    rows = ordered(rows)
    return turns(rows, seams(rows))
