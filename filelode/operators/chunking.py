"""How the chunks of a long list follow from one another when the list is dealt to many tasks.

A chunk takes items while there is room. What a stretch of items does to the chunk that is open before it depends on one
number, the bytes held: either all of it still fits, or a new chunk begins at the first item that doesn't, and from there on
all chunks of the stretch are given. So a stretch is a map of few pieces from bytes held to bytes held and new chunks. The
chunk that begins after each item is found by a range search over the sums, the last chunk of the stretch from each item on by
pointer doubling. Maps of neighbouring stretches are composed in groups, in tasks; the driver follows one number through the
groups, and each group then through its stretches.

Bytes held count a comma after each item, so an item of ``size`` bytes takes ``size + 1`` of ``most + 1``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelode.sources.shared import checkpointed

MAP = "reach long, shift long, at array<long>, held array<long>, more array<long>"


@dataclass
class Stretch:
    """Up to ``reach`` bytes held, all still fits and ``shift`` bytes are added (-1: never). Above, the piece counts whose
    upper end ``at`` (ascending) is the first at or over the bytes held: then ``held`` bytes are held and ``more`` chunks were begun."""

    reach: int
    shift: int
    at: np.ndarray
    held: np.ndarray
    more: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray, room: int, later: int) -> "Stretch":
        sums = np.concatenate([[0], np.cumsum(sizes + 1)])
        n = len(sizes)
        if n and later + int(sizes.max()) + 1 > room:
            raise ValueError(f"an item takes {int(sizes.max())} bytes")
        # a chunk that begins with item j (from 0) ends before the first item up to whose end there is more than its room
        then = np.append(np.searchsorted(sums, room - later + sums[:n], side="right") - 1, n)
        count, last = np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
        jump = then.copy()
        while (jump[:n] < n).any():  # pointer doubling: chunks begun from each item on, and the first item of the last one
            count = count + count[jump]
            last = np.where(jump < n, last[np.minimum(jump, n)], last)
            jump = jump[jump]
        first = np.arange(n)[sums[:n] <= room]  # items that can be the first that doesn't fit
        held, more = later + sums[n] - sums[last[first]], count[first]
        return cls(room - int(sums[n]), int(sums[n]), (room - sums[first])[::-1], held[::-1], more[::-1]).short()

    def short(self) -> "Stretch":
        """Neighbouring pieces that give the same are one."""
        if len(self.at):
            kept = np.append((self.held[1:] != self.held[:-1]) | (self.more[1:] != self.more[:-1]), True)
            self.at, self.held, self.more = self.at[kept], self.held[kept], self.more[kept]
        return self

    def follow(self, held: int) -> tuple[int, int]:
        """Bytes held after the stretch, and chunks begun in it."""
        if held <= self.reach:
            return held + self.shift, 0
        k = int(np.searchsorted(self.at, held))
        return int(self.held[k]), int(self.more[k])

    def then(self, other: "Stretch") -> "Stretch":
        """The map of this stretch and the one behind it."""
        fits = self.held <= other.reach
        k = np.minimum(np.searchsorted(other.at, self.held), max(len(other.at) - 1, 0))
        held = np.where(fits, self.held + other.shift, other.held[k] if len(other.at) else 0)
        more = self.more + np.where(fits, 0, other.more[k] if len(other.at) else 0)
        reach = min(self.reach, other.reach - self.shift)
        ends = np.minimum(other.at - self.shift, self.reach)
        inside = (ends > reach) & (np.append(-math.inf, ends[:-1]) < self.reach) if len(ends) else np.zeros(0, bool)
        return Stretch(
            reach, self.shift + other.shift, np.concatenate([ends[inside], self.at]), np.concatenate([other.held[inside], held]), np.concatenate([other.more[inside], more])
        ).short()

    def row(self) -> dict:
        return {"reach": self.reach, "shift": self.shift, "at": self.at, "held": self.held, "more": self.more}


def _stretch(row: object) -> Stretch:
    return Stretch(int(row.reach), int(row.shift), *(np.array(x, np.int64) for x in (row.at, row.held, row.more)))


def _runs(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, np.ndarray]]:
    """Keys of a partition with their sizes, in order."""
    now, held = None, []
    for batch in batches:
        keys, sizes = batch[key].to_numpy(), batch["size"].to_numpy()
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else []
        for part in np.split(np.arange(len(keys)), edges):
            if held and keys[part[0]] != now:
                yield now, np.concatenate(held)
                held = []
            now = keys[part[0]]
            held.append(sizes[part])
    if held:
        yield now, np.concatenate(held)


def entries(items: DataFrame, key: str, order: list[str], most: int, first: int, later: int) -> tuple[dict[int, tuple[int, int, int]], DataFrame]:
    """The items in order over partitions; and of each partition that begins within a key, the bytes held, chunk and place before it."""
    room = most + 1
    ordered = checkpointed(items.repartitionByRange(key, *order).sortWithinPartitions(key, *order))
    narrow, kind = ordered.select(key, "size"), items.schema[key].dataType.simpleString()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = TaskContext.get().partitionId()
        keys = [b[key].iloc[[0, -1]] for b in batches if len(b)]
        if keys:
            yield pd.DataFrame({"part": [here], "begin": [keys[0].iloc[0]], "end": [keys[-1].iloc[-1]]})

    found = sorted(narrow.mapInPandas(ends, f"part int, begin {kind}, end {kind}").collect())  # a row a partition
    begun: dict[int, int] = {}  # partition to the one that its first key begins in
    for before, after in zip(found, found[1:]):
        if before.end == after.begin:
            begun[after.part] = begun.get(before.part, before.part) if before.begin == before.end else before.part
    if not begun:
        return {}, ordered
    starts = set(begun.values())

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = TaskContext.get().partitionId()
        if here not in begun and here not in starts:
            return
        rows, sizes = [], None
        for n, (_, sizes) in enumerate(_runs(batches, key)):
            if n == 0 and here in begun:
                rows.append({"part": here, "run": begun[here], "n": len(sizes)} | Stretch.of(sizes, room, later).row())
        if sizes is not None and here in starts:  # its last key goes on in the next partition
            rows.append({"part": here, "run": here, "n": len(sizes)} | Stretch.of(sizes, room, later).row())
        yield pd.DataFrame(rows, columns=["part", "run", "n", "reach", "shift", "at", "held", "more"])

    maps = checkpointed(narrow.mapInPandas(mapped, f"part int, run int, n long, {MAP}"))
    size = max(1, math.isqrt(len(begun)))  # stretches of a group
    places = {run: sorted({run, *(p for p, r in begun.items() if r == run)}) for run in starts}
    group = {(run, part): k // size for run, parts in places.items() for k, part in enumerate(parts)}
    dealt = maps.join(
        F.broadcast(items.sparkSession.createDataFrame([(run, part, g) for (run, part), g in group.items()], "run int, part int, g int")), ["run", "part"]
    )  # a row a partition at most, twice

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = list(rows.sort_values("part").itertuples())
        whole = _stretch(rows[0])
        for row in rows[1:]:
            whole = whole.then(_stretch(row))
        return pd.DataFrame([{"run": rows[0].run, "g": rows[0].g, "n": sum(r.n for r in rows)} | whole.row()])

    groups = sorted(dealt.groupBy("run", "g").applyInPandas(composed, f"run int, g int, n long, {MAP}").collect(), key=lambda r: (r.run, r.g))
    into: dict[tuple[int, int], tuple[int, int, int]] = {}
    state = (first, 0, 0)
    for row in groups:
        state = (first, 0, 0) if row.g == 0 else state
        into[row.run, row.g] = state
        held, more = _stretch(row).follow(state[0])
        state = held, state[1] + more, state[2] + row.n

    def followed(rows: pd.DataFrame) -> pd.DataFrame:
        held, chunk, place = into[int(rows["run"].iloc[0]), int(rows["g"].iloc[0])]
        out = []
        for row in rows.sort_values("part").itertuples():
            out.append((row.part, row.run, held, chunk, place))
            held, more = _stretch(row).follow(held)
            chunk, place = chunk + more, place + row.n
        return pd.DataFrame(out, columns=["part", "run", "held", "chunk", "place"])

    each = dealt.groupBy("run", "g").applyInPandas(followed, "part int, run int, held long, chunk long, place long").collect()
    return {r.part: (r.held, r.chunk, r.place) for r in each if begun.get(r.part) == r.run}, ordered
