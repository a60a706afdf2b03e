"""Best-fit packing of tokenised documents into sequences of fixed capacity, by hierarchical residual packing.

Each partition packs its own pieces: longest first, each into the fullest sequence that still takes it. Sequences with
at most ``TOLERANCE`` free tokens are emitted, and those that not even the smallest item fits into; the others become
items of the next round, where partitions are merged (half as many, without a shuffle) and best-fit again. There are
never fewer partitions than ``ITEMS`` each make, so no task gathers an unbounded rest: once that number is reached the
items are dealt anew instead, so that small ones meet large ones of other partitions, for as long as that joins
``WORTH`` of them. Rounds end when one partition did the last merge or nothing is joined; the sequences that are left are
emitted as they are. A round holds lengths and places of pieces, never tokens.

Defined cases: a null text is empty and makes one piece, the end token alone. Of a document longer than the capacity
the first piece takes the remainder and the others are full. Repeated rows make pieces of their own. A row with a null
id is packed like any other. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelode.llm import bpe
from filelode.llm.common import checkpoint, give_back

CAPACITY = 2048
END = 0
#: Free tokens with which a sequence counts as nearly full.
TOLERANCE = 4
#: Items that a task of a later round gets at most, on average.
ITEMS = 100_000
#: Share of the items that a round of dealing anew must join for another one.
WORTH = 0.005

MEMBER = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, offset: bigint>"
BIN = f"used int, members array<{MEMBER}>"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only a longer one than the capacity is cut."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", remembered: int = bpe.REMEMBERED
) -> DataFrame:
    """The pieces of each document's ids and ``END``: doc_id, piece, start, length, ids_crc32.

    ``remembered`` words are kept by a worker; fewer than the encoder's own number are forgotten after each task, with the
    encoder, for jobs whose other stages need the memory.
    """

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        model.remembered = remembered
        for batch in batches:
            rows, n, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(model.encode_batch(t.as_py() for t in batch.column(1))):
                ids = np.append(ids, np.uint32(END)).astype("<u4")
                for k, (at, size) in enumerate(cut(len(ids), capacity)):
                    rows.append(row)
                    n.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[at : at + size]))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])
        if remembered < bpe.REMEMBERED:
            del model
            bpe.load.cache_clear()
            give_back()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(tokenised, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Groups of places in ``sizes``: longest first, each to the fullest open group with room.

    Open groups are stacked by free room; the bits of one integer tell which stacks hold any, so that the next fitting
    room is one shift away.
    """
    groups: list[list[int]] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        room = some >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            g = open_at[free].pop()
            if not open_at[free]:
                some ^= 1 << free
            groups[g].append(i)
            free -= size
        else:
            g, free = len(groups), capacity - size
            groups.append([i])
        if free:
            open_at[free].append(g)
            some |= 1 << free
    return groups


def _round(bins: DataFrame, capacity: int) -> DataFrame:
    """Best fit of the bins of each partition as items."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        used = table.column(0).to_numpy()
        lists = table.column(1).combine_chunks() if table.column(1).num_chunks != 1 else table.column(1).chunk(0)
        starts = lists.offsets.to_numpy()
        flat = lists.values
        groups = best_fit(used, capacity)
        takes, shifts, sizes, totals = [], [], [], []
        for group in groups:
            at = 0
            count = 0
            for i in group:
                span = np.arange(starts[i], starts[i + 1])
                takes.append(span)
                shifts.append(np.full(len(span), at))
                at += int(used[i])
                count += len(span)
            sizes.append(count)
            totals.append(at)
        members = flat.take(pa.array(np.concatenate(takes)))
        fields = {f.name: members.field(f.name) for f in members.type}
        fields["offset"] = pa.array(fields["offset"].to_numpy() + np.concatenate(shifts), pa.int64())
        merged = pa.StructArray.from_arrays(list(fields.values()), fields=list(members.type))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        out = pa.ListArray.from_arrays(ends, merged)
        step = 20_000
        for k in range(0, len(groups), step):
            yield pa.RecordBatch.from_arrays([pa.array(totals[k : k + step], pa.int32()), out.slice(k, step)], ["used", "members"])

    return bins.mapInArrow(packed, BIN)


def pack(found: DataFrame, capacity: int = CAPACITY, tolerance: int = TOLERANCE, items: int = ITEMS) -> DataFrame:
    """``found`` (as ``pieces`` gives it) with ``sequence_id`` and ``offset``: sequences are gapless from 0."""
    found = checkpoint(found)  # else each task has two Python workers, and both come to hold an encoder
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("offset"))
    bins = checkpoint(_round(found.select(F.col("length").cast("int").alias("used"), F.array(member).alias("members")), capacity))
    done, rest = [bins.where(F.col("used") >= capacity - tolerance)], bins.where(F.col("used") < capacity - tolerance)
    left, least, parts = *rest.agg(F.count(F.lit(1)), F.min("used")).first(), rest.rdd.getNumPartitions()
    while left > 1 and parts > 1:
        fewest = math.ceil(left / items)
        dealt = parts <= fewest
        parts = max(parts // 2, fewest)
        full = (F.col("used") >= capacity - tolerance) | (F.col("used") + least > capacity)
        done.append(rest.where(full))
        rest = rest.where(~full)
        merged = checkpoint(_round(rest.repartition(parts) if dealt else rest.coalesce(parts), capacity))
        before = rest.count()
        rest = merged
        now, least = rest.agg(F.count(F.lit(1)), F.min("used")).first()
        if before - now <= (WORTH * before if dealt else 0):
            break
        left = now
    for more in done:
        rest = rest.unionByName(more)
    numbered = rest.withColumn("sequence_id", F.monotonically_increasing_id())
    return numbered.select("sequence_id", F.explode("members").alias("m")).select(
        "m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset"
    )


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", remembered: int = bpe.REMEMBERED
) -> DataFrame:
    """Tokenise and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path, capacity, id_col, text_col, remembered), capacity).withColumnRenamed("doc_id", id_col)
