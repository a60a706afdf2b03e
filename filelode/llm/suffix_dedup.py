"""Exact repeated byte strings by suffix arrays of shards that share content.

Every string of ``LENGTH`` bytes has a minimiser, its ``K`` bytes of least hash (the leftmost of equals), and a context:
``HALF`` bytes before the minimiser if the string holds as many, else ``HALF`` bytes behind it, which it then does. Equal
strings have equal minimisers and contexts, so a text falls into stretches of strings that share one context, and a
string can only repeat among the stretches with the same context hash. Contexts that occur once are settled by a count;
equal stretches are one with a count, and repeat as a whole. What is left, different stretches of one context, is
gathered by context into shards of bounded size, and a shard's suffix array and permuted common prefixes tell which
strings start more than once. No stretch is longer than about two strings.

Text of a period of up to ``PERIOD`` bytes that is longer than a string and a period (one letter repeated, padding, a
repeated line) would have a stretch a period. All its strings repeat inside it, which is known at sight; only those of its
first period are looked for elsewhere.

The stretches of a context of more than ``GROUP`` different ones (a passage that very many documents embed) are cut into
blocks of strings, whose context is all that the strings of a block share, and go the same way; blocks that are still too
many, string by string, where equal ones are told by a count with partial aggregates that no number of them can stall.

Defined cases: a null text is empty; a text shorter than ``LENGTH`` loses nothing; rows of one id are separate texts if
their text differs and copies of each other otherwise; rows with a null id count and are returned like others. Where a
removed run ends inside a letter, what is left is no UTF-8: ``text`` is null then, and the digest, which is of the bytes,
as always.
The result reads intermediate files in the checkpoint folder, which stay there until that is cleared.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelode.llm import words
from filelode.llm.common import attach_groups, checkpoint, drop_path, ensure_checkpoint_dir
from filelode.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH = 400
K = 32
#: Context bytes on one side: at least one side of a minimiser has as many in its string.
HALF = (LENGTH - K) // 2
#: Bytes of a period that is looked for; in a longer one no minimiser's window holds a whole period.
PERIOD = LENGTH - K
#: Different stretches of a context that a shard takes.
GROUP = 512
#: Strings of a block, where the stretches of a context are too many: cut finer, then string by string.
BLOCKS = (23, 1)
#: Bytes of a shard.
SHARD = 1 << 18
#: Bytes of text looked at together; longer texts are looked at in parts that overlap, each string in one of them.
BATCH = 1 << 20

STRETCH = "context long, row long, start long, n int, lead int"


def periodic(x: np.ndarray, of: np.ndarray, periods: list[int]) -> list[tuple[int, int, int]]:
    """Maximal (first start, last start, period) of strings that all repeat at a distance of one of the periods."""
    out = []
    for d in periods:
        same = np.zeros(len(x) - d + 2, np.int8)
        same[1:-1] = (x[d:] == x[:-d]) & (of[d:] == of[:-d])
        edges = np.diff(same)
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = end - begin >= LENGTH  # a string and its copy
        out += [(u, v - LENGTH + d, d) for u, v in zip(begin[long].tolist(), end[long].tolist())]
    return out


def stretches(texts: list[bytes]) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int, int]]]:
    """Of the texts: context hash, number of the text, first start of a string, number of starts, bytes to the minimiser;
    and runs of starts that repeat in their own text: number of the text, first and last start."""
    joined = b"".join(texts)
    x = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    n = len(x)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return (none.view(np.uint64), none, none, none, none), []
    powers, inverses = words._power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    grams = words.mixed((sums[K:] - sums[:-K]) * inverses[: n - K + 1])
    bits = max(1, (n - 1).bit_length())
    key = (grams >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64)
    window, width = LENGTH - K + 1, 1
    least = key
    while 2 * width <= window:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < window:
        gap = window - width
        least = np.minimum(least[:-gap], least[gap:])
    at = (least & np.uint64((1 << bits) - 1)).astype(np.int64)  # of each string of the joined texts
    string = np.arange(len(at))
    of = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
    inside = string + LENGTH <= ends[of]
    left = at - string >= HALF
    begins = ends - sizes

    def cut() -> tuple[np.ndarray, ...]:
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (left[1:] != left[:-1]) | ~inside[:-1]
        first = np.flatnonzero(new & inside)
        stop = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
        p = at[first]
        lo = np.where(left[first], p - HALF, p)
        hi = np.where(left[first], p + K, p + K + HALF)
        context = words.mixed((sums[hi] - sums[lo]) * inverses[lo] + left[first].astype(np.uint64))
        return context, of[first], first, stop - first + 1, p - first

    found, runs = cut(), []
    context, text, first, _, lead = found
    periods: set[int] = set()
    for k in (1, 2, 3):  # stretches of a period, one for each side of the minimiser and one for the cut
        near = (context[k:] == context[:-k]) & (text[k:] == text[:-k])
        gap = (first + lead)[k:][near] - (first + lead)[:-k][near]
        periods.update(gap[(gap > 0) & (gap <= PERIOD)].tolist())
    if periods:
        owner = np.repeat(np.arange(len(texts)), sizes)
        for a, b, d in periodic(x, owner, sorted(periods)):
            inside[a + d : b + 1] = False
            runs.append((int(owner[a]), int(a - begins[owner[a]]), int(b - begins[owner[a]])))
        found = cut()
    context, text, first, count, lead = found
    return (context, text, first - begins[text], count, lead), runs


def _stretches(docs: DataFrame) -> DataFrame:
    """All stretches of ``docs`` (``row``, ``data``)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []
        firsts: list[int] = []
        parts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            (context, of, start, n, lead), runs = stretches(parts)
            own = np.array(runs, np.int64).reshape(-1, 3)  # these have no context
            of, base = np.concatenate([of, own[:, 0]]), np.array(firsts, np.int64)
            start = np.concatenate([start, own[:, 1]]) + base[of]
            n, lead = np.concatenate([n, own[:, 2] - own[:, 1] + 1]), np.concatenate([lead, np.zeros(len(own), np.int64)])
            context = pa.array(np.concatenate([context.view(np.int64), own[:, 0]]), mask=np.arange(len(of)) >= len(context))
            columns = [context, pa.array(np.array(rows, np.int64)[of]), pa.array(start), pa.array(n, pa.int32()), pa.array(lead, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["context", "row", "start", "n", "lead"])

        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py() or b""
                for first in range(0, max(1, len(data) - LENGTH + 1), BATCH - LENGTH + 1):
                    rows.append(row)
                    firsts.append(first)
                    parts.append(data[first : first + BATCH])
                    held += len(parts[-1])
                    if held >= BATCH:
                        yield flush()
                        rows, firsts, parts, held = [], [], [], 0
        if parts:
            yield flush()

    return docs.mapInArrow(found, STRETCH)


#: What one pass over the joined texts writes: 0, a text without stretches that matter; 1, another text; 2, a stretch with
#: its bytes.
STAGED = "kind int, id long, row long, context long, digest binary, start long, n int, lead int, payload binary"


def _staged(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts side by side with the stretches asked of them; the only shuffle of all texts."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in STAGED.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0

            def put(*values: object) -> None:
                for column, value in zip(out, values):
                    column.append(value)

            for id_, row, data, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                data = data.as_py()
                put(1 if parts.is_valid else 0, id_, row, None, None, None, len(data), None, data)
                held += len(data)
                flat = parts.values if parts.is_valid else None
                for context, start, n, lead in zip(*(flat.field(c).to_pylist() for c in ("context", "start", "n", "lead"))) if flat is not None else ():
                    if context is None:
                        continue
                    piece = data[start : start + n + LENGTH - 1]
                    held += len(piece)
                    put(2, id_, row, context, xxhash.xxh3_128_digest(piece), start, n, lead, piece)
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
                        out, held = [[] for _ in names], 0
                if held > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
                    out, held = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)

    by_row = wanted.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("context", "start", "n", "lead")).alias("parts"))
    return rows.join(by_row, F.col("row") == F.col("__row"), "left").select("id", "row", "data", "parts").mapInArrow(cut, STAGED)


def repeated_starts(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the starts of strings of ``LENGTH`` bytes that start more than once in the texts."""
    out, sizes = [], [len(t) for t in texts]
    joined = b"\0".join(texts) + b"\0"
    data = np.frombuffer(joined, np.uint8).astype(np.int64) + 2
    ends = np.cumsum(np.array(sizes) + 1) - 1
    data[ends] = 1  # between texts
    order = suffix_array(data, 258)
    shared = permuted_common_prefixes(data, order)[order] >= LENGTH  # with the one before
    both = shared.copy()
    both[:-1] |= shared[1:]
    repeats = np.zeros(len(data), bool)
    repeats[order] = both
    for end, size in zip(ends.tolist(), sizes):
        # a string inside a text never meets a separator, so what it shares lies inside texts too
        out.append(np.flatnonzero(repeats[end - size : end - LENGTH + 1]))
    return out


def _runs(starts: np.ndarray) -> list[dict]:
    """Neighbouring starts as (first, last)."""
    if not len(starts):
        return []
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(starts[np.append(0, cuts + 1)], starts[np.append(cuts, len(starts) - 1)])]


def _shards(texts: DataFrame) -> DataFrame:
    """Runs of repeated starts in each text (``context``, ``digest``, ``bytes``), contexts together in a partition."""

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            runs = [_runs(s) for s in repeated_starts([h[2] for h in held])]
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            return pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary()), pa.array(runs, kind)], ["context", "digest", "runs"]
            )

        for batch in batches:
            for context, digest, data in zip(*(c.to_pylist() for c in batch.columns)):
                if size > SHARD and context != last:
                    yield flush()
                    held, size = [], 0
                held.append((context, digest, data))
                size, last = size + len(data), context
        if held:
            yield flush()

    return texts.select("context", "digest", "bytes").mapInArrow(sorted_out, "context long, digest binary, runs array<struct<a: int, b: int>>")


def _blocks(texts: DataFrame, size: int) -> DataFrame:
    """Stretches (``context``, ``digest``, ``bytes``) cut into such of ``size`` strings, whose context is all that these share."""
    kind = "context long, digest binary, row struct<context: bigint, digest: binary>, start long, n int, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for context, digest, lead, data in zip(*(c.to_pylist() for c in batch.columns)):
                strings, start = len(data) - LENGTH + 1, 0
                while start < strings:
                    first = start - (start - lead) % size  # of the whole block: counted from the minimiser, so alike in all
                    stop = min(strings, first + size)
                    shared = data[first + size - 1 : first + LENGTH]
                    piece = data[start : stop - 1 + LENGTH]
                    values = xxhash.xxh3_64_intdigest(shared), xxhash.xxh3_128_digest(piece), {"context": context, "digest": digest}, start, stop - start, piece
                    for column, value in zip(out, values):
                        column.append(value)
                    start = stop
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(out[0], np.uint64).view(np.int64)), pa.array(out[1], pa.binary()),
                    pa.array(out[2], pa.struct([("context", pa.int64()), ("digest", pa.binary())])),
                    pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32()), pa.array(out[5], pa.binary()),
                ],
                ["context", "digest", "row", "start", "n", "bytes"],
            )

    return texts.select("context", "digest", "lead", "bytes").mapInArrow(cut, kind)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and the ``text`` that is left."""
    spark = docs.sparkSession
    ids = F.col(id_col).cast("long")
    rows = docs.select(ids.alias("id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("data"))
    unclear = docs.groupBy(ids.alias("id")).count().where("count > 1 OR id IS NULL")
    rows = rows.withColumn("row", F.col("id") if unclear.isEmpty() else F.xxhash64("id", "data"))
    place = f"{ensure_checkpoint_dir(spark)}/stretches-{uuid.uuid4().hex}"
    _stretches(rows.where(F.octet_length("data") >= LENGTH).select("row", "data")).write.parquet(f"{place}-all")
    found = spark.read.schema(STRETCH).parquet(f"{place}-all")
    # computed first: only a join of plain shuffles can split the stretches of a context that very many texts have
    often = checkpoint(found.where("context IS NOT NULL").groupBy("context").count().where("count > 1").select("context"))
    own = found.where("context IS NULL")
    wanted = found.join(often, "context", "left_semi").unionByName(own)
    _staged(rows, wanted).write.partitionBy("kind").option("compression", "zstd").parquet(place)
    runs = checkpoint(own.select("row", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1).alias("b")))
    drop_path(spark, f"{place}-all")
    staged = spark.read.schema(STAGED).parquet(place)
    zero = F.lit(0).cast("long")
    plain = staged.where("kind = 0").select(
        "id", F.octet_length("payload").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("payload", 256).alias("kept_sha256"), F.col("payload").cast("string").alias("text")
    )
    pieces = staged.where("kind = 2").select("context", "digest", "row", "start", "n", "lead", F.col("payload").alias("bytes"))
    found = checkpoint(spans(pieces, runs).withColumnRenamed("row", "__row"))
    others = staged.where("kind = 1").select("id", "row", F.col("payload").alias("data"))
    touched = _kept(others.join(found, F.col("row") == F.col("__row"), "left").select("id", "data", "spans"))
    return plain.unionByName(touched).withColumnRenamed("id", id_col)


def spans(pieces: DataFrame, runs: DataFrame) -> DataFrame:
    """``(row, spans)`` of the rows that have bytes to remove; a span is (first, last start). ``runs`` are known ones."""
    return _marks(pieces, 0).unionByName(runs).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _marks(pieces: DataFrame, level: int) -> DataFrame:
    """``(row, a, b)``: runs of starts of repeated strings, of stretches ``(context, digest, lead, row, start, n, bytes)``.

    ``lead`` tells how far before the minimiser a stretch starts, so that all stretches of a context are cut alike.
    """
    keys = ["context", "digest"]
    distinct = checkpoint(pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")))
    sizes = distinct.groupBy("context").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("fewest"))
    kinds = checkpoint(attach_groups(distinct, sizes, "context", "kinds", distinct.count()))
    whole = kinds.where("copies > 1").select(*keys)
    mixed = kinds.where("kinds > 1 AND fewest = 1")  # else all repeat as a whole
    places = pieces.select(*keys, "row", "start", "n")
    marks = places.join(whole, keys).select("row", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1).alias("b"))
    if not mixed.isEmpty():
        one = pieces.groupBy(*keys).agg(F.first("bytes").alias("bytes"), F.first("lead").alias("lead"))
        texts_of = one.join(mixed.select(*keys, "kinds"), keys)
        n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        partly = _shards(texts_of.where(F.col("kinds") <= GROUP).repartition(n, "context").sortWithinPartitions(*keys))
        if level < len(BLOCKS) and not mixed.where(F.col("kinds") > GROUP).isEmpty():
            finer = checkpoint(_blocks(texts_of.where(F.col("kinds") > GROUP), BLOCKS[level]).withColumn("lead", F.lit(0)))
            inner = _marks(finer, level + 1).groupBy("row").agg(F.collect_list(F.struct(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"))).alias("runs"))
            partly = partly.unionByName(inner.select("row.context", "row.digest", "runs"))
        partly = partly.where("size(runs) > 0").join(whole, keys, "left_anti")
        found = places.join(partly, keys).select("row", "start", F.explode("runs").alias("r"))
        marks = marks.unionByName(found.select("row", (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b")))
    return marks


def _kept(rows: DataFrame) -> DataFrame:
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for data, found in zip(batch.column(1), batch.column(2)):
                data = data.as_py()
                gone, n_spans, at, kept = 0, 0, 0, []
                if found.is_valid:
                    end = -1
                    for a, b in sorted((s["a"], s["b"] + LENGTH) for s in found.as_py()):
                        if a > end:  # spans that touch are one run
                            n_spans += 1
                            kept.append(data[at:a])
                        gone += max(0, b - max(a, end, 0))
                        end = max(end, b)
                        at = end
                kept.append(data[at:])
                whole = b"".join(kept)
                try:
                    left = whole.decode("utf-8")
                except UnicodeDecodeError:
                    left = None
                for column, value in zip(out, (len(data), gone, n_spans, hashlib.sha256(whole).hexdigest(), left)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return rows.mapInArrow(removed, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
