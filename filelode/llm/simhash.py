"""SimHash near-dedup: fingerprints joined through deletion-variant signatures.

A fingerprint has 64 bits and two of them link at ``MAX_BITS`` = 3 or fewer differing bits. Cut into two halves, one
half then differs by at most one bit. So each half is indexed under its 32 one-wildcard variants (one bit cleared, its
place part of the key): two linked fingerprints always share a key, and an equality join on keys finds them all.

Most keys hold one fingerprint. A count per key, aggregated before the shuffle, settles those and the keys of two. Keys
of up to ``GROUP`` fingerprints are verified together, in one small array. Beyond that a key is refined: what it shares
is fixed, so the other half differs by at most three bits and is cut and indexed the same way, then once more. After the
last cut 11 bits are free, so no group exceeds 2048 fingerprints, whatever the data. Verified groups yield a spanning
star for each of their parts, never all pairs, and components follow from those links.

Defined cases: a null or blank text has fingerprint zero and links like any other; fewer than three words make one
shingle; equal fingerprints are one node. Rows with a null id get the fingerprint and component of their text's class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelode.llm.common import attach_groups, checkpoint, give_back
from filelode.llm.graph import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Fingerprints verified together in one task; larger keys are refined. The last refinement leaves 2**11 at most.
GROUP = 1024
#: Bits of a segment at each cut.
WIDTHS = (32, 16, 8)
#: Shingles hashed at a time, so that a very long text needs no more memory.
CHUNK = 1 << 18


def fingerprint(text: bytes | None, words_in_shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text, unsigned."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n, counts = max(1, len(words) - words_in_shingle + 1), np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + words_in_shingle - 1]
        shingles = zip(*(part[i:] for i in range(words_in_shingle))) if n > 1 or len(words) == words_in_shingle else [part]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with ``fp`` as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.array([fingerprint(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])
        give_back()

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(hashed, "doc_id long, fp long")


def _variants(rows: DataFrame, level: int) -> DataFrame:
    """Each row under the one-wildcard variants of its two segments at this cut, in a new key column ``k<level>``.

    ``base`` is the first bit of the part that isn't fixed yet; afterwards it is that of the segment not used.
    """
    width = WIDTHS[level]
    lower = f"(j div {width})"
    value = f"(shiftrightunsigned(fp, cast(base + {width} * {lower} as int)) & {(1 << width) - 1}L)"
    return (
        rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))))
        .withColumn(f"k{level}", F.expr(f"shiftleft(cast(j as bigint), 33) | ({value} & ~shiftleft(1L, cast(j % {width} as int)))"))
        .withColumn("base", F.expr(f"cast(base + {width} * (1 - {lower}) as int)"))
        .drop("j")
    )


def _stars(groups: DataFrame, max_bits: int) -> DataFrame:
    """Links from the members of each group's connected parts to the part's smallest node."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for members in batch.column(0):
                flat = members.values.flatten()
                fp, node = (x.to_numpy(zero_copy_only=False) for x in flat)
                order = np.argsort(node)
                fp, node = fp[order].view(np.uint64), node[order]
                near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= max_bits
                part = np.arange(len(node))
                while True:
                    least = np.where(near, part[None, :], len(node)).min(axis=1)
                    if (least == part).all():
                        break
                    part = least
                linked = part != np.arange(len(node))
                us.append(node[linked])
                vs.append(node[part[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return groups.select("members").mapInArrow(parts, "u long, v long")


def links(nodes: DataFrame, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """``(u, v)`` links that connect exactly what fingerprints at ``max_bits`` or fewer bits connect.

    ``nodes`` has ``(node, fp)``, one row per distinct fingerprint.
    """
    if max_bits > 3:
        raise ValueError("two segments differ by at most one bit only up to three differing bits")
    spread = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # 64 keys a row: not for the few tasks that hold the rows
    rows, keys, found = nodes.repartition(spread, "node").select("node", "fp", F.lit(0).alias("base")), [], None
    for level in range(len(WIDTHS)):
        rows, keys = _variants(rows, level), [*keys, f"k{level}"]
        ends = [F.min("fp").alias("a"), F.max("fp").alias("b"), F.min_by("node", "fp").alias("u"), F.max_by("node", "fp").alias("v")]
        sizes = checkpoint(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ends).where("n > 1"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
        pairs = sizes.where((F.col("n") == 2) & near).select("u", "v")
        last = level == len(WIDTHS) - 1
        small = sizes.where(F.col("n") > 2) if last else sizes.where((F.col("n") > 2) & (F.col("n") <= group))
        # by sort and merge at every size: the keys' number grows with the rows, a broadcast would only fit small inputs
        groups = rows.join(small.select(*keys).hint("merge"), keys, "left_semi").groupBy(*keys).agg(F.collect_list(F.struct("fp", "node")).alias("members"))
        level_links = pairs.unionByName(_stars(groups, max_bits)).distinct()
        found = level_links if found is None else found.unionByName(level_links)
        large = sizes.where(F.col("n") > group).select(*keys)
        if last or large.isEmpty():
            return found
        rows = checkpoint(rows.join(large, keys, "left_semi"))
    return found


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` (signed long) and ``component_id``, the smallest id reachable by links."""
    rows = checkpoint(fingerprints(docs, id_col, text_col))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")))
    linked = connected_components(links(nodes.where("node IS NOT NULL"), max_bits))
    classes = nodes.join(linked, "node", "left").select("fp", "n", F.coalesce("component", "node").alias("component_id"))
    return attach_groups(rows, classes, "fp", "n", rows.count()).select(F.col("doc_id").alias(id_col), "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
