"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids is linked.

A transducer reads both token rows. Its state is which side leads and the bytes of its last token that the other side
hasn't matched yet; the other side's next token shortens them, or takes the lead with what is left of itself. Transitions
are remembered by state and token. With nothing left over, a group closes. Each token that is read against a residual is
linked to the token that the residual is of, so a group of m and n tokens has m + n - 1 links.

Both tokenizers cut texts at single spaces, so a text without odd white space is aligned word by word and each distinct
word once; any other text goes through the transducer in one piece.

The links of each pair of ids are counted over all documents by partial aggregates. What a document needs of the counts
comes back in two ways: a pair with more than a ``HEAVY``-th of all links (there are fewer than ``HEAVY`` such, by
counting) is broadcast, every other one is joined by its key, none of which is hot then.

Defined cases: a null or empty text, and one whose tokens don't spell a space and the text (a literal U+2581 is read as a
space by the second tokenizer), has no tokens, no links and empty groups. Repeated rows each count. A null id stays null.
An empty table gives no rows. Only the id and text columns are read, whatever else the table has.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filelode.llm import bpe, sentence_pieces
from filelode.llm.common import checkpoint, drop_path, ensure_checkpoint_dir, give_back

#: A pair of ids with more than this share of all links is broadcast.
HEAVY = 200_000
#: Words, and transitions, remembered by a worker.
REMEMBERED = 450_000
TRANSITIONS = 1 << 20
#: Characters whose words are held at a time.
AT_ONCE = 1 << 20
FIRST, SECOND = 0, 1


class Transducer:
    """Aligns rows of token ids of two vocabularies, given the bytes of each token."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.raw = first, second
        self.size = len(second)
        self.width = max(len(first), len(second))
        self.told = [str(i) for i in range(self.width)]
        self.states: list[tuple[int, bytes]] = [(FIRST, b"")]
        self.first_leads = [True]
        self.number: dict[tuple[int, bytes], int] = {}
        self.begun: dict[int, int] = {}
        self.moves: dict[int, int] = {}

    def _state(self, leader: int, residual: bytes) -> int:
        """Number of a state; 0 without residual."""
        if not residual:
            return 0
        found = self.number.setdefault((leader, residual), len(self.states))
        if found == len(self.states):
            self.states.append((leader, residual))
            self.first_leads.append(leader == FIRST)
        return found

    def _begin(self, token: int) -> int:
        found = self.begun[token] = self._state(FIRST, self.raw[FIRST][token])
        return found

    def _move(self, state: int, token: int) -> int:
        """The state after the side that lags reads a token; -1 if the bytes differ."""
        if len(self.moves) > TRANSITIONS:
            self.moves.clear()
        leader, residual = self.states[state]
        data = self.raw[1 - leader][token]
        if residual.startswith(data):
            then = self._state(leader, residual[len(data) :])
        elif data.startswith(residual):
            then = self._state(1 - leader, data[len(residual) :])
        else:
            then = -1
        self.moves[state * self.width + token] = then
        return then

    def align(self, first: list[int], second: list[int]) -> tuple[list[str], list[int]] | None:
        """Groups (``a1,a2|b1``) and links (first id times the size of the second vocabulary, plus second id) in order.

        None where the bytes differ, or where a token without bytes could stand anywhere.
        """
        groups, links = [], []
        moves, begun, leads, told, size, width = self.moves, self.begun, self.first_leads, self.told, self.size, self.width
        state = i = j = 0
        n, m = len(first), len(second)
        while i < n or j < m or state:
            if not state:
                if i == n:
                    return None
                x = first[i]
                i += 1
                state = begun.get(x) or self._begin(x)
                if not state:
                    return None
                mine, other = told[x], ""
                continue
            if leads[state]:
                if j == m:
                    return None
                token = y = second[j]
                j += 1
                other = f"{other},{told[y]}" if other else told[y]
            else:
                if i == n:
                    return None
                token = x = first[i]
                i += 1
                mine = f"{mine},{told[x]}"
            links.append(x * size + y)
            then = moves.get(state * width + token)
            state = self._move(state, token) if then is None else then
            if state < 0:
                return None
            if not state:
                groups.append(f"{mine}|{other}")
        return groups, links


class Aligner:
    """Both encoders, the transducer, and the words that were aligned before."""

    def __init__(self, first: str, second: str):
        self.a = bpe.Bpe(first)
        self.a.split_added = None  # strings of special tokens in a text are text
        self.b = sentence_pieces.load(second)
        if not (self.a.byte_decoder and self.b.by_word and self.b.prefix and self.b.escape and not self.b.squeeze and not self.b.map.units):
            raise ValueError("aligned are a byte-level vocabulary and pieces with a space before the text and no other normalising")
        self.transducer = Transducer(self.a.raw, self.b.raw)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes, self.keys, self.ends = array("i"), array("q"), array("q", [0])  # three numbers a word; all links, and where each word's end
        self.wrong: set[int] = set()

    def _spelled(self, ids: list[int]) -> bytes:
        return b"".join(map(self.a.raw.__getitem__, ids))

    def learn(self, words: Iterable[str]) -> None:
        """Align words that aren't known, each after a space."""
        new = [w for w in words if w not in self.index]
        self.a.learn_chunks(new)
        first = [memoryview(self.a.chunks[w]).cast("I").tolist() for w in new]
        lossless = self._spelled([i for ids in first for i in ids]) == "".join([" " + w for w in new]).encode("utf-8", "replace")
        align, none = self.transducer.align, ([], [])
        for word, a, b in zip(new, first, self.b.merged([sentence_pieces.SPACE + w for w in new])):
            b = memoryview(b).cast("I").tolist()
            found = align(a, b) if lossless or self._spelled(a) == f" {word}".encode("utf-8", "replace") else None
            if found is None:
                self.wrong.add(len(self.groups))
            groups, links = found or none
            self.index[word] = len(self.groups)
            self.groups.append(";".join(groups))
            self.sizes.extend((len(a), len(b), len(groups)))
            self.keys.extend(links)
            self.ends.append(len(self.keys))
        self.a.chunks.clear()
        if len(self.a.known) > REMEMBERED:
            self.a.known.clear()

    def words(self, text: str) -> list[str] | None:
        """The words of a text at whose spaces both encoders cut, or None."""
        if "  " in text or text.startswith(" ") or text.endswith(" ") or sentence_pieces.SPACE in text or bpe.ODD_SPACE.search(text):
            return None
        found = self.a.normalized(text)
        return found.split(" ") if found == text else None

    def _whole(self, text: str) -> tuple[str, tuple[int, int, int], np.ndarray, np.ndarray] | None:
        a = next(iter(self.a.encode_batch([" " + text]))).tolist()
        b = next(iter(self.b.encode_batch([text]))).tolist()
        for cache in (self.a.chunks, self.b.words, self.b.others):
            if len(cache) > REMEMBERED:
                cache.clear()
        if self._spelled(a) != f" {text}".encode("utf-8", "replace") or (found := self.transducer.align(a, b)) is None:
            return None
        return ";".join(found[0]), (len(a), len(b), len(found[0])), *np.unique(np.array(found[1], np.int64), return_counts=True)

    def _joined(self, words: list[str]) -> tuple[str, tuple[int, int, int], np.ndarray, np.ndarray] | None:
        own = list(map(self.index.__getitem__, words))
        at, often = np.unique(np.array(own, np.int64), return_counts=True)
        if self.wrong and not self.wrong.isdisjoint(at.tolist()):
            return None
        sizes = np.frombuffer(self.sizes, np.int32).reshape(-1, 3)[at]
        ends = np.frombuffer(self.ends, np.int64)
        begins, lengths = ends[at], ends[at + 1] - ends[at]
        places = np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        keys, inverse = np.unique(np.frombuffer(self.keys, np.int64)[places], return_inverse=True)
        counts = np.bincount(inverse, np.repeat(often, lengths), len(keys)).astype(np.int64)  # exact: far below 2 ** 53
        return ";".join(map(self.groups.__getitem__, own)), tuple((sizes * often[:, None]).sum(axis=0).tolist()), keys, counts

    def align_batch(self, texts: Iterable[str | None]) -> Iterator[tuple[str, tuple[int, int, int], np.ndarray, np.ndarray]]:
        """For each text: groups as text, numbers of tokens of each side and of groups, keys of its linked pairs, links of each."""
        none = "", (0, 0, 0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, waiting = 0, []

        def flush() -> Iterator[tuple]:
            if len(self.index) > REMEMBERED:
                self.forget()
            self.learn({w for _, words in waiting for w in words or ()})
            for text, words in waiting:
                if not text:
                    yield none
                else:
                    yield (self._whole(text) if words is None else self._joined(words)) or none

        for text in texts:
            waiting.append((text, self.words(text) if text else None))
            held += len(text or "")
            if held > AT_ONCE:
                yield from flush()
                held, waiting = 0, []
        yield from flush()


@lru_cache(maxsize=1)
def load(first: str, second: str) -> Aligner:
    """The aligner of two files, kept by the worker from task to task."""
    return Aligner(first, second)


STATS = ["n_a", "n_b", "n_groups", "n_links"]


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, counts.

    ``keys`` are the pairs of ids that the document links, the first id times the size of the second vocabulary plus the
    second, in ascending order; ``counts`` how many links each has. With ``keep_groups`` also ``groups``: ``a1,a2|b1;a3|b2``.
    """
    types = [pa.int64(), pa.int64(), *[pa.int64()] * len(STATS), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()][: 9 + keep_groups]
    names = ["row", "doc_id", *STATS, "groups_sha256", "keys", "counts", "groups"][: 9 + keep_groups]

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load(first, second)
        gc.disable()  # no cycles are made; the collector would walk all that is remembered again and again
        for batch in batches:
            held: list[tuple] = []
            links, at = 0, 0

            def out() -> pa.RecordBatch:
                own = [batch.column(0).slice(at, len(held)), batch.column(1).slice(at, len(held))]
                return pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, t in zip(zip(*held), types[2:]))], names)

            for groups, (a, b, n), keys, counts in aligner.align_batch(t.as_py() for t in batch.column(2)):
                digest = hashlib.sha256(groups.encode()).hexdigest() if a else ""
                held.append((a, b, n, a + b - n, digest, keys, counts, *([groups] if keep_groups else [])))
                links += len(keys)
                if links > 1 << 20:
                    yield out()
                    at += len(held)
                    held, links = [], 0
            if held:
                yield out()
        gc.enable()
        give_back()

    narrow = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join([*(f"{n} long" for n in names[:6]), "groups_sha256 string, keys array<long>, counts array<long>", *(["groups string"] if keep_groups else [])])
    return narrow.mapInArrow(aligned, schema)


def pair_counts(aligned: DataFrame, second_size: int) -> DataFrame:
    """key, a, b, links over all documents, and ``best``: whether no pair with the same second id has more."""
    pairs = aligned.select(F.inline(F.arrays_zip("keys", "counts"))).groupBy(F.col("keys").alias("key")).agg(F.sum("counts").alias("links"))
    pairs = pairs.withColumns({"a": F.expr(f"key div {second_size}"), "b": F.col("key") % second_size})
    # the pairs of one second id are at most as many as the first vocabulary has ids
    return pairs.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def _looked_up(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """row, n_best, count_sum of each row of ``aligned``."""
    spark = aligned.sparkSession
    total = counts.agg(F.sum("links")).first()[0] or 0
    often = counts.where(F.col("links") * HEAVY > total).select("key", "links", "best").orderBy("key").toArrow()  # fewer than HEAVY rows
    heavy = spark.sparkContext.broadcast([often.column(n).to_numpy() for n in ("key", "links", "best")])

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, links, best = heavy.value
        for batch in batches:
            rows, lists = batch.column(0).to_numpy(), batch.column(1)
            keys, n = lists.flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            of = np.repeat(np.arange(len(rows)), np.diff(lists.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            sums = [np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)]
            np.add.at(sums[0], of[hit], n[hit] * best[at[hit]])
            np.add.at(sums[1], of[hit], n[hit] * links[at[hit]])
            rest = ~hit
            empty = pa.nulls(len(rows), pa.int64())
            names = ["row", "key", "n", "n_best", "count_sum"]
            yield pa.RecordBatch.from_arrays([batch.column(0), empty, empty, *map(pa.array, sums)], names)
            if rest.any():
                empty = pa.nulls(int(rest.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rows[of[rest]]), pa.array(keys[rest]), pa.array(n[rest]), empty, empty], names)

    found = checkpoint(aligned.select("row", "keys", "counts").mapInArrow(looked, "row long, key long, n long, n_best long, count_sum long"))
    few = counts.where(F.col("links") * HEAVY <= total).select("key", "links", "best")
    rare = found.where("key IS NOT NULL").join(few, "key").select("row", F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("links")).alias("count_sum"))
    both = found.where("key IS NULL").select("row", "n_best", "count_sum").unionByName(rare)
    return both.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def cross_tokenizer(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and pairs (key, a, b, links, best)."""
    spark = docs.sparkSession
    place = f"{ensure_checkpoint_dir(spark)}/aligned-{uuid.uuid4().hex}"
    align(docs, first, second, id_col, text_col).write.option("compression", "zstd").parquet(place)
    aligned = spark.read.parquet(place)
    counts = checkpoint(pair_counts(aligned, len(sentence_pieces.load(second).names)))
    found = aligned.select("row", "doc_id", *STATS, "groups_sha256").join(_looked_up(aligned, counts), "row")
    found = checkpoint(found.select(F.col("doc_id").alias(id_col), *STATS, "n_best", "count_sum", "groups_sha256"))
    drop_path(spark, place)
    return found, counts
