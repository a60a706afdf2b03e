"""Language identification by cross-parsing entropy.

Of each language's labelled text a bounded sample of whole rows is turned into a suffix automaton, the smallest machine
that reads exactly the substrings of the sample. A text is parsed against a machine greedily: a phrase is the longest
match, the next begins where it ended. The fewer phrases a language needs, each weighed with the logarithm of its sample's
length (what naming a place in the sample costs), the nearer the text is to it; the cheapest language wins.

Texts are parsed whole, in blocks of ``BLOCK`` symbols side by side: first as if each block began a phrase, then again
from the state in which the block before it ended, until the parse runs as it did before, which it mostly does after a few
phrases. So the phrases are those of one parse from the first symbol to the last.

Symbols are lower-case letters, as many as the samples have; a run of anything else is one space. A machine's moves stand
in a hash table by state and symbol, so alphabets of thousands of letters cost no more than small ones. Letters that no
sample has end a phrase.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. Rows with a null label are predicted but
never learned from, and a null id is learned from like another. Without a labelled row of any language everything is
``und``. Ties go to the language that sorts first. Only id, text and, in training, label columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512
#: Symbols of a text that are parsed at a time.
SEGMENT = 1 << 22
UNDETERMINED = "und"
#: How sharply the score follows the gap in bits between a language and the likeliest one, over the whole text: the more
#: letters agree, the surer.
SHARPNESS = 0.1


@dataclass(frozen=True)
class Limits:
    """Bounds of the training for each language: labelled rows drawn (expected), and letters, after which no more of them
    are taken. A row that is taken is taken whole, so the last one may exceed the bound."""

    rows: int = 64
    letters: int = 60_000


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the states of the suffix automaton of a sequence; state 0 reads the empty string."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Machine:
    """The moves of a suffix automaton by state and symbol, by open addressing; ``stop`` is a symbol that is never read."""

    def __init__(self, moves: list[dict[int, int]], width: int, stop: int):
        self.width, self.between = width, len(moves)  # between: where a text starts and an unread letter leads
        edges = [(state * width + c, to) for state, next_of in enumerate(moves) for c, to in next_of.items() if c != stop]
        keys, to = (np.array(x, np.int64) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
        self.bits = max(10, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to = np.full(1 << self.bits, -1, np.int32)
        slot, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.to[slot[put]] = keys[put], to[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        self.fresh = np.full(width, self.between, np.int32)  # where a symbol leads that begins a phrase
        for c, state in moves[0].items():
            if c != stop:
                self.fresh[c] = state

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether a phrase ended so that the symbol began one."""
        key = state * np.int64(self.width) + symbol
        slot = self._home(key)
        held = self.keys.take(slot)
        to = self.to.take(slot)
        miss = held != key
        ended = miss & (held == -1)
        left = np.flatnonzero(miss & ~ended)
        while len(left):
            at = (slot[left] + 1) & (len(self.keys) - 1)
            slot[left] = at
            held = self.keys[at]
            hit, none = held == key[left], held == -1
            to[left[hit]] = self.to[at[hit]]
            ended[left[none]] = True
            left = left[~hit & ~none]
        np.copyto(to, self.fresh.take(symbol), where=ended)
        return to, ended


class Parser:
    """The machines of all languages, and the symbols they share: 0 is space, the last one any letter that no sample has."""

    def __init__(self, samples: dict[str, list[str]], limits: Limits = Limits()):
        self.langs = sorted(samples)
        letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
        self.width = len(letters) + 2
        self.symbol_of = np.zeros(0x110000, np.int32)
        self.symbol_of[[c for c in range(0x110000) if chr(c).isalpha()]] = self.width - 1
        for i, c in enumerate(letters):
            self.symbol_of[ord(c)] = i + 1
        self.machines, self.weights = [], []
        for lang in self.langs:
            joined: list[int] = []
            for text in samples[lang]:
                joined += self.symbols(text).tolist() + [self.width - 1]  # matches nothing
            self.machines.append(Machine(suffix_automaton(joined), self.width, self.width - 1))
            self.weights.append(math.log2(len(joined) + 2))

    def symbols(self, text: str) -> np.ndarray:
        found = self.symbol_of[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != 0) | (found[:-1] != 0)
        return found[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text (as symbols) needs in each language."""
        out = np.zeros((len(self.langs), len(texts)), np.int64)
        state = [np.full(len(texts), m.between, np.int32) for m in self.machines]
        for at in range(0, max(map(len, texts), default=0), SEGMENT):
            live = np.array([i for i, t in enumerate(texts) if len(t) > at], np.int64)
            parts = [texts[i][at : at + SEGMENT] for i in live]
            for n, (counts, last) in enumerate(self._parse(parts, [s[live] for s in state])):
                out[n, live] += counts
                state[n][live] = last
        return out

    def _parse(self, texts: list[np.ndarray], into: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each language the phrases that begin in each text, from the states in which they are entered, and the last states."""
        ends = np.cumsum([-(-len(t) // BLOCK) for t in texts])
        first = np.append(0, ends[:-1])
        sizes = np.concatenate([np.minimum(BLOCK, len(t) - np.arange(0, len(t), BLOCK)) for t in texts])
        owner = np.repeat(np.arange(len(texts)), ends - first)
        order = np.argsort(-sizes, kind="stable")  # longest first
        row = np.empty(len(order), np.int64)
        row[order] = np.arange(len(order))
        grid = np.zeros((BLOCK, len(order)), np.int32)
        for t, a, z in zip(texts, first.tolist(), ends.tolist()):
            padded = np.zeros((z - a) * BLOCK, np.int32)
            padded[: len(t)] = t
            grid[:, row[a:z]] = padded.reshape(z - a, BLOCK).T
        size = sizes[order]
        later = np.flatnonzero(np.concatenate([[False], owner[1:] == owner[:-1]]))
        before, later = row[later - 1], row[later]
        for machine, entered in zip(self.machines, into):
            states = np.zeros((BLOCK + 1, len(order)), np.int32)
            ended = np.zeros((BLOCK, len(order)), bool)
            came = np.full(len(order), machine.between, np.int32)
            came[row[first]] = entered
            states[0] = came
            for at in range(BLOCK):
                some = int(np.searchsorted(-size, -at, side="left"))  # rows longer than a place
                if not some:
                    break
                states[at + 1, :some], ended[at, :some] = machine.step(states[at, :some], grid[at, :some])
            while True:  # from where the block before ended
                left = states[size[before], before]
                again = left != came[later]
                if not again.any():
                    break
                live, state = later[again], left[again]
                came[live] = state
                for at in range(BLOCK):
                    inside = size[live] > at
                    live, state = live[inside], state[inside]
                    if not len(live):
                        break
                    to, end = machine.step(state, grid[at, live])
                    ended[at, live] = end
                    new = to != states[at + 1, live]
                    states[at + 1, live] = to
                    live, state = live[new], to[new]
            last = row[ends - 1]
            yield np.bincount(owner[order], weights=ended.sum(axis=0), minlength=len(texts)).astype(np.int64), states[size[last], last]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        symbols = [self.symbols(t or "") for t in texts]
        has_letter = np.array([bool(s.any()) for s in symbols], bool)
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        bits = self.phrases(symbols) * np.array(self.weights)[:, None]
        best = bits.argmin(axis=0)
        gap = (bits - bits.min(axis=0)) * SHARPNESS
        score = np.where(has_letter, 1 / np.exp2(-np.minimum(gap, 1000)).sum(axis=0), 0.0)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, has_letter)], score


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Parser:
    """Machines from labelled rows: of each language about ``limits.rows`` whole rows, by the hash of id and text, up to
    ``limits.letters``. Rows without id, or that share one, are drawn each by its text; equal rows are one. Which rows are
    taken depends on ids and texts alone, so the same table gives the same model. The driver gets what is taken: of each
    language rows of ``limits.letters`` letters and one row.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")
    ).where(r"l IS NOT NULL AND t RLIKE '\\p{L}'").withColumn("h", F.xxhash64("i", "t"))
    # how many different rows a language has, to a few hundredths; so about limits.rows of them pass, whatever is repeated
    counts = rows.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("count"))
    places = F.broadcast(counts.select("l", F.least(F.lit(1.0), 1.1 * limits.rows / F.col("count")).alias("share")))  # one row a language
    drawn = rows.join(places, "l").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30)).groupBy("l", "h", "t").agg(F.lit(1)).select("l", "h", "t")
    before = Window.partitionBy("l").orderBy("h", "t").rowsBetween(Window.unboundedPreceding, -1)
    taken = drawn.withColumn("before", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0))).where(F.col("before") < limits.letters)
    samples: dict[str, list[str]] = {}
    for r in sorted(taken.select("l", "h", "t").toArrow().to_pylist(), key=lambda r: (r["l"], r["h"], r["t"])):
        samples.setdefault(r["l"], []).append(r["t"])
    return Parser(samples, limits)


def predict(docs: DataFrame, parser: Parser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred``, ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = shared.value
        for batch in batches:
            at = 0
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            while at < batch.num_rows:  # about a few MB of text at a time
                end, held = at, 0
                while end < batch.num_rows and (end == at or held + sizes[end] <= 1 << 22):
                    held += int(sizes[end])
                    end += 1
                langs, score = parser.predict(batch.column(1).slice(at, end - at).to_pylist())
                ids = batch.column(0).slice(at, end - at)
                yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])
                at = end

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(predicted, "doc_id long, lang_pred string, score double").withColumnRenamed("doc_id", id_col)


def identify(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Learn from the rows that aren't held out, predict all: doc_id, held_out, lang_pred, score."""
    parser = train(docs.where(~is_held_out()), limits)
    return predict(docs, parser).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
