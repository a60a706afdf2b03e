"""Byte pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

A piece (a word) starts as one symbol a byte. Each leaf of its tree holds the rank of the pair that starts there, with
its place, and each inner node the smaller child, so the root is the leftmost pair of lowest rank. A merge joins that
pair and changes three leaves, each a path of logarithmic length; no mergeable pair left: done. Distinct short pieces
of a batch are merged together, one tree a row of an array; longer pieces have a tree of their own.

The vocabulary file is the JSON of the ``tokenizers`` library; read from it are merges, end-of-word suffix, added
tokens, and which of these the file asks for: NFC, white space and lower-case normalisers, a split pattern, byte level.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

#: Above all ranks: of pairs that don't merge, and of empty leaves.
NO_PAIR = np.int64(1) << 40
LAST_RANK = 1 << 24
#: Pieces of at most this many bytes are merged in batches.
SHORT = 64
#: Short pieces merged at a time: their trees fit a core's cache.
BATCH = 4096
#: Pieces, and chunks between spaces, remembered by a worker.
REMEMBERED = 700_000
#: Signs that are a piece of their own when one ends a word.
SIGNS = frozenset('!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')
#: Control characters on which Python and the split patterns disagree whether they are white space.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Split of byte-level files that name no pattern of their own, as published with that vocabulary.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    more = itertools.count(0x100)
    return [chr(b) if b in plain else chr(next(more)) for b in range(256)]


# Unicode 16 added these letters and digits (first and last code points). The library splits by Unicode 16,
# Python knows 15.1 and the pattern engine a later one.
ADDED_IN_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C),
    (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
# Capitals that Python's Unicode doesn't know, and what the library makes of them in lower case.
LOWER = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
    | {0x10D50 + i: 0x10D70 + i for i in range(22)}
    | {0x16EA0 + i: 0x16EBB + i for i in range(25)}
)
NEW_CAPITALS = re.compile("[" + "".join(map(chr, LOWER)) + "]")


@lru_cache(maxsize=1)
def newer_letters() -> dict[int, int]:
    """Code points that the pattern engine takes for letters or digits and the library doesn't know, to one that neither knows."""
    unknown = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    known = set(map(ord, regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, unknown)))))
    blank = next(c for c in unknown if not regex.match(r"[^\p{Cn}]", chr(c)))
    return dict.fromkeys(known.difference(*(range(a, z + 1) for a, z in ADDED_IN_16)), blank)


class PairTable:
    """Pair of symbol ids to (rank, merged id), by open addressing in arrays so that many pairs are looked up at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        self.bits = max(10, (8 * len(pairs)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros((1 << self.bits, 2), np.int64)
        self.probes = 1
        for (a, b), value in pairs.items():
            key, n = a << 32 | b, 0
            at = self._slot(key)
            while self.keys[(at + n) & self.mask] != -1:
                n += 1
            self.keys[(at + n) & self.mask], self.values[(at + n) & self.mask] = key, value
            self.probes = max(self.probes, n + 1)

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (``NO_PAIR`` where there is none) and merged ids."""
        key = a << 32 | b
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        rank, merged = np.full(len(key), NO_PAIR), np.zeros(len(key), np.int64)
        left = np.arange(len(key))
        for n in range(self.probes):
            slot = (at[left] + n) & self.mask
            held = self.keys[slot]
            hit = held == key[left]
            rank[left[hit]], merged[left[hit]] = self.values[slot[hit], 0], self.values[slot[hit], 1]
            left = left[~hit & (held != -1)]
            if not len(left):
                break
        return rank, merged


def merge_one(symbols: list[int] | np.ndarray, table: PairTable, pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The merges of one piece of any length, with its segment tree in an array of integers.

    A leaf is the rank of the pair that starts there, times the size of the tree, plus its place.
    """
    n = len(symbols)
    if n < 2:
        return list(symbols)
    size = 1 << (n - 1).bit_length()
    first = np.asarray(symbols, np.int64)
    none = LAST_RANK * size
    leaves = np.full(size, none, np.int64)
    rank, _ = table.find(first[:-1], first[1:])
    leaves[: n - 1] = np.where(rank < NO_PAIR, rank * size + np.arange(n - 1), none)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
    tree = array("q", np.concatenate([[none], *levels[::-1]]).astype("<i8").tobytes())
    after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    held = array("i", first.astype("<i4").tobytes())
    alive = bytearray(b"\1") * n

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            beside = tree[i ^ 1]
            if beside < value:
                value = beside
            i >>= 1
            if tree[i] == value:
                break
            tree[i] = value

    def leaf(i: int) -> int:
        j = after[i]
        pair = pairs.get((held[i], held[j])) if j < n else None
        return pair[0] * size + i if pair else none

    while tree[1] < none:
        i = tree[1] & (size - 1)
        j = after[i]
        held[i] = pairs[held[i], held[j]][1]
        alive[j] = 0
        k = after[i] = after[j]
        if k < n:
            before[k] = i
        put(j, none)
        put(i, leaf(i))
        if before[i] >= 0:
            put(before[i], leaf(before[i]))
    return np.frombuffer(held, np.int32)[np.frombuffer(alive, np.uint8) > 0].tolist()


def merge_many(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The merges of many short pieces: row ``r`` of ``symbols`` holds ``lengths[r]`` symbols, its width a power of two.

    Returns all ids, piece after piece, and the number of ids of each. Arrays are flat: place ``i`` of row ``r`` is at
    ``r * width + i``, node ``n`` of its tree at ``2 * r * width + n``. A leaf is ``rank * width + i``.
    """
    rows, width = symbols.shape
    place = np.arange(width, dtype=np.int32)
    alive = (place[None, :] < lengths[:, None]).ravel()
    symbols = symbols.astype(np.int64).ravel()
    if width == 1:
        return symbols[alive], lengths.copy()
    held = 2 * width
    none = np.int32(LAST_RANK * width)
    after, before = np.tile(place + 1, rows), np.tile(place - 1, rows)
    tree = np.full((rows, held), none, np.int32)
    becomes = np.zeros(rows * width, np.int64)  # what the pair that starts at a place becomes
    second = alive.reshape(rows, width).copy()
    second[:, :-1] = second[:, 1:]
    second[:, -1] = False
    at = np.flatnonzero(second.ravel())
    rank, becomes[at] = table.find(symbols[at], symbols[at + 1])
    leaf = np.where(rank < NO_PAIR, rank * width + at % width, none)
    tree[at // width, width + at % width] = leaf
    level = width
    while level > 1:
        half = level // 2
        tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level = half
    tree = tree.ravel()

    def put(top: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
        node = i + width
        tree[top + node] = value
        for _ in range(width.bit_length() - 1):
            value = np.minimum(value, tree[top + (node ^ 1)])
            node = node >> 1
            tree[top + node] = value

    act = np.flatnonzero(tree[1::held] < none)
    while len(act):
        row, top = act * width, act * held
        i = tree[top + 1] % width
        here = row + i
        j = after[here]
        gone = row + j
        symbols[here] = becomes[here]
        alive[gone] = False
        k = after[gone]
        after[here] = k
        put(top, j, none)
        right, h = k < lengths[act], before[here]
        left = h >= 0
        before[(row + k)[right]] = i[right]
        first = np.concatenate([here[right], (row + h)[left]])
        then = np.concatenate([(row + k)[right], here[left]])
        rank, becomes[first] = table.find(symbols[first], symbols[then])
        n = int(right.sum())
        value = np.full(len(act), none, np.int32)
        value[right] = np.where(rank[:n] < NO_PAIR, rank[:n] * width + i[right], none)
        put(top, i, value)
        put(top[left], h[left], np.where(rank[n:] < NO_PAIR, rank[n:] * width + h[left], none).astype(np.int32))
        act = act[tree[top + 1] < none]
    return symbols[alive], alive.reshape(rows, width).sum(axis=1)


class Bpe:
    """An encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.table = PairTable(self.pairs)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.split_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        kinds = {n["type"] for n in (spec["normalizer"] or {"normalizers": []}).get("normalizers", [spec["normalizer"]])}
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        parts = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        pattern = next((p["pattern"]["Regex"] for p in parts if p["type"] == "Split"), BYTE_LEVEL)
        self.pattern = regex.compile(pattern)
        self.byte_decoder = (spec["decoder"] or {}).get("type") == "ByteLevel"
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in added.items()}
        self.names = np.array([names.get(i, "") for i in range(max(names) + 1)], dtype=object)
        back = {c: b for b, c in enumerate(letters)}
        self.raw = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in self.names] if self.byte_decoder else []
        self.spaces_vanish = not pattern.endswith(r"|\s+")
        self.remembered = REMEMBERED
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def found(self, text: str) -> list[str]:
        """The pieces of a normalised text. Letters and digits newer than the library's Unicode count as what it takes them
        for, code points without a character."""
        if text.isascii() or (newer := newer_letters()).keys().isdisjoint(map(ord, set(text))):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(newer))]

    def normalized(self, text: str) -> str:
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # letter by letter: a capital sigma at a word's end is no exception
            text = text.replace("Σ", "σ").lower()
            if NEW_CAPITALS.search(text):
                text = text.translate(LOWER)
        return text

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text in order; an added token is a piece that starts with U+FFFF twice."""
        if self.split_added is None:
            return self.found(self.normalized(text))
        out: list[str] = []
        for n, part in enumerate(self.split_added.split(text)):
            if n % 2:
                out.append("￿￿" + part)
            elif part:
                out += self.found(self.normalized(part))
        return out

    def merged(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, little-endian, 32 bits each."""
        out: list[bytes] = [b""] * len(pieces)
        short: dict[int, tuple[list[int], list[bytes]]] = {}
        for k, piece in enumerate(pieces):
            data = piece.encode("utf-8", "replace")
            if len(data) > SHORT:
                symbols = np.append(self.first[np.frombuffer(data[:-1], np.uint8)], self.last[data[-1]])
                out[k] = np.array(merge_one(symbols, self.table, self.pairs), "<u4").tobytes()
            else:
                places, words = short.setdefault((len(data) - 1).bit_length(), ([], []))
                places.append(k)
                words.append(data)
        for power, (places, words) in short.items():
            width = 1 << power
            for at in range(0, len(words), BATCH):
                part = words[at : at + BATCH]
                lengths = np.fromiter(map(len, part), np.int64, len(part))
                data = np.frombuffer(b"".join([d.ljust(width, b"\0") for d in part]), np.uint8).reshape(-1, width)
                symbols = self.first[data]
                ends = np.arange(len(part)), lengths - 1
                symbols[ends] = self.last[data[ends]]
                ids, counts = merge_many(symbols, lengths, self.table)
                data, start = ids.astype("<u4").tobytes(), 0
                for k, end in zip(places[at : at + BATCH], np.cumsum(4 * counts).tolist()):
                    out[k] = data[start:end]
                    start = end
        return out

    def merge_words(self, words: list[str], space: str) -> None:
        """Remember chunks that are words, of letters alone: cut from one buffer, by width, without a loop over them."""
        buffer = np.frombuffer("\n".join([*words, ""]).encode("utf-8"), np.uint8)
        ends = np.flatnonzero(buffer == 10)
        starts = np.append(0, ends[:-1] + 1)[: len(ends)]
        lengths = ends - starts + len(space)
        out = self.chunks
        for power in range(SHORT.bit_length()):
            width = 1 << power
            places = np.flatnonzero((lengths <= width) & (lengths > width // 2))
            for at in range(0, len(places), BATCH):
                part = places[at : at + BATCH]
                sizes, place = lengths[part], np.arange(width)
                data = buffer[np.minimum(starts[part, None] + place[None, :] - len(space), len(buffer) - 1)]
                if space:
                    data[:, 0] = 32
                symbols = self.first[data]
                last = np.arange(len(part)), sizes - 1
                symbols[last] = self.last[data[last]]
                ids, counts = merge_many(symbols, sizes, self.table)
                data, start = ids.astype("<u4").tobytes(), 0
                for k, end in zip(part.tolist(), np.cumsum(4 * counts).tolist()):
                    out[words[k]] = data[start:end]
                    start = end
        long = [words[k] for k in np.flatnonzero(lengths > SHORT)]
        out.update(zip(long, self.merged([space + w for w in long])))

    def learn(self, pieces: Iterable[str]) -> None:
        """Remember pieces that aren't known."""
        new = [p for p in pieces if p not in self.known]
        special = [p for p in new if p.startswith("￿￿") and p[2:] in self.added]
        for piece in special:
            self.known[piece] = np.array([self.added[piece[2:]]], "<u4").tobytes()
        plain = [p for p in new if p not in self.known]
        self.known.update(zip(plain, self.merged(plain)))

    def learn_chunks(self, missing: Iterable[str]) -> None:
        """Remember chunks. Most are a word, or a word and one sign; the pattern is asked about the others alone."""
        space, words, signed, odd = "" if self.spaces_vanish else " ", set(), [], {}
        for chunk in missing:
            if chunk.isalpha():
                words.add(chunk)
            elif chunk[-1:] in SIGNS and chunk[:-1].isalpha():
                signed.append(chunk)
                if chunk[:-1] not in self.chunks:
                    words.add(chunk[:-1])
            else:
                odd[chunk] = self.found(space + chunk)
        self.learn({*SIGNS, *(p for found in odd.values() for p in found)})
        of = self.known.__getitem__
        self.merge_words(list(words), space)
        for chunk in signed:
            self.chunks[chunk] = self.chunks[chunk[:-1]] + of(chunk[-1])
        for chunk, found in odd.items():
            self.chunks[chunk] = b"".join(map(of, found))

    def split(self, text: str) -> list[str] | None:
        """The text cut at single spaces into chunks that are encoded each for itself, or None where cuts could matter.

        If white space vanishes, a chunk is what stands between white space. Else each chunk but the first begins with
        the space before it, which is left out here: a piece takes one space before it at most, and of other white
        space the longest run that ends before the last, so only double spaces reach over a cut.
        """
        if ODD_SPACE.search(text) or (self.split_added and self.split_added.search(text)):
            return None
        if self.spaces_vanish:
            return self.normalized(text).split()
        return None if "  " in text else self.normalized(text).split(" ")

    def encode_batch(self, texts: Iterable[str | None], at_once: int = 1 << 22) -> Iterator[np.ndarray]:
        """The ids of each text; about ``at_once`` characters are held in pieces at a time."""
        held, waiting = 0, []

        def flush() -> Iterator[np.ndarray]:
            for cache in (self.known, self.chunks):
                if len(cache) > self.remembered:
                    cache.clear()
            self.learn({p for pieces, _ in waiting for p in pieces})
            chunks: set[str] = set()
            for _, parts in waiting:
                chunks.update(parts)
            self.learn_chunks(chunks.difference(self.chunks))
            for pieces, parts in waiting:
                yield np.frombuffer(b"".join([*map(self.known.__getitem__, pieces), *map(self.chunks.__getitem__, parts)]), "<u4")

        for text in texts:
            text = text or ""
            parts = self.split(text)
            if parts is None:
                waiting.append((self.pieces(text), []))
            elif self.spaces_vanish:
                waiting.append(([], parts))
            else:
                waiting.append((self.found(parts.pop(0)), parts))
            held += len(text)
            if held > at_once:
                yield from flush()
                held, waiting = 0, []
        yield from flush()

    def encode(self, text: str | None) -> np.ndarray:
        return next(iter(self.encode_batch([text])))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte level if the file has that decoder, else the tokens with spaces between."""
        if self.byte_decoder:
            return b"".join(self.raw[i] for i in ids).decode("utf-8", "replace")
        return " ".join(self.names[ids])


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The encoder of a file, kept by the worker from task to task."""
    return Bpe(path)
