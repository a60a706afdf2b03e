"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the longest rule of the model's compiled character map that fits at each place; beside each
normalised character stands the byte of the text that it came from, so every piece has a span of bytes of the text as it
was given. Pieces are merged with the segment trees of ``bpe``, best score first and of equal scores the leftmost; two
neighbouring characters that no piece holds side by side are never merged, so the text is cut there first and each
distinct chunk is merged once. Characters that are no piece become byte pieces, or unknown pieces if the model has no bytes.

Read are models of type BPE without user-defined and unused pieces, others raise ``ValueError``.

Defined cases: a null or empty text has no ids and decodes to the empty text. Repeated rows are encoded alike, a null id
stays null. Only the id and text columns are read, whatever else the table has.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filelode.llm.bpe import BATCH, SHORT, PairTable, merge_many, merge_one

SPACE = "▁"
#: Symbols from here on are characters that are no piece themselves: this plus the code point.
CHARACTER = 1 << 22
#: Chunks remembered by a worker.
REMEMBERED = 500_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def fields(data: bytes) -> dict[int, list]:
    """The fields of one protocol-buffer message: number to values, messages and strings as bytes."""
    out: dict[int, list] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        out.setdefault(key >> 3, []).append(value)
    return out


class CharacterMap:
    """A compiled character map: a double-array trie of UTF-8 keys, then the replacements, each ended by a zero byte."""

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.units = np.frombuffer(data, "<u4", size // 4, 4).tolist() if data else []
        self.texts = data[4 + size :]
        self.alone: dict[str, bool] = {}

    def _under(self, node: int) -> int:
        unit = self.units[node]
        return node ^ (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[str, int] | None:
        """Replacement and length in bytes of the longest key that ``data`` has at ``at``."""
        found, node = None, self._under(0)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = self.units[node]
            if unit & 0x800000FF != data[k]:
                break
            node = self._under(node)
            if unit & 256:
                found = self.units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        end = self.texts.index(0, found[0])
        return self.texts[found[0] : end].decode("utf-8", "replace"), found[1]

    def begins(self, letter: str) -> bool:
        """Whether a key begins with this character."""
        if letter not in self.alone:
            node = self._under(0)
            self.alone[letter] = True
            for byte in letter.encode("utf-8", "replace"):
                node ^= byte
                if self.units[node] & 0x800000FF != byte:
                    self.alone[letter] = False
                    break
                node = self._under(node)
        return self.alone[letter]


def _byte_by_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("filelode_byte_by_byte", _byte_by_byte)


class PieceModel:
    """An encoder and decoder of one model file."""

    def __init__(self, data: bytes):
        spec = fields(data)
        trainer, rules = fields(b"".join(spec.get(2, []))), fields(b"".join(spec.get(3, [])))
        back = fields(b"".join(spec.get(5, [])))
        flag = lambda number, default: bool(rules.get(number, [default])[-1])
        self.prefix, self.squeeze, self.escape = flag(3, True), flag(4, True), flag(5, True)
        rows = [fields(x) for x in spec.get(1, [])]
        self.names = [r[1][0].decode("utf-8") for r in rows]
        self.scores = [struct.unpack("<f", r[2][0])[0] if 2 in r else 0.0 for r in rows]
        self.kinds = [r.get(3, [NORMAL])[-1] for r in rows]
        if trainer.get(3, [1])[-1] != 2 or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or trainer.get(24, [0])[-1] or back.get(2, [b""])[-1]:
            raise ValueError("only BPE models with white space before words, without user-defined or unused pieces, are read")
        self.map = CharacterMap(rules.get(2, [b""])[-1])
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer.get(44, [" ⁇ ".encode()])[-1].decode()
        self.bytes_of = {int(n[3:5], 16): i for i, (n, k) in enumerate(zip(self.names, self.kinds)) if k == BYTE} if trainer.get(35, [0])[-1] else {}
        self._tables()
        self.remembered = REMEMBERED
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def _tables(self) -> None:
        normal = {n: i for i, (n, k) in enumerate(zip(self.names, self.kinds)) if k == NORMAL}
        self.symbol = np.arange(0x110000, dtype=np.int64) + CHARACTER
        for name, i in normal.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
        rank = {s: r for r, s in enumerate(sorted({self.scores[i] for i in normal.values()}, reverse=True))}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        beside = set()

        def symbol(text: str) -> int | None:
            return int(self.symbol[ord(text)]) if len(text) == 1 else normal.get(text)

        for name, i in normal.items():
            beside.update(zip(name, name[1:]))
            for k in range(1, len(name)):
                a, b = symbol(name[:k]), symbol(name[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank[self.scores[i]], i
        self.table = PairTable(self.pairs)
        self.beside = np.array(sorted(ord(a) << 32 | ord(b) for a, b in beside), np.int64)
        # chunks are words, each with the space before it, if no piece has a space after another character
        self.by_word = not any(b == SPACE != a for a, b in beside)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if self.by_word else re.compile(".+", re.S)
        value = np.full(len(self.names), -1)
        for byte, i in self.bytes_of.items():
            value[i] = byte
        self.is_byte, self.continues = value >= 0, (value >= 0x80) & (value < 0xC0)
        self.byte_value = value
        self.letters = np.where(self.is_byte, 1, [len(n) for n in self.names])
        shown = [n.replace(SPACE, " ") if k == NORMAL else "" for n, k in zip(self.names, self.kinds)]
        shown[self.unknown] = self.unknown_text
        self.shown = np.array(shown, dtype=object)
        self.raw = [bytes([v]) if v >= 0 else s.encode() for v, s in zip(value.tolist(), shown)]

    # ---- normalising ----

    def normalized(self, text: str) -> str:
        """The normalised text alone."""
        return self.mapped(text)[0] if self.map.units or self.squeeze else self._plain(text)

    def _plain(self, text: str) -> str:
        if not text:
            return ""
        text = " " + text if self.prefix else text
        return text.replace(" ", SPACE) if self.escape else SPACE * self.prefix + text[self.prefix :]

    def aligned(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its characters and for its end, the byte of the text where its source begins."""
        if self.map.units or self.squeeze:
            out, source = self.mapped(text)
            return out, np.array(source, np.int64)
        codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        sizes = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(sizes)])
        return self._plain(text), np.concatenate([[0], at]) if self.prefix and text else at

    def mapped(self, text: str) -> tuple[str, list[int]]:
        """``aligned`` by the character map, rule by rule."""
        data, out, source, at, k = text.encode("utf-8", "replace"), [], [], 0, 0
        text = data.decode("utf-8")
        space = SPACE if self.escape else " "
        after_space, begun = self.squeeze, False
        while k < len(text):
            found = self.map.longest(data, at) if self.map.units and self.map.begins(text[k]) else None
            if found is None:
                found = text[k], len(text[k].encode("utf-8"))
            begin, (new, size) = at, found
            at, left = at + size, size
            while left:
                left -= len(text[k].encode("utf-8"))
                k += 1
            if not begun:
                if self.squeeze and new == " ":  # spaces before all else
                    continue
                begun = True
                if self.prefix:
                    out.append(SPACE if self.escape else " ")
                    source.append(begin)
            new = new.lstrip(" ") if after_space else new
            for letter in new:
                out.append(space if letter == " " else letter)
                source.append(begin)
            if new:
                after_space = new.endswith(" ")
            after_space &= self.squeeze
        while self.squeeze and out and out[-1] == space:
            out.pop()
            at = source.pop()
        return "".join(out), [*source, at]

    # ---- encoding ----

    def merged(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks of normalised text, little-endian, 32 bits each."""
        if not chunks:
            return []
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))])
        pair = codes[:-1] << 32 | codes[1:]
        near = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        first = np.ones(len(codes), bool)
        first[1:] = self.beside[near] != pair
        first[bounds[:-1]] = True
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(codes)))
        symbols = self.symbol[codes]
        ids, kept = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)

        def put(at: np.ndarray, found: np.ndarray, counts: np.ndarray) -> None:
            places = np.repeat(at - np.cumsum(counts) + counts, counts) + np.arange(len(found))
            ids[places] = found
            kept[places] = True

        for power in range(SHORT.bit_length()):
            width = 1 << power
            rows = np.flatnonzero((lengths <= width) & (lengths > width // 2))
            for k in range(0, len(rows), BATCH):
                part = rows[k : k + BATCH]
                inside = np.minimum(starts[part, None] + np.arange(width)[None, :], len(codes) - 1)
                put(starts[part], *merge_many(symbols[inside], lengths[part], self.table))
        for r in np.flatnonzero(lengths > SHORT).tolist():
            found = np.array(merge_one(symbols[starts[r] : starts[r] + lengths[r]], self.table, self.pairs))
            put(starts[r : r + 1], found, np.array([len(found)]))
        counts = np.add.reduceat(kept, bounds[:-1], dtype=np.int64)
        flat, of = ids[kept], np.repeat(np.arange(len(chunks)), counts)
        flat, of = self._spelled(flat, of)
        data, ends, out, begin = flat.astype("<u4").tobytes(), np.cumsum(4 * np.bincount(of, minlength=len(chunks))).tolist(), [], 0
        for end in ends:
            out.append(data[begin:end])
            begin = end
        return out

    def _spelled(self, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as bytes."""
        strange = ids >= CHARACTER
        if not strange.any():
            return ids, of
        if not self.bytes_of:
            return np.where(strange, self.unknown, ids), of
        places = np.flatnonzero(strange)
        spelled = [[self.bytes_of[b] for b in chr(i - CHARACTER).encode("utf-8", "replace")] for i in ids[places].tolist()]
        counts = np.ones(len(ids), np.int64)
        counts[places] = [len(s) for s in spelled]
        out = np.repeat(ids, counts)
        begins = (np.cumsum(counts) - counts)[places]
        sizes = counts[places]
        at = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        out[at] = [b for s in spelled for b in s]
        return out, np.repeat(of, counts)

    def encode_normalized(self, texts: Iterable[str], at_once: int = 1 << 22) -> Iterator[np.ndarray]:
        """The ids of texts that are normalised already; about ``at_once`` characters are held in chunks at a time."""
        held, waiting = 0, []

        def flush() -> Iterator[np.ndarray]:
            for cache in (self.words, self.others):
                if len(cache) > self.remembered:
                    cache.clear()
            words: set[str] = set()
            for own, other in waiting:
                words.update(own)
            missing = list(words.difference(self.words))
            self.words.update(zip(missing, self.merged([SPACE + w for w in missing])))
            missing = list({c for _, other in waiting for c in other}.difference(self.others))
            self.others.update(zip(missing, self.merged(missing)))
            for own, other in waiting:
                ids = np.frombuffer(b"".join([*map(self.words.__getitem__, own), *map(self.others.__getitem__, other)]), "<u4")
                if not self.bytes_of:  # unknown characters side by side are one piece
                    strange = ids == self.unknown
                    ids = ids[~(strange & np.append(False, strange[:-1]))]
                yield ids

        for text in texts:
            if self.by_word and text.startswith(SPACE) and SPACE * 2 not in text and not text.endswith(SPACE):
                waiting.append((text[1:].split(SPACE), []))
            else:
                waiting.append(([], self.chunk.findall(text)))
            held += len(text)
            if held > at_once:
                yield from flush()
                held, waiting = 0, []
        yield from flush()

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        return self.encode_normalized(self.normalized(t or "") for t in texts)

    def spans(self, ids: np.ndarray, source: np.ndarray, normal: str = "") -> tuple[np.ndarray, np.ndarray]:
        """First and last byte (exclusive) of each piece in the text, given what ``aligned`` says.

        The bytes of a character stand where it begins, the last of them covers it.
        """
        steps = self.letters[ids]
        steps[self.is_byte[ids] & np.append(self.continues[ids][1:], False)] = 0
        ends = np.cumsum(steps)
        if not self.bytes_of and (ids == self.unknown).any():
            ends = self._ends_with_unknown(ids, normal)
        begins = np.append(0, ends[:-1])[: len(ends)]
        return source[begins], source[ends]

    def _ends_with_unknown(self, ids: np.ndarray, normal: str) -> np.ndarray:
        at, ends = 0, []
        for i in ids.tolist():
            if i == self.unknown:
                while at < len(normal) and self.symbol[ord(normal[at])] >= CHARACTER:
                    at += 1
            else:
                at += len(self.names[i])
            ends.append(at)
        return np.array(ends, np.int64)

    def encode(self, text: str | None) -> np.ndarray:
        return next(iter(self.encode_batch([text])))

    def encode_with_spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the bytes of the text that each begins and ends at."""
        normal, source = self.aligned(text or "")
        ids = next(iter(self.encode_normalized([normal])))
        return ids, *self.spans(ids, source, normal)

    # ---- decoding ----

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Bytes that aren't UTF-8 are a replacement character each; the space before the first word goes."""
        ids = np.asarray(ids, np.int64)
        lead = ""
        drops = self.prefix or self.squeeze
        for n, i in enumerate(ids.tolist()):  # pieces at the beginning, until one shows something
            if not drops or self.is_byte[i]:
                ids = ids[n:]
                break
            own = self.shown[i]
            if self.kinds[i] == NORMAL and own.startswith(" "):
                lead = own[1:]
                if lead or not self.squeeze:
                    ids = ids[n + 1 :]
                    break
            elif own:
                ids = ids[n:]
                break
        else:
            return lead
        if not self.is_byte[ids].any():
            return lead + "".join(self.shown[ids])
        edges = np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8))) + 1
        parts = [lead]
        for run in np.split(ids, edges):
            if self.is_byte[run[0]]:
                parts.append(bytes(self.byte_value[run].astype(np.uint8)).decode("utf-8", "filelode_byte_by_byte"))
            else:
                parts += self.shown[run].tolist()
        return "".join(parts)


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The encoder of a model file, kept by the worker from task to task."""
    with open(path, "rb") as f:
        return PieceModel(f.read())


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``ids``, and the bytes of the text where each piece ``begins`` and ``ends``."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                found = model.encode_with_spans(text.as_py())
                columns = [pa.array([x.astype(kind)], pa.list_(pa.from_numpy_dtype(kind))) for x, kind in zip(found, (np.int32, np.int64, np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *columns], ["doc_id", "ids", "begins", "ends"])

    out = _narrow(docs, id_col, text_col).mapInArrow(encoded, "doc_id long, ids array<int>, begins array<long>, ends array<long>")
    return out.withColumnRenamed("doc_id", id_col)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id and ``text``; null ids decode to the empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [model.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    narrow = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return narrow.mapInArrow(decoded, "doc_id long, text string").withColumnRenamed("doc_id", id_col)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode with offsets, then decode the ids.

    ``n_tokens``, the SHA-256 of the ids (decimal, a comma between) and of the decoded text, and of the pieces' spans
    (begin and end of each, little-endian, 64 bits).
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        decimals = np.array([str(i) for i in range(len(model.names))], dtype=object)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            sources = []

            def normal() -> Iterator[str]:
                for t in batch.column(1):
                    text, source = model.aligned(t.as_py() or "")
                    sources.append((source, text if not model.bytes_of else ""))
                    yield text

            counts, ids_sha, text_sha, span_sha = [], [], [], []
            for row, ids in enumerate(model.encode_normalized(normal())):
                source, sources[row] = sources[row], None
                counts.append(len(ids))
                ids_sha.append(sha(",".join(decimals[ids]).encode()))
                text_sha.append(sha(model.decode(ids).encode("utf-8", "replace")))
                span_sha.append(sha(np.column_stack(model.spans(ids, *source)).astype("<i8").tobytes()))
            columns = [batch.column(0), pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in (ids_sha, text_sha, span_sha))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    out = _narrow(docs, id_col, text_col).mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)
