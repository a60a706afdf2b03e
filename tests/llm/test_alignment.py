"""Alignment of two tokenizers against plain offsets and all pairs of overlapping tokens."""

import hashlib
import random
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from filelode.llm import alignment
from filelode.llm.bpe import byte_letters
from filelode.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
PARTS = ["the ", "cat", "sat", " ", "  ", "\n", "é", "日本", "😀", "<|endoftext|>", "<s>", "1234", "ing ", "don't ", "\t", "ﬁ", "X", "…", "\x1c", "▁", "unbelievably "]


def invented(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS[:-2] if rnd.random() < 0.97 else PARTS) for _ in range(rnd.randrange(1, 25))) for _ in range(n)]


def plain(texts):
    """The contract by offsets: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, and the counts."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    back = {c: b for b, c in enumerate(byte_letters())}
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        spelled_a = [bytes(back[c] for c in first.id_to_token(i)) for i in a]
        spelled_b = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [second.id_to_piece(i)]]
        if not b"".join(spelled_a) == b"".join(spelled_b) == (" " + text).encode():
            found.append(None)
            continue
        ends = []
        for spelled in (spelled_a, spelled_b):
            at, own = 0, []
            for data in spelled:
                own.append((at, at + len(data)))
                at += len(data)
            ends.append(own)
        cuts = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
        groups = [([i for i, (x, y) in zip(a, ends[0]) if lo <= x and y <= hi], [i for i, (x, y) in zip(b, ends[1]) if lo <= x and y <= hi]) for lo, hi in zip([0, *cuts], cuts)]
        links = [(i, j) for i, (x, y) in zip(a, ends[0]) for j, (v, w) in zip(b, ends[1]) if x < w and v < y]
        found.append((len(a), len(b), groups, links))
    counts = Counter(link for f in found if f for link in f[3])
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
        best = sum(counts[link] == most[link[1]] for link in f[3])
        out.append((f[0], f[1], len(f[2]), len(f[3]), best, sum(counts[link] for link in f[3]), hashlib.sha256(told.encode()).hexdigest()))
    return out, counts


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, keys string, row int")
    found, pairs = alignment.cross_tokenizer(docs, A, B)
    want, counts = plain([r[1] for r in rows])
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got, key=key) == sorted([(r[0], *w) for r, w in zip(rows, want)], key=key)
    assert {(r.a, r.b): r.links for r in pairs.collect()} == counts


def test_against_plain_offsets(spark, monkeypatch):
    """Nulls, empty texts, repeated rows and clashing columns among invented texts; pairs broadcast, joined, and both."""
    rows = [(n, t, "k", n) for n, t in enumerate(invented(300, 4))] + [(None, "Hello world", None, 1), (7, None, None, 1), (8, "", None, 1), (9, "a▁b", None, 1)] + [(10, "Hello  world", None, 1)] * 3
    check(spark, rows)
    monkeypatch.setattr(alignment, "HEAVY", 50)
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    monkeypatch.setattr(alignment, "AT_ONCE", 200)
    alignment.load.cache_clear()
    check(spark, rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found, pairs = alignment.cross_tokenizer(docs, A, B)
    assert found.count() == 0 and pairs.count() == 0


def test_long_text(spark):
    text = "Words of a very long text, 123 times.\n" * 60 + "  two"
    check(spark, [(1, text, None, 1)])


def test_transducer_on_all_cuts():
    """Tokens of every way to cut a short text on both sides; bytes that differ."""
    raw = [bytes([97 + i]) * (n + 1) for i in range(1) for n in range(6)]
    cuts = lambda n: [[]] if n == 0 else [[k, *rest] for k in range(1, n + 1) for rest in cuts(n - k)]
    machine = alignment.Transducer(raw, raw)
    for x in cuts(6):
        for y in cuts(6):
            groups, links = machine.align([k - 1 for k in x], [k - 1 for k in y])
            edges = [{sum(z[: n + 1]) for n in range(len(z))} for z in (x, y)]
            assert len(groups) == len(edges[0] & edges[1])
            spans = [[(sum(z[:n]), sum(z[: n + 1])) for n in range(len(z))] for z in (x, y)]
            assert len(links) == sum(a < d and c < b for a, b in spans[0] for c, d in spans[1])
    assert machine.align([0, 1], [0]) is None and machine.align([0], [0, 0]) is None
    assert alignment.Transducer([b"ab"], [b"ac"]).align([0], [0]) is None
    assert machine.align([], []) == ([], []) and machine.align([1, 0], [0, 1]) == (["1,0|0,1"], [6, 7, 1])


def test_groups_can_be_kept(spark):
    docs = spark.createDataFrame([(1, "Hello unbelievably")], "doc_id long, text string")
    row = alignment.align(docs, A, B, keep_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and sum(row.counts) == row.n_links
