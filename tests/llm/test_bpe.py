import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

from filelode.llm import bpe, bpe_columns

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def texts():
    rng = random.Random(3)
    fixed = [
        None, "", " ", "\n\n  a  b \t", "Hello, world's we'll I'D 'S 12345 ½Ⅷ", "ΑΣ ΣΑΣ İI", "é Å ﬁ",
        "x" * 70, "ab" * 500, "日本語のテキスト 한국어 العربية", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "\x1c\x1d \x85  x​﻿", "😀👩‍👩 é",
        "%%% ### &&& $$$ ...!!", "the\x00end￿￿x", "word " * 3000,
    ]
    pool = [chr(c) for r in ((0x20, 0x250), (0x370, 0x400), (0x4E00, 0x4E20), (0x1F600, 0x1F610), (0x300, 0x310), (0x2000, 0x2030)) for c in range(*r)]
    return fixed + ["".join(rng.choices(pool, k=rng.randint(1, 120))) for _ in range(150)]


@pytest.mark.parametrize("name", FILES)
def test_same_as_the_library(name):
    path = public_tokenizers.path(name)
    library, ours = Tokenizer.from_file(path), bpe.Bpe(path)
    for text, ids in zip(texts(), ours.encode_batch(texts(), at_once=500)):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert ours.decode(ids) == library.decode(want, skip_special_tokens=False), text


@pytest.mark.parametrize("name", FILES)
def test_batched_trees_and_single_trees_agree(name):
    ours = bpe.Bpe(public_tokenizers.path(name))
    rng = random.Random(5)
    words = {"".join(rng.choices("thereionas ", k=rng.randint(1, 60))) for _ in range(800)}
    ours.learn(words)
    for word in words:
        data = word.encode()
        symbols = [*ours.first[np.frombuffer(data[:-1], np.uint8)].tolist(), int(ours.last[data[-1]])]
        assert np.frombuffer(ours.known[word], "<u4").tolist() == bpe.merge_one(symbols, ours.table, ours.pairs)


@pytest.mark.parametrize("name", FILES)
def test_every_letter_on_which_unicode_versions_differ(name):
    """All letters and digits that the pattern engine knows and Python's Unicode doesn't, and every 97th of all code points."""
    path = public_tokenizers.path(name)
    library, ours = Tokenizer.from_file(path), bpe.Bpe(path)
    unknown = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    points = list(map(ord, regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, unknown))))) + [c for c in range(0, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}2 .{chr(c)}" for c in points]
    want = library.encode_batch(texts, add_special_tokens=False)
    assert [hex(c) for c, ids, w in zip(points, ours.encode_batch(texts), want) if ids.tolist() != w.ids] == []


@pytest.mark.parametrize("name", FILES)
def test_a_long_piece_without_a_split(name):
    path = public_tokenizers.path(name)
    library, ours = Tokenizer.from_file(path), bpe.Bpe(path)
    for text in ("ab" * 30_000, "thequickbrownfox" * 4_000, "é" * 20_000, "x" * 70_001):
        assert ours.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_columns(spark):
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    want = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = bpe_columns.round_trip_digests(df, path).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
    back = bpe_columns.decode(bpe_columns.encode(df, path), path).collect()
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in back} == {i: w[2] for i, w in want.items()}
    assert bpe_columns.round_trip_digests(df.limit(0), path).collect() == []
