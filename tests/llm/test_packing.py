import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from filelode.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_cut():
    assert packing.cut(1, 8) == [(0, 1)]
    assert packing.cut(8, 8) == [(0, 8)]
    assert packing.cut(9, 8) == [(0, 1), (1, 8)]
    assert packing.cut(24, 8) == [(0, 8), (8, 8), (16, 8)]


def test_best_fit_takes_the_fullest():
    sizes = np.array([3, 6, 5, 2, 4, 8])
    groups = packing.best_fit(sizes, 10)
    assert sorted(sum(groups, [])) == list(range(6))
    assert sorted(int(sum(sizes[i] for i in g)) for g in groups) == [8, 10, 10]


def brute(docs, capacity):
    library = Tokenizer.from_file(PATH)
    out = {}
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[i, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    return out


def test_pieces_and_sequences(spark):
    rng = random.Random(2)
    words = ["the", "tion", "réeux", "\n", "ab,", "  ", "123"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 160)))) for i in range(300)] + [(300, None), (301, ""), (302, "x " * 3000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, offset string").repartition(6)
    rows = packing.pack_documents(df, PATH, capacity=128).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == brute(docs, 128)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    least = -(-sum(r.length for r in rows) // 128)
    assert len(held) <= least * 1.02 + 1
    assert packing.pack_documents(df.limit(0), PATH).collect() == []


def test_items_that_never_fit_together_end(spark):
    df = spark.createDataFrame([(i, 0, 0, 100, 0) for i in range(50)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(df.repartition(8), capacity=128, items=10).collect()
    assert len({r.sequence_id for r in rows}) == 50


def test_large_items_and_a_few_small_ones(spark, monkeypatch):
    """Items over half the capacity never join; the few small ones must still find room, and no task gets all that is left."""
    rng = random.Random(4)
    sizes = [rng.randint(520, 1000) for _ in range(3000)] + [rng.randint(20, 60) for _ in range(60)]
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    seen, plain = [], packing._round

    def counted(bins, capacity):
        seen.append(max(bins.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect(), default=0))
        return plain(bins, capacity)

    monkeypatch.setattr(packing, "_round", counted)
    rows = packing.pack(df.repartition(16), capacity=1024, items=300).collect()
    held = defaultdict(int)
    for r in rows:
        held[r.sequence_id] += r.length
    assert len(rows) == len(sizes) and max(held.values()) <= 1024
    assert len(held) <= 3000 + 3 and max(seen) <= 450
