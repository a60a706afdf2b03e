import datetime
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from filelode.functions.dates import pdf_date
from filelode.functions.layout import TOKEN, page_tokens
from filelode.sources import hashes


def slow_blake3(data):
    """The published hash, a block at a time, in plain whole numbers."""
    mask, iv = 0xFFFFFFFF, [int(x) for x in hashes.IV]
    rot = lambda x, n: (x >> n | x << (32 - n)) & mask

    def compress(cv, block, counter, length, flags):
        m = [int.from_bytes(block.ljust(64, b"\0")[i : i + 4], "little") for i in range(0, 64, 4)]
        v = [*cv, *iv[:4], counter & mask, counter >> 32, length, flags]
        for turn in range(7):
            for i, (a, b, c, d) in enumerate([(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]):
                for word, r, s in ((m[2 * i], 16, 12), (m[2 * i + 1], 8, 7)):
                    v[a] = (v[a] + v[b] + word) & mask
                    v[d] = rot(v[d] ^ v[a], r)
                    v[c] = (v[c] + v[d]) & mask
                    v[b] = rot(v[b] ^ v[c], s)
            m = [m[k] for k in hashes.ORDER]
        return [v[i] ^ v[i + 8] for i in range(8)]

    def node(part, first, root):
        if len(part) <= 1024:
            cv, blocks = iv, [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
            for i, b in enumerate(blocks):
                end = i == len(blocks) - 1
                cv = compress(cv, b, first, len(b), (i == 0) * 1 + end * 2 + (end and root) * 8)
            return cv
        half = 1 << ((len(part) - 1) // 1024).bit_length() - 1
        both = node(part[: half * 1024], first, False) + node(part[half * 1024 :], first + half, False)
        return compress(iv, b"".join(x.to_bytes(4, "little") for x in both), 0, 64, 4 + root * 8)

    return b"".join(x.to_bytes(4, "little") for x in node(data, 0, True)).hex()


def test_blake3(spark, monkeypatch):
    assert hashes.blake3(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert hashes.blake3(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    monkeypatch.setattr(hashes.Blake3, "PIECE", 2048)
    data = os.urandom(14000)
    for n in (1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 4096, 4097, 5000, 8192, 10240, 14000):
        state = hashes.Blake3()
        for i in range(0, n, 700):
            state.update(data[i : min(n, i + 700)])
        assert state.hexdigest() == slow_blake3(data[:n]), n
    many = [data[:n] for n in (0, 1, 1024, 1025, 3000, 5000, 14000)]
    assert hashes.blake3_many(many) == [slow_blake3(m) for m in many]
    df = spark.createDataFrame([(b"abc",), (None,)], "c binary")
    assert [r[0] for r in df.select(hashes.blake3_of(F.col("c"))).collect()][0][:8] == "6437b3ac"


def test_sampled_chunks(spark, tmp_path):
    assert len(hashes.sequence()) == 100_000
    assert hashes.sampled_chunks(1, []) is None
    assert hashes.sampled_chunks(32 << 20, []) == sorted(set(hashes.sampled_chunks(32 << 20, [])))
    assert len(hashes.sampled_chunks(40 << 20, [])) == 8 and len(hashes.sampled_chunks(200 << 20, [150 << 20, 190 << 20, 210 << 20])) == 10
    path = tmp_path / "large"
    data = os.urandom(1 << 20) * 33 + b"tail"
    path.write_bytes(data)
    chunks = hashes.sampled_chunks(len(data), [])
    want = hashlib.sha256(b"".join(data[c << 20 : (c + 1) << 20] for c in chunks)).hexdigest()
    df = spark.createDataFrame([(str(path), len(data)), (str(path), 5)], "path string, size long")
    assert {r.size: r.quick_hash for r in hashes.quick_hashes(df, []).collect()} == {len(data): want, 5: None}


def test_pdf_dates(spark):
    at = lambda *a: datetime.datetime(*a)
    cases = {
        "D:20230101120000Z": at(2023, 1, 1, 12), "D:20230101120000+02'00'": at(2023, 1, 1, 10), "20230101": at(2023, 1, 1), "(D:202301011230)": at(2023, 1, 1, 12, 30),
        "D:20060828175626-05": at(2006, 8, 28, 22, 56, 26), "D:200608289956261": at(2006, 8, 28), "D:14000101": None, "none": None, "0001-01-01T00:00:00": None, "": None,
        "D:20231301": None, "hello": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r[0]: r[1] for r in df.select("t", F.date_format(pdf_date(F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()}
    assert got == {k: v and v.strftime("%Y-%m-%d %H:%M:%S") for k, v in cases.items()}


def test_page_tokens(spark):
    df = spark.createDataFrame([([("a", 10.0, 20.0, 60.0, 220.0)], 100.0, 200.0)], f"tokens {TOKEN}, w double, h double")
    box = lambda unit: df.select(page_tokens(F.col("tokens"), F.col("w"), F.col("h"), unit).alias("t")).first().t[0].box
    assert box("pt") == [10, -20, 60, 180] and box("normalized") == [0.1, -0.1, 0.6, 0.9] and box("per_mille") == [100, 0, 600, 900]
    with pytest.raises(ValueError):
        box("em")
