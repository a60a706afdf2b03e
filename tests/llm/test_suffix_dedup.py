import hashlib
import random
from collections import Counter

import pytest

from filelode.llm import suffix_dedup as S


def brute(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + 400] for _, d in data for k in range(len(d) - 399))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - 399):
            if seen[d[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        spans = sum(1 for k in range(len(d)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        try:
            text = kept.decode()
        except UnicodeDecodeError:
            text = None
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest(), text))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdé fgh\n", k=n))
    shared = [text(n) for n in (380, 399, 401, 700, 1500)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 900))]
        for s in rng.sample(shared, rng.randint(0, 2)):
            parts += [s, text(rng.randint(0, 500))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[0][1]), (101, rows[5][1]), (102, None), (103, ""), (104, "x" * 1200), (105, "ab" * 900), (106, "ab" * 700 + "c"), (107, text(399))]
    rows += [(108, rows[7][1][:200] + "!" + rows[7][1][200:]), (109, shared[3] * 3), (110, rows[9][1][3:])]
    return rows


@pytest.mark.parametrize("group,shard,batch", [(512, 1 << 20, 1 << 20), (1, 1 << 20, 1000), (512, 1000, 500)])
def test_against_brute_force(spark, monkeypatch, group, shard, batch):
    monkeypatch.setattr(S, "BATCH", batch)
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "SHARD", shard)
    rows = fixture()
    df = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, row string, kind int").repartition(3)
    assert sorted((tuple(r) for r in S.suffix_dedup(df).collect()), key=str) == brute(rows)


def test_repeated_and_null_ids_and_empty(spark):
    rows = fixture()[:8]
    rows += [rows[0], (3, rows[1][1]), (None, rows[2][1]), (None, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in S.suffix_dedup(df).collect()), key=str) == brute(rows)
    assert S.suffix_dedup(df.limit(0)).collect() == []


def test_periodic_text_has_few_stretches():
    """Megabytes of one letter, of a repeated line and of padding inside prose: stretches in proportion to the rest."""
    rng = random.Random(3)
    prose = "".join(rng.choices("abcdefgh ", k=20_000)).encode()
    line = bytes(rng.choices(range(97, 123), k=59))
    for text in (b"a" * S.BATCH, line * (S.BATCH // 59), prose + b" " * 500_000 + prose[::-1], bytes(range(33, 46)) * 50_000):
        (_, _, start, n, _), runs = S.stretches([text])
        assert len(start) < 50 + 2 * 40_000 // 100 and int(n.sum()) + sum(b - a for _, a, b in runs) >= len(text) - 1000
        assert len(runs) <= 3 and sum(b - a for _, a, b in runs) > 400_000


def test_long_periodic_documents(spark):
    line = "the same line of padding, over and over again, to the end.\n"
    rows = [(1, "x" * 10_000_000), (2, line * 50_000), (3, "start " + line * 8 + "end"), (4, "y" + "q" * 399 + "z"), (5, "y" + "x" * 400 + "z")]
    got = {r.doc_id: r for r in S.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[1].text) == (10_000_000, 1, "")
    assert got[2].n_removed == len(line) * 50_000 and got[4].n_removed == 0
    assert got[5].n_removed == 400 and got[5].text == "yz"
    assert got[3].n_removed == 8 * len(line) and got[3].text == "start end"
