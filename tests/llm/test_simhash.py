import random

import pytest
import xxhash
from pyspark.sql import functions as F

from filelode.llm import simhash
from filelode.llm.graph import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    part = {i: i for i in fps}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    ids = sorted(fps)
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                part[b] = a
    return {i: root(i) for i in ids}


def test_fingerprint_matches_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "one two", "A b\tC", "É é\x0bx y"] + [
        " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(3, 60))) for _ in range(40)
    ]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) == brute_fingerprint(t)


@pytest.mark.parametrize("group", [1024, 4])
def test_links_connect_what_brute_force_connects(spark, group):
    rng = random.Random(group)
    fps = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        fps |= {seed} | {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(15)}
    fps |= {1, 3, 7, 0, 2**63, 2**63 | 1}
    nodes = {i: fp for i, fp in enumerate(sorted(fps))}
    df = spark.createDataFrame([(i, fp - 2**64 if fp >= 2**63 else fp) for i, fp in nodes.items()], "node long, fp long")
    found = {r.node: r.component for r in connected_components(simhash.links(df, group=group)).collect()}
    assert {i: found.get(i, i) for i in nodes} == brute_components(nodes)


def test_whole_operator_with_nulls_copies_and_clashing_columns(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"]) for _ in range(200)) for _ in range(6)]
    texts = {i: t for i, t in enumerate(base + [base[0]] * 3 + [base[1] + " ab", None, "", "x", "x y", base[2].upper()])}
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in texts.items()], "doc_id long, text string, fp int, node int")
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    got = simhash.simhash_dedup(df).withColumn("fingerprint", simhash.hex_fingerprint()).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{fp:016x}" for i, fp in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_components(fps)
    assert simhash.simhash_dedup(df.limit(0)).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (8, 7)]
    df = spark.createDataFrame(links, "u long, v long")
    found = {r.node: r.component for r in connected_components(df).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)}
    nulls = spark.createDataFrame([(None, 1)], "u long, v long")
    assert connected_components(nulls.where(F.lit(True))).collect() == []
