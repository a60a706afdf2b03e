"""Chunks of long lists that are dealt to many tasks, against one pass."""

import random

import numpy as np
import pytest

from filelode.operators import chunking, records


def plain(sizes, first, later, most, held=None):
    """Bytes held (commas counted) and chunks begun after all items, from some bytes held on."""
    held, more = (first if held is None else held), 0
    for size in sizes:
        if held + size + 1 > most + 1:
            held, more = later, more + 1
        held += size + 1
    return held, more


def test_maps_and_their_composition():
    rnd = random.Random(2)
    for _ in range(200):
        most = rnd.choice([20, 60, 300])
        later = rnd.randrange(0, 6)
        a, b, c = ([rnd.randrange(0, most - later + 1) if rnd.random() < 0.2 else rnd.randrange(0, 9) for _ in range(rnd.randrange(0, 30))] for _ in range(3))
        maps = [chunking.Stretch.of(np.array(x, np.int64), most + 1, later) for x in (a, b, c)]
        for held in range(0, most + 2):
            assert maps[0].follow(held) == plain(a, 0, later, most, held)
            assert maps[0].then(maps[1]).then(maps[2]).follow(held) == plain(a + b + c, 0, later, most, held)
            assert maps[0].then(maps[1].then(maps[2])).follow(held) == plain(a + b + c, 0, later, most, held)


@pytest.mark.parametrize("parts", ["2", "16"])
@pytest.mark.parametrize("later", [0, 5])
def test_one_key_over_many_tasks(spark, parts, later):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed, same in ((1, False), (2, True)):
            rnd = random.Random(seed)
            rows = [("hot", n, 30 if same else rnd.randrange(1, 60)) for n in range(3000)] + [(k, n, rnd.randrange(1, 60)) for k in ("a", "zz") for n in range(40)]
            items = spark.createDataFrame(rows, "k string, n long, size long")
            entries, _ = chunking.entries(items, "k", ["n"], 500, 20, later)
            assert len(entries) >= int(parts) - 3
            got = records.number_chunks(items, "k", ["n"], most=500, first=20, later=later).collect()
            for key in ("hot", "a", "zz"):
                mine = sorted((r.n, r.place, r.chunk) for r in got if r.k == key)
                sizes = [size for k, _, size in rows if k == key]
                assert [m[2] for m in mine] == records.chunk_numbers(sizes, 20, later, 500)
                assert [m[1] for m in mine] == list(range(1, len(mine) + 1))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_items_and_items_that_are_too_large(spark):
    items = spark.createDataFrame([], "k string, n long, size long")
    assert records.number_chunks(items, "k", ["n"], most=500).count() == 0
    large = spark.createDataFrame([("a", n, 100) for n in range(400)] + [("a", 400, 600)], "k string, n long, size long")
    with pytest.raises(Exception, match="an item takes"):
        records.number_chunks(large, "k", ["n"], most=500).collect()
