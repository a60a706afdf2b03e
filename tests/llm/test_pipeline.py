import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_packing import brute as brute_pieces  # noqa: E402
from tests.llm.test_simhash import brute_components, brute_fingerprint  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, digest string"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 7)))
    texts = {i: [word() for _ in range(rng.randint(60, 200))] for i in range(400)}
    for i in range(0, 400, 3):
        texts[i].insert(rng.randrange(50), "vileword")
    passage = [word() for _ in range(90)]
    for i in (1, 4, 7):
        texts[i][30:30] = passage
    rows = [(i, " ".join(w)) for i, w in texts.items()]
    rows += [(500, rows[1][1] + " "), (501, rows[1][1].replace(" ", "\n")), (502, " ".join(texts[2][:-1] + ["x"])), (503, None), (504, ""), rows[5]]
    rows += [(505, " ".join(word() for _ in range(6000)))]
    where = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, "en", None, len(t or ""), "d") for i, t in rows], COLUMNS).repartition(4).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "near-dedup", "substring dedup", "packing"]

    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    rows = {(r.doc_id, r.text) for r in clean.collect()}
    want = {(r.doc_id, r.text) for r in docs.collect() if "vileword" not in (r.text or "")}
    assert rows == want and clean.count() == len(want) + 1  # the repeated row

    once = stages["exact dedup"](spark, clean, sf_dir)
    seen = {}
    for i, t in sorted(want):
        seen.setdefault(" ".join((t or "x").replace("\n", " ").split(" ")) if t else "", (i, t))
    assert once.columns == docs.columns and sorted((r.doc_id, r.text) for r in once.collect()) == sorted(seen.values())

    near = stages["near-dedup"](spark, once, sf_dir)
    fps = {i: brute_fingerprint(t) for i, t in seen.values()}
    roots = {i for i, c in brute_components(fps).items() if i == c}
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == roots and near.count() == len(roots)

    left = stages["substring dedup"](spark, near, sf_dir)
    before, after = ({r.doc_id: r for r in df.collect()} for df in (near, left))
    assert left.columns == docs.columns and set(after) == set(before)
    for i, r in after.items():
        if i in (4, 7):
            assert 80 <= len(before[i].text.split()) - len(r.text.split()) <= 94 and r.n_chars == len(r.text)
        elif i == 502:  # what it shares with document 2 is all but its last word
            assert r.text == "x"
        else:
            assert r == before[i]

    packed = stages["packing"](spark, left, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == brute_pieces([(i, r.text) for i, r in after.items()], 2048)


def test_run_is_the_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(pieces).collect())) == sorted(map(tuple, docs.select(pieces).collect()))


@pytest.mark.parametrize("n", range(5))
def test_each_stage_takes_nulls_repeats_and_nothing(spark, sf_dir, n):
    odd = [(None, "a b c", None, None, None, "x"), (None, "a b c", None, None, None, "x"), (1, None, None, None, None, None), (1, None, None, None, None, None), (2, "", "en", "s", 0, "y"), (3, "a  b c", "en", "s", 5, "z")]
    docs = spark.createDataFrame(odd, COLUMNS)
    name, stage = corpus_pipeline.STAGES[n]
    got = stage(spark, docs, sf_dir)
    rows = got.collect()
    if n < 4:
        assert got.columns == docs.columns
        assert len(rows) == {0: 6, 1: 2, 2: 4, 3: 6}[n]
    else:
        assert len(rows) == 6
    assert stage(spark, docs.limit(0), sf_dir).collect() == []


def test_near_dedup_keeps_unrelated_texts_of_one_id(spark, sf_dir):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(80))
    one, two, three = text(), text(), text()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), "d") for i, t in [(1, one), (1, two), (2, three), (2, three), (3, two + " ")]], COLUMNS)
    got = corpus_pipeline.simhash_dedup(spark, docs, sf_dir)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == sorted([(1, one), (1, two), (2, three)])
