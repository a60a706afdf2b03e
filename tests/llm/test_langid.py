import random
import zlib

from filelode.llm import langid


def brute_phrases(parser, sample, text):
    """Greedy longest matches by substring search, from the first symbol to the last."""
    joined = []
    for s in sample:
        joined += parser.symbols(s).tolist() + [parser.width - 1]
    hay = "".join(chr(0x4E00 + x) for x in joined)
    total = 0
    symbols, i = parser.symbols(text).tolist(), 0
    while i < len(symbols):
        n = 0
        while i + n < len(symbols) and symbols[i + n] != parser.width - 1 and "".join(chr(0x4E00 + x) for x in symbols[i : i + n + 1]) in hay:
            n += 1
        i += max(n, 1)
        total += 1
    return total


def test_phrases_match_substring_search():
    rng = random.Random(4)
    samples = {
        "aa": ["".join(rng.choices("abcde ", k=200)) for _ in range(4)],
        "bb": ["".join(rng.choices("defghé. ", k=150)) for _ in range(4)],
    }
    parser = langid.Parser(samples, langid.Limits())
    texts = ["".join(rng.choices("abcdefghé ", k=rng.randint(1, 1500))) for _ in range(12)] + ["a", "z", "abzzcd", ""]
    got = parser.phrases([parser.symbols(t) for t in texts])
    for n, lang in enumerate(parser.langs):
        for i, t in enumerate(texts):
            assert got[n][i] == brute_phrases(parser, samples[lang], t)


def test_matches_that_reach_over_blocks(monkeypatch):
    rng = random.Random(6)
    sample = "".join(rng.choices("abc ", k=3000))
    parser = langid.Parser({"aa": [sample], "bb": ["ab" * 50]})
    texts = [sample[100:2900], sample[5:700] + "x" + sample[20:1500], "ab" * 2000, sample[:512], sample[:513]]
    got = parser.phrases([parser.symbols(t) for t in texts])
    for n, lang in enumerate(parser.langs):
        assert got[n].tolist() == [brute_phrases(parser, {"aa": [sample], "bb": ["ab" * 50]}[lang], t) for t in texts]
    assert got[0][0] == 1
    monkeypatch.setattr(langid, "SEGMENT", 1024)
    assert (parser.phrases([parser.symbols(t) for t in texts]) == got).all()


def test_languages_of_many_letters(spark):
    """Two languages that share half of some thousand letters, beside one of a few: all are told apart."""
    rng = random.Random(8)
    han = [chr(0x4E00 + k) for k in range(3000)]
    words = {
        "ja": ["".join(rng.choices(han[:2000], k=rng.randint(1, 3))) for _ in range(1500)],
        "zh": ["".join(rng.choices(han[1000:], k=rng.randint(1, 3))) for _ in range(1500)],
        "en": ["".join(rng.choices("abcdefghijklm", k=rng.randint(2, 7))) for _ in range(300)],
    }
    rows = [(i, "".join(rng.choices(words[lang], k=60)) if lang != "en" else " ".join(rng.choices(words[lang], k=40)), lang) for i in range(600) for lang in [("ja", "zh", "en")[i % 3]]]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    assert sum(r.lang_pred == ("ja", "zh", "en")[r.doc_id % 3] for r in got) >= 0.98 * len(got)


def test_whole_operator(spark):
    rng = random.Random(9)
    words = {"x1": ["the", "with", "and", "house"], "x2": ["der", "und", "ß", "haus"], "x3": ["les", "avec", "être", "maison"]}
    rows = [(i, " ".join(rng.choices(words[l], k=rng.randint(3, 60))), l) for i in range(240) for l in [f"x{i % 3 + 1}"]]
    rows += [(1000, None, "x1"), (1001, "", "x1"), (1002, "123 !?", "x2"), (1003, "avec être " * 4000, None), (1004, "日本", None), (None, "der und haus", "x2"), rows[0]]
    df = spark.createDataFrame([(i, t, l, "s", 0.5) for i, t, l in rows], "doc_id long, text string, lang string, source string, score double")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    truth = {i: l for i, t, l in rows if i is not None and i < 1000}
    held = [i for i in truth if by_id[i].held_out]
    assert held and sum(by_id[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    for i in truth:
        assert by_id[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= by_id[i].score <= 1
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "x3"]
    assert by_id[1004].lang_pred in {"x1", "x2", "x3"} and by_id[1000].score == 0
    assert langid.identify(df.limit(0)).collect() == []
    none = langid.identify(df.where("lang IS NULL")).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_rows_without_id_and_repeated_ids_are_learned_from(spark):
    rng = random.Random(3)
    words = {"aa": ["the", "with", "and", "house", "street"], "bb": ["der", "und", "strasse", "haus", "mit"]}
    text = lambda l: " ".join(rng.choices(words[l], k=12))
    for ids in (lambda n: None, lambda n: 7, lambda n: n % 3):
        rows = [(ids(n), text(l), l) for n in range(200) for l in words]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        parser = langid.train(df)
        langs, _ = parser.predict([t for _, t, _ in rows])
        assert langs == [l for *_, l in rows]


def test_the_draw_is_bounded_whatever_is_repeated(spark):
    rows = [(1, "the house " * 50, "aa")] * 3000 + [(n, f"street {n} " * 30, "aa") for n in range(20)] + [(n, "mit der strasse " * 20, "bb") for n in range(400)]
    seen = []
    parser = langid.Parser
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langid.Parser = lambda samples, limits: seen.append(samples) or parser(samples, limits)
    try:
        langid.train(df, langid.Limits(rows=30, letters=2000))
    finally:
        langid.Parser = parser
    assert sum(map(len, seen[0]["aa"][:-1])) < 2000 and sum(map(len, seen[0]["bb"][:-1])) < 2000
    assert len(seen[0]["aa"]) > 1 and len(set(seen[0]["aa"])) == len(seen[0]["aa"])
