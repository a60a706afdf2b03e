import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filelode.functions import scalars as S


def human(n):
    value = float(n)
    for unit in S.UNITS:
        if value < 1024 or unit == "PiB":
            break
        value /= 1024
    return f"{value:.{2 if unit in ('GiB', 'TiB', 'PiB') else 0}f} {unit}"


def test_human_size_rounds_exact_values_half_to_even(spark):
    sizes = [0, 1, 22, 1023, 1024, 1536, 2233, 2560, 223344, 22334455, 1048575, 1073741823, 2233445566, 22334455667788, 2**50 - 1, 2**50]
    sizes += [1024 * k + 512 for k in range(6)] + [(1 << 30) * k // 200 for k in range(201, 260)]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert [r[1] for r in df.select("n", S.human_size(F.col("n"))).collect()] == [human(n) for n in sizes]


def test_parse_size(spark):
    cases = {"10MB": 10**7, "2.5 GiB": 5 * 2**29, ".5k": 500, "17": 17, " 3 tib ": 3 * 2**40, "1 pib": None, "x": None, "1.2.3 kb": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", S.parse_size(F.col("t"))).collect()} == cases


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=20))
def test_json_size_is_that_of_escaped_json(spark, texts):
    df = spark.createDataFrame([(json.dumps(t, ensure_ascii=False),) for t in texts if "\ud800" > "" and not any(0xD800 <= ord(c) < 0xE000 for c in t)] or [("{}",)], "t string")
    for r in df.select("t", S.json_size(F.col("t"))).collect():
        assert r[1] == len(json.dumps(json.loads(r[0])))


def test_small_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    h = "AB" * 32
    assert tuple(get(S.parse_hash(F.lit(h)))) == (h.lower(), "SHA-256")
    assert tuple(get(S.parse_hash(F.lit("quick:" + h)))) == (h.lower(), "QUICK")
    assert tuple(get(S.parse_hash(F.lit("md5:" + h)))) == (None, None)
    assert tuple(get(S.cell_reference(F.lit("A1:AB12")))) == (12, 28)
    assert get(S.coerce_integer(F.lit("3/12"))) == 3 and get(S.coerce_integer(F.lit("3.5"))) is None
    assert get(S.coerce_float(F.lit("1.5 / 2"))) == 1.5
    assert get(S.dataset_id(F.lit("https://x.example/d/some/iso-language"))) == "some/iso-language"
    assert get(S.clean_extension(F.lit(".PDF"))) == ".pdf" and get(S.clean_extension(F.lit("pdf"))) is None
    assert get(S.isbn(F.lit("978-0-306-40615-7"))) == "9780306406157"
    assert get(S.keywords(F.lit("a; b,,c "))) == ["a", "b", "c"]
    assert get(S.is_media_type(F.lit("é/png"))) and not get(S.is_media_type(F.lit("image")))
    assert get(S.icon(F.lit("text/x"), {"text": "t"}, "f")) == "t" and get(S.icon(F.lit("a/b"), {}, "f")) == "f"


def test_human_size_of_sizes_whose_hundredfold_is_no_long(spark):
    sizes = [2**56 + 2**49, 92_233_720_368_547_759, 2**62 + 3 * 2**42, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in sizes], "n long")
    assert [r[1] for r in df.select("n", S.human_size(F.col("n"))).collect()] == [human(n) for n in sizes]
