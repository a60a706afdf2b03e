"""The named queries over the driver's tables and their SQL twins. A name starts with the operator's handle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelode.functions import scalars as S
from filelode.functions.dates import pdf_date
from filelode.functions.layout import page_tokens
from filelode.operators import aggregates as A
from filelode.operators import filters, sets
from filelode.sources.hashes import blake3_of
from filelode.plans.views import BIG_FILES_SQL, FILES_SQL, big_files, files, numbered, read, tags

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def named(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(query: Query) -> Query:
        _QUERIES[name] = query
        if sql is not None:
            _ORACLES[name] = sql
        return query

    return register


# Scalar functions

_HALF_EVEN = """CASE WHEN n < 1024 THEN n::VARCHAR || ' B'
  WHEN n < 1048576 THEN {kib} || ' KiB' WHEN n < 1073741824 THEN {mib} || ' MiB'
  WHEN n < 1099511627776 THEN {gib} || ' GiB' WHEN n < 1125899906842624 THEN {tib} || ' TiB' ELSE {pib} || ' PiB' END"""


def _rounded(k: int) -> str:
    d, s = 1 << (10 * k), 100 if k > 2 else 1
    q = f"((n::HUGEINT * {s}) // {d})"
    r = f"((n::HUGEINT * {s}) % {d})"
    v = f"({q} + CASE WHEN 2 * {r} > {d} OR (2 * {r} = {d} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"{v}::VARCHAR" if s == 1 else f"({v} // 100)::VARCHAR || '.' || lpad(({v} % 100)::VARCHAR, 2, '0')"


SIZE_TEXT_SQL = _HALF_EVEN.format(kib=_rounded(1), mib=_rounded(2), gib=_rounded(3), tib=_rounded(4), pib=_rounded(5))


@named(
    "s1_human_size",
    f"WITH s AS (SELECT o_orderkey, (o_orderkey + 3)::BIGINT * (o_orderkey + 1) * (1 + (o_custkey % 5) * 10000003) % 900719925474099 AS n FROM orders) "
    f"SELECT o_orderkey, n AS size, {SIZE_TEXT_SQL} AS text FROM s",
)
def s1_human_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, factor, most = F.col("o_orderkey"), 1 + (F.col("o_custkey") % 5) * 10000003, F.lit(900719925474099)
    pairs = (key + 3).cast("decimal(19,0)") * (key + 1).cast("decimal(19,0)") % most  # the product of all three is no long beyond some 480,000 orders
    size = (pairs * factor.cast("decimal(19,0)") % most).cast("long")
    return read(spark, sf_dir, "orders").select("o_orderkey", size.alias("size")).select("o_orderkey", "size", S.human_size(F.col("size")).alias("text"))


_UNITS_SQL = "CASE u " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in S.SIZE_UNITS.items()) + " END"


@named(
    "s2_parse_size",
    f"""WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || ' GiB' WHEN 1 THEN p_size || '.5kb' WHEN 2 THEN ' .25 MB '
      WHEN 3 THEN p_size::VARCHAR WHEN 4 THEN p_size || ' pib' ELSE p_name END AS text FROM part),
    m AS (SELECT *, lower(regexp_extract(text, '^\\s*(\\d*\\.?\\d+)\\s*([a-zA-Z]+)\\s*$', 2)) AS u,
      TRY_CAST(regexp_extract(text, '^\\s*(\\d*\\.?\\d+)\\s*([a-zA-Z]+)\\s*$', 1) AS DOUBLE) AS v FROM t)
    SELECT p_partkey, text, CASE WHEN u <> '' THEN trunc(v * {_UNITS_SQL})::BIGINT ELSE TRY_CAST(trim(text) AS BIGINT) END AS bytes FROM m""",
)
def s2_parse_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 6
    text = (
        F.when(kind == 0, F.concat(size, F.lit(" GiB"))).when(kind == 1, F.concat(size, F.lit(".5kb"))).when(kind == 2, " .25 MB ")
        .when(kind == 3, size).when(kind == 4, F.concat(size, F.lit(" pib"))).otherwise(F.col("p_name"))
    )
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("text"), S.parse_size(text).alias("bytes"))


@named(
    "s3_json_size",
    "SELECT conv_id, turn, sum(CASE WHEN unicode(c) < 127 THEN 1 WHEN unicode(c) < 65536 THEN 6 ELSE 12 END)::BIGINT AS bytes "
    "FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?s).')) AS c FROM conversations) GROUP BY conv_id, turn",
)
def s3_json_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", S.json_size(F.col("text")).cast("long").alias("bytes"))


@named("s4_content_hash", f"WITH {FILES_SQL} SELECT ordinal, hash FROM files")
def s4_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("ordinal", "hash")


@named("s5_bounded_string", "SELECT doc_id, CASE WHEN length(text) > 0 THEN substr(text, 1, 255) END AS text FROM documents")
def s5_bounded_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", S.bounded(F.col("text")).alias("text"))


@named(
    "s8_strip_keywords",
    r"""SELECT page_id, CASE WHEN trim(regexp_replace(html, '<[^>]+>', '', 'g')) <> '' THEN trim(regexp_replace(html, '<[^>]+>', '', 'g')) END AS stripped,
    list_filter(list_transform(regexp_split_to_array(url, '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS keywords FROM pages""",
)
def s8_strip_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", S.strip_tags(F.col("html")).alias("stripped"), S.keywords(F.col("url")).alias("keywords"))


@named(
    "s8_isbn",
    r"""WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ISBN: ' || (9780000000000 + p_partkey) WHEN 1 THEN 'urn:isbn:' || (100000000 + p_partkey) || 'X'
      WHEN 2 THEN '978-0-' || (100000000 + p_partkey) WHEN 3 THEN ' ' || (1000000000 + p_partkey) || ' ' ELSE p_name END AS text FROM part)
    SELECT p_partkey, text, CASE WHEN regexp_extract(text, '(?:ISBN[ \t]*:?|urn:isbn:)\s*([0-9]{9,12}[0-9X])', 1) <> ''
      THEN regexp_extract(text, '(?:ISBN[ \t]*:?|urn:isbn:)\s*([0-9]{9,12}[0-9X])', 1)
      WHEN regexp_full_match(trim(replace(text, '-', '')), '[0-9]{9}[0-9X]|[0-9]{13}') THEN trim(replace(text, '-', '')) END AS isbn FROM t""",
)
def s8_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, kind = F.col("p_partkey"), F.col("p_partkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("ISBN: "), (key + 9780000000000).cast("string")))
        .when(kind == 1, F.concat(F.lit("urn:isbn:"), (key + 100000000).cast("string"), F.lit("X")))
        .when(kind == 2, F.concat(F.lit("978-0-"), (key + 100000000).cast("string")))
        .when(kind == 3, F.concat(F.lit(" "), (key + 1000000000).cast("string"), F.lit(" "))).otherwise(F.col("p_name"))
    )
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("text"), S.isbn(text).alias("isbn"))


@named(
    "s9_coercions",
    r"""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_quantity::INT || '/' || l_suppkey WHEN 2 THEN l_quantity::INT || ' / 2.5'
      WHEN 3 THEN ' ' || l_quantity::INT || ' ' WHEN 4 THEN l_quantity::INT || '.5' WHEN 5 THEN l_quantity::INT || '.25/4' ELSE l_returnflag END AS text FROM lineitem)
    SELECT l_orderkey, l_linenumber, text,
      coalesce(CASE WHEN regexp_full_match(trim(text), '[+-]?\d+') THEN TRY_CAST(trim(text) AS BIGINT) END,
        TRY_CAST(regexp_extract(trim(text), '^([+-]?\d+)\s*/\s*[+-]?(?:\d*\.)?\d+$', 1) AS BIGINT)) AS whole,
      coalesce(TRY_CAST(trim(text) AS DOUBLE), TRY_CAST(regexp_extract(trim(text), '^([+-]?(?:\d*\.)?\d+)\s*/\s*[+-]?(?:\d*\.)?\d+$', 1) AS DOUBLE)) AS number FROM t""",
)
def s9_coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, kind = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    text = (
        F.when(kind == 1, F.concat(n, F.lit("/"), F.col("l_suppkey").cast("string"))).when(kind == 2, F.concat(n, F.lit(" / 2.5")))
        .when(kind == 3, F.concat(F.lit(" "), n, F.lit(" "))).when(kind == 4, F.concat(n, F.lit(".5")))
        .when(kind == 5, F.concat(n, F.lit(".25/4"))).otherwise(F.col("l_returnflag"))
    )
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", text.alias("text"), S.coerce_integer(text).alias("whole"), S.coerce_float(text).alias("number")
    )


@named(
    "s10_media_type_parts",
    "SELECT page_id, split_part('text/html; charset=' || page_id, '/', 1) AS head, trim(split_part(' text/html ; charset=' || page_id, ';', 1)) AS plain FROM pages",
)
def s10_media_type_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id").cast("string")
    return read(spark, sf_dir, "pages").select(
        "page_id", S.media_head(F.concat(F.lit("text/html; charset="), key)).alias("head"), S.without_parameters(F.concat(F.lit(" text/html ; charset="), key)).alias("plain")
    )


@named(
    "s11_cell_reference",
    "SELECT p_partkey, p_size AS rows, (p_partkey % 26 + 1) * 26 + (p_size % 26 + 1) AS cols FROM part",
)
def s11_cell_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.concat(F.char(65 + F.col("p_partkey") % 26), F.char(65 + F.col("p_size") % 26))
    cell = S.cell_reference(F.concat(F.lit("A1:"), letters, F.col("p_size").cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", cell["rows"].alias("rows"), cell["cols"].cast("long").alias("cols"))


@named(
    "s12_icon",
    f"WITH {FILES_SQL} SELECT ordinal, CASE media_type WHEN 'text/en' THEN 'book' WHEN 'text/fr' THEN 'page' ELSE 'text' END AS icon FROM files",
)
def s12_icon(spark: SparkSession, sf_dir: str) -> DataFrame:
    icons = {"text/en": "book", "text/fr": "page", "text": "text"}
    return files(spark, sf_dir).select("ordinal", S.icon(F.col("media_type"), icons, "file").alias("icon"))


@named("s13_record_url", f"WITH {FILES_SQL} SELECT ordinal, 'https://records.example/f/' || hash AS url FROM files")
def s13_record_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("ordinal", S.record_url("https://records.example/f/", F.col("hash")).alias("url"))


@named(
    "f10_parse_hash",
    rf"""WITH {FILES_SQL}, t AS (SELECT ordinal, CASE ordinal % 6 WHEN 0 THEN upper(hash) WHEN 1 THEN 'BLAKE3:' || hash WHEN 2 THEN 'sha-256:' || upper(hash)
      WHEN 3 THEN 'T1' || hash || 'abcdef' WHEN 4 THEN 'quick:' || substr(hash, 2) ELSE 'tlsh:t1' || hash || 'ABCDEF' END AS text FROM files)
    SELECT ordinal, CASE ordinal % 6 WHEN 0 THEN lower(text) WHEN 1 THEN substr(text, 8) WHEN 2 THEN lower(substr(text, 9)) WHEN 3 THEN lower(text)
      WHEN 5 THEN lower(substr(text, 6)) END AS value,
      CASE ordinal % 6 WHEN 0 THEN 'SHA-256' WHEN 1 THEN 'BLAKE3' WHEN 2 THEN 'SHA-256' WHEN 3 THEN 'TLSH' WHEN 5 THEN 'TLSH' END AS function FROM t""",
)
def f10_parse_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, kind = F.col("hash"), F.col("ordinal") % 6
    text = (
        F.when(kind == 0, F.upper(h)).when(kind == 1, F.concat(F.lit("BLAKE3:"), h)).when(kind == 2, F.concat(F.lit("sha-256:"), F.upper(h)))
        .when(kind == 3, F.concat(F.lit("T1"), h, F.lit("abcdef"))).when(kind == 4, F.concat(F.lit("quick:"), F.substring(h, 2, 99)))
        .otherwise(F.concat(F.lit("tlsh:t1"), h, F.lit("ABCDEF")))
    )
    return files(spark, sf_dir).withColumn("p", S.parse_hash(text)).select("ordinal", "p.value", "p.function")


@named(
    "f11_extension_and_media_type",
    r"""SELECT p_partkey, CASE WHEN regexp_full_match('.' || p_name, '\.[a-zA-Z0-9_!-]{1,16}') THEN lower('.' || p_name) END AS spaced,
      lower('.' || p_type) AS extension, regexp_full_match(p_type || '/' || p_name, '\w+/[-+.\w]+') AS is_type FROM part""",
)
def f11_extension_and_media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    dot = lambda c: F.concat(F.lit("."), F.col(c))
    kind = F.concat("p_type", F.lit("/"), "p_name")
    return read(spark, sf_dir, "part").select(
        "p_partkey", S.clean_extension(dot("p_name")).alias("spaced"), S.clean_extension(dot("p_type")).alias("extension"), S.is_media_type(kind).alias("is_type")
    )


@named(
    "f12_dataset_id",
    r"""WITH t AS (SELECT page_id, regexp_extract(url, '^(?:.*/)?([a-z0-9\-]{3,32}/[a-z0-9\-]{3,32})$', 1) AS id FROM pages)
    SELECT page_id, CASE WHEN id <> '' AND NOT contains(id, '--') THEN id END AS dataset_id FROM t""",
)
def f12_dataset_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", S.dataset_id(F.col("url")).alias("dataset_id"))


@named(
    "s7_pdf_date",
    """SELECT o_orderkey, CASE o_custkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate - INTERVAL 150 MINUTE, '%Y-%m-%d %H:%M:%S')
      WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS at FROM orders""",
)
def s7_pdf_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, kind = F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_custkey") % 5
    text = (
        F.when(kind == 0, F.concat(F.lit("D:"), day, F.date_format("o_orderdate", "HHmmss"), F.lit("Z")))
        .when(kind == 1, F.concat(F.lit("(D:"), day, F.date_format("o_orderdate", "HHmmss"), F.lit("+02'30')")))
        .when(kind == 2, F.concat(day, F.lit("9956261"))).when(kind == 3, F.lit("none")).otherwise(F.col("o_orderpriority"))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(pdf_date(text), "yyyy-MM-dd HH:mm:ss").alias("at"))


@named(
    "sc10_page_tokens",
    """SELECT l_orderkey, l_partkey, l_linenumber, least(greatest(trunc(l_quantity / 40 * 1000)::INT, 0), 1000) AS x0, least(greatest(trunc((50 - l_tax * 1000) / 50 * 1000)::INT, 0), 1000) AS y0 FROM lineitem""",
)
def sc10_page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, t = F.col("l_quantity"), F.col("l_tax") * 1000
    token = F.struct(F.col("l_returnflag").alias("text"), q.alias("left"), F.lit(0.0).alias("bottom"), (q + 1).alias("right"), t.alias("top"))
    boxes = page_tokens(F.array(token), F.lit(40.0), F.lit(50.0), "per_mille")
    box = F.get(boxes, F.lit(0))["box"]
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.get(box, F.lit(0)).alias("x0"), F.get(box, F.lit(1)).alias("y0"))


@named("h1_blake3")
def h1_blake3(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", blake3_of(text).alias("blake3"))


# Filters


@named(
    "f1_filter",
    f"WITH {FILES_SQL} SELECT ordinal, name FROM files WHERE size > 1000 AND size <= 9000 AND media_type IN ('text/en', 'text/de') AND contains(name, '1') AND source IS NOT DISTINCT FROM 'src1'",
)
def f1_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.matching(files(spark, sf_dir), size__gt=1000, size__lte=9000, media_type__in=["text/en", "text/de"], name__contains="1", source="src1")
    return found.select("ordinal", "name")


@named(
    "f2_f3_size_bounds",
    f"""WITH {BIG_FILES_SQL} SELECT 'collection' AS rule, count(*) AS files FROM big_files WHERE size > 1000000 AND size <= 50000000
    UNION ALL SELECT 'directory', count(*) FROM big_files WHERE size BETWEEN 1000000 AND 50000000""",
)
def f2_f3_size_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lo, hi = big_files(spark, sf_dir), 1_000_000, 50_000_000
    collection = rows.where((F.col("size") > lo) & (F.col("size") <= hi)).agg(F.count(F.lit(1)).alias("files"))
    directory = rows.where(filters.size_allows(F.col("size"), lo, hi)).agg(F.count(F.lit(1)).alias("files"))
    return collection.select(F.lit("collection").alias("rule"), "files").unionByName(directory.select(F.lit("directory").alias("rule"), "files"))


@named(
    "f4_f7_dependencies",
    f"""WITH {BIG_FILES_SQL} SELECT ordinal, media_type <> 'x/AF1' AND (media_type IN ('x/AF2', 'x/NO3') OR regexp_matches(media_type, '^(?:x/R)')) AS media_ok,
      extension IN ('.1', '.2') AS extension_ok, size >= 1000 AND size <= 1000000 AS size_ok, regexp_matches(name, '7$') AS name_ok FROM big_files""",
)
def f4_f7_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return big_files(spark, sf_dir).select(
        "ordinal",
        filters.media_type_allows(F.col("media_type"), ["x/AF2", "x/NO3"], ["x/AF1"], include_pattern="x/R").alias("media_ok"),
        filters.extension_allows(F.col("extension"), ["1", ".2"]).alias("extension_ok"),
        filters.size_allows(F.col("size"), 1000, 1_000_000).alias("size_ok"),
        filters.name_allows(F.col("name"), "7$").alias("name_ok"),
    )


@named(
    "f14_search",
    f"WITH {FILES_SQL} SELECT min(ordinal) AS ordinal, hash FROM files WHERE contains(lower(name), 'doc_1') AND extension = '.en' AND size > 2000 GROUP BY hash",
)
def f14_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search(files(spark, sf_dir), "doc_1 extension:en size:>2kb", deduplicate=True).select("ordinal", "hash")


@named(
    "f16_vocabulary_linter",
    """WITH c AS (SELECT user_id, list(event_type ORDER BY event_id) AS labels FROM events GROUP BY user_id)
    SELECT user_id, list_filter(labels, lambda x: NOT list_contains(['click', 'view'], x)) AS missing FROM c""",
)
def f16_vocabulary_linter(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.coalesce(F.col("event_type").isin("click", "view"), F.lit(False))
    unknown = F.when(~known, F.struct("event_id", "event_type"))  # what is in the vocabulary is never gathered
    labels = F.transform(F.array_sort(F.collect_list(unknown)), lambda x: x["event_type"])
    by = read(spark, sf_dir, "events").groupBy("user_id").agg(labels.alias("labels"))
    return by.select("user_id", filters.outside_vocabulary(F.col("labels"), F.array(F.lit("click"), F.lit("view"))).alias("missing"))


@named(
    "f17_hash_integrity",
    f"""WITH {FILES_SQL} SELECT ordinal, CASE ordinal % 4 WHEN 0 THEN [] WHEN 1 THEN ['BLAKE3 missing'] WHEN 2 THEN ['hash is not the SHA-256'] ELSE ['repeated hash id', 'equal hashes'] END AS faults FROM files""",
)
def f17_hash_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, h = F.col("ordinal") % 4, F.col("hash")
    pair = lambda i, v: F.struct(F.lit(i).alias("id"), v.alias("value"))
    sha, blake, other = pair("SHA-256", h), pair("BLAKE3", F.reverse(h)), pair("SHA-256", F.reverse(h))
    all_hashes = F.when(kind == 1, F.array(sha)).when(kind == 2, F.array(other, blake)).when(kind == 3, F.array(sha, blake, blake)).otherwise(F.array(sha, blake))
    twin = F.when(kind == 3, h)
    return files(spark, sf_dir).select("ordinal", filters.hash_faults(h, all_hashes, [twin]).alias("faults"))


@named(
    "f19_tags",
    r"""SELECT p_name AS hash, p_brand AS name, p_type AS value, count(*) AS times, regexp_full_match(p_brand, '[a-zA-Z0-9_]{3,64}') AS valid
    FROM part GROUP BY ALL HAVING count(*) > 1""",
)
def f19_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.repeated_tags(tags(spark, sf_dir)).withColumn("valid", filters.valid_tag_name(F.col("name")))


# Aggregates


@named(
    "a1_overall",
    f"""WITH {FILES_SQL} SELECT count(*) AS total_files, sum(size)::BIGINT AS total_size, round(sum(size) / count(*), 6) AS avg_size,
      (SELECT name FROM files ORDER BY size DESC, ordinal LIMIT 1) AS largest, (SELECT name FROM files ORDER BY size, ordinal LIMIT 1) AS smallest,
      (SELECT name FROM files ORDER BY date_modified DESC, ordinal LIMIT 1) AS newest, (SELECT name FROM files ORDER BY date_modified, ordinal LIMIT 1) AS oldest FROM files""",
)
def a1_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overall(files(spark, sf_dir))


_SHARE_SQL = """SELECT {k}, count(*) AS files, sum(size)::BIGINT AS total_size, round(sum(size) * 100.0 / (SELECT sum(size) FROM {t}), 6) AS percentage
FROM {t} GROUP BY {k}"""


@named("a2_by_type", f"WITH {FILES_SQL} " + _SHARE_SQL.format(k="media_type", t="files"))
def a2_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.share_by(files(spark, sf_dir), "media_type")


@named("a2_by_type_large", f"WITH {BIG_FILES_SQL} " + _SHARE_SQL.format(k="media_type", t="big_files"))
def a2_by_type_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.share_by(big_files(spark, sf_dir), "media_type")


@named("a3_by_source", f"WITH {FILES_SQL} " + _SHARE_SQL.format(k="source", t="files"))
def a3_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.share_by(files(spark, sf_dir), "source")


_DUPLICATES_SQL = """SELECT hash, count(*) AS copies, arg_min(size, ordinal) AS size, arg_min(name, ordinal) AS first_name,
  arg_min(size, ordinal) * (count(*) - 1) AS wasted FROM {t} WHERE {w} GROUP BY hash HAVING count(*) > 1"""


@named("a4_duplicates", f"WITH {FILES_SQL} " + _DUPLICATES_SQL.format(t="files", w="size > 100"))
def a4_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicate_sets(files(spark, sf_dir), min_size=100)


@named(
    "a4_duplicate_members",
    f"WITH {FILES_SQL} SELECT hash, ordinal, name FROM files WHERE hash IN (SELECT hash FROM files GROUP BY hash HAVING count(*) > 1)",
)
def a4_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    return A.duplicate_members(rows, A.duplicate_sets(rows))


@named(
    "a4_duplicate_totals",
    f"WITH {FILES_SQL}, d AS ({_DUPLICATES_SQL.format(t='files', w='TRUE')}), t AS (SELECT count(*) AS total_sets, sum(copies)::BIGINT AS files, sum(wasted)::BIGINT AS n FROM d) "
    f"SELECT total_sets, files, n AS wasted, {SIZE_TEXT_SQL} AS wasted_text FROM t",
)
def a4_duplicate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.duplicate_totals(A.duplicate_sets(files(spark, sf_dir)))


@named(
    "a5_staged_duplicates",
    f"""WITH {FILES_SQL} SELECT hash, count(*) AS copies, min(size) AS size FROM files WHERE size BETWEEN 200 AND 100000 GROUP BY hash HAVING count(*) > 1""",
)
def a5_staged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).withColumn("quick", F.substring("hash", 1, 8))
    return A.staged_duplicates(rows, 200, 100_000, quick="quick")


@named(
    "a6_directory_summary",
    """WITH s AS (SELECT *, l_linenumber = 7 AS is_dir, CASE WHEN l_suppkey % 10 = 0 THEN NULL ELSE l_quantity::BIGINT END AS size,
      CASE WHEN l_partkey % 3 = 0 THEN '.' ELSE '' END || l_partkey AS name, l_partkey % 512 AS mode FROM lineitem), f AS (SELECT * FROM s WHERE NOT is_dir)
    SELECT (SELECT count(*) FROM f) AS total_files, (SELECT count(*) FROM s WHERE is_dir) AS total_dirs, (SELECT count(*) FROM f WHERE name LIKE '.%') AS hidden_files,
      sum(size)::BIGINT AS total_size, round(avg(size), 6) AS avg_size, count(*) FILTER ((mode & 256) <> 0 AND (mode & 128) = 0) AS read_only,
      count(*) FILTER ((mode & 128) <> 0 AND (mode & 256) = 0) AS write_only, count(*) FILTER ((mode & 64) <> 0) AS executable FROM f WHERE size IS NOT NULL""",
)
def a6_directory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_partkey")
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") == 7).alias("is_dir"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_quantity").cast("long")).alias("size"),
        F.concat(F.when(key % 3 == 0, ".").otherwise(""), key.cast("string")).alias("name"),
        (key % 512).alias("mode"),
    )
    return A.directory_summary(rows)


def _panel_sql(key: str, value: str, name: str, where: str = "TRUE", table: str = "big_files") -> str:
    return f"""WITH {BIG_FILES_SQL}, g AS (SELECT {key}, {value} AS {name}, min(ordinal) AS o FROM {table} WHERE {where} GROUP BY {key}),
    r AS (SELECT *, row_number() OVER (ORDER BY {name} DESC, o) AS rn FROM g)
    SELECT CASE WHEN rn <= 14 THEN {key} ELSE 'Other' END AS {key}, sum({name})::BIGINT AS {name} FROM r GROUP BY ALL"""


@named("a7_media_types_by_count", _panel_sql("media_type", "count(*)", "count"))
def a7_media_types_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.panel_by(big_files(spark, sf_dir), "media_type", "count")


@named("a7_media_types_by_size", _panel_sql("media_type", "sum(size)::BIGINT", "total_size"))
def a7_media_types_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.panel_by(big_files(spark, sf_dir), "media_type", "total_size")


@named("a7_extensions_by_count", _panel_sql("extension", "count(*)", "count", "extension <> ''"))
def a7_extensions_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.panel_by(big_files(spark, sf_dir), "extension", "count")


@named("a7_timeline", f"WITH {FILES_SQL} SELECT ordinal, strftime(date_modified, '%Y-%m-%dT%H:%M:%S') AS x, name AS y FROM files")
def a7_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.timeline(files(spark, sf_dir))


@named("a7_extensions_by_size", _panel_sql("extension", "sum(size)::BIGINT", "total_size", "extension <> ''"))
def a7_extensions_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.panel_by(big_files(spark, sf_dir), "extension", "total_size")


@named(
    "a7_largest_files",
    f"""WITH {BIG_FILES_SQL}, r AS (SELECT name, size, ordinal, row_number() OVER (ORDER BY size DESC, ordinal) AS rn FROM big_files)
    SELECT name, size FROM r WHERE rn <= 14 UNION ALL SELECT 'Other', sum(size)::BIGINT FROM r WHERE rn > 14""",
)
def a7_largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.largest_files(big_files(spark, sf_dir))


@named(
    "a8_size_histogram",
    f"""WITH {BIG_FILES_SQL}, p AS (SELECT size, row_number() OVER (ORDER BY size) AS rn FROM big_files WHERE size > 0),
    k AS (SELECT count(*) AS n, min(size) AS lo, max(size) AS hi, (count(*) + 1) // 4 AS j1, (count(*) + 1) % 4 AS d1,
      3 * (count(*) + 1) // 4 AS j3, 3 * (count(*) + 1) % 4 AS d3 FROM p),
    q AS (SELECT n, lo, hi, ((SELECT size FROM p WHERE rn = j1) * (4 - d1) + (SELECT size FROM p WHERE rn = j1 + 1) * d1) / 4 AS q1,
      ((SELECT size FROM p WHERE rn = j3) * (4 - d3) + (SELECT size FROM p WHERE rn = j3 + 1) * d3) / 4 AS q3 FROM k),
    b AS (SELECT *, greatest(1, least(25, ceil((hi - lo) / (2 * (q3 - q1) / (n ** (1.0 / 3))))))::INT AS bins FROM q),
    e AS (SELECT i AS bin, CASE WHEN hi / lo > 1000 THEN 10 ** (log10(lo) + i * (log10(hi) - log10(lo)) / bins) ELSE lo + i * (hi - lo) / bins END AS a,
      CASE WHEN hi / lo > 1000 THEN 10 ** (log10(lo) + (i + 1) * (log10(hi) - log10(lo)) / bins) ELSE lo + (i + 1) * (hi - lo) / bins END AS z, i = bins - 1 AS last FROM b, range(25) t(i) WHERE i < bins)
    SELECT bin::INT AS bin, round(a, 3) AS lower, round(z, 3) AS upper, count(*) AS count FROM e JOIN p ON size >= a AND (size < z OR (last AND size = z)) GROUP BY ALL""",
)
def a8_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.size_histogram(big_files(spark, sf_dir))


@named("a9_cache_summary", "SELECT count(*) AS total, count(toxic) AS full_records, count(*) - count(toxic) AS hash_only FROM documents LEFT JOIN labels USING (doc_id)")
def a9_cache_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return A.cache_summary(rows.withColumn("record", F.col("toxic")))


@named("a11_batch_totals", "SELECT o_orderkey // 1000 AS batch, count(*) AS rows, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS total FROM orders GROUP BY 1")
def a11_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").withColumn("batch", F.floor(F.col("o_orderkey") / 1000))
    return A.batch_totals(rows, "batch", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0))


@named(
    "a12_tracks",
    """SELECT l_orderkey AS file, arg_min(l_returnflag, l_linenumber * 1000000000::BIGINT + l_partkey) FILTER (l_linenumber <= 2) AS general_format,
    count(*) FILTER (l_linenumber > 2) AS other_tracks, count(DISTINCT CASE WHEN l_linenumber <= 2 THEN 'General' WHEN l_linenumber <= 4 THEN 'Video' ELSE 'Audio' END) AS kinds
    FROM lineitem GROUP BY l_orderkey""",
)
def a12_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = numbered(read(spark, sf_dir, "lineitem")).select(
        F.col("l_orderkey").alias("file"), (n * F.lit(1_000_000_000).cast("long") + F.col("l_partkey")).alias("track_no"), F.col("l_returnflag").alias("format"),
        F.when(n <= 2, "General").when(n <= 4, "Video").otherwise("Audio").alias("kind"), "row",
    )
    return A.tracks_by_type(rows, then=["row"])


@named(
    "a13_merged_results",
    """WITH r AS (SELECT l_orderkey AS file, l_returnflag AS schema, l_linenumber * 1000000000::BIGINT + l_partkey AS step, l_linestatus || l_partkey || '-' || l_suppkey AS record
      FROM lineitem WHERE l_quantity <> 13)
    SELECT file, schema, CASE WHEN schema = 'A' THEN [arg_max(record, (step, record))] ELSE list(record ORDER BY step, record) END AS records FROM r GROUP BY file, schema""",
)
def a13_merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("schema"), (F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey")).alias("step"),
        F.concat("l_linestatus", F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("record"), F.when(F.col("l_quantity") == 13, "failed").alias("error"),
    )
    return A.merged_results(rows, core=["A"])


# Orders, sets, lookups


@named("o1_scan_order", f"WITH {FILES_SQL} SELECT name, size, media_type FROM files ORDER BY media_type DESC, ordinal LIMIT 20")
def o1_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.scan_order(files(spark, sf_dir), "media_type", descending=True).select("name", "size", "media_type")


@named("o4_most_recent", f"WITH {FILES_SQL} SELECT ordinal, name FROM files ORDER BY date_modified DESC, ordinal LIMIT 1")
def o4_most_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.most_recent(files(spark, sf_dir)).select("ordinal", "name")


@named("o5_page", f"WITH {FILES_SQL} SELECT ordinal, name FROM files ORDER BY ordinal LIMIT 25 OFFSET 50")
def o5_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.page(files(spark, sf_dir), 3, 25, [F.col("ordinal")]).select("ordinal", "name")


_HALVES_SQL = "l AS (SELECT * FROM files WHERE ordinal % 3 <> 0), r AS (SELECT * FROM files WHERE ordinal % 3 <> 1)"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = files(spark, sf_dir)
    return rows.where("ordinal % 3 != 0"), rows.where("ordinal % 3 != 1")


@named(
    "u1_union_by_hash",
    f"""WITH {FILES_SQL}, {_HALVES_SQL}, b AS (SELECT 0 AS side, * FROM l UNION ALL SELECT 1, * FROM r)
    SELECT hash, arg_min(side, (side, ordinal)) AS side, arg_min(ordinal, (side, ordinal)) AS ordinal, arg_max(name, (side, ordinal)) AS name FROM b GROUP BY hash""",
)
def u1_union_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union_by_hash(*_halves(spark, sf_dir)).select("hash", "side", "ordinal", "name")


@named("u2_difference", f"WITH {FILES_SQL}, {_HALVES_SQL} SELECT ordinal, hash FROM l WHERE hash NOT IN (SELECT hash FROM r)")
def u2_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.difference_by_hash(*_halves(spark, sf_dir)).select("ordinal", "hash")


@named(
    "sc5_deduplicating_scan",
    f"WITH {FILES_SQL} SELECT ordinal, hash, CASE WHEN ordinal = min(ordinal) OVER (PARTITION BY hash) THEN 'processed' ELSE 'duplicate' END AS status FROM files",
)
def sc5_deduplicating_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.first_of_hash(files(spark, sf_dir)).select("ordinal", "hash", "status")


@named(
    "j1_fresh_lookup",
    """SELECT o.o_orderkey AS path, CASE WHEN l_orderkey IS NOT NULL THEN 'cache' ELSE 'disk' END AS origin FROM orders o
    LEFT JOIN (SELECT DISTINCT l_orderkey, date_trunc('month', l_shipdate) AS m FROM lineitem) c ON o_orderkey = l_orderkey AND date_trunc('month', o_orderdate) = m""",
)
def j1_fresh_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = lambda c: F.date_trunc("month", c)
    asked = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), month("o_orderdate").alias("modified"))
    held = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), month("l_shipdate").alias("modified")).distinct().withColumn("hash", F.lit("h"))
    return sets.fresh(asked, held).select("path", "origin")


@named("j4_is_indexed", f"WITH {FILES_SQL}, {_HALVES_SQL} SELECT ordinal, hash IN (SELECT hash FROM r) AS indexed FROM l")
def j4_is_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _halves(spark, sf_dir)
    return sets.is_indexed(left, right).select("ordinal", "indexed")


@named(
    "j5_collection_diff",
    f"""WITH {FILES_SQL}, {_HALVES_SQL}, s AS (SELECT hash, max(o) AS o, max(n) AS n FROM (SELECT hash, 1 AS o, 0 AS n FROM l UNION ALL SELECT hash, 0, 1 FROM r) GROUP BY hash)
    SELECT count(*) FILTER (o = 0) AS added, count(*) FILTER (n = 0) AS removed, count(*) FILTER (o = 1 AND n = 1) AS unchanged FROM s""",
)
def j5_collection_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.collection_diff(*_halves(spark, sf_dir))


@named(
    "j6_identify",
    f"""WITH {FILES_SQL}, f AS (SELECT *, substr(hash, 1, 3) AS quick FROM files), r AS (SELECT * FROM f WHERE ordinal % 3 <> 0),
    q AS (SELECT quick, min(ordinal) AS id FROM r GROUP BY quick HAVING count(*) = 1), s AS (SELECT hash, min(ordinal) AS id FROM r GROUP BY hash)
    SELECT f.ordinal, coalesce(q.id, s.id) AS record_id, CASE WHEN q.id IS NOT NULL THEN 'QUICK' WHEN s.id IS NOT NULL THEN 'SHA-256' END AS method
    FROM f LEFT JOIN q USING (quick) LEFT JOIN s USING (hash)""",
)
def j6_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("ordinal", "hash", F.substring("hash", 1, 3).alias("quick_hash"))
    records = rows.where("ordinal % 3 != 0").select(F.col("ordinal").alias("record_id"), "hash", "quick_hash")
    return sets.identify(rows, records)


def queries() -> dict[str, Query]:
    from filelode.plans import collections, records  # register their queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from filelode.plans import collections, records  # noqa: F401

    return dict(_ORACLES)
