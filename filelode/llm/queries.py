"""The corpus queries for the driver: one ``opN_<name>`` an operator, over its whole table, and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from filelode.llm.common import checkpoint, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.simhash import hex_fingerprint, simhash_dedup

    found = simhash_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.bpe_columns import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.exact_dedup import DigestIndex, exact_dedup

    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    try:
        # in two appended batches, so that the second meets an index with rows in it
        return checkpoint(exact_dedup(table(spark, sf_dir, "documents"), index, batches=2))
    finally:
        index.drop()


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.embedding_dedup import embedding_dedup

    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.substring_dedup import passages, runs

    return runs(passages(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.conversations import damage, repair

    rows = table(spark, sf_dir, "conversations")
    return repair(damage(rows), rows.selectExpr("conv_id AS conv")).withColumnRenamed("conv", "conv_id")


def op12_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.alignment import cross_tokenizer

    return cross_tokenizer(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))[0]


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from filelode.llm.sentence_pieces import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, coalesce(len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS ok FROM embeddings
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.ok AND b.ok AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.95
), r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.node)
SELECT vec_id, (SELECT count(*) FROM l WHERE u = vec_id) AS n_links, min(root) AS component_id, vec_id = min(root) AS kept
FROM v JOIN r ON node = vec_id GROUP BY vec_id
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS s FROM (SELECT doc_id, h, unnest(range(greatest(0, n - 399))) AS i FROM d)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS c FROM w) WHERE c > 1),
m AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM g)),
p AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM m GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM p),
t AS (SELECT doc_id, count(*) AS spans, sum(b - a)::BIGINT AS gone, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, TRY(decode(unhex(coalesce(kept, h)))) AS text FROM d LEFT JOIN t USING (doc_id)
"""


# the CRC-32 by its table; least (cost, edits, lines) of the rows that are left, from the last row back, for each state of the roles
OP11_SQL = r"""
WITH RECURSIVE t0 AS (SELECT i, i AS c, 0 AS k FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM t0 WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM t0 WHERE k = 8),
d0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(regexp_replace(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '(..)', '\1 ', 'g').rtrim(), ' '),
      lambda x: ('0x' || x)::BIGINT), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM d0 WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, E' \t\n\x0b\x0c\r') AS said, left(role, 1) AS ch FROM d),
f AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN min(i) OVER (PARTITION BY conv_id, role, text) < i THEN 'duplicate'
    WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(ch) OVER (PARTITION BY conv_id ORDER BY i) || ch NOT IN ('su', 'ua', 'au') AS bad, max(i) OVER (PARTITION BY conv_id) AS n FROM o),
s AS (SELECT DISTINCT conv_id, n + 1 AS i, {c: 0, a: '', l: []::VARCHAR[]} AS f0, {c: 10, a: 'II', l: ['user:', 'assistant:']} AS f1,
    {c: 5, a: 'I', l: ['assistant:']} AS f2, {c: 0, a: '', l: []::VARCHAR[]} AS f3 FROM f
  UNION ALL
  SELECT conv_id, i, list_min([g0, {c: 5 + h2.c, a: 'I' || h2.a, l: ['user:'] || h2.l}]), list_min([g1, {c: 5 + h2.c, a: 'I' || h2.a, l: ['user:'] || h2.l}]),
    list_min([g2, {c: 5 + h3.c, a: 'I' || h3.a, l: ['assistant:'] || h3.l}]), list_min([g3, {c: 5 + h2.c, a: 'I' || h2.a, l: ['user:'] || h2.l}])
  FROM (SELECT *, list_min([g2, {c: 5 + g3.c, a: 'I' || g3.a, l: ['assistant:'] || g3.l}]) AS h2, list_min([g3, {c: 5 + g2.c, a: 'I' || g2.a, l: ['user:'] || g2.l}]) AS h3
  FROM (SELECT conv_id, i,
    list_min([{c: 2 + f0.c, a: 'D' || f0.a, l: f0.l}, {c: r + f2.c, a: 'R' || f2.a, l: ['user:' || text] || f2.l},
      {c: CASE ch WHEN 's' THEN k + f1.c WHEN 'u' THEN k + f2.c ELSE 1000000 END, a: 'K' || CASE ch WHEN 's' THEN f1.a ELSE f2.a END, l: [role || ':' || text] || CASE ch WHEN 's' THEN f1.l ELSE f2.l END}]) AS g0,
    list_min([{c: 2 + f1.c, a: 'D' || f1.a, l: f1.l}, {c: r + f2.c, a: 'R' || f2.a, l: ['user:' || text] || f2.l},
      {c: CASE ch WHEN 'u' THEN k + f2.c ELSE 1000000 END, a: 'K' || f2.a, l: [role || ':' || text] || f2.l}]) AS g1,
    list_min([{c: 2 + f2.c, a: 'D' || f2.a, l: f2.l}, {c: r + f3.c, a: 'R' || f3.a, l: ['assistant:' || text] || f3.l},
      {c: CASE ch WHEN 'a' THEN k + f3.c ELSE 1000000 END, a: 'K' || f3.a, l: [role || ':' || text] || f3.l}]) AS g2,
    list_min([{c: 2 + f3.c, a: 'D' || f3.a, l: f3.l}, {c: r + f2.c, a: 'R' || f2.a, l: ['user:' || text] || f2.l},
      {c: CASE ch WHEN 'u' THEN k + f2.c ELSE 1000000 END, a: 'K' || f2.a, l: [role || ':' || text] || f2.l}]) AS g3
  FROM (SELECT f.*, s.* EXCLUDE (conv_id, i), CASE fault WHEN 'truncated' THEN 5 WHEN '' THEN 0 ELSE 1000000 END AS k,
      CASE fault WHEN 'truncated' THEN 6 WHEN '' THEN 1 ELSE 1000000 END AS r FROM s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i - 1)))),
e AS (SELECT conv_id, f0.c AS cost, f0.a AS audit, array_to_string(f0.l, chr(10)) AS kept FROM s WHERE i = 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(kept, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_simhash": op1_simhash, "op2_bpe": op2_bpe, "op3_exact_dedup": op3_exact_dedup, "op4_language": op4_language, "op5_best_fit_packing": op5_best_fit_packing, "op6_html_extraction": op6_html_extraction, "op7_embedding_dedup": op7_embedding_dedup, "op8_suffix_dedup": op8_suffix_dedup, "op9_substring_dedup": op9_substring_dedup, "op10_toxicity": op10_toxicity, "op11_conversation_repair": op11_conversation_repair, "op12_cross_tokenizer": op12_cross_tokenizer, "op13_sentence_pieces": op13_sentence_pieces}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op7_embedding_dedup": OP7_SQL, "op8_suffix_dedup": OP8_SQL, "op11_conversation_repair": OP11_SQL}
