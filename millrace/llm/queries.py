"""One query for each corpus operator with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, chat, decontam, isomedia, langid, licenses, ngram_join, pii, secrets, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recover(table(spark, sf_dir, "conversations"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isomedia.text_media(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# the columns of the operators above that SQL can give as well


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_pii(spark, sf_dir).drop("spans")


def media_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_language_id, op3_chat_format, op4_media_columns, op5_warc, op6_ngram_jaccard, op7_secrets, op8_licenses, op9_byte_bpe, op10_decontamination, pii_base, media_payload, license_base, bpe_decoded)}


_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
     top AS (SELECT hex, max(page_id) AS top FROM p GROUP BY hex),
     marked AS (SELECT page_id, octet_length(payload) AS n, p.hex AS hex, CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM p JOIN top ON p.hex = top.hex)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM marked
"""


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOW}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS x FROM documents),
 s AS (SELECT doc_id, CASE WHEN x IS NULL OR len(x) = 0 THEN [] WHEN len(x) < 3 THEN [array_to_string(x, ' ')] ELSE list_distinct(list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2])) END AS s FROM w),
 e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
 l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 edge AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 reach AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id FROM s LEFT JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, s.s
"""

_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
#: kind -> pattern and what a match x must meet.
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(x, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND CAST('0' || right(p, 3) AS INTEGER) <= 255))"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) ELSE CAST(substr('0246813579', CAST(substr(reverse({_DIGITS}), i, 1) AS INTEGER) + 1, 1) AS INTEGER) END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
}


def _places(place: int, kind: str) -> str:
    """SQL: a list of (s, k, v) for the valid matches of a kind in t."""
    pattern, valid = _KINDS[kind]
    made = f"list_transform(range(1, len(m_{kind}) + 1), lambda i: {{'s': CAST(list_sum(list_transform(p_{kind}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m_{kind}[1:i - 1], lambda y: length(y))), 0) AS BIGINT), 'x': m_{kind}[i]}})"
    return f"list_transform(list_filter({made}, lambda z: list_bool_and(list_transform([z.x], lambda x: {valid}))), lambda z: {{'s': z.s, 'k': {place}, 'v': '{kind}:' || z.s || ':' || (z.s + length(z.x))}})"


_PII = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 m AS (SELECT doc_id, {', '.join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS p_{k}" for k, (p, _) in _KINDS.items())} FROM t),
 f AS (SELECT doc_id, {', '.join(f'{_places(i, k)} AS f_{k}' for i, k in enumerate(_KINDS))} FROM m)
SELECT doc_id, {', '.join(f'CAST(len(f_{k}) AS BIGINT) AS n_{k}' for k in _KINDS)}, sha256(array_to_string(list_transform(list_sort(list_concat(list_concat(f_email, f_ip), list_concat(f_card, f_phone))), lambda z: z.v), ',')) AS base_sha256 FROM f
"""

_LICENSE = rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS x FROM documents),
 p AS (SELECT doc_id, x, list_filter(range(1, len(x)), lambda i: x[i] = 'mit' AND x[i + 1] = 'license') AS mit, list_filter(range(1, len(x)), lambda i: x[i] = 'apache' AND x[i + 1] = 'license') AS apache,
  list_filter(range(1, len(x) - 1), lambda i: x[i] = 'general' AND x[i + 1] = 'public' AND x[i + 2] = 'license') AS gpl FROM w)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_words, CAST(len(mit) + len(apache) + len(gpl) AS BIGINT) AS n_base, CAST(list_min(list_concat(list_concat(mit, apache), gpl)) - 1 AS BIGINT) AS first_word,
 CAST(list_max(list_concat(list_concat(mit, apache), gpl)) - 1 AS BIGINT) AS last_word, concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels FROM p
"""

_MEDIA = """
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + k AS BIGINT) AS payload_bytes, sha256(raw || unhex(repeat('00', CAST(k AS BIGINT)))) AS payload_sha256
FROM (SELECT doc_id, raw, octet_length(raw) AS n, CASE WHEN octet_length(raw) = 0 THEN 64 ELSE (64 - octet_length(raw) % 64) % 64 END AS k FROM (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc": _WARC,
        "op6_ngram_jaccard": _JACCARD,
        "pii_base": _PII,
        "media_payload": _MEDIA,
        "license_base": _LICENSE,
        "bpe_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    }
