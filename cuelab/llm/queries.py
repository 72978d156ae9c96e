"""The operators as queries over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelab.workspace import fresh_path

from . import bpe, conversation_trie, exact_dedup, html_text, lexical_search, packing, pii, quality, simhash, token_counts, token_files, toxicity, url_rules

WORD_BPE, BYTE_BPE, RANKS = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.token_counts(table(spark, sf, "documents"), WORD_BPE)
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), BYTE_BPE, capacity=1024, end_id=2)


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    judged, name = quality.judge_quality(docs, drop_text=True)
    return judged.select("doc_id", *[F.col(v).alias(k) for k, v in name.items()])


def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.main_texts(table(spark, sf, "pages"))


def op6_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf, "pages"), rules)


def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"), shingle=3, most_bits=3)


def op8_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = token_files.write_token_files(table(spark, sf, "documents"), BYTE_BPE, fresh_path(spark, "token-files"), end_id=0)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    both = table(spark, sf, "documents").select("doc_id", bpe.round_trip(spark, text, RANKS, public_tokenizers.PATTERN).alias("b")).select("doc_id", "b.*")
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256")
    )


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    digest = F.sha2(exact_dedup.normalised("text"), 256)
    return exact_dedup.exact_groups(table(spark, sf, "documents"), carry={"text_sha256": digest})


def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=20)


def op12_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns = conversation_trie.numbered(conversation_trie.turn_keys(table(spark, sf, "conversations")))
    return conversation_trie.trie(*conversation_trie.with_lent_heads(turns, every=5, most=8))


def op13_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return pii.counted_spans(pii.personal_data(table(spark, sf, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_best_fit_packing, op3_toxicity, op4_quality_rules, op5_html_text,
        op6_url_filters, op7_simhash, op8_token_files, op9_byte_bpe, op10_exact_dedup,
        op11_ranked_search, op12_conversation_trie, op13_personal_data,
    )
}

ORACLES = {
    "op6_url_filters": r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS sep FROM pages
), p AS (
  SELECT page_id,
    CASE WHEN sep = 0 THEN '' ELSE regexp_extract(substr(url, sep + 3), '^[^/?#]*') END AS raw_host,
    CASE WHEN sep = 0 THEN '' ELSE regexp_extract(substr(url, sep + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM u
), h AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM p
), rules(rh, rp, rv) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM (SELECT DISTINCT host, path FROM h) JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp)
  GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM h LEFT JOIN best USING (host, path)
""",
    "op10_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
""",
    "op11_ranked_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), q AS (
  SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id,
      unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark)
  GROUP BY item, item_id, term
), whole AS (
  SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS all_terms FROM d
), p AS (
  SELECT r, doc_id, n, term, count(*) AS tf
  FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q)
  GROUP BY r, doc_id, n, term
), w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*) AS df FROM p GROUP BY term), whole
), scored AS (
  SELECT item, item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // all_terms))))::BIGINT AS score
  FROM p JOIN w USING (term) JOIN q USING (term), whole GROUP BY item, item_id, r, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
""",
    "op12_conversation_trie": r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), lens AS (
  SELECT c, count(*) AS n FROM turns GROUP BY c
), heads AS (
  SELECT c, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))
  ), 4294967295) % 9 AS h
  FROM lens
), rebuilt AS (
  SELECT heads.c, place AS d, role, text FROM heads JOIN turns ON turns.c = heads.c - heads.c % 5 AND place <= h
  UNION ALL
  SELECT heads.c, place - h + least(h, coalesce(n, 0)), role, text
  FROM heads JOIN turns ON turns.c = heads.c AND place > h LEFT JOIN lens ON lens.c = heads.c - heads.c % 5
), paths AS (
  SELECT c, d, strlen(text) AS bytes,
    md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') OVER (PARTITION BY c ORDER BY d)) AS key
  FROM rebuilt
  UNION ALL SELECT c, 0, 0, 'root' FROM lens
), sized AS (
  SELECT *, max(d) OVER (PARTITION BY c) AS last FROM paths
), nodes AS (
  SELECT key, d, min(c) AS conv, count(*) AS n, max(bytes) AS bytes, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = last) AS ends
  FROM sized GROUP BY key, d
), placed AS (
  SELECT nodes.*, paths.key AS parent FROM nodes LEFT JOIN paths ON paths.c = conv AND paths.d = nodes.d - 1
), children AS (
  SELECT parent AS key, count(*) AS n_children FROM placed GROUP BY parent
), counted AS (
  SELECT placed.*, coalesce(n_children, 0) AS n_children FROM placed LEFT JOIN children USING (key)
), under AS (
  SELECT a.key, sum((x.n - 1) * x.bytes)::BIGINT AS saved_tokens, count(*) FILTER (x.n_children = 0) AS n_leaves
  FROM counted x JOIN paths a ON a.c = x.conv AND a.d <= x.d GROUP BY a.key
)
SELECT x.conv AS conv_id, x.d AS depth, up.conv AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves, saved_tokens,
  sha256(coalesce(x.ends, '')) AS ends_sha256
FROM counted x JOIN under USING (key) LEFT JOIN nodes up ON up.key = x.parent
""",
}
