"""Queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnspark.llm import (
    conversation_trie, dart_minhash, exact_dedup, line_crf, line_dedup, masked_lm, mixing, piece_sampling, substring_dedup, suffix_dedup, token_file,
    url_filter, whitening)
from vulnspark.llm.common import new_path, table

#: Rules of the URL query: (verdict, host, path prefix).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The URL query lists every URL met on a host whose name begins so.
LISTED_HOSTS = r"^(www\.|blog\.|m\.)?(cheap-pills|casino-win|spam-farm|ads-track)\."


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    token_file.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    files = token_file.read(spark, path)
    docs = token_file.documents(files).join(token_file.starts(files), ["part", "shard"])
    return docs.select("doc_id", (F.col("first_id") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_verdicts(table(spark, sf_dir, "documents"))


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(mixing.sized(table(spark, sf_dir, "documents")))
    rows = rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("positions")).alias("taken"),
                       F.get("positions", F.lit(0)).alias("first_position"))
    return rows.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS no FROM totals),
weighted AS (SELECT *, 3 * source_size AS cap, no % 3 + 1 AS w FROM numbered),
filled AS (
  SELECT *, cap * sum(w) OVER later <= (sum(source_size) OVER () - coalesce(sum(cap) OVER sooner, 0)) * w AS capped FROM weighted
  WINDOW later AS (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         sooner AS (ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, no, CASE WHEN capped THEN cap::DOUBLE ELSE
    (w * (sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)))::BIGINT
    / (sum(CASE WHEN NOT capped THEN w END) OVER ())::BIGINT END AS target FROM filled),
placed AS (
  SELECT doc_id, size, source_size, target, no,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * ((2 * c + size <= 2 * target)::INT + (2 * (c + source_size) + size <= 2 * target)::INT
           + (2 * (c + 2 * source_size) + size <= 2 * target)::INT))::BIGINT AS taken,
  CASE WHEN 2 * c + size <= 2 * target AND size > 0 THEN CASE no % 3
    WHEN 0 THEN 2 * share / (1.5::DOUBLE + sqrt(2.25::DOUBLE - 2 * share))
    WHEN 1 THEN 2 * share / (1::DOUBLE + sqrt(1::DOUBLE))
    ELSE CASE WHEN share <= 0.3125::DOUBLE THEN 2 * share / (0.5::DOUBLE + sqrt(0.25::DOUBLE + share))
         ELSE 0.5::DOUBLE + 2 * (share - 0.3125::DOUBLE) / (0.75::DOUBLE + sqrt(0.5625::DOUBLE + 5 * (share - 0.3125::DOUBLE))) END END END AS first_position
FROM (SELECT *, (c + size / 2) / target AS share FROM placed)
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_sampling.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return url_filter.judge(pages, listed, URL_RULES).drop("passed_filter")


OP8_SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url IS NULL AS missing, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query FROM cut),
keyed AS (
  SELECT page_id, host, path, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p:
           p <> '' AND split_part(p, '=', 1) <> 'ref' AND NOT starts_with(split_part(p, '=', 1), 'utm_'))), '&') AS q, missing FROM parts),
canon AS (
  SELECT page_id, host, path, CASE WHEN NOT missing THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
         || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS k FROM keyed),
listed AS (
  SELECT DISTINCT k FROM canon
  WHERE k IS NOT NULL AND regexp_matches(host, '^(www\.|blog\.|m\.)?(cheap-pills|casino-win|spam-farm|ads-track)\.')),
ruled AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule, k IN (SELECT k FROM listed) AND k IS NOT NULL AS listed FROM canon)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM ruled
"""

def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = masked_lm.train(docs)
    return masked_lm.score(docs, model, model.coded)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = conversation_trie.turn_lists(table(spark, sf_dir, "conversations"))
    heads = own.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 8).alias("_head"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    nothing = F.array().cast(conversation_trie.TURNS)
    rows = own.join(heads, own["conv_id"] - own["conv_id"] % 5 == heads["_base"], "left").withColumn("_h", shared)
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns") - F.col("_h"), F.lit(0)))
    rebuilt = rows.select("conv_id", F.concat(F.slice(F.coalesce("_head", nothing), F.lit(1), F.col("_h")), rest).alias("turns"))
    return conversation_trie.nodes(rebuilt).drop("node", "parent_node")


OP11_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS steps),
own AS (
  SELECT conv_id, list({'k': md5(coalesce(role, '')) || md5(coalesce(text, '')), 'b': octet_length(encode(coalesce(text, '')))}
                       ORDER BY turn NULLS FIRST, role, text) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (
  SELECT o.*, b.t AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(o.conv_id::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
    lambda x, y: xor(x >> 8, steps[(xor(x, y) & 255) + 1])), 4294967295) % 9 AS h
  FROM own o CROSS JOIN crc LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
rebuilt AS (SELECT conv_id, list_concat(CASE WHEN base IS NULL THEN [] ELSE base[1:h] END, t[h + 1:]) AS t FROM headed),
firsts AS (
  SELECT conv_id, d, len(t) = d AS ends, md5(array_to_string(list_transform(t[1:d], lambda x: x.k), '')) AS node,
         md5(array_to_string(list_transform(t[1:d - 1], lambda x: x.k), '')) AS parent, CASE WHEN d > 0 THEN t[d].b ELSE 0 END AS bytes
  FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM firsts GROUP BY d, node),
children AS (SELECT d - 1 AS d, parent AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, parent),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (d, node)),
under AS (
  SELECT a.d, a.node, sum((u.n_children = 0)::INT) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved
  FROM counted u JOIN firsts a ON a.conv_id = u.conv_id AND a.d <= u.d GROUP BY a.d, a.node)
SELECT c.conv_id, c.d::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs::BIGINT AS n_convs, c.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN under USING (d, node) LEFT JOIN nodes p ON c.d > 0 AND p.d = c.d - 1 AND p.node = c.parent
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), texts=False)


QUERIES = {f.__name__: f for f in (op1_token_file, op2_line_dedup, op3_curriculum_mix, op4_exact_dedup, op5_line_crf, op6_dart_minhash,
                                   op7_piece_sampling, op8_url_filter, op9_substring_dedup, op10_masked_lm, op11_conversation_trie,
                                   op12_whitening, op13_suffix_dedup)}
ORACLES = {"op3_curriculum_mix": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op8_url_filter": OP8_SQL, "op11_conversation_trie": OP11_SQL}
