"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from specloom.llm import bpe, embeddings, lengths, lmscore, packing, pieces, pii, quality, ranked, repair, sharding, simhash, toxicity
from specloom.llm.common import read

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")  # the same vocabulary and merges, with a special token
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), RANKS)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = sharding.Tree.balanced(24)
    return sharding.shard(read(spark, sf_dir, "documents"), tree, tree.grown())


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), RANKS)


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.suffix_sums(lengths.histogram(read(spark, sf_dir, "documents"), RANKS))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(read(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(read(spark, sf_dir, "conversations"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(read(spark, sf_dir, "documents"), PIECES)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_sharding, op3_lm_scores, op4_embeddings, op5_packing, op6_token_counts, op7_quality, op8_pii, op9_toxicity, op10_simhash, op11_ranked, op12_repair, op13_sentencepiece)}

ORACLE_SQL = {
    "op7_quality": r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT doc_id, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
w AS (SELECT row_number() OVER () AS r, * FROM m),
win AS (SELECT r, unnest(generate_series(1, len(words) - 7)) AS i, words FROM w WHERE len(words) >= 8),
k AS (SELECT r, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram FROM win),
dup AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
rep AS (SELECT r, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest(range(8)) AS j) GROUP BY r),
b AS (
  SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.r = w.r),
c AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
f AS (
  SELECT *, CAST(word_chars < 2 * n_words AS INT) + CAST(word_chars > 14 * n_words AS INT) + CAST(10 * n_symbols > n_words AS INT) + CAST(4 * n_symbols > n_words AS INT)
         + CAST(100 * n_repeat_words > 15 * n_words AS INT) + CAST(5 * n_dup_lines > n_words AS INT) + CAST(base_failed AS INT) AS fails
  FROM c),
h AS (SELECT source AS host, count(*)::DOUBLE AS n, sum(CAST(fails > 0 AS INT))::DOUBLE AS f FROM f GROUP BY source),
t AS (SELECT sum(n) AS n_all, count(*) AS hosts, sum(n * n) AS n2, sum(f) / sum(n) AS m, sum(f * f / n) - sum(f) * sum(f) / sum(n) AS bh FROM h),
v AS (SELECT m, (bh - (hosts - 1) * m * (1 - m)) / nullif(n_all - n2 / n_all - (hosts - 1), 0) AS v FROM t),
s AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1e-3) WHEN m > 0 AND m < 1 THEN 1e6 ELSE 1.0 END AS strength FROM v),
r AS (SELECT host, (f + strength * m) / (n + strength) AS rate FROM h, s)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND fails < CASE WHEN rate > 0.5 THEN 1 ELSE 2 END AS kept
FROM f JOIN r ON r.host IS NOT DISTINCT FROM f.source
""",
    "op11_ranked": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, CAST(sum(len(ts)) AS BIGINT) AS words FROM d),
p AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, docs),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
i AS (SELECT p.r, p.doc_id, p.t, w.w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words))) AS points FROM p JOIN w USING (t), s),
c AS (SELECT item_id, r, doc_id, CAST(sum(times * points) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r) AS INT) AS rank, doc_id, score FROM c WHERE score > 0 QUALIFY rank <= 20
""",
}
