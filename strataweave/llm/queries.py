"""One query for each operator of this subpackage, over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, bwt, byte_bpe, hash_tree, kneser_ney, mixing, nndescent, ogg, partenum, range_coder, ranked_search, spelling, viterbi
from .common import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op3_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature 0.5 over the sources' characters; the expected size of the result is that of the input."""
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.withColumn("rate", F.round("rate", 9))


OP3_SQL = """
WITH sizes AS (SELECT source, CAST(SUM(LENGTH(COALESCE(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY source),
w AS (SELECT source, size, CASE WHEN size > 0 THEN POW(size, 0.5) ELSE 0.0 END AS weight FROM sizes),
r AS (SELECT source, CASE WHEN size > 0 THEN weight / (SELECT SUM(weight) FROM w) * (SELECT SUM(size) FROM w) / size ELSE 0.0 END AS rate FROM w),
k AS (SELECT source, rate, UNNEST(GENERATE_SERIES(0, CAST(CEIL(rate + 12 * SQRT(rate) + 40) AS BIGINT))) AS k FROM r),
p AS (SELECT source, rate, k, CASE WHEN rate > 0 THEN EXP(k * LN(rate) - rate - SUM(LN(CAST(GREATEST(k, 1) AS DOUBLE))) OVER (PARTITION BY source ORDER BY k))
                                   WHEN k = 0 THEN 1.0 ELSE 0.0 END AS p FROM k),
c AS (SELECT source, rate, k, SUM(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
l AS (SELECT source, rate, LIST(cdf) AS cdfs FROM c GROUP BY source, rate),
d AS (SELECT *, CAST(('0x' || SUBSTR(MD5(COALESCE(CAST(doc_id AS VARCHAR), MD5(COALESCE(text, ''))) || '|11'), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
n AS (SELECT d.*, l.rate, LEN(LIST_FILTER(l.cdfs, lambda x: x <= d.u)) AS n FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
e AS (SELECT doc_id, text, lang, source, n_chars, rate, UNNEST(GENERATE_SERIES(1, n)) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, ROUND(rate, 9) AS rate, CAST(copy AS INTEGER) AS copy,
       CAST(('0x' || SUBSTR(MD5(COALESCE(CAST(doc_id AS VARCHAR), MD5(COALESCE(text, ''))) || '|' || copy || '|11'), 1, 15)) AS BIGINT) AS shuffle_key
FROM e
"""


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; the package that knows the place is beside pyspark on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_coder.encode_table(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of equal weight under the law `key`."""
    placed = hash_tree.shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through an Ogg file of 8-bit samples; the file itself is left out of the result."""
    return ogg.media_column(table(spark, sf_dir, "documents"), with_media=False)


def op2_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_join(table(spark, sf_dir, "documents"))


def op4_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi.ids_of(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.removed_bytes(table(spark, sf_dir, "documents"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.nearest(table(spark, sf_dir, "embeddings"))


def op7_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract(table(spark, sf_dir, "pages"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.score(docs, kneser_ney.fit(docs, table(spark, sf_dir, "labels")))


def op11_positional_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_sparse_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
s AS (SELECT CAST(COUNT(*) AS BIGINT) AS n_docs, CAST(SUM(LEN(terms)) AS BIGINT) AS n_terms FROM d WHERE LEN(terms) > 0),
t AS (SELECT r, doc_id, n, term, COUNT(*) AS tf FROM (SELECT r, doc_id, CAST(LEN(terms) AS BIGINT) AS n, UNNEST(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, COUNT(*) AS df FROM t GROUP BY term),
i AS (SELECT item_id, q, term, COUNT(*) AS times FROM (SELECT item_id, text AS q, UNNEST(REGEXP_EXTRACT_ALL(TRANSLATE(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT i.item_id, i.q, t.r, t.doc_id, CAST(SUM(i.times * CAST(FLOOR(1000 * LN((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT)
             * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms))))) AS BIGINT) AS score
      FROM i JOIN f USING (term) JOIN t USING (term) CROSS JOIN s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, ROW_NUMBER() OVER (PARTITION BY item_id, q ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 20
"""


def op13_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ogg": op1_ogg,
    "op2_partenum": op2_partenum,
    "op3_mixing_sources": op3_mixing_sources,
    "op4_viterbi": op4_viterbi,
    "op5_bwt_merge": op5_bwt_merge,
    "op6_nn_descent": op6_nn_descent,
    "op7_text_blocks": op7_text_blocks,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_range_coder": op9_range_coder,
    "op10_hash_tree": op10_hash_tree,
    "op11_positional_grams": op11_positional_grams,
    "op12_sparse_product": op12_sparse_product,
    "op13_chunked_bpe": op13_chunked_bpe,
}
ORACLE_SQL: dict[str, str] = {"op3_mixing_sources": OP3_SQL, "op12_sparse_product": OP12_SQL}
