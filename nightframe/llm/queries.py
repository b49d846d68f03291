"""The registered queries of this package and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.llm import chat_format, exact_dedup, filter_audit, hard_negatives, html_extract, language_id, lm_scoring, ngram_join, packing
from nightframe.llm import piece_codec, quality_classifier, quality_rules, token_counts
from nightframe.session import use_utc

#: Rows and bytes handed to Python at a time: texts can be long.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies: ``TOKENIZER_DIR`` or the installed collection."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return use_utc(spark)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and line counts, base failures and the verdict of the host for every document."""
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "host_docs", *[f"host_{r}" for r in quality_rules.RULES], "host_rejected", "kept",
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components and numbers of links of documents whose three-word runs have a Jaccard similarity of 0.9 or more."""
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"), n=3, percent=90).select(
        "doc_id", "n_shingles", "component_id", "n_links"
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return chat_format.collapse_snapshots(_table(spark, sf_dir, "conversations"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and which row of each stays."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages")).withColumn(
        "n_chars", F.length("text").cast("bigint")
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the model trained on the labels."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, _table(spark, sf_dir, "labels"))
    return quality_classifier.quality_scores(docs, model)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge-dropout encoding of every document, decoded again."""
    return piece_codec.encode_documents(
        _table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), seed=1, rate=0.1, keep_ids=False
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = _table(spark, sf_dir, "documents")
    return language_id.language_id(docs, language_id.train(docs))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the hashed maximum-entropy model, and under add-one counts."""
    return lm_scoring.lm_scores(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector and its nearest vectors of the same label."""
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source under all orders of them."""
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    fn.__name__: fn
    for fn in (
        op1_quality_rules, op2_ngram_jaccard_join, op3_chat_format, op4_packing, op5_exact_dedup, op6_html_extraction,
        op7_token_counts, op8_quality_classifier, op9_piece_codec, op10_language_id, op11_lm_scoring, op12_hard_negatives,
        op13_filter_audit,
    )
}

ORACLES = {
    "op1_quality_rules": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
f AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 2 * n_symbols > n_words AS f3,
             10 * n_dup_lines > 3 * n_lines AS f4 FROM c),
s AS (SELECT source AS host, count(*) AS host_docs, CAST(sum(CAST(f1 AS INT)) AS BIGINT) AS host_short,
             CAST(sum(CAST(f2 AS INT)) AS BIGINT) AS host_repeat, CAST(sum(CAST(f3 AS INT)) AS BIGINT) AS host_symbols,
             CAST(sum(CAST(f4 AS INT)) AS BIGINT) AS host_lines FROM f GROUP BY source),
u AS (UNPIVOT s ON host_short, host_repeat, host_symbols, host_lines INTO NAME rule VALUE n),
m AS (SELECT rule, avg(n / host_docs) AS mean, coalesce(var_samp(n / host_docs), 0) AS var FROM u GROUP BY rule),
p AS (SELECT rule, mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 1), 1000) ELSE 1000 END AS strength FROM m),
v AS (SELECT host, max((n + mean * strength) / (host_docs + strength)) > 0.5 AS host_rejected
      FROM u JOIN p USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, host_docs,
       host_short, host_repeat, host_symbols, host_lines, host_rejected, NOT (f1 OR f2) AND NOT host_rejected AS kept
FROM f JOIN s ON s.host IS NOT DISTINCT FROM f.source JOIN v ON v.host IS NOT DISTINCT FROM f.source""",
    "op3_chat_format": r"""
WITH t AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS k, conv_id, turn,
         '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS piece
  FROM conversations),
c AS (SELECT k, any_value(conv_id) AS conv_id, count(*) AS n, list(piece ORDER BY turn NULLS FIRST, piece) AS l FROM t GROUP BY k),
u AS (SELECT l, n, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l, n)
SELECT conv_id, n AS n_turns, copies, array_to_string(l, '') AS text FROM u
WHERE NOT EXISTS (SELECT 1 FROM u v WHERE v.n > u.n AND v.l[1] = u.l[1] AND v.l[1:u.n] = u.l)""",
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents),
g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM d JOIN g USING (n)""",
    "op12_hard_negatives": r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS rid,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
             CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0),
p AS (SELECT rid, anchor_id, id AS positive_id, score AS positive_score,
             row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) AS n
      FROM s WHERE same QUALIFY n <= 5),
h AS (SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.rid, n ORDER BY s.score DESC, s.id) AS INT) AS rank
      FROM p JOIN s ON s.rid = p.rid AND NOT s.same
      WHERE 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT * FROM h WHERE rank <= 3""",
    "op13_filter_audit": r"""
WITH l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good,
                  max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic
           FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
              100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'),
              coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false)] AS fails
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM a, a b, a c, a d, a e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS col,
             [ascii(filter_order[k]) - 64 for k in range(1, step)] AS before
      FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, s.col,
             CAST(sum(CASE WHEN NOT g AND NOT fails[s.col] THEN n ELSE 0 END) AS BIGINT) AS kept,
             CAST(sum(CASE WHEN NOT g AND fails[s.col] THEN n ELSE 0 END) AS BIGINT) AS removed,
             CAST(sum(CASE WHEN g AND fails[s.col] THEN n ELSE 0 END) AS BIGINT) AS redundant,
             CAST(sum(CASE WHEN fails[s.col] AND len(list_filter(fails, lambda y: y)) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
             CAST(sum(CASE WHEN NOT g AND fails[s.col] THEN good ELSE 0 END) AS BIGINT) AS good_lost,
             CAST(sum(CASE WHEN NOT g AND fails[s.col] THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
      FROM (SELECT *, len(list_filter(before, lambda b: fails[b])) > 0 AS g FROM m, s) s GROUP BY ALL)
SELECT * EXCLUDE (col), CAST(sum(removed) OVER (PARTITION BY part, col) AS BIGINT) AS shapley FROM r""",
}
