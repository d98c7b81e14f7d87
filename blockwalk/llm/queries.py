"""The operators over their whole tables with production parameters, and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwalk.llm import (
    best_fit,
    collocations,
    content_sort,
    host_rules,
    jaccard_pruning,
    language_codes,
    projection_passes,
    secret_ledger,
    segment_bpe,
    sparse_suffix,
    template_removal,
    toxic_neighbours,
    whitening,
)
from blockwalk.llm.common import in_fold, table


def op1_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_codes.identified(docs, language_codes.train(docs))


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_segment_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return segment_bpe.round_trips(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two turns, as a scan that is repeated when rows arrive: half of the ids first, then all rows over the ledger of the first turn."""
    docs = table(spark, sf_dir, "documents")
    findings, _ = secret_ledger.scan_in_turns([docs.where(in_fold(F.col("doc_id"), 2, 0)), docs])
    return secret_ledger.by_row(docs, findings).drop("blob")


def op5_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_removal.extracted(table(spark, sf_dir, "pages"))


def op6_jaccard_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_pruning.classes(table(spark, sf_dir, "documents"))


def op7_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(table(spark, sf_dir, "documents"))


def op8_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.repeats(table(spark, sf_dir, "documents"))


def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_rules.judged(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *host_rules.COUNTS, "base_failed", "kept")


def op10_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_neighbours.scored(docs, *toxic_neighbours.build(docs, table(spark, sf_dir, "labels")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_passes.near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_spectrum_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_language_codes, op2_best_fit, op3_segment_bpe, op4_secret_ledger, op5_template_removal, op6_jaccard_pruning, op7_content_sort, op8_sparse_suffix,
    op9_host_rules, op10_toxic_neighbours, op11_collocations, op12_projection_passes, op13_spectrum_slices)}


def _secrets() -> str:
    parts = []
    for place, rule in enumerate(secret_ledger.RULES):
        pattern = f"((?s:.*?))({rule.pattern})".replace("'", "''")
        all_of = lambda g: f"regexp_extract_all(text, '{pattern}', {g})"  # noqa: B023, E731
        parts.append(
            f"SELECT rid, {place} AS place, '{rule.kind}' AS kind, unnest({all_of(1)}) AS gap, unnest({all_of(2)}) AS hit, "
            f"unnest({all_of(2 + rule.measured)}) AS measured, {rule.least} AS least, generate_subscripts({all_of(1)}, 1) AS pos FROM d")
    counts = ", ".join(f"coalesce(count(*) FILTER (WHERE kind = '{k}'), 0) AS n_{k}" for k in secret_ledger.BASE)
    outer = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_ledger.BASE)
    n = len(secret_ledger.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(parts)}),
e AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY pos) AS stop FROM m),
s AS (SELECT rid, place, kind, stop - length(hit) AS start, stop FROM e WHERE length(measured) >= least),
t AS (SELECT rid, {counts},
  string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, place) FILTER (WHERE place < {n}) AS base,
  string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, place) AS spans FROM s GROUP BY rid)
SELECT doc_id, {outer}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (rid)"""


_EXACT = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256 FROM d"""


def _quality() -> str:
    names = list(host_rules.RULES)
    sums = ", ".join(f"count(*) FILTER (WHERE f_{k})::DOUBLE AS f_{k}" for k in names)
    flags = ", ".join(f"{c} AS f_{k}" for k, c in host_rules.RULES.items())
    moments = ", ".join(f"avg(f_{k} / n) AS m_{k}, var_pop(f_{k} / n) AS v_{k}" for k in names)
    strength = {k: f"(CASE WHEN v_{k} > 0 THEN least(greatest(m_{k} * (1 - m_{k}) / v_{k} - 1, 1.0), 1e4) ELSE 1.0 END)" for k in names}
    bad = " OR ".join(f"(f_{k} + m_{k} * {strength[k]}) / (n + {strength[k]}) > {host_rules.HOST_LIMIT}" for k in names)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
k AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS times FROM g),
c AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM k WHERE times > 1) GROUP BY rid),
s AS (SELECT doc_id, source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)),
r AS (SELECT *, {flags} FROM s),
h AS (SELECT source, count(*) AS n, {sums} FROM r WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT {moments} FROM h),
b AS (SELECT source FROM h, p WHERE {bad})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_short OR f_repeats AS base_failed,
  NOT (f_short OR f_repeats) AND source NOT IN (SELECT source FROM b) IS NOT FALSE AS kept FROM r"""


CHECKS = {"op4_secret_ledger": _secrets(), "op7_content_sort": _EXACT, "op9_host_rules": _quality()}
