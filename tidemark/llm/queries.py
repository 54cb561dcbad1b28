"""Registered queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, compression_quality, html_extract, language_id, mixing, near_dedup, packing, quality_rules, toxicity, warc
from tidemark.llm.common import crc_mod, read, written


def _held_out(folds: int, fold: int):
    return F.coalesce(crc_mod("doc_id", folds) == fold, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(read(spark, sf_dir, "documents"))
    rows = quality_rules.apply_policy(rows, quality_rules.POLICIES["strict"])
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.POLICIES["base"].mask)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strict policy rejects, alone and at all, from the stored ledger of op2_quality_rules."""
    rows = written(quality_rules.ledger(read(spark, sf_dir, "documents")).select("doc_id", "failed"), "quality-ledger")
    return quality_rules.ablations(rows, quality_rules.POLICIES["strict"])


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = language_id.identify(docs, language_id.learn(docs))
    return rows.select("doc_id", _held_out(language_id.FOLDS, language_id.HELD_OUT).alias("held_out"), "lang_pred", "score", "accepted")


def op4_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = compression_quality.score(docs, compression_quality.learn(docs, read(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= compression_quality.THRESHOLD).cast("int")
    return rows.select("doc_id", _held_out(compression_quality.FOLDS, 0).alias("held_out"), "score", predicted.alias("predicted"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = warc.write_archives(read(spark, sf_dir, "pages"))
    return warc.read_archives(folder, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(read(spark, sf_dir, "documents"), fraction=(1, 1), max_epochs=2)
    return rows.select("doc_id", "mix_domain", "lang", "source", "n_tokens", "epoch")


def op9_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(ann.build(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 20 == 0)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_language_id": op3_language_id,
    "op4_compression_quality": op4_compression_quality,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_weighted_minhash": op6_weighted_minhash,
    "op7_packing": op7_packing,
    "op8_source_mixing": op8_source_mixing,
    "op9_additive_quantisation": op9_additive_quantisation,
    "op10_html_extraction": op10_html_extraction,
    "quality_rule_ablations": quality_rule_ablations,
}

_OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
wins AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
again AS (SELECT rid, i FROM wins WHERE (rid, s) IN (SELECT (rid, s) FROM wins GROUP BY rid, s HAVING count(*) > 1)),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM again) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines,
    length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS n_upper,
    length(t) - length(regexp_replace(t, '\p{L}+', '', 'g')) AS n_letters,
    length(t) - length(replace(t, '!', '')) AS n_shouts
  FROM d JOIN w USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 50 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 8 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END + CASE WHEN n_letters >= 20 AND 100 * n_upper > 60 * n_letters THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_shouts > 50 * n_words THEN 64 ELSE 0 END + CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END)::BIGINT AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


def mixing_sql(table: str, num: int, den: int, max_epochs: int, seed: int, columns: str) -> str:
    """The mixture in SQL, by running sums over whole leaves."""
    domains = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(mixing.DOMAINS))
    weight = {level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in w.items()) + " ELSE 1 END" for level, w in mixing.WEIGHTS.items()}
    parts, above = [], f"(SELECT 0 AS root, sum(tokens)::HUGEINT * {num} // {den} AS budget FROM leaves)"
    for depth, level in enumerate(mixing.LEVELS):
        parent = ", ".join(["root", *mixing.LEVELS[:depth]])
        win = f"(PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight::DOUBLE, {level} ROWS UNBOUNDED PRECEDING)"
        parts.append(f"""
c{depth} AS (SELECT *, {weight[level]}::HUGEINT AS weight FROM (SELECT {parent}, {level}, sum(tokens)::HUGEINT * {max_epochs} AS capacity FROM leaves GROUP BY ALL) JOIN {above} USING ({parent})),
u{depth} AS (SELECT *, sum(capacity) OVER {win} - capacity AS used, sum(weight) OVER (PARTITION BY {parent}) - sum(weight) OVER {win} + weight AS opened FROM c{depth}),
x{depth} AS (SELECT *, min(CASE WHEN capacity * opened <= weight * (budget - used) THEN 1 ELSE 0 END) OVER {win} = 1 AS spent FROM u{depth}),
b{depth} AS (SELECT {parent}, {level}, CASE WHEN spent THEN capacity ELSE
  (budget - coalesce(sum(CASE WHEN spent THEN capacity END) OVER (PARTITION BY {parent}), 0)) * weight // sum(CASE WHEN NOT spent THEN weight END) OVER (PARTITION BY {parent}) END AS budget FROM x{depth})""")
        above = f"b{depth}"
    return rf"""
WITH t AS (
  SELECT *, CASE WHEN regexp_matches(source, '^src[0-9]{{1,9}}$') THEN CASE try_cast(substr(source, 4) AS BIGINT) % {len(mixing.DOMAINS)} {domains} END ELSE '(none)' END AS mix_domain,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens FROM {table}),
k AS (SELECT *, 0 AS root, coalesce(mix_domain, '(none)') AS domain, coalesce(lang, '(none)') AS l, coalesce(source, '(none)') AS s FROM t),
leaves AS (SELECT 0 AS root, domain, l AS lang, s AS source, sum(n_tokens)::HUGEINT AS tokens FROM k GROUP BY ALL),{",".join(parts)},
plan AS (SELECT domain, lang AS l, source AS s, tokens, budget, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS epochs FROM b2 JOIN leaves USING (root, domain, lang, source)),
e AS (SELECT k.*, plan.budget, plan.tokens, plan.epochs, unnest(range(0, least(plan.epochs, {max_epochs - 1})::BIGINT + 1)) AS epoch FROM k JOIN plan USING (domain, l, s)),
o AS (SELECT *, ('0x' || substr(md5('{seed}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw FROM e),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, l, s, epoch ORDER BY draw, n_tokens) AS running FROM o)
SELECT {columns} FROM r WHERE epoch < epochs OR running <= budget - epochs * tokens
"""


_ABLATIONS = f"""
SELECT rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed = bit) AS n_only,
  count(*) FILTER (failed = 0) AS n_kept, count(*) FILTER (failed & ~bit = 0) AS n_kept_without
FROM ({_OP2}) CROSS JOIN (VALUES {", ".join(f"('{r}', {1 << i}::BIGINT)" for i, r in enumerate(quality_rules.RULES))}) rules(rule, bit) GROUP BY rule
"""

ORACLES: dict[str, str] = {
    "op2_quality_rules": _OP2,
    "quality_rule_ablations": _ABLATIONS,
    "op8_source_mixing": mixing_sql("documents", 1, 1, 2, 17, "doc_id, domain AS mix_domain, lang, source, n_tokens, epoch::INTEGER AS epoch"),
}
