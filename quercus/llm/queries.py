"""One query per operator over its whole table, with SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quercus.llm import (
    chat,
    corpus_scoring,
    decontamination,
    fill_in_middle,
    html_extraction,
    language_id,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    source_mixing,
    spelling,
    toxicity,
)
from quercus.llm.common import crc_mod


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_extraction.extract(pages, html_extraction.fit(pages))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 3) == 1
    model = language_id.fit(docs.filter(~held_out).select("lang", "text"))
    return language_id.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.classes(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "class_id", F.col("is_first").alias("kept"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 5) == 0
    model = toxicity.fit(docs.filter(~held_out), labels(spark, sf_dir))
    return toxicity.judge(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


_WORDS = (
    "regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
OP6_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS.format(c='text')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format(c='text')} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes)),
hits AS (SELECT DISTINCT doc_id, k, n, item_id FROM places JOIN windows USING (n, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select(
        "doc_id", *quality_rules.BASE, "base_failed", "kept", "distance"
    )


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 5) == 0
    model = quality_classifier.fit(docs.filter(~held_out), labels(spark, sf_dir))
    return quality_classifier.judge(docs, model).withColumn("held_out", held_out)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 5) == 1
    scored = corpus_scoring.score_corpus(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat.collapse_and_render(logged).select("conv_id", "turn", "n_turns", "n_copies", "segment")


OP5_SQL = r"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY turn NULLS LAST, role, text) AS said
  FROM turns GROUP BY conv_id),
prefixes AS (
  SELECT DISTINCT list_slice(said, 1, k) AS said FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM whole)),
single AS (SELECT said, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM whole GROUP BY said, n_turns),
kept AS (SELECT s.conv_id, s.n_turns, s.n_copies FROM single s ANTI JOIN prefixes p ON s.said = p.said)
SELECT t.conv_id, t.turn, k.n_turns, k.n_copies,
  concat('<|im_start|>', lower(t.role), chr(10),
    regexp_replace(t.text, '<\|(im_start|im_end)\|>', '< |\1| >', 'g'), '<|im_end|>', chr(10)) AS segment
FROM turns t JOIN kept k USING (conv_id)"""


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.search(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = fill_in_middle.transform(documents(spark, sf_dir).select("doc_id", "text"))
    return told.select(
        F.col("_row.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.sha2("told", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restore(F.col("told"), F.col("form")), 256).alias("restored_sha256"),
    )


OP11_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT doc_id, t, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
    OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
  WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
cut AS (SELECT doc_id, t, n, form, least(a, b) AS p, greatest(a, b) - least(a, b) AS m FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || left(t, p) || '<S>' || substr(t, p + m + 1) || '<M>' || substr(t, p + 1, m)
    ELSE '<S>' || substr(t, p + m + 1) || '<P>' || left(t, p) || '<M>' || substr(t, p + 1, m) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut"""


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.plan(documents(spark, sf_dir)).select(
        F.col("_kept.doc_id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


OP12_SQL = r"""WITH d AS (
  SELECT doc_id, source, t, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size,
    length(translate(t, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) AS solid,
    length(t) - length(regexp_replace(t, '[!-@\[-`{-~]', '', 'g')) AS marks,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || t), 1, 13) AS BIGINT) AS h
  FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
keyed AS (SELECT doc_id, source, size,
  floor((ln(-ln((h + 0.5::DOUBLE) / 4503599627370496)) - ln(CASE WHEN solid = 0 THEN 1.0::DOUBLE
    ELSE greatest(0.05::DOUBLE, 1 - marks::DOUBLE / solid) END) + 40) / 64 * 281474976710656) AS code FROM d),
per AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
weighed AS (SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
  list_extract([3.0::DOUBLE, 1.0, 2.0], (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1) AS w FROM per),
units AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM weighed),
aims AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT max(unit) FROM units WHERE unit < cap / w), cap)) AS target FROM units),
budget AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM aims),
placed AS (SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, floor(b.target + 0.5) - b.epochs * b.source_size AS room,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.code, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN budget b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
  CAST(epochs * size + least(greatest(room - before, 0), size) AS BIGINT) AS taken
FROM placed"""


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(documents(spark, sf_dir))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_quality_rules": op7_quality_rules,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_html_extraction": op9_html_extraction,
    "op10_language_id": op10_language_id,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_source_mixing": op12_source_mixing,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES: dict[str, str] = {
    "op5_chat_formatting": OP5_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op11_fill_in_middle": OP11_SQL,
    "op12_source_mixing": OP12_SQL,
}
