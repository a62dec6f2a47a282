"""The registered queries of the ten operators, with production parameters on their whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, licenses, linededup, mixing, ngram_join, quality, secrets_scan, sp_wfst, tokenfile
from .common import reach, table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; it is the same on every machine that has the tokenizers."""
    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_one_bit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op3_sentencepiece_wfst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with the digest of each text; the round trip is told by a flag, decode_documents gives the texts back."""
    return sp_wfst.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    turns = rows.unionByName(extra).select("conv_id", "turn", "role", chat.text_parts(F.coalesce("text", F.lit(""))).alias("parts"))
    return chat.read_back(chat.format_chat(turns))


def op7_bit_plane_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfile.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read_token_files(spark, files)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scan_secrets(table(spark, sf_dir, "documents"))
    n = {r.kind: F.col("n")[i].alias(f"n_{r.kind}") for i, r in enumerate(secrets_scan.BASE)}
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *n.values(), "base_sha256", spans.alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    reach(spark)
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    fns = (op1_mix_sources, op2_one_bit_ann, op3_sentencepiece_wfst, op4_ngram_jaccard_join, op5_license_scan, op6_chat_format, op7_bit_plane_token_files, op8_line_dedup, op9_secret_scan, op10_quality_rules)
    return {f.__name__: f for f in fns}


def _license_sql(dice: float = 0.8) -> str:
    rows = ", ".join(f"({k}, '{name}', [{', '.join(repr(b) for b in licenses.template_bigrams(text))}])" for k, (name, text) in enumerate(licenses.TEMPLATES))
    return f"""
WITH t(template, license, bigrams) AS (VALUES {rows}),
lines AS (
  SELECT doc_id, generate_subscripts(ls, 1) - 1 line, unnest(ls) raw
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents)),
words AS (
  SELECT doc_id, line, string_split(trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ') w FROM lines),
sets AS (
  SELECT doc_id, line, list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2])) b FROM words WHERE len(w) BETWEEN 2 AND 200),
hits AS (
  SELECT doc_id, line, template, license, 2.0 * len(list_intersect(b, bigrams)) / (len(b) + len(bigrams)) dice FROM sets, t
  WHERE len(b) * {2 - dice} >= len(bigrams) * {dice} AND len(bigrams) * {2 - dice} >= len(b) * {dice}),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, template) r FROM hits WHERE dice >= {dice})
SELECT doc_id, list_sort(list_distinct(list(license))) licenses, count(DISTINCT line) n_lines, max(dice) best_dice
FROM best WHERE r = 1 GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_license_scan": _license_sql()}
