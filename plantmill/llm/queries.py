"""One query for each operator: the operator on its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantmill.llm import chat, classifier, decontaminate, language, lattice, licences, manifest, prefix_counts, quality, simhash, tokenfile, urls, whitening
from plantmill.llm.common import table
from plantmill.llm.oracles import ORACLES  # noqa: F401

END_ID, TOKEN_LIMIT = 2, 4096


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_and_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages"), urls.rules_frame(spark))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lattice.encode(docs, model, spell=True)
    text = F.translate(F.coalesce("text", F.lit("")), "▁", " ")  # the model spells its space mark as a space
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == text).alias("round_trip"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), TOKEN_LIMIT)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fits_chars")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    out = chat.format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own))
    read = out.select("conv_id", chat.turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"), F.length("formatted").alias("n"), "in_order")
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.col("n").cast("long").alias("formatted_chars"), "in_order",
    )


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.audit(table(spark, sf_dir, "documents"), manifest.without_newlines(F.col("doc_id"), F.col("text")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_simhash, op3_url_filter, op4_sentencepiece, op5_token_counts, op6_language, op7_chat, op8_licences, op9_decontaminate, op10_quality,
        op11_quality_classifier, op12_whitening, op13_merkle_manifest,
    )
}
