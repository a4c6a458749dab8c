"""The registered queries of the text-preparation operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeglass.llm import (
    conversation_repair,
    decontaminate,
    html_blocks,
    language_labels,
    license_rules,
    line_rules,
    near_dedup,
    packing,
    pii,
    quality,
    resampling,
    token_counts,
    url_filter,
)

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Rules of the registered URL query: (host and path, verdict).
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[run.__name__] = run
    return run


def given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Judge every page's URL; the number in a path is the document whose labels tell good from bad pages."""
    pages = given(spark, folder, "pages").select("page_id", "url")
    labels = given(spark, folder, "labels").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    number = F.regexp_extract("url", r"^[^:]*://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})[^/?#]*/?(?:[?#]|$)", 1)
    known = pages.select("page_id", F.when(number != "", number).cast("bigint").alias("doc_id")).join(labels, "doc_id").select("page_id", "bad")
    return url_filter.judge_urls(pages, known, URL_RULES)


@query
def op2_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Licences that each document names, by rules over sequences of known sentences."""
    found = license_rules.find_licenses(given(spark, folder, "documents"))
    return found.select("doc_id", F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", "licenses").alias("licenses"))


@query
def op3_fourier_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(given(spark, folder, "documents"), given(spark, folder, "labels"))


@query
def op4_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    judged = line_rules.clean_lines(given(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_checked_spans(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find_pii(given(spark, folder, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    digest = F.sha2(F.encode(listed("base_spans"), "UTF-8"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), listed("spans").alias("spans"))


@query
def op6_block_labels(spark: SparkSession, folder: str) -> DataFrame:
    found = html_blocks.main_text(given(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


@query
def op7_piece_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(given(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op8_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(given(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@query
def op9_containment(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(given(spark, folder, "documents"), given(spark, folder, "benchmark"))


@query
def op10_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(given(spark, folder, "documents"), near_dedup.Method(shingle=2))


@query
def op11_word_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of each document by its words' labels, learnt without the documents of fold 2."""
    docs = given(spark, folder, "documents").select("doc_id", "text", "lang")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    held_out = F.coalesce(fold == 2, F.lit(False)).alias("held_out")
    model = language_labels.fit(docs.where(~held_out).select("text", "lang"))
    return language_labels.languages(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


@query
def op12_role_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damage every conversation by a fixed rule, repair it at the least cost, and state the faults, edits and a digest."""
    given_rows = given(spark, folder, "conversations")
    repaired = conversation_repair.repair(conversation_repair.damaged(given_rows))
    every = given_rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    reports = repaired.reports.withColumnRenamed("conv_id", "_report")
    digests = conversation_repair.digests(repaired.rows).withColumnRenamed("conv_id", "_digest")
    joined = every.join(reports, F.col("conv_id").eqNullSafe(F.col("_report")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_digest")), "left")
    counts = [F.coalesce(name, F.lit(0)).cast("bigint").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"))


@query
def op13_target_draw(spark: SparkSession, folder: str) -> DataFrame:
    """Documents weighed by the benchmark's word runs, a quarter of them drawn."""
    drawn = resampling.resample(given(spark, folder, "documents"), given(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
