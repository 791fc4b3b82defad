"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import decontamination, lm_scoring, oracles, packing, preference, prefix_free, prefix_trie, pu_quality, quality_rules, simhash, structure_repair, substring_fm, token_scan, toxicity
from .rows import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def labels(spark, folder):
    return spark.read.parquet(f"{folder}/labels.parquet")


@query
def op1_nn_pu_quality(spark, folder):
    return pu_quality.quality_scores(documents(spark, folder), labels(spark, folder))


@query
def op2_cross_entropy_difference(spark, folder):
    return lm_scoring.cross_entropy_difference(documents(spark, folder), labels(spark, folder).where("quality = 1"))


@query
def op3_cutting_stock_packing(spark, folder):
    return packing.pack(documents(spark, folder))


@query
def op4_substring_fm_index(spark, folder):
    return substring_fm.substring_dedup(documents(spark, folder)).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLES["op4_substring_fm_index"] = oracles.SUBSTRING


@query
def op5_prefix_free_parsing(spark, folder):
    return prefix_free.prefix_free_dedup(documents(spark, folder)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op6_preference_format(spark, folder):
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    convs = preference.conversations(turns)
    # The table names no preferences: conversations that open alike are paired, and neighbours by id.
    pairs = preference.first_turn_pairs(convs).union(preference.neighbour_pairs(convs)).distinct()
    made = preference.preference_format(turns, pairs)
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), " ")
    return made.withColumns({c: spans(c) for c in ("chosen_mask", "rejected_mask")})


ORACLES["op6_preference_format"] = preference.ORACLE


@query
def op7_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(documents(spark, folder)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_separator_scan(spark, folder):
    return token_scan.document_token_counts(documents(spark, folder), in_files=True)


@query
def op9_line_rules(spark, folder):
    return quality_rules.line_rules(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op9_line_rules"] = oracles.RULES


@query
def op10_cgk_decontamination(spark, folder):
    return decontamination.leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet")).select(
        "doc_id", "item_id", "distance", "at", "n_words")


@query
def op11_conversation_trie(spark, folder):
    return prefix_trie.family_trie(spark.read.parquet(f"{folder}/conversations.parquet")).drop("na", "nb")


ORACLES["op11_conversation_trie"] = prefix_trie.ORACLE


@query
def op12_structure_repair(spark, folder):
    return structure_repair.structure_repair(spark.read.parquet(f"{folder}/conversations.parquet"))


@query
def op13_boosted_toxicity(spark, folder):
    return toxicity.toxicity_scores(documents(spark, folder), labels(spark, folder))


@query
def pipeline(spark, folder):
    return corpus_pipeline.run(spark, folder)
