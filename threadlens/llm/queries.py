"""Registered queries of the operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import (bitplanes, bytecnn, cascade, ctw, decontam, exactdedup, laesa, langid, linefreq, packing, probminhash, toxicity,
                            whitening)
from threadlens.llm.common import held_out, shared_path
from threadlens.llm.encode import tokenizer_path
from threadlens.sources.tables import load


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


def op3_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.flag(docs, load(spark, sf_dir, "benchmark")).drop("text")


def op4_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = bitplanes.write_ids(load(spark, sf_dir, "documents"), shared_path(spark, "ids"),
                                 tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return bitplanes.read_ids(spark, folder)


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.cascade(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_site_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.drop_lines(load(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op6_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(load(spark, sf_dir, "documents"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", held_out(5, 0))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", held_out(3, 1))
    model = toxicity.train(docs.where(~F.col("held_out")), load(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "held_out", "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", held_out(5, 0))
    model = bytecnn.train(docs.where(~F.col("held_out")), load(spark, sf_dir, "labels"))
    scored = bytecnn.score(docs.select("doc_id", "held_out", "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").withColumn("held_out", held_out(7, 2))
    model = ctw.train(docs.where(~F.col("held_out")))
    return ctw.score(docs.select("doc_id", "held_out", "text"), model)


def op11_laesa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laesa.cluster(load(spark, sf_dir, "embeddings")).drop("centroid")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.classes(load(spark, sf_dir, "documents"))


def op13_block_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(load(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))  # null beyond 64 bits


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_best_fit_packing, op2_context_tree, op3_aho_corasick, op4_bit_planes, op5_language_mixture, op6_probminhash, op7_rule_cascade, op8_byte_cnn, op9_kneser_ney, op10_site_line_frequency,
    op11_laesa, op12_exact_dedup, op13_block_whitening)}
ORACLE: dict[str, str] = {"op7_rule_cascade": cascade.oracle_sql(), "op10_site_line_frequency": linefreq.oracle_sql(),
                          "op11_laesa": laesa.oracle_sql(), "op12_exact_dedup": exactdedup.oracle_sql()}
