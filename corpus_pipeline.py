"""The corpus pipeline: its stages are applied to ``documents`` in order, each written as Parquet and read again.

Every stage but the last returns the columns of ``documents``; rows of any stage's input may repeat, and other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import decontam, langid, linefreq, packing, probminhash
from threadlens.llm.common import spare, stored
from threadlens.llm.encode import KEPT_FEW, tokenizer_path
from threadlens.sources.tables import load

#: A document goes if no language has this share of it.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some language is found: not null, with letters, and no jumble of many languages."""
    lang, score = spare(docs, "lang_pred", "score")
    held = docs.withColumnsRenamed({c: f"{c}__own" for c in docs.columns if c in ("lang_pred", "score", "mixture")})
    judged = langid.identify(held, langid.train(held)).withColumnsRenamed({"lang_pred": lang, "score": score})
    kept = judged.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SHARE)).drop(lang, score)
    return kept.toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; ``n_chars`` follows the text.

    Copies are still there, so a source's documents of equal text count as one: else a document that is often
    copied would lose all its lines.
    """
    out = linefreq.drop_lines(docs, counts=False, copies=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return probminhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    held = docs.withColumnsRenamed({c: f"{c}__own" for c in docs.columns if c in decontam.ADDED})
    flagged = decontam.flag(held, load(spark, sf_dir, "benchmark"))
    return flagged.where(~F.col("contaminated")).drop(*decontam.ADDED).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document's token pieces and their places in sequences of 2048 tokens.

    Executors hold what the stages before have left, so their workers keep few words.
    """
    return packing.pack(packing.pieces(docs, tokenizer_path("word_bpe_49k.json"), kept=KEPT_FEW))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup),
          ("benchmark decontamination", decontamination), ("best-fit packing", pack)]

#: Tokenizers and trained models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the whole ``documents`` table."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
