"""From raw documents to token ids: each stage works on all the one before it kept.

Defined cases: a null text counts as empty in every stage, and line dedup hands it on as empty; rows with one doc_id pass the
first stage each by their own text, are one document to line dedup and near duplicates, and share their fate; rows without doc_id lose no
line and are no near duplicate; texts of any length are read whole; an empty table passes through all stages; other columns of
documents are carried to the last stage, which returns doc_id, lang, source and the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augury.llm import bpe, decontamination, line_dedup, near_duplicates, quality_classifier
from augury.llm.common import table, written

KEEP_QUALITY = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the compression classifier accepts."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_classifier.score(F.col("text"), model) >= KEEP_QUALITY)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat across documents."""
    out = line_dedup.cleaned(docs, line_dedup.build(docs)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (80 % of five-word shingles)."""
    gone = near_duplicates.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every document; lossless: decoding gives the text back."""
    coded = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    coded = coded.withColumn("coded", bpe.round_trip(F.col("text"), bpe.default_file()))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        bpe.n_tokens(F.col("coded.ids")).alias("n_tokens"),
        F.col("coded.ids").alias("ids"),
        (F.col("coded.decoded") == F.col("text")).alias("lossless"),
    )


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near duplicates", near),
    ("decontamination", decontaminate),
    ("tokens", tokens),
]

# Fitted scores, byte-pair merges and similarity components have no SQL form; tests hold the stages
# against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
