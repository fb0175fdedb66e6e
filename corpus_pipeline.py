"""The corpus pipeline: language ID, near-dedup, suffix-array dedup, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps with their columns, the last one the encoded
documents. run() writes every stage's result as Parquet and rereads it as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.llm import decontaminate, langid, minhash, pieces, suffix_dedup
from volspark.llm.common import materialise, table

#: A prediction less sure than this is a rejection; with four languages an even guess scores 0.25.
LEAST_SCORE = 0.3


def _recounted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, follows a changed text."""
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or null (und) and those whose best language scores under LEAST_SCORE. Without rows to
    learn from every document goes; each of repeated rows is judged alone; very long texts are read whole, in pieces."""
    model = langid.fit(docs, F.lit(True))
    out, lang, score = langid.identify(docs, model)
    return out.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (5-word shingles, similarity 0.8) one row stays, that of the smallest doc_id; rows without one take
    part and stay only where no row of their class has one. Several texts under one doc_id are judged each alone, and those that resemble none stay. Of rows equal in doc_id and text any one stays; texts without words all
    stay; an empty table gives one."""
    return minhash.first_of_classes(docs, k=5)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte out of the texts that a repeated 200-byte string covers; no document goes. Null and shorter texts stay as they
    are; repeated rows are copies of each other and lose all; very long texts are searched in pieces; an empty table gives one."""
    return _recounted(suffix_dedup.remove_repeats(docs), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the words that benchmark windows cover; documents covered by more than half go. Texts without words stay; each of repeated
    rows is judged alone; an empty table or benchmark leaves what there is."""
    return _recounted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_words, n_pieces, ids (4-byte little-endian integers), and whether decoding gives the text back (U+2581 being a space).
    Null texts have null ids, empty ones none; a row for each of repeated rows; an empty table gives one."""
    model = pieces.read_model(pieces.tokenizer_path())
    out, n_words, ids, decoded = pieces.encode(docs, model)
    same = F.col(decoded) == F.replace("text", F.lit(pieces.SPACE), F.lit(" "))
    return out.select("doc_id", "lang", "source", F.col(n_words).alias("n_words"), F.coalesce(F.octet_length(ids) / 4, F.lit(0)).cast("long").alias("n_pieces"), F.col(ids).alias("ids"), same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: Learned and hashed stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
