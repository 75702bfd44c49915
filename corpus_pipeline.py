"""The corpus pipeline: quality rules, language ID, near duplicates, repeated passages, packing.

Each stage takes a stored table with at least doc_id, text and lang and, but for the last, returns some of its rows with its
columns (extra ones too). Equal or null doc_ids are documents of their own; an empty table gives no rows; texts of
any length are judged whole.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from impactlake.llm import language_id, ngram_join, packing, quality_rules, suffix_dedup
from impactlake.llm.common import crc_mod, free_name, written
from impactlake.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Null and empty texts have too few words and go; a null language is one of its own; repeated rows stay or go together."""
    (name,) = free_name(docs, "quality")
    return quality_rules.quality(docs).filter(F.col(name)["kept"]).select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is plain; the dictionaries are those of the labelled texts that came in, but one crc32 class of three. Null texts, texts without a letter, ties and narrow margins are rejected; null languages teach nothing."""
    (name,) = free_name(docs, "language")
    learned = language_id.fit_dictionaries(docs.filter(crc_mod(docs["doc_id"], 3) != 1), docs["text"], docs["lang"])
    return language_id.identify(docs, learned).filter(~F.col(name)["rejected"]).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 or more over five-word shingles connect: the one of the smallest doc_id. Of repeated rows one stays; null texts and texts without a word are linked with nothing and all stay."""
    return ngram_join.one_of_each(docs, Fraction(8, 10), width=5)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of 50 words or more that occur twice or more; n_chars follows the text. Null, empty and shorter texts stay as they are; repeated rows lose all of a text of 50 words."""
    (name,) = free_name(docs, "repeats")
    found = F.col(name)
    changed = {"text": F.when(found["n_removed"] > 0, found["kept_text"]).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(found["n_removed"] > 0, F.length(found["kept_text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return suffix_dedup.without_repeats(docs, width=50, unit="words").withColumns(changed).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of 1024 tokens. Null and empty texts are a piece of the end id alone."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [("quality_rules", quality_stage), ("language_id", language_stage), ("near_duplicates", near_duplicate_stage), ("repeated_passages", repeated_passage_stage), ("best_fit_packing", packing_stage)]
#: Perplexities, compressed sizes and tokens cannot be had in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each on what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
