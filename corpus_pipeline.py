"""From raw documents to packed sequences: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import exact_dedup, ngram_join, packing, quality_rules, suffix_dedup
from panelmill.llm.common import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current quality policy keeps, with all their columns.

    Null and empty texts have no words and go. Repeated rows stay or go together; null ids don't matter; an empty table
    gives none. Columns of any name are carried through untouched.
    """
    return quality_rules.kept_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the row with the smallest doc_id, with all its columns.

    A null id is the smallest. Of rows that repeat both id and text one stays. Null and empty texts are equal. An empty
    table gives none; helper columns take names that no column has.
    """
    return exact_dedup.unique_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest doc_id, with all its columns.

    Rows that repeat an id stay or go together, and those without an id stay. Texts without words are like none other.
    An empty table gives none; other columns are not read.
    """
    return ngram_join.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes and more that a document with a smaller doc_id holds; n_chars counts what is left.

    All rows stay. Rows with one id don't remove from each other; a null id is the smallest; a null text stays null, and
    n_chars is then null too. Characters of which bytes were removed go. Helper columns take names that no column has.
    """
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences.

    Every row makes pieces, repeated ones too; null and empty texts make one of the end id alone; a null id stays null;
    an empty table gives none. Equal lengths take places in any order.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("passages", passages), ("pack", pack)]

#: SQL cannot express the packing search; tests compare every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
