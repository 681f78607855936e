"""From raw documents to token ids: five stages, each on all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``.  All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import take
from ledgerloom.llm.ngram_jaccard import keep_representatives
from ledgerloom.llm.quality_classifier import keep_quality
from ledgerloom.llm.queries import held_out, piece_model_path
from ledgerloom.llm.sentencepiece_model import encode_pieces
from ledgerloom.llm.shared import drop_table, read_table, write_table
from ledgerloom.llm.substring_dedup import without_repeats


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels").where(~held_out()))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each class of five-word shingle sets linked at 0.8 or more."""
    return keep_representatives(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 50-word windows that an earlier document has; n_chars follows the text."""
    return without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the entropy-balanced mix takes them."""
    return take(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document's text."""
    encoded = encode_pieces(docs, piece_model_path())
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids")


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("repeated_passages", without_repeated_passages),
    ("mixing", mixed_sources),
    ("token_ids", token_ids),
]

#: No SQL expresses a fitted classifier, recompression or piece merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, done = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}"), docs
        drop_table(done)  # nothing reads a stage's input once its output is written
    return docs
