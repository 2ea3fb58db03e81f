"""From raw documents to token ids: the stages of a training corpus.

``STAGES`` names them in order.  Each takes (spark, docs, sf_dir), works on all
documents the stage before has kept, and returns a DataFrame that is written
and read again as the next one's documents; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitloom.llm import line_dups, mixing, near_dups, pieces, quality_rules
from remitloom.llm.queries import VOCABULARY
from remitloom.llm.scratch import freeze

MIN_DOCS_OF_A_LINE = 10


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rule or a certified cutoff rejects."""
    return quality_rules.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that ten or more of these documents have; a document may end up empty."""
    return line_dups.without_repeated_lines(docs, min_docs=MIN_DOCS_OF_A_LINE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 of their five-word shingles: the one with the smallest id."""
    return near_dups.one_of_each(docs, shingle=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; those without words are not taken."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids and whether decoding gives the text back."""
    wanted = docs.select(F.struct("doc_id", "source").alias("row"), "text")
    encoded = pieces.encode(wanted, pieces.Vocabulary.load(VOCABULARY), id_column="row")
    return encoded.select("row.doc_id", "row.source", F.size("ids").cast("long").alias("n_ids"), "ids", "exact")


STAGES = [
    ("quality rules", reject_low_quality),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL expresses neither the certified cutoffs nor the ids; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = freeze(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
