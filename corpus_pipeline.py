"""The corpus pipeline: documents without the toxic, with repeated passages cut, one of each near-duplicate class, mixed to
target weights, packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared folder
and reads it again as the next stage's docs. Every stage works on all that the one before it kept; all but the last return
the columns of documents. The mixing stage repeats a document's row as often as the mix takes it.

Defined results: a null text is empty: not toxic, unlike all texts but other empty ones, of size 0 (taken, if its source has
a target), packed as its end id; rows of a null doc_id take part in all stages; rows that repeat are one document to the
near-duplicate stage, which keeps one of them; where documents tie, the least doc_id, then a hash of the text, is the first; columns
beyond those that a stage reads are kept as they are, whatever their names, and left out by the last stage; n_chars is the
text's new length where passages were cut; an empty table gives no rows; very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thornwick.llm import linededup, mixing, neardup, packing, toxicity
from thornwick.llm.common import settled, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier predicts toxic (score of 0.7 or more)."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that an earlier document holds; every row stays."""
    return linededup.dedup_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each class."""
    return neardup.without_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's documents to its target, some not at all and some twice."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: No stage but mixing can be put in SQL (a trained scan, alignment, a vocabulary's tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(name, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
