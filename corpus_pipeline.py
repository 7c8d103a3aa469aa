"""A corpus pipeline of five stages, each working on all documents that its predecessor kept.

Every stage takes (spark, docs, sf_dir); its rows are written as Parquet in the shared folder and read
again as the next stage's docs. All work on whole texts, take a null text for an empty one, keep the columns
of docs whatever their names (but for the last stage), and give no rows for none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.llm import bitplane, bm25, chosenpath, curriculum, quality
from motifmill.llm.shared import save


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, and the whole row, whatever its columns are named."""
    return docs.select("doc_id", "source", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row_"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules, the n-gram likelihood ratio or the limit on toxic words reject go.

    Null and empty texts fail the base rules. Repeated rows and rows without doc_id are judged by their text
    alike. The fewer labels there are, the nearer the limits are to fixed ones (`quality.score_documents`).
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_documents(_whole(docs), labels, keep=("row_",)).where("kept").select("row_.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the least doc_id.

    Equal rows stay once; a class without any doc_id keeps the row of the least text hash; texts that are null
    or have no word are no duplicates.
    """
    return chosenpath.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; an empty benchmark, or one of items without words, removes nothing.
    """
    return bm25.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, sorted by training position.

    Documents of a null source are a source of their own, the last. Texts without words have size 0 and are
    taken as `curriculum.mix` says. Ties of positions stand in the order of doc_id.
    """
    mixed = curriculum.mix(_whole(docs), keep=("row_",))
    return curriculum.in_order(mixed).select("row_.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the documents' ids as a bit-plane store and digest what is read back from it: doc_id, start, n_tokens, ids_crc32.

    One row for each row of docs, in ascending doc_id order (null first), rows of one doc_id by their texts; a
    null or empty text has the end id alone.
    """
    return bitplane.round_trip(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_ids),
]

#: SQL can express neither the hashed likelihood ratio nor the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from documents to the digests of the store."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
