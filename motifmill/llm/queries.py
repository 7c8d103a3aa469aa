"""The registered query of each operator, over its whole table, and DuckDB SQL where SQL can express it.

Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names have the results
that the operators' docstrings state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.llm import bitplane, bm25, chaining, chosenpath, curriculum, hpylm, interactions, lengths, licenses, quality, ranking, salvage, toolcalls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hpylm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole texts, learnt from those not held out; as `hpylm.score`."""
    return hpylm.score(_table(spark, sf_dir, "documents"))


def op2_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bit-plane store of all whole texts gives back; as `bitplane.digests`."""
    return bitplane.round_trip(_table(spark, sf_dir, "documents"))


def op3_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share with earlier ones; as `chaining.passages`."""
    return chaining.passages(_table(spark, sf_dir, "documents"))


def op4_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold; as `bm25.leaks`."""
    return bm25.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with the words that the mix takes of it, by its first training position (those that aren't taken last); as `curriculum.mix`."""
    mixed = curriculum.mix(_table(spark, sf_dir, "documents"))
    first = F.round(F.get("positions", F.lit(0)), 6)
    out = mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), first.alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op6_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that the conversations' turns stand for, linked with their results; as `toolcalls.link`."""
    return toolcalls.link(*toolcalls.from_conversations(_table(spark, sf_dir, "conversations")))


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every encoded length of all whole texts as a context limit; as `lengths.limits`."""
    return lengths.limits(lengths.histogram(_table(spark, sf_dir, "documents")))


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its class of near duplicates and its links; as `chosenpath.join`."""
    return chosenpath.join(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its base counts, score and verdict; as `quality.score_documents`."""
    out = quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "toxicity", "ratio_failed", "toxic_failed")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its licence labels; as `licenses.scan`."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of each source's documents in all orders, and their Shapley values; as `interactions.audit`."""
    cells = interactions.document_cells(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return interactions.audit(cells, interactions.FILTERS)


def op12_length_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item; as `ranking.best`."""
    return ranking.best(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What archives of all pages give back; as `salvage.round_trip`."""
    return salvage.round_trip(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_hpylm_score, op2_bitplane_ids, op3_collinear_passages, op4_bm25_decontamination, op5_curriculum_mix,
        op6_tool_call_links, op7_length_histogram, op8_chosen_path_join, op9_quality_rules, op10_license_scan,
        op11_filter_interactions, op12_length_strata, op13_warc_salvage,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from motifmill.llm import sql

    return dict(sql.ORACLES)
