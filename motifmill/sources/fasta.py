"""Sequence sources: FASTA text, matrices and cluster files, and sequences derived from tables.

A sequence set is a DataFrame of seq_id BIGINT, title STRING, seq STRING.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifmill.session import save

RNA = "ACGU"
#: Hexadecimal digits as letters, four digits to each.
HEX, LETTERS = "0123456789abcdef", "ACGUACGUACGUACGU"


def _numbered(d: DataFrame) -> DataFrame:
    """seq_id: the place in the order of files, of their blocks, and of lines.

    Spark reads a block of a file as a run of rows of one task, in order; how many rows each block has tells
    where its numbers begin.
    """
    d = d.withColumn("row_", F.monotonically_increasing_id())
    block = d.groupBy("file_", "start_").agg(F.min("row_").alias("first_"), F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("file_", "start_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block of a file
    block = block.select(F.col("file_").alias("f_"), F.col("start_").alias("s_"), (before - F.col("first_")).alias("shift_"))
    block = save(block, "blocks")  # a written table, so that Spark knows its size and sends it to all tasks only if it is small
    d = d.join(block, (F.col("file_") == F.col("f_")) & (F.col("start_") == F.col("s_")))
    return d.withColumn("seq_id", F.col("row_") + F.col("shift_")).drop("row_", "shift_", "file_", "start_", "f_", "s_")


def _place() -> list[Column]:
    return [F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("start_")]


def single_line(spark: SparkSession, path: str) -> DataFrame:
    """Every line that is neither blank nor a title is one sequence; N, Y and S are deleted."""
    line = F.trim(F.regexp_replace("value", r"\r", ""))
    d = spark.read.text(path).select(line.alias("line"), *_place()).where("line <> '' and line not like '>%'")
    return _numbered(d).select("seq_id", F.lit(None).cast("string").alias("title"), F.translate("line", "NYS", "").alias("seq"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    d = _numbered(spark.read.option("lineSep", ">").text(path).select("value", *_place()).where(F.trim("value") != ""))
    lines = F.split(F.regexp_replace("value", r"\r", ""), "\n")
    body = F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "")
    return d.select("seq_id", F.trim(lines[0]).alias("title"), body.alias("seq"))


def multi_line(spark: SparkSession, path: str, least: int = 0) -> DataFrame:
    """One sequence per record; those shorter than `least` or with an S ("Sequence unavailable") are dropped."""
    return _records(spark, path).where((F.length("seq") >= least) & ~F.col("seq").contains("S") & (F.col("seq") != "")).select("seq_id", "title", "seq")


def upper(spark: SparkSession, path: str) -> DataFrame:
    """One upper-case sequence per record, unfiltered."""
    return _records(spark, path).select("seq_id", "title", F.upper("seq").alias("seq"))


def stats(seqs: DataFrame) -> DataFrame:
    n = F.length("seq").cast("long")
    return seqs.agg(F.count("*").alias("n"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.sum(n).alias("letters"))


def ppm(spark: SparkSession, path: str) -> DataFrame:
    """Position matrices of a folder of PPM-<pattern>.txt files, long: pattern, pos, chr, w."""
    d = spark.read.option("sep", "\t").option("header", True).csv(path)
    letters = [c for c in d.columns if c != "PO"]
    d = d.withColumn("pattern", F.url_decode(F.regexp_extract(F.col("_metadata.file_name"), r"PPM-(.*)\.txt$", 1)))  # brackets are escaped in it
    return d.unpivot(["pattern", "PO"], letters, "chr", "w").select("pattern", F.col("PO").cast("int").alias("pos"), "chr", F.col("w").cast("double").alias("w"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, pattern) of a file with one tab-separated cluster on each line."""
    d = spark.read.text(path).where("value <> ''").withColumn("cluster_id", F.monotonically_increasing_id())
    return d.select("cluster_id", F.explode(F.split(F.regexp_replace("value", r"\r", ""), "\t")).alias("pattern")).where("pattern <> ''")


def alignments(spark: SparkSession, path: str) -> DataFrame:
    """(query, target, offset, p, e, q) of an external aligner's tab-separated result.

    A header may begin with # or not; rows are those whose offset is a whole number and whose values are numbers.
    """
    v = F.split(F.regexp_replace("value", r"\r", ""), "\t")
    d = spark.read.text(path).where("value <> '' and value not like '#%'").select(v.alias("v")).where(F.size("v") >= 6)
    n = lambda i, kind: F.get("v", F.lit(i)).try_cast(kind)
    d = d.select(F.get("v", F.lit(0)).alias("query"), F.get("v", F.lit(1)).alias("target"), n(2, "int").alias("offset"), *[n(i, "double").alias(c) for i, c in ((3, "p"), (4, "e"), (5, "q"))])
    return d.where("offset is not null and p is not null")


def pwm_kmers(spark: SparkSession, path: str) -> DataFrame:
    """The body lines of a FASTA file."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", r"\r", "")).alias("kmer")).where("kmer <> '' and kmer not like '>%'")


def hashed(table: DataFrame, key: str, salt: str = "") -> DataFrame:
    """One 32-letter sequence per key of a table, from the key's md5."""
    return table.select(F.col(key).cast("long").alias("seq_id"), from_key(F.col(key), salt).alias("seq"))


def from_key(key: Column, salt: str = "") -> Column:
    return F.translate(F.md5(F.concat(F.lit(salt), key.cast("string")).cast("binary")), HEX, LETTERS)


def from_text(docs: DataFrame) -> DataFrame:
    """The letters A, C, G, T, U of each document's upper-cased text."""
    return docs.select(F.col("doc_id").alias("seq_id"), F.regexp_replace(F.upper("text"), "[^ACGTU]", "").alias("seq"))
