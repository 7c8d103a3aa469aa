"""Exact histogram of encoded lengths, and what its suffix sums tell of every context limit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifmill.llm import bitplane, text
from motifmill.llm.shared import in_arrow, save

#: Neighbouring lengths that one range of the two-level suffix sums has.
RANGE = 512


def _counts(path: str):
    def run(batches):
        enc = bitplane.encoder(path)
        for batch in batches:
            lens = [enc.lengths(part) for _, part in bitplane.groups(text.column(batch, "text"))]
            n, docs = np.unique(np.concatenate([np.zeros(0, np.int64), *lens]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(docs.astype(np.int64))], ["n_tokens", "n_docs"])
        enc.forget()

    return run


def histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs) of all whole texts, without special tokens; null text is empty, repeated rows count each.

    Written in the shared folder, so that its readers don't encode the texts again. No rows give none; other
    columns don't matter, and the order of rows with equal lengths neither.
    """
    d = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = in_arrow(d, _counts(tokenizer or bitplane.default_tokenizer()), "n_tokens long, n_docs long")
    return save(parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "lengths")


def limits(hist: DataFrame, width: int = RANGE) -> DataFrame:
    """For each length that occurs, taken as a context limit: how the corpus fares under it.

    n_tokens, n_docs (of just this length), docs_over and tokens_over (of longer documents),
    truncated_total (tokens if every document is cut to the limit), whole_share (documents that fit) and
    total (all tokens). Sums over longer documents are those of the ranges above and those of the rest
    of the range, so no task reads the whole histogram. A histogram without rows gives none.
    """
    h = hist.withColumn("range", F.floor(F.col("n_tokens") / width)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    above = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    everything = Window.partitionBy()
    ranges = h.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    zero = F.lit(0).cast("long")
    ranges = ranges.select(
        F.col("range").alias("range_"), F.coalesce(F.sum("d").over(above), zero).alias("docs_above"), F.coalesce(F.sum("t").over(above), zero).alias("tokens_above"),
        F.sum("d").over(everything).alias("docs"), F.sum("t").over(everything).alias("total"),
    )
    longer = Window.partitionBy("range").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    h = h.withColumn("docs_in", F.coalesce(F.sum("n_docs").over(longer), zero)).withColumn("tokens_in", F.coalesce(F.sum("tokens").over(longer), zero))
    h = h.join(ranges, F.col("range") == F.col("range_"))
    over, tokens_over = F.col("docs_in") + F.col("docs_above"), F.col("tokens_in") + F.col("tokens_above")
    return h.select(
        "n_tokens", "n_docs", over.alias("docs_over"), tokens_over.alias("tokens_over"),
        (F.col("total") - tokens_over + over * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("docs") - over) / F.col("docs")).alias("whole_share"), "total",
    )


def at_limit(hist: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit, a length of the corpus or not: docs_over, truncated_total, total."""
    n, d = F.col("n_tokens"), F.col("n_docs")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return hist.agg(total(F.when(n > limit, d)).alias("docs_over"), total(F.least(n, F.lit(limit)) * d).alias("truncated_total"), total(n * d).alias("total"))


def quantile(hist: DataFrame, share: float) -> DataFrame:
    """One row, n_tokens: the least length that at least this share of all documents doesn't exceed; null without documents."""
    return limits(hist).where(F.col("whole_share") >= share).agg(F.min("n_tokens").alias("n_tokens"))
