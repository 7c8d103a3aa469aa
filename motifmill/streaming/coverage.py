"""k-mer coverage of sequences that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from motifmill.operators import kmers


def start(seqs: DataFrame, ks: list[int], path: str, checkpoint: str, alphabet: str | None = None) -> StreamingQuery:
    """Append each micro-batch's exact (batch, k, kmer, visits, cov) to a table; sequences arrive in one batch each, so sums over batches are exact."""

    def write(batch: DataFrame, number: int) -> None:
        c = kmers.coverage(kmers.index(batch, ks, alphabet))
        c.write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is run again replaces itself

    return seqs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def total(spark, path: str) -> DataFrame:
    """(k, kmer, visits, cov) over all batches so far."""
    return spark.read.parquet(path).groupBy("k", "kmer").agg(F.sum("visits").alias("visits"), F.sum("cov").alias("cov"))
