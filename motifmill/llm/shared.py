"""Checkpoint tables, Arrow tasks and grouping helpers used by several operators."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.session import discard, new_path, save, shared_dir  # noqa: F401

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch, about; a single longer row is a batch of its own.
BATCH_BYTES = 4 << 20


@functools.lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # not this C library
        return lambda _: 0


def released(run):
    """run, at whose end the worker gives freed memory back to the system, since workers live on for the next stage."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return task


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow in batches of bounded bytes, with workers that hold nothing between tasks.

    The bound on batches is a setting of the session, which is lowered to BATCH_BYTES and stays.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(released(run), schema)


def save_and_free(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """`save`, then let Spark's cleaner remove the shuffle files of finished jobs, which can be as large as the input, before its own next turn."""
    out = save(df, name, by)
    del df
    for _ in range(2):  # what the first round lets go of holds the shuffles of the second
        gc.collect()
        out.sparkSession.sparkContext._jvm.System.gc()
    return out


def row_groups(batches, key: list[str], max_rows: int = 1 << 16):
    """Consecutive rows with equal keys, from Arrow batches that are sorted by them.

    Yields (key tuple, pa.Table). A group is held whole, so callers bound its size.
    """
    import numpy as np

    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cut = np.zeros(batch.num_rows, bool)
        cut[0] = True
        for k in key:
            col = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            cut[1:] |= col[1:] != col[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], batch.num_rows)
        for s, e in zip(starts.tolist(), ends.tolist()):
            k = tuple(table.column(c)[s].as_py() for c in key)
            if held and k != held_key:
                yield held_key, pa.concat_tables(held)
                held = []
            held_key = k
            held.append(table.slice(s, e - s))
    if held:
        yield held_key, pa.concat_tables(held)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root): the smallest id that each id of ``edges`` (a, b) is connected with.

    Alternates large-star and small-star steps, which takes a number of rounds logarithmic in the
    component's size. Each round is one written table, so that lost executors cost one round.
    Raises if the labels haven't settled after ``max_rounds``.
    """
    # (u, v) with v < u: u hangs below v
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    cur = save(down, "cc0")
    for i in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u hangs below the least of u's neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours hang below the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        nxt = save(small, f"cc{i + 1}")
        # settled when every u has one parent and no parent hangs below another
        parents = nxt.groupBy("u").agg(F.count("*").alias("n"))
        bad = parents.where("n > 1").select("u").union(nxt.select(F.col("v").alias("u")).join(parents.select("u"), "u", "left_semi"))
        if bad.isEmpty():
            roots = nxt.select(F.col("u").alias("id"), F.col("v").alias("root"))
            return roots.union(nxt.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        cur = nxt
    raise RuntimeError("connected components did not settle")
