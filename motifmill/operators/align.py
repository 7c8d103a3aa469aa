"""Alignment of matrices with p-values: the best offset of each query and target against the chance of such a score.

A place of the query scores against a place of the target by their correlation, in whole steps. The scores
of a query's place against all places of all targets are its null distribution; that of a run of places is
the convolution of theirs, built up place by place. An offset's p-value is the chance that the run of query
places that it lays over the target scores as much.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifmill.operators import degenerate
from motifmill.session import save

#: Steps from a correlation of -1 to one of 1.
STEPS = 100


def steps_of(r: Column, steps: int) -> Column:
    """A correlation in whole steps from -1; noise beyond 9 places is cut, so that halves go up alike."""
    return F.floor(F.round((r + 1) * steps / 2, 9) + 0.5).cast("long")


def place_scores(rows: DataFrame, alphabet: int, steps: int) -> DataFrame:
    """(query, i, step, n): how many places of all targets score so many steps against a query's place, from `degenerate.matrices`.

    Equal places are scored once, so that what is compared is the places that differ.
    """
    place = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.slice("unit", (i * alphabet + 1).cast("int"), alphabet).alias("u")))
    places = save(rows.select("pattern", F.inline(place)).select("pattern", "i", F.transform("u", lambda x: F.round(x, 12) + 0.0).alias("u")), "places")
    kinds = save(places.groupBy("u").agg(F.count("*").alias("n")).withColumn("pattern", F.to_json("u")), "kinds")
    pairs = degenerate.pattern_pairs(kinds)
    same = kinds.select(F.struct(*kinds.columns).alias("a"), F.struct(*kinds.columns).alias("b"))
    r = F.aggregate(F.zip_with("a.u", "b.u", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.union(pairs.select("b", "a")).union(same).select(F.col("a.pattern").alias("kind"), steps_of(r, steps).alias("step"), F.col("b.n").alias("n"))
    each = save(scored.groupBy("kind", "step").agg(F.sum("n").alias("n")), "place_scores")
    return places.select(F.col("pattern").alias("query"), "i", F.to_json("u").alias("kind")).join(each, "kind").select("query", "i", "step", "n")


def _tails(steps: int):
    """(query, null) to (query, first, last, tail): tail[s] is the chance that a run of places scores s steps or more."""

    def run(batches):
        for batch in batches:
            rows = []
            for query, null in zip(batch.column("query").to_pylist(), batch.column("null").to_pylist()):
                single: dict[int, np.ndarray] = {}
                for x in null:
                    single.setdefault(x["i"], np.zeros(steps + 1))[x["step"]] = x["n"]
                single = {i: d / d.sum() for i, d in single.items()}
                for first in sorted(single):
                    d = np.ones(1)
                    for last in range(first, len(single)):
                        d = np.convolve(d, single[last])
                        rows.append((query, first, last, np.cumsum(d[::-1])[::-1]))
            kinds = pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], ["query", "first", "last", "tail"])

    return run


def aligned(ppm: DataFrame, least_overlap: int = 2, alphabet: int = 4, steps: int = STEPS) -> DataFrame:
    """(query, target, offset, overlap, score, p, e, q): each query's best offset on every other target, from (pattern, pos, chr, w).

    The best is the one of the least p-value, then of the smallest shift, then the negative one; place i of the query lies over
    place i + offset of the target. score is in steps, the sum over the overlap. p is corrected for the offsets tried,
    1 - (1 - p)^offsets; e is p times the targets; q the least share of false ones among the query's
    targets of at most this p. Pairs without an offset of enough overlap have no row.
    """
    rows = save(degenerate.matrices(ppm, alphabet), "matrices")
    targets = rows.count() - 1
    scores = place_scores(rows, alphabet, steps)
    null = scores.groupBy("query").agg(F.collect_list(F.struct("i", "step", "n")).alias("null"))  # steps + 1 entries a place
    tails = save(null.mapInArrow(_tails(steps), "query string, first int, last int, tail array<double>"), "tails")
    pairs = degenerate.pattern_pairs(rows)
    d = pairs.union(pairs.select("b", "a")).select(F.col("a").alias("x"), F.col("b").alias("y"))
    d = d.select("x", "y", F.explode(F.sequence(1 - F.col("x.n"), F.col("y.n") - 1)).alias("offset"))
    d = d.withColumn("overlap", degenerate.overlap_of(F.col("x.n"), F.col("y.n"), F.col("offset"))).where(F.col("overlap") >= least_overlap)
    first = F.greatest(-F.col("offset"), F.lit(0))
    cut = lambda m, i, at: F.transform(F.slice(F.col(m), ((at + i) * alphabet + 1).cast("int"), alphabet), lambda u: F.round(u, 12))
    r = lambda i: F.aggregate(F.zip_with(cut("x.unit", i, first), cut("y.unit", i, first + F.col("offset")), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    score = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("overlap") - 1), lambda i: steps_of(r(i), steps)), F.lit(0).cast("long"), lambda s, v: s + v)
    d = d.select(F.col("x.pattern").alias("query"), F.col("y.pattern").alias("target"), "offset", "overlap", first.alias("first"), (first + F.col("overlap") - 1).alias("last"), score.alias("score"))
    d = d.join(tails, ["query", "first", "last"]).withColumn("p", F.element_at("tail", (F.col("score") + 1).cast("int")))
    best = d.groupBy("query", "target").agg(
        F.count("*").alias("offsets"), F.min(F.struct(F.round(F.log("p"), 9).alias("log"), F.abs("offset").alias("shift"), "offset", "overlap", "score")).alias("b"), F.min("p").alias("p")
    )
    p = 1 - F.pow(1 - F.col("p"), F.col("offsets"))
    d = best.select("query", "target", "b.offset", F.col("b.overlap").cast("long").alias("overlap"), "b.score", p.alias("p"))
    rank = F.rank().over(Window.partitionBy("query").orderBy(F.col("p").desc()))  # a query's targets
    most = Window.partitionBy("query").orderBy(F.col("p").desc()).rangeBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("n", F.count("*").over(Window.partitionBy("query"))).withColumn("upto", F.col("n") - rank + 1)
    d = d.withColumn("q", F.least(F.min(F.col("p") * F.col("n") / F.col("upto")).over(most), F.lit(1.0)))
    return d.select("query", "target", "offset", "overlap", "score", "p", (F.col("p") * targets).alias("e"), "q")
