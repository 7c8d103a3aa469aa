"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Every source has a weight (its share of all words) and a schedule (how its rate changes over training
time 0 to 1, piecewise linear). The integral of the schedule, inverted at a document's place in its
source's stream of demanded words, is the document's training position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifmill.llm.shared import save

WEIGHTS = (1.0, 2.0, 3.0)
#: Knots (time, rate) of the schedules, dealt to the sources in turn: falling, flat, rising.
SCHEDULES = (((0.0, 3.0), (0.5, 1.0), (1.0, 1.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 1.0), (1.0, 3.0)))
#: A table of sources up to this size is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null has none."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    edges = (parts[0] == "").cast("int") + (F.element_at(parts, -1) == "").cast("int")
    return F.greatest(F.size(parts) - edges, F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: float = 3.0) -> DataFrame:
    """(source, source_size, source_no, target) from (source, size).

    Sources are numbered by code point, null last, and take the weights in turn. A target is weight
    times one common level, or max_repeats times the source's size if that is less; the level is where
    the targets add up to all sizes, which is what resharing the excess again and again ends in.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", F.row_number().over(one) - 1).withColumn("weight", weight)
    per = per.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left_weight = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / left_weight).withColumn("nth", F.row_number().over(order))
    level = F.min(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("nth", "level"))).over(all_rows)["level"]
    return per.select("source", "source_size", "source_no", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap"))).alias("target"))


def inverse_integral(share: Column, knots) -> Column:
    """The time at which a schedule has used up this share of its whole integral."""
    areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:])]
    x = share * F.lit(float(sum(areas)))
    out, used = None, 0.0
    pieces = []
    for ((t0, r0), (t1, r1)), area in zip(zip(knots, knots[1:]), areas):
        slope = (r1 - r0) / (t1 - t0)
        rest = x - F.lit(used)
        t = F.lit(t0) + (rest / F.lit(r0) if slope == 0 else (F.sqrt(F.greatest(F.lit(r0 * r0) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(r0)) / F.lit(slope))
        used += area
        pieces.append((used, t))
    for upto, t in reversed(pieces):
        out = t if out is None else F.when(x <= F.lit(upto), t).otherwise(out)
    return F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, max_repeats: float = 3.0, hex_digits: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, positions (one for each copy), and the columns named in keep.

    A source's documents stand in the order of md5(doc_id), the same in every run. Each is taken
    floor(target / source_size) times, and once more while the words before its middle are within the
    rest of the target, so that a source misses its target by half a document at most.

    Sums along that order are made from sums by hash range (16**hex_digits ranges a source) and sums
    within a range, so that no task holds a whole source.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: ordered as the empty string.
    Repeated rows count each; rows that tie are interchangeable. No rows: no rows.
    """
    d = docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"), *keep
    ).withColumn("range", F.substring("h", 1, hex_digits))
    if not keep:  # else it would hold whole texts, which are cheaper to read again
        d = save(d, "sizes")
    by_range = save(d.groupBy("source", "range").agg(F.sum("size").alias("size")), "ranges")
    targets = save(source_targets(by_range, weights, max_repeats), "targets")
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = by_range.select("source", "range", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("base"))
    small = targets.count() <= BROADCAST_SOURCES
    t = targets.withColumnRenamed("source", "source_")
    ranges = base.join(F.broadcast(t) if small else t, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").select(F.col("source").alias("s_"), F.col("range").alias("r_"), "base", "source_size", "source_no", "target")
    within = Window.partitionBy("source", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(ranges, (F.col("range") == F.col("r_")) & F.col("source").eqNullSafe(F.col("s_"))).withColumn("ahead", F.col("base") + F.col("inside"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    d = d.withColumn("whole", whole.cast("int"))
    more = (F.col("size") > 0) & (F.col("ahead") + F.col("size") / 2.0 <= F.col("target") - F.col("whole") * F.col("source_size"))
    d = d.withColumn("copies", F.col("whole") + more.cast("int"))
    kinds = len(schedules)

    def place(copy: Column) -> Column:
        share = (copy * F.col("source_size") + F.col("ahead") + F.col("size") / 2.0) / F.col("target")
        at = inverse_integral(share, schedules[-1])
        for i, knots in enumerate(schedules[:-1]):
            at = F.when(F.col("source_no") % kinds == i, inverse_integral(share, knots)).otherwise(at)
        return at

    positions = F.when((F.col("copies") > 0) & (F.col("target") > 0), F.transform(F.sequence(F.lit(0), F.col("copies") - 1), place)).otherwise(F.array().cast("array<double>"))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", positions.alias("positions"), *keep)


def in_order(mixed: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by training position."""
    return mixed.select("*", F.explode_outer("positions").alias("position")).where("position is not null").drop("positions", "copies").orderBy("position", "doc_id")
