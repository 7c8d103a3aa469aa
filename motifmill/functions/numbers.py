"""Column functions on lists and numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ngrams(items: Column, n: int) -> Column:
    """All runs of n items of an array, in order; none of shorter arrays."""
    last = F.size(items) - (n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(items, i, n))).otherwise(F.slice(F.array(items), 1, 0))


def all_ngrams(items: Column, most: int) -> Column:
    """Runs of 1 to most - 1 items."""
    return F.flatten(F.array(*[ngrams(items, n) for n in range(1, most)]))


def least_offset(a: Column, b: Column) -> Column:
    """The least positive y - x over x in a and y in b; -1 if there is none. For short lists, as each x looks through b; `least_offsets` is for long ones."""
    after = lambda x: F.array_min(F.filter(b, lambda y: y > x))
    gaps = F.filter(F.transform(a, lambda x: after(x) - x), lambda g: g.isNotNull())
    return F.coalesce(F.array_min(gaps), F.lit(-1))


def least_offsets(d: DataFrame, key: str, value: str, first: str) -> DataFrame:
    """(key, least): `least_offset` of each key's whole values where `first` is true and where it is false, from one row for each value.

    Values are gone through once, falling, with the last one of the other list seen so far. Null values count for nothing.
    """
    w = Window.partitionBy(key).orderBy(F.col(value).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, -1)
    after = F.min(F.when(~F.col(first), F.col(value))).over(w)
    gaps = d.withColumn("gap_", F.when(F.col(first), after - F.col(value)))
    return gaps.groupBy(key).agg(F.coalesce(F.min("gap_"), F.lit(-1)).cast("long").alias("least"))


def gcd(a: Column, b: Column) -> Column:
    """By Euclid's algorithm; 64 steps reach the end for any two 64-bit numbers under 2**44, and more are taken than any pair of ints needs."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(s["x"] % s["y"]).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(a.cast("long") * b) / gcd(a, b)).cast("long")


def boundaries(low: float, high: float, step: float) -> list[tuple[float, float]]:
    """Intervals from minus infinity through low, low + step, .. to high and infinity."""
    n = int(round((high - low) / step))
    ends = [float("-inf"), *[low + i * step for i in range(n + 1)], float("inf")]
    return list(zip(ends, ends[1:]))


def transposed(strings: DataFrame) -> DataFrame:
    """(pos, letters): the letters at each place of (id, seq), in the order of id; for a list of bounded size."""
    d = strings.select("id", F.posexplode(F.split("seq", "")).alias("pos", "chr")).where("chr <> ''")
    rows = F.array_sort(F.collect_list(F.struct("id", "chr")))
    return d.groupBy("pos").agg(F.array_join(F.transform(rows, lambda x: x["chr"]), "").alias("letters"))


def log_odds(share: Column, background: Column) -> Column:
    """log2(share / background) to two digits; a share of 0 counts as 0.01."""
    return F.round(F.log2(F.when(share == 0, 0.01).otherwise(share) / background), 2)


def float_range(first: float, end: float, step: float) -> list[float]:
    """first, first + step, .. below end, each from its own multiple so that errors don't add up."""
    n = math.ceil((end - first) / step - 1e-9)
    return [first + i * step for i in range(max(n, 0))]


def flat_index(row: Column, col: Column, width: Column | int) -> Column:
    """The place of (row, col) in a grid that is read row by row."""
    return (row * width + col).cast("long")


def grid_index(i: Column, width: Column | int) -> Column:
    """struct (row, col) of a place."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.struct(F.floor(i / width).cast("long").alias("row"), (i % width).cast("long").alias("col"))


def lcm_of(values: Column) -> Column:
    """The least common multiple of an array; 1 of an empty one."""
    return F.aggregate(values, F.lit(1).cast("long"), lambda s, x: lcm(s, x.cast("long")))


def range_index(value: Column, ends: list[float]) -> Column:
    """How many of the rising boundaries the value has reached: the place of the first one above it."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in ends), F.lit(0)).cast("long")


def counts_ic(counts: Column) -> Column:
    """The information content of a place from its letters' counts: the sum of f log10(4 f); letters that don't occur add nothing."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    part = lambda x: F.when(x > 0, x / total * F.log10(4 * x / total)).otherwise(0.0)
    return F.aggregate(F.transform(counts, part), F.lit(0.0), lambda s, x: s + x)
