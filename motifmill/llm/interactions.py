"""Filter interaction audit: what every order of some filters removes, and each filter's Shapley value.

Each document gets one bit for each filter that it fails. Counting documents by their bits, and summing the
counts over the bits that a coalition of filters meets, tabulates what all 2^n coalitions remove. A
filter's removals behind any others are the difference of two coalitions. The Shapley values are the
solution of the least squares fit of an additive game to the table, coalitions weighted by the Shapley
kernel and the fit bound to add up to what all filters remove. The normal equations are the same for every
part of the corpus, so they are solved once, in rationals; the solution is applied to each part in whole numbers.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.llm.shared import WORD, save

#: Orders of more filters than this would be too many rows for each part.
MOST_FILTERS = 7


def kernel(n: int, size: int) -> Fraction:
    """The Shapley kernel's weight of a coalition of `size` of n filters, 0 < size < n."""
    return Fraction(n - 1, comb(n, size) * size * (n - size))


def solution(n: int) -> list[list[int]]:
    """For each of n filters the whole numbers by which the 2^n coalitions' removals are multiplied, to add up to n! times its Shapley value.

    Column S of the right-hand sides is what a removal of 1 by coalition S alone gives: Z'W for the
    coalitions that the fit weighs, and the bound on the sum for the one of all filters. Gauss-Jordan elimination
    of the bordered normal equations (Z'WZ 1; 1' 0), in fractions.
    """
    inside = lambda i, s: s >> i & 1
    full = (1 << n) - 1
    weight = [kernel(n, s.bit_count()) if 0 < s < full else Fraction(0) for s in range(full + 1)]
    rows = [[sum((weight[s] for s in range(full + 1) if inside(i, s) and inside(j, s)), Fraction(0)) for j in range(n)] + [Fraction(1)] + [weight[s] * inside(i, s) for s in range(full + 1)] for i in range(n)]
    rows.append([Fraction(1)] * n + [Fraction(0)] + [Fraction(int(s == full)) for s in range(full + 1)])
    for c in range(n + 1):
        pivot = next(r for r in range(c, n + 1) if rows[r][c])
        rows[c], rows[pivot] = rows[pivot], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n + 1):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    scaled = [[x * factorial(n) for x in row[n + 1 :]] for row in rows[:n]]
    if any(x.denominator != 1 for row in scaled for x in row):
        raise ArithmeticError("the solution times n! has to be whole")
    return [[int(x) for x in row] for row in scaled]


def tabulated(cells: DataFrame, n: int, values: tuple[str, ...] = ("n", "good", "toxic")) -> DataFrame:
    """(part, and for each value an array): entry S sums the value over all cells whose mask shares a bit with S, and so what coalition S removes.

    cells: (part, mask, values..), a row for each part and mask at most; a part has 2^n rows at most here.
    """
    coalition = F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))).alias("coalition")
    each = cells.select("part", "mask", *values, coalition).groupBy("part", "coalition")
    met = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    sums = each.agg(*[F.sum(F.when(met, F.col(v)).otherwise(0)).alias(v) for v in values])
    table = sums.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("coalition", *values))).alias("t"))
    return table.select("part", *[F.col("t").getField(v).alias(v) for v in values])


STEPS = "array<struct<filter_order string, step int, filter string, own int, before int, after int, weights array<long>>>"


def steps(filters: str) -> list[dict]:
    """Every step of every order: its filter's bit, the coalitions before and after it, and the filter's row of the solution."""
    rows, bits = solution(len(filters)), {f: 1 << i for i, f in enumerate(filters)}
    out = []
    for order in permutations(filters):
        before = 0
        for i, f in enumerate(order):
            out.append({"filter_order": "".join(order), "step": i + 1, "filter": f, "own": bits[f], "before": before, "after": before | bits[f], "weights": rows[filters.index(f)]})
            before |= bits[f]
    return out


def audit(cells: DataFrame, filters: str) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every order of the filters.

    filters: a letter each, the first being bit 0 of mask. cells: (part, mask, n, good, toxic): how many
    documents of a part fail just the filters of mask, how many of them are good, how many toxic. kept: what is
    left after the step; removed: what it takes; redundant: what fails its filter and is gone before;
    unique_fails: what fails it alone; shapley: its filter's removals, summed over all orders. Parts without
    a document have no rows. Cells may come in several rows.
    """
    n = len(filters)
    if n > MOST_FILTERS:
        raise ValueError(f"{n} filters have {factorial(n)} orders")
    cells = cells.groupBy("part", "mask").agg(*[F.sum(v).alias(v) for v in ("n", "good", "toxic")])
    size = cells.groupBy("part").agg(F.sum("n").alias("size"))
    table = tabulated(cells, n).join(size, "part")
    at = lambda values, i: F.element_at(values, i + 1)
    full = (1 << n) - 1
    d = table.select("*", F.inline(F.from_json(F.lit(json.dumps(steps(filters))), STEPS)))
    step = lambda v: at(F.col(v), F.col("after")) - at(F.col(v), F.col("before"))
    removed = step("n")
    solved = F.aggregate(F.zip_with("n", "weights", lambda x, w: x * w), F.lit(0).cast("long"), lambda s, x: s + x)
    return d.select(
        "part", "filter_order", "step", "filter", (F.col("size") - at(F.col("n"), F.col("after"))).alias("kept"), removed.alias("removed"),
        (at(F.col("n"), F.col("own")) - removed).alias("redundant"), (at(F.col("n"), F.lit(full)) - at(F.col("n"), full - F.col("own"))).alias("unique_fails"),
        step("good").alias("good_lost"), step("toxic").alias("toxic_lost"), solved.alias("shapley"),
    )


#: The filters of `document_cells`: too few words, too few different words, too many capitals, signs, copies.
FILTERS = "ABCDE"


def failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, different, capitals = F.size(words), F.size(F.array_distinct(words)), F.regexp_count(text, F.lit("[A-Z]"))
    fails = (n < 50, 100 * different.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length(text), text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def document_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of whole documents by source, with the filters ABCDE.

    A null text is empty, a null source the empty string. E fails where a row of a smaller doc_id has the
    same text, wherever in the table and whether removed or not; rows of one doc_id aren't smaller than each
    other, and a row without doc_id neither has nor is a smaller one. Repeated rows count each. A document is
    good if any label of its doc_id has quality 1, toxic if any has toxic 1. No rows give none; other columns
    don't matter.

    The texts are read once; what is shuffled is a row of some 60 bytes for each document. Texts are told
    apart by SHA-256. The first row of each text is found by its digest and doc_id together, so that a text
    that a third of all documents have makes no hot key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    marked = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    d = d.join(marked, F.col("doc_id") == F.col("label_id"), "left").drop("label_id")
    d = save(d.na.fill(0, ["good", "toxic"]), "failures")
    least = d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = d.join(least, ["digest", "doc_id"], "left_semi").unionByName(d.where("doc_id is null"))
    counts = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    copy = 1 << FILTERS.index("E")
    signed = lambda t, mask, sign: t.select("part", mask.alias("mask"), *[(sign * F.col(v)).alias(v) for v in ("n", "good", "toxic")])
    every = d.groupBy("part", "mask").agg(*counts)
    once = save(first.groupBy("part", "mask").agg(*counts), "first")
    cells = signed(every, F.col("mask") + copy, 1).union(signed(once, F.col("mask") + copy, -1)).union(signed(once, F.col("mask"), 1))
    return cells.groupBy("part", "mask").agg(*[F.sum(v).alias(v) for v in ("n", "good", "toxic")])
