"""Column functions on k-mers and degenerate patterns such as A[CG]T."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = 4


def kmers(seq: Column, k: int) -> Column:
    """All overlapping k-mers; an empty array for shorter sequences."""
    n = F.length(seq) - (k - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(seq, i, k))).otherwise(F.array().cast("array<string>"))


def join_kmers(parts: Column) -> Column:
    """Overlapping k-mers back to the sequence: AT, TG gives ATG."""
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.right(x, F.lit(1))), ""))


def matches(a: Column, b: Column) -> Column:
    """Places with equal letters."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda m: m)).cast("long")


def positions(pattern: Column) -> Column:
    """The letter class at each place: A[CG]T gives A, CG, T."""
    return F.transform(F.regexp_extract_all(pattern, F.lit(r"(\[[^\]]+\]|.)"), 1), lambda c: F.translate(c, "[]", ""))


def optional_positions(pattern: Column) -> Column:
    """As positions, keeping a ? that follows: A?[CG] gives A?, CG."""
    return F.transform(F.regexp_extract_all(pattern, F.lit(r"((?:\[[^\]]+\]|.)\??)"), 1), lambda c: F.translate(c, "[]", ""))


def assemble(classes: Column) -> Column:
    """The pattern of letter classes, with or without a ? at their ends."""
    letters = lambda c: F.regexp_replace(c, r"\?$", "")
    return F.array_join(F.transform(classes, lambda c: F.concat(F.when(F.length(letters(c)) > 1, F.concat(F.lit("["), letters(c), F.lit("]"))).otherwise(letters(c)), F.when(c.endswith("?"), F.lit("?")).otherwise(F.lit("")))), "")


def expand(pattern: Column) -> Column:
    """Every k-mer that a pattern stands for."""
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return F.aggregate(positions(pattern), F.array(F.lit("")), lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(letters(c), lambda x: F.concat(a, x)))))


def length(pattern: Column) -> Column:
    return F.size(positions(pattern)).cast("long")


def merge_count(pattern: Column) -> Column:
    """Letters beyond the first of all classes."""
    return (F.aggregate(positions(pattern), F.lit(0), lambda s, c: s + F.length(c)) - F.size(positions(pattern))).cast("long")


def alike(a: Column, b: Column) -> Column:
    """Whether one class has all letters of the other."""
    x, y = F.split(a, ""), F.split(b, "")
    return (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def distance(p: Column, q: Column) -> Column:
    """Places whose classes aren't alike."""
    return F.size(F.filter(F.zip_with(positions(p), positions(q), alike), lambda m: ~m)).cast("long")


def union(a: Column, b: Column) -> Column:
    """The letters of both classes in order; a blank makes the other optional."""
    letters = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.translate(F.concat(a, b), "? ", ""), ""), lambda x: x != ""))), "")
    optional = (a == " ") | (b == " ") | a.endswith("?") | b.endswith("?")
    return F.concat(letters, F.when(optional, F.lit("?")).otherwise(F.lit("")))


def merge(p: Column, q: Column) -> Column:
    """Place by place union of two patterns (or k-mers); an empty string if their lengths differ."""
    return F.when(length(p) == length(q), assemble(F.zip_with(positions(p), positions(q), union))).otherwise(F.lit(""))


def scored_merge(p: Column, q: Column, max_dist: float = 1.0) -> Column:
    """The merge of two patterns if their distance is over 0 and at most max_dist and no class has all letters, else null.

    A place costs 0 if equal, 0.6 if one class is a substring of the other, else 1.
    """
    cost = lambda a, b: F.when(a == b, 0.0).when(a.contains(b) | b.contains(a), 0.6).otherwise(1.0)
    total = F.aggregate(F.zip_with(positions(p), positions(q), cost), F.lit(0.0), lambda s, x: s + x)
    merged = merge(p, q)
    full = F.exists(positions(merged), lambda c: F.length(c) >= ALPHABET)
    return F.when((total > 0) & (total <= max_dist) & ~full, merged)


def ic(pattern: Column) -> Column:
    """Sum over places of log10(4 / class size)."""
    return F.aggregate(positions(pattern), F.lit(0.0), lambda s, c: s + F.log10(F.lit(float(ALPHABET)) / F.length(c)))


def string_ic(text: Column) -> Column:
    """The information content of one column of letters, given as a string: the sum of f log10(4 f) over its different letters; 0 without letters."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters)
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda s, c: s + share(c) * F.log10(share(c) * F.lit(float(ALPHABET))))


def similar(a: Column, b: Column, k: int) -> Column:
    """Whether two k-mers have at least k - 3 equal 2-mers at equal places."""
    same = F.zip_with(kmers(a, 2), kmers(b, 2), lambda x, y: x == y)
    return F.size(F.filter(same, lambda m: m)) >= k - 3


def similar_halves(a: Column, b: Column, k: int) -> Column:
    """Whether two k-mers share a segment of k // 2 letters at one place; for odd k, one more equal letter outside it."""
    h = k // 2
    starts = range(1, k - h + 2)
    out = F.lit(False)
    for s in starts:
        shared = F.substring(a, s, h) == F.substring(b, s, h)
        if k % 2:
            rest = lambda x, s=s: F.concat(F.substring(x, 1, s - 1), F.substring(x, s + h, k))
            shared = shared & (matches(rest(a), rest(b)) > 0)
        out = out | shared
    return out


def features(pattern: Column) -> dict[str, Column]:
    """Counts of fixed and variable places and their longest runs (of equal kind)."""
    sizes = F.transform(positions(pattern), F.length)
    run = lambda fixed: F.array_max(
        F.transform(F.split(F.array_join(F.transform(sizes, lambda n: F.when((n == 1) == F.lit(fixed), F.lit("x")).otherwise(F.lit(" "))), ""), " +"), F.length)
    ).cast("long")
    n = F.size(sizes)
    fixed = F.size(F.filter(sizes, lambda x: x == 1))
    return {
        "fixed_cnt": fixed.cast("long"),
        "fixed_run": run(True),
        "var_cnt": F.aggregate(sizes, F.lit(1), lambda s, x: s * x).cast("long"),
        "var_run": run(False),
        "var_rate": (n - fixed) / n,
        "length": n.cast("long"),
    }


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series, exact to about 1e-12; small n from their products."""
    import math

    x = n.cast("double")
    small = F.element_at(F.array(*[F.lit(math.log(math.factorial(i))) for i in range(16)]), F.least(F.greatest(n, F.lit(0)), F.lit(15)).cast("int") + 1)
    y = F.greatest(x, F.lit(1.0))
    series = y * F.log(y) - y + 0.5 * F.log(2 * math.pi * y) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return F.when(n < 16, small).otherwise(series)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)
