"""The report of a layer's patterns, and what leads to it: filters, adjusted p-values, matrices' similarity by alignment, cores by mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifmill.functions import patterns as P
from motifmill.operators import background, degenerate
from motifmill.operators import kmers as k
from motifmill.operators.draws import Draws
from motifmill.session import save


def testable(patterns: DataFrame, least_ic: float) -> DataFrame:
    """Of (pattern, ic, ..) those whose p-value is worth testing: information content of at least least_ic, and no class of all letters."""
    return patterns.where((F.col("ic") >= least_ic) & ~F.exists(P.positions(F.col("pattern")), lambda c: F.length(c) >= P.ALPHABET))


def frequent(patterns: DataFrame, n_seqs: int, least: float = 0.1) -> DataFrame:
    """Of (pattern, cov, ..) those that at least this share of the sequences has."""
    return patterns.where(F.col("cov") >= least * n_seqs)


def sampled_p(patterns: DataFrame, draws: Draws, tests: int) -> DataFrame:
    """(pattern, p): adjusted extrapolated p-values of (pattern, cov) against samples of references."""
    words = patterns.select("pattern", "cov")
    hist = background.histograms(words, draws.coverage(degenerate.expansions(patterns), "pattern"), draws.n_samples, "pattern")
    return save(adjusted(background.p_values(words, hist, "pattern"), tests, "p_extrapolated"), "p")


def adjusted(p: DataFrame, tests: int, value: str = "p") -> DataFrame:
    """(pattern, p) times the number of tests, 1 at most."""
    return p.select("pattern", background.bonferroni(F.col(value), F.lit(tests)).alias("p"))


def report(patterns: DataFrame, first: DataFrame, second: DataFrame | None = None, most: float = 0.05) -> DataFrame:
    """(pattern, ic, cov, first_p, second_p) of (pattern, ic, cov) whose adjusted p against the first background is at most `most`.

    A pattern without a first p is left out. second_p is null without a second background or without a p
    there; it filters nothing. first and second are (pattern, p), adjusted.
    """
    d = patterns.select("pattern", "ic", "cov").join(first.select("pattern", F.col("p").alias("first_p")), "pattern").where(F.col("first_p") <= most)
    if second is None:
        return d.withColumn("second_p", F.lit(None).cast("double"))
    return d.join(second.select("pattern", F.col("p").alias("second_p")), "pattern", "left").select("pattern", "ic", "cov", "first_p", "second_p")


def worth_second(patterns: DataFrame, first: DataFrame, most: float = 0.05) -> DataFrame:
    """The patterns that the first background doesn't reject, so that only they are tested against a second one."""
    return patterns.join(first.where(F.col("p") > most).select("pattern"), "pattern", "left_anti")


def against_negatives(patterns: DataFrame, negative: DataFrame, n_pos: int, n_neg: int, below: float = 0.05) -> DataFrame:
    """(pattern, pos_cov, neg_cov, p) with an adjusted two-sided exact p under `below`; patterns is (pattern, cov), negative the same among negative sequences.

    Patterns are as many tests as they are rows. Two-sided, so those that negatives have more often stay too.
    """
    d = patterns.select("pattern", F.col("cov").alias("pos_cov")).join(negative.select("pattern", F.col("cov").alias("neg_cov")), "pattern", "left").withColumn("neg_cov", F.coalesce("neg_cov", F.lit(0)))
    a, c = F.col("pos_cov"), F.col("neg_cov")
    p = background.bonferroni(background.fisher(a, n_pos - a, c, n_neg - c), F.lit(patterns.count()))
    return d.withColumn("p", p).where(F.col("p") < below)


def aligned_similarity(sims: DataFrame, aligned: DataFrame, lengths: DataFrame) -> DataFrame:
    """(p1, p2, offset, similarity) of all pairs of `sims`, at the offset that `aligned` (p1, p2, offset) has for it or else at 0.

    The similarity is the sum of the places' correlations over the length of the motif that is moved: the
    first one for an offset over 0, else the second. lengths is (pattern, n). Offsets with too little overlap
    to be among sims give 0.
    """
    pairs = sims.select("p1", "p2").distinct().join(aligned.select("p1", "p2", "offset"), ["p1", "p2"], "left").withColumn("offset", F.coalesce("offset", F.lit(0)))
    n1, n2 = (lengths.select(F.col("pattern").alias(f"p{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    d = pairs.join(sims.select("p1", "p2", "offset", "pcc"), ["p1", "p2", "offset"], "left").join(n1, "p1").join(n2, "p2")
    moved = F.when(F.col("offset") > 0, F.col("n1")).otherwise(F.col("n2"))
    return d.select("p1", "p2", "offset", (F.coalesce("pcc", F.lit(0.0)) / moved).alias("similarity"))


def across(sims: DataFrame, side: DataFrame) -> DataFrame:
    """(kind, n, mean): pairs of motifs of one data set ("in") and of two ("trans"), their number and mean similarity; side is (pattern, side)."""
    s1, s2 = (side.select(F.col("pattern").alias(f"p{i}"), F.col("side").alias(f"s{i}")) for i in (1, 2))
    kind = F.when(F.col("s1") == F.col("s2"), "in").otherwise("trans")
    return sims.join(s1, "p1").join(s2, "p2").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.avg("similarity").alias("mean"))


def regrouped(members: DataFrame, mode: int) -> DataFrame:
    """(cluster_id, pattern, ..) with clusters put together: mode 0 none; 2 all those of one pattern; 3 those, and all others too.

    A cluster that is put together has the least of its patterns as cluster_id.
    """
    if mode not in (0, 2, 3):
        raise ValueError(mode)
    if mode == 0:
        return members
    size = members.groupBy("cluster_id").agg(F.countDistinct("pattern").alias("n"))
    alone = F.col("n") == 1
    group = F.when(alone, "one").otherwise(F.lit("many") if mode == 3 else F.col("cluster_id"))
    d = members.join(size, "cluster_id").withColumn("group", group).drop("cluster_id", "n")
    least = d.groupBy("group").agg(F.min("pattern").alias("cluster_id"))
    return d.join(least, "group").drop("group")


def cores_by_p(clusters: DataFrame, p: DataFrame, most: int = 5) -> DataFrame:
    """(cluster_id, pattern, rank, p): of each cluster the patterns of the least p, ties by their letters (mode 1)."""
    w = Window.partitionBy("cluster_id").orderBy("p", "pattern")
    d = clusters.select("cluster_id", "pattern").distinct().join(p.select("pattern", "p"), "pattern")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("cluster_id", "pattern", "rank", "p")


def preferred(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of `first`, and those of `second` whose key it lacks."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def ranked_pairs(d: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """(g, p1, p2, rank): each group's pairs of items, ranked as lines of a file are: by when the later of the two first came, then by name."""
    e = d.select(F.col(group).alias("g"), F.col(item).alias("x"), F.col(order).alias("o")).where("g is not null and x is not null").groupBy("g", "x").agg(F.min("o").alias("o"))
    a = e.select("g", F.col("x").alias("p1"), F.col("o").alias("o1"))
    b = e.select("g", F.col("x").alias("p2"), F.col("o").alias("o2"))
    w = Window.partitionBy("g").orderBy(F.greatest("o1", "o2"), "p1", "p2")
    return a.join(b, "g").where("p1 < p2").select("g", "p1", "p2", F.row_number().over(w).alias("rank"))


def coexisting_ranks(pairs: DataFrame) -> DataFrame:
    """(p1, p2, n, best, worst, total): how many groups have a pair, if more than one, and what its ranks there are."""
    d = pairs.groupBy("p1", "p2").agg(F.count("*").alias("n"), F.min("rank").alias("best"), F.max("rank").alias("worst"), F.sum("rank").alias("total"))
    return d.where("n > 1")


def merged_coverage(patterns: DataFrame, kmers: DataFrame) -> DataFrame:
    """(p1, p2, merged, cov) of pairs p1 > p2 near enough to be merged, with the sequences that either of the two has."""
    patterns = save(patterns, "patterns")
    a, b = (patterns.select(F.col("pattern").alias(c)) for c in ("p1", "p2"))
    near = a.join(b, F.col("p1") > F.col("p2")).withColumn("merged", P.scored_merge(F.col("p1"), F.col("p2"))).where("merged is not null")
    # the k-mers of both patterns, each once, so that rows are made for sequences and pairs only
    words = near.select("p1", "p2", "merged", F.explode(F.array_distinct(F.concat(P.expand(F.col("p1")), P.expand(F.col("p2"))))).alias("kmer"))
    either = kmers.select("kmer", "seq_id").join(k.sent(words), "kmer").select("p1", "p2", "merged", "seq_id").distinct()
    return either.groupBy("p1", "p2", "merged").agg(F.count("*").alias("cov"))
