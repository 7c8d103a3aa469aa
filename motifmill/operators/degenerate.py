"""Degenerate patterns: merging, coverage, information content and position matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifmill.functions import patterns as P
from motifmill.operators import kmers
from motifmill.session import save


def segment_merge(words: DataFrame, group: str) -> DataFrame:
    """(group, pattern): the place by place union of each group's k-mers, letters in order."""
    letters = words.select(group, F.posexplode(F.split("kmer", "")).alias("pos", "chr")).where("chr <> ''")
    classes = letters.groupBy(group, "pos").agg(F.array_join(F.array_sort(F.collect_set("chr")), "").alias("letters"))
    cls = F.when(F.length("letters") > 1, F.concat(F.lit("["), F.col("letters"), F.lit("]"))).otherwise(F.col("letters"))
    return classes.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", cls.alias("c")))), lambda x: x["c"]), "").alias("pattern"))


def expansions(patterns: DataFrame) -> DataFrame:
    """(pattern, kmer)."""
    return patterns.select("pattern", F.explode(P.expand(F.col("pattern"))).alias("kmer"))


def held(patterns: DataFrame, index: DataFrame) -> DataFrame:
    """(pattern, seq_id), distinct, of sequences with any of a pattern's k-mers, by an equi-join of expansions and the k-mer index."""
    return index.select("kmer", "seq_id").join(kmers.sent(expansions(patterns)), "kmer").select("pattern", "seq_id").distinct()


def coverage(patterns: DataFrame, index: DataFrame) -> DataFrame:
    """Sequences with any of each pattern's k-mers."""
    return held(patterns, index).groupBy("pattern").agg(F.count("*").alias("cov"))


def matching(patterns: DataFrame, seqs: DataFrame) -> DataFrame:
    """(pattern, seq_id, seq) of sequences that have any of a pattern's k-mers, by equi-joins, so that a pattern is searched for only where it is."""
    e = save(expansions(patterns), "expansions")
    return kmers.holders(seqs, e.select("kmer")).join(kmers.sent(e), "kmer").select("pattern", "seq_id", "seq").distinct()


def regex_coverage(patterns: DataFrame, seqs: DataFrame) -> DataFrame:
    """(pattern, cov, matches): sequences that match, and matches from left to right without overlap."""
    d = matching(patterns, seqs)
    return d.groupBy("pattern").agg(F.count("*").alias("cov"), F.sum(F.size(F.expr("regexp_extract_all(seq, pattern, 0)"))).alias("matches"))


def weighted_ic(patterns: DataFrame, cov: DataFrame) -> DataFrame:
    """(pattern, ic): the information content of letter frequencies weighted by coverage; a k-mer without coverage counts 1."""
    d = expansions(patterns).join(cov.select("kmer", "cov"), "kmer", "left").select("pattern", "kmer", F.coalesce("cov", F.lit(1)).alias("w"))
    letters = d.select("pattern", "w", F.posexplode(F.split("kmer", "")).alias("pos", "chr")).where("chr <> ''")
    f = letters.groupBy("pattern", "pos", "chr").agg(F.sum("w").alias("w"))
    place = f.groupBy("pattern", "pos").agg(F.sum("w").alias("all"), F.sum(F.col("w") * F.log10(F.col("w").cast("double"))).alias("wlog"))
    # sum of f log10(4 f) with f = w / all
    place = place.withColumn("ic", F.col("wlog") / F.col("all") + F.log10(F.lit(4.0)) - F.log10(F.col("all").cast("double")))
    return place.groupBy("pattern").agg(F.sum("ic").alias("ic"))


def column_ic(seqs: DataFrame) -> DataFrame:
    """(pos, ic) of aligned strings: sum of f log10(4 f) over the letters of each place."""
    letters = seqs.select(F.posexplode(F.split("seq", "")).alias("pos", "chr")).where("chr <> ''").groupBy("pos", "chr").agg(F.count("*").alias("n"))
    d = letters.groupBy("pos").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log10(F.col("n").cast("double"))).alias("nlog"))
    return d.select("pos", (F.col("nlog") / F.col("all") + F.log10(F.lit(4.0)) - F.log10(F.col("all").cast("double"))).alias("ic"))


def ppm(patterns: DataFrame, seqs: DataFrame) -> DataFrame:
    """(pattern, pos, chr, w): each sequence deals a weight of one evenly to its matches; pos from 1."""
    d = matching(patterns, seqs).select("pattern", F.expr("regexp_extract_all(seq, pattern, 0)").alias("found"))
    d = d.select("pattern", (1 / F.size("found")).alias("w"), F.explode("found").alias("m"))
    letters = d.select("pattern", "w", F.posexplode(F.split("m", "")).alias("pos", "chr")).where("chr <> ''")
    return letters.groupBy("pattern", (F.col("pos") + 1).alias("pos"), "chr").agg(F.sum("w").alias("w"))


def logo(ppm: DataFrame) -> DataFrame:
    """(pattern, pos, chr, height): a letter's share times the information content of its place, in bits."""
    total = ppm.groupBy("pattern", "pos").agg(F.sum("w").alias("all"))
    d = ppm.join(total, ["pattern", "pos"]).withColumn("f", F.col("w") / F.col("all"))
    bits = d.groupBy("pattern", "pos").agg((F.lit(2.0) + F.sum(F.col("f") * F.log2("f"))).alias("bits"))
    return d.join(bits, ["pattern", "pos"]).select("pattern", "pos", "chr", (F.col("f") * F.col("bits")).alias("height"))


def pwm_counts(words: DataFrame) -> DataFrame:
    """(pattern, pos, chr, n) of (pattern, kmer)."""
    return words.select("pattern", F.posexplode(F.split("kmer", "")).alias("pos", "chr")).where("chr <> ''").groupBy("pattern", "pos", "chr").agg(F.count("*").alias("n"))


def matrices(ppm: DataFrame, alphabet: int = 4) -> DataFrame:
    """(pattern, n, unit): a row for each pattern of (pattern, pos, chr, w), `unit` with `alphabet` numbers for each of its n places in order of pos.

    The numbers are the letters' shares less 1 / alphabet, over the root of their squares' sum, so that the
    product of two places is Pearson's r with the mean fixed at 1 / alphabet; those of a uniform place are 0. Letters
    that no place has are 0 in all.
    """
    letters = sorted(r.chr for r in ppm.select("chr").distinct().limit(alphabet + 1).collect())
    if len(letters) > alphabet:
        raise ValueError(f"more than {alphabet} letters")
    mean = 1 / alphabet
    place = ppm.groupBy("pattern", "pos").agg(F.sum("w").alias("all"), *[F.sum(F.when(F.col("chr") == c, F.col("w")).otherwise(0.0)).alias(f"w{i}") for i, c in enumerate(letters)])
    spread = [F.col(f"w{i}") / F.col("all") - mean for i in range(len(letters))] + [F.lit(-mean)] * (alphabet - len(letters))
    norm = F.sqrt(sum((x * x for x in spread), F.lit(0.0)))
    unit = F.array(*[F.when(F.col("norm") > 1e-6, x / F.col("norm")).otherwise(0.0) for x in spread])
    place = place.withColumn("norm", norm).select("pattern", "pos", unit.alias("unit"))
    rows = place.groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("pos", "unit"))).alias("p"))
    return rows.select("pattern", F.size("p").alias("n"), F.flatten(F.transform("p", lambda x: x["unit"])).alias("unit"))


def pattern_pairs(rows: DataFrame, blocks: int = 4) -> DataFrame:
    """(a, b) of all pairs of rows (pattern, ..) with a.pattern > b.pattern, as structs: rows are dealt to blocks, and pairs of blocks are joined on their numbers."""
    d = rows.select(F.struct(*rows.columns).alias("x"), F.pmod(F.xxhash64("pattern"), F.lit(blocks)).cast("int").alias("block"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    a = d.select(F.col("x").alias("a"), F.col("block").alias("i"), every.alias("j"))
    b = d.select(F.col("x").alias("b"), every.alias("i"), F.col("block").alias("j"))
    return a.join(b, ["i", "j"]).where("a.pattern > b.pattern").select("a", "b")


def overlap_of(n1: Column, n2: Column, offset: Column) -> Column:
    """Places of a first matrix of n1 that lie over one of n2 that begins `offset` places before it."""
    return F.least(n1, n2 - offset) - F.greatest(-offset, F.lit(0))


def offset_similarities(ppm: DataFrame, least_overlap: int = 2, alphabet: int = 4) -> DataFrame:
    """(p1, p2, offset, overlap, pcc) for pairs p1 > p2 and every offset with enough overlap.

    pcc: the sum over the overlap's places of Pearson's r of the letters' shares, with their mean fixed at
    1 / alphabet; a uniform place adds nothing. Place i of p1 lies over place i + offset of p2. A pattern is one row with its
    matrix as an array, and a pair's offsets are one expression.
    """
    d = pattern_pairs(save(matrices(ppm, alphabet), "matrices"))
    d = d.select("a", "b", F.explode(F.sequence(1 - F.col("a.n"), F.col("b.n") - 1)).alias("offset"))
    first = F.greatest(-F.col("offset"), F.lit(0))
    d = d.withColumn("overlap", overlap_of(F.col("a.n"), F.col("b.n"), F.col("offset"))).where(F.col("overlap") >= least_overlap)
    cut = lambda m, at: F.slice(F.col(m), (at * alphabet + 1).cast("int"), (F.col("overlap") * alphabet).cast("int"))
    products = F.zip_with(cut("a.unit", first), cut("b.unit", first + F.col("offset")), lambda x, y: x * y)
    pcc = F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
    return d.select(F.col("a.pattern").alias("p1"), F.col("b.pattern").alias("p2"), "offset", F.col("overlap").cast("long").alias("overlap"), pcc.alias("pcc"))


def best_offsets(sims: DataFrame) -> DataFrame:
    """Per pair the offset of the largest mean pcc, ties to the smallest shift, then the negative one."""
    mean = F.round(F.col("pcc") / F.col("overlap"), 9)
    d = sims.groupBy("p1", "p2").agg(F.max(F.struct(mean.alias("mean"), (-F.abs("offset")).alias("near"), (-F.col("offset")).alias("neg"), F.col("pcc"))).alias("b"))
    return d.select("p1", "p2", (-F.col("b.neg")).alias("offset"), F.col("b.mean").alias("mean_pcc"), F.col("b.pcc").alias("pcc"))


#: Patterns of a block, about, whose pairs with another block's are one task's arrays.
BLOCK = 512


def aligned_pairs(ppm: DataFrame, least_mean: float, least_overlap: int = 2, alphabet: int = 4, block: int = BLOCK) -> DataFrame:
    """(p1, p2, offset, similarity) for pairs p1 > p2: `report.aligned_similarity` at the offsets of `best_offsets` whose mean pcc is over least_mean.

    Of all patterns of a data set rows of (pair, offset) are too many to be written and joined, so each pair of blocks is a
    product of arrays for each offset, and a pair's offsets are compared where they are made.
    """
    rows = save(matrices(ppm, alphabet), "matrices")
    blocks = max(1, -(-rows.count() // block))
    d = rows.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    d = d.select("pattern", "n", "unit", "block", F.greatest("block", "other").alias("i"), F.least("block", "other").alias("j"))

    def run(key, table):
        n, mine, names = table.column("n").to_numpy(), table.column("block").to_numpy(), table.column("pattern").to_pylist()
        rank = np.empty(len(names), np.int64)
        rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
        units = table.column("unit").to_pylist()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))]
        i, j = (x.as_py() for x in key)
        for bi, bj in {(i, j), (j, i)}:
            for n1 in np.unique(n[mine == bi]).tolist():
                for n2 in np.unique(n[mine == bj]).tolist():
                    a, b = np.flatnonzero((mine == bi) & (n == n1)), np.flatnonzero((mine == bj) & (n == n2))
                    x, y = np.nonzero(rank[a][:, None] > rank[b][None, :])
                    if len(x) and min(n1, n2) >= least_overlap:
                        offset, similarity = _at_best(np.array([units[p] for p in a]), np.array([units[p] for p in b]), n1, n2, least_mean, least_overlap, alphabet)
                        out.append((a[x], b[y], offset[x, y], similarity[x, y]))
        first, second, offset, similarity = (np.concatenate(c) for c in zip(*out))
        col = table.column("pattern").combine_chunks()
        return pa.table({"p1": col.take(pa.array(first)), "p2": col.take(pa.array(second)), "offset": pa.array(offset, pa.int32()), "similarity": similarity})

    return d.groupBy("i", "j").applyInArrow(run, "p1 string, p2 string, offset int, similarity double")


def _at_best(a: np.ndarray, b: np.ndarray, n1: int, n2: int, least_mean: float, least_overlap: int, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Offset and similarity of each row of a (matrices of n1 places) with each of b (n2)."""
    most, offset, chosen, zero = np.full((len(a), len(b)), -np.inf), np.zeros((len(a), len(b)), np.int32), np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for o in sorted(range(1 - n1, n2), key=lambda o: (abs(o), o)):  # of equal means the smallest shift, then the negative one
        first, overlap = max(-o, 0), min(n1, n2 - o) - max(-o, 0)
        if overlap < least_overlap:
            continue
        pcc = a[:, first * alphabet : (first + overlap) * alphabet] @ b[:, (first + o) * alphabet : (first + o + overlap) * alphabet].T
        mean = np.round(pcc / overlap, 9)
        better = mean > most
        most[better], offset[better], chosen[better] = mean[better], o, pcc[better]
        if o == 0:
            zero = pcc
    near = most > least_mean
    offset = np.where(near, offset, 0).astype(np.int32)
    return offset, np.where(near, chosen, zero) / np.where(offset > 0, n1, n2)


def normalized(sims: DataFrame, value: str = "pcc") -> DataFrame:
    """Min-max scaled over all pairs; exact 0 and 1 are moved inwards by 0.0001; null if all are equal."""
    ends = sims.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    d = sims.join(F.broadcast(ends), F.lit(True))
    s = F.when(F.col("high") > F.col("low"), (F.col(value) - F.col("low")) / (F.col("high") - F.col("low")))
    return d.select("p1", "p2", F.when(s == 0, 0.0001).when(s == 1, 0.9999).otherwise(s).alias("similarity"))
