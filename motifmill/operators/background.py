"""Significance against a background pool, sampled or exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifmill.functions import patterns as P
from motifmill.operators import kmers
from motifmill.operators.draws import Draws


def _number(*parts: Column) -> Column:
    """A deterministic number from 0 to 2**32 - 1."""
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 8), 16, 10).cast("long")


def pool(refs: DataFrame, shortest: int, longest: int, shuffled: bool = True, seed: str = "7", rna: bool = True) -> DataFrame:
    """(ref_id, seg): one segment of random length and start of each reference (ref_id, seq), its letters shuffled; all by hash.

    A length that leaves fewer than two places to start from is drawn again, three lengths at most. A start whose segment has
    an N is drawn again; draws again of both kinds are four at most. References for which that isn't enough
    have no segment. rna turns T into U. References are dealt to tasks before that, as each letter of a segment is hashed.
    """
    key = F.col("ref_id").cast("string")
    number = lambda what: _number(F.lit(seed + what), key)
    lengths = F.array(*[(F.lit(shortest) + number(f"n{i or ''}") % (longest - shortest + 1)).cast("int") for i in range(3)])
    long_enough = F.filter(F.transform(lengths, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda x: F.length("seq") > x["n"] + 1)
    d = kmers.spread(refs, "ref_id").withColumn("drawn", F.get(long_enough, F.lit(0))).where("drawn is not null")
    starts = F.array(*[number(f"s{i or ''}") for i in range(5)])
    places = F.length("seq") - F.col("drawn.n")
    usable = F.slice(starts, F.lit(1), 5 - F.col("drawn.i"))
    segs = F.transform(usable, lambda s: F.substring("seq", (s % places + 1).cast("int"), F.col("drawn.n")))
    seg = F.get(F.filter(segs, lambda x: ~x.contains("N")), F.lit(0))
    d = d.select("ref_id", seg.alias("seg")).where("seg is not null")
    seg = F.translate("seg", "T", "U") if rna else F.col("seg")
    if shuffled:
        letters = F.filter(F.split(seg, ""), lambda c: c != "")
        place = F.transform(letters, lambda c, i: F.struct(F.md5(F.concat(F.lit(seed), key, F.lit("/"), i.cast("string")).cast("binary")).alias("h"), c.alias("c")))
        seg = F.array_join(F.transform(F.array_sort(place), lambda x: x["c"]), "")
    return d.select("ref_id", seg.alias("seg"))


def samples(refs: DataFrame, n_samples: int, size: int, seed: str = "7") -> DataFrame:
    """(sample_id, ref_id): for each sample `size` of the references, drawn without replacement as in `draws.Draws`."""
    return Draws(refs, n_samples, size, seed).rows()


def sampled_coverage(ref_words: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
    """(key, sample_id, cov): sequences of each sample with the word; ref_words is (key, ref_id), distinct. By joining rows; `Draws.coverage` counts without."""
    return ref_words.join(drawn, "ref_id").groupBy(key, "sample_id").agg(F.count("*").alias("cov"))


def histograms(words: DataFrame, cov: DataFrame, n_samples: int, key: str) -> DataFrame:
    """(key, cov, freq): samples by coverage, those without the word at 0."""
    hits = cov.groupBy(key, "cov").agg(F.count("*").alias("freq"))
    seen = hits.groupBy(key).agg(F.sum("freq").alias("seen"))
    none = words.select(key).distinct().join(seen, key, "left").select(key, F.lit(0).cast("long").alias("cov"), (F.lit(n_samples) - F.coalesce("seen", F.lit(0))).alias("freq"))
    return hits.unionByName(none.where("freq > 0"))


def thresholds(hist: DataFrame, share: float = 0.99, key: str = "kmer") -> DataFrame:
    """(key, threshold): the least coverage whose cumulative share reaches `share`."""
    w = Window.partitionBy(key).orderBy("cov").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("freq").over(Window.partitionBy(key))
    return hist.withColumn("cum", F.sum("freq").over(w) / total).where(F.col("cum") >= share).groupBy(key).agg(F.min("cov").alias("threshold"))


def p_values(words: DataFrame, hist: DataFrame, key: str = "kmer", weight: float = 0.5) -> DataFrame:
    """Of (key, cov): p_basic, p_half and p_extrapolated against the histograms.

    p_basic: share of samples with at least the coverage. p_half adds half of the slot below. p_extrapolated
    is p_basic, or, where that is 0, the share of the nearest slot below times weight to the distance.
    """
    d = words.select(key, F.col("cov").alias("c")).join(hist, key)
    out = d.groupBy(key, "c").agg(
        F.sum("freq").alias("n"),
        F.coalesce(F.sum(F.when(F.col("cov") >= F.col("c"), F.col("freq"))), F.lit(0)).alias("over"),
        F.coalesce(F.sum(F.when(F.col("cov") == F.col("c") - 1, F.floor(F.col("freq") / 2))), F.lit(0)).alias("half"),
        F.max(F.when(F.col("cov") < F.col("c"), F.struct("cov", "freq"))).alias("below"),
    )
    basic = F.col("over") / F.col("n")
    tail = F.col("below.freq") * F.pow(F.lit(weight), F.col("c") - F.col("below.cov")) / F.col("n")
    return out.select(key, F.col("c").alias("cov"), basic.alias("p_basic"), ((F.col("over") + F.col("half")) / F.col("n")).alias("p_half"), F.when(F.col("over") > 0, basic).otherwise(tail).alias("p_extrapolated"))


def _spread(drawn: Column, with_word: Column, size: Column) -> tuple[Column, Column]:
    """The mean of a hypergeometric number, and a distance from it beyond which what is left is below 1e-30."""
    mean = drawn * with_word / F.greatest(size, F.lit(1).cast("long"))
    sd = F.sqrt(mean * (1 - with_word / F.greatest(size, F.lit(1).cast("long"))))
    return F.floor(mean).cast("long"), F.ceil(12 * sd).cast("long") + 40


def exact_p(cov: Column, drawn: Column, with_word: Column, size: Column) -> Column:
    """P(X >= cov) where X is hypergeometric: `drawn` sequences out of `size`, of which `with_word` have the word.

    Terms further than 12 standard deviations (and 40) from the mean are left out, so an array of terms has
    the order of the square root of the number of sequences.
    """
    term = lambda x: F.exp(P.log_choose(with_word, x) + P.log_choose(size - with_word, drawn - x) - P.log_choose(size, drawn))
    mean, far = _spread(drawn, with_word, size)
    low = F.greatest(cov, drawn + with_word - size, F.lit(0).cast("long"), mean - far)
    upto = F.least(with_word, drawn, F.greatest(mean, cov) + far)
    terms = F.when(low <= upto, F.transform(F.sequence(low, upto), term)).otherwise(F.array().cast("array<double>"))
    return F.least(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the table ((a, b), (c, d)): the sum of all tables' probabilities that don't exceed this one's.

    Probabilities fall on both sides of the most probable table, so the tables between this one and the first on the other side that
    doesn't exceed it aren't looked at; that one is found by bisection. From both, 12 standard deviations (and 40) outwards are
    summed by the ratios of neighbours. So the terms have the order of the square root of the number of sequences, however far
    this table lies from the mean.
    """
    table = F.struct(a.cast("long").alias("a"), (a + b).cast("long").alias("row"), (a + c).cast("long").alias("col"), (a + b + c + d).cast("long").alias("n"))
    return _once(table, _two_sided)


def _once(value: Column, use) -> Column:
    """use(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _two_sided(t: Column) -> Column:
    a, row, col, n = t["a"], t["row"], t["col"], t["n"]
    least, most = F.greatest(F.lit(0).cast("long"), col - (n - row)), F.least(row, col)
    mode = F.least(F.greatest(F.floor((row + 1) * (col + 1).cast("double") / (n + 2)), least), most)
    known = F.struct(*[t[x].alias(x) for x in ("a", "row", "col", "n")], least.alias("least"), most.alias("most"), mode.alias("mode"), _spread(row, col, n)[1].alias("far"), P.log_choose(n, col).alias("all"))
    return _once(known, lambda t: _once(_log_p(t, t["a"]), lambda here: _sums(t, here)))


def _log_p(t: Column, x: Column) -> Column:
    return _once(x, lambda x: P.log_choose(t["row"], x) + P.log_choose(t["n"] - t["row"], t["col"] - x) - t["all"])


def _sums(t: Column, here: Column) -> Column:
    """The two tails of a table whose probability has the logarithm `here`: from itself outwards, and from the first place on the mode's other side that doesn't exceed it."""
    a, mode, zero = t["a"], t["mode"], F.lit(0).cast("long")
    up = a >= mode
    at = lambda i: F.when(up, mode - i).otherwise(mode + i)
    # `over` places beyond the mode the last is known to exceed, `under` places beyond it the first is known not to, or the tables end
    first = F.struct(F.when(a == mode, zero).otherwise(zero - 1).alias("over"), (F.when(up, mode - t["least"]).otherwise(t["most"] - mode) + 1).alias("under"))

    def halved(s, _):
        half = F.floor((s["over"] + s["under"]) / 2)
        either = lambda h: F.when(_log_p(t, at(h)) > here + 1e-7, F.struct(h.alias("over"), s["under"].alias("under"))).otherwise(F.struct(s["over"].alias("over"), h.alias("under")))
        return F.when(s["under"] - s["over"] > 1, _once(half, either)).otherwise(s)

    other = F.aggregate(F.sequence(F.lit(1), F.lit(40)), first, halved, lambda s: at(s["under"]))
    none = lambda x: (x < t["least"]) | (x > t["most"])
    beyond = lambda x: F.when(none(x), 0.0).otherwise(_once(_log_p(t, x), lambda log: F.when(up, _outwards(t, x, log, False)).otherwise(_outwards(t, x, log, True))))
    own = F.when(up, _outwards(t, a, here, True)).otherwise(_outwards(t, a, here, False))
    return F.least(own + _once(other, beyond), F.lit(1.0))


def _outwards(t: Column, start: Column, log: Column, rising: bool) -> Column:
    """The sum of the probabilities from start on, each from the one before by their ratio."""
    row, col, rest = t["row"], t["col"], t["n"] - t["row"] - t["col"]
    if rising:
        ratio = lambda x: F.when(x < t["most"], (row - x).cast("double") * (col - x) / ((x + 1).cast("double") * (rest + x + 1))).otherwise(0.0)
    else:
        ratio = lambda x: F.when(x > t["least"], x.cast("double") * (rest + x) / ((row - x + 1).cast("double") * (col - x + 1))).otherwise(0.0)
    step = lambda s, i: F.struct((s["p"] * ratio(start + i if rising else start - i)).alias("p"), (s["sum"] + s["p"]).alias("sum"))
    begin = F.struct(F.exp(log).alias("p"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), t["far"]), begin, step, lambda s: s["sum"])


def bonferroni(p: Column, tests: Column) -> Column:
    return F.least(p * tests, F.lit(1.0))


def share_up_to(hist: DataFrame, words: DataFrame, key: str = "kmer") -> DataFrame:
    """(key, cov, share): the share of samples with at most the word's coverage."""
    d = words.select(key, F.col("cov").alias("c")).join(hist, key).groupBy(key, "c")
    return d.agg((F.coalesce(F.sum(F.when(F.col("cov") <= F.col("c"), F.col("freq"))), F.lit(0)) / F.sum("freq")).alias("share")).withColumnRenamed("c", "cov")
