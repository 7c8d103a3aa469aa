"""Queries of the pattern report and of what leads to it, registered beside those of `catalog`."""

from __future__ import annotations

from pyspark.sql import functions as F

from motifmill.functions import numbers as N
from motifmill.functions import patterns as P
from motifmill.operators import background, degenerate, kmers, report, search
from motifmill.operators.draws import Draws
from motifmill.plans import flow
from motifmill.plans import catalog as c
from motifmill.plans.catalog import query
from motifmill.session import save
from motifmill.sources import fasta

#: Information content that patterns of four places need at least.
LEAST_IC = search.LOW_IC * c.K

_IC = """ic AS (SELECT pattern, 3 * log10(4) + log10(4.0 / length(letters)) AS ic FROM pats)"""
_PATCOV = "pcov AS (SELECT pattern, count(DISTINCT seq_id) AS cov FROM expd JOIN km USING (kmer) GROUP BY pattern)"
_TESTED = f"{c.PBASE}, {_IC}, {_PATCOV}, tested AS (SELECT pattern, ic, cov FROM ic JOIN pcov USING (pattern) WHERE ic >= {LEAST_IC})"


def _tested(spark, d):
    pats = c.patterns(spark, d)
    cov = degenerate.coverage(pats, c.index(spark, d))
    return save(report.testable(pats.select("pattern", P.ic(F.col("pattern")).alias("ic")).join(cov, "pattern"), LEAST_IC), "tested")


@query(f"{_TESTED} SELECT pattern, round(ic, 9) AS ic, cov FROM tested")
def pattern_testable(spark, d):
    return _tested(spark, d).withColumn("ic", F.round("ic", 9))


@query(f"{c.PBASE}, {_PATCOV} SELECT pattern, cov FROM pcov WHERE cov >= 0.1 * (SELECT count(*) FROM pos)")
def frequent_patterns(spark, d):
    return report.frequent(degenerate.coverage(c.patterns(spark, d), c.index(spark, d)), c.positives(spark, d).count())


# the second background: whole sequences of customers' keys
_MIR = f"mir AS (SELECT c_custkey::BIGINT AS ref_id, translate(md5('mir' || c_custkey::VARCHAR),{c._HEX}) AS seq FROM customer)"
_MIRDRAW = c.draw("mir", "mdrawn", "8")


def _p(words: str, drawn: str, index: str, name: str) -> str:
    """SQL of extrapolated p-values of a background, as a table (pattern, p) called name."""
    return f"""{name}_sc AS (SELECT pattern, sample_id, count(DISTINCT ref_id) AS cov FROM expd JOIN {index} USING (kmer) JOIN {drawn} USING (ref_id) WHERE pattern IN (SELECT pattern FROM {words}) GROUP BY ALL),
{name}_hits AS (SELECT pattern, cov, count(*) AS freq FROM {name}_sc GROUP BY ALL),
{name}_hist AS (SELECT * FROM (FROM {name}_hits UNION ALL SELECT w.pattern, 0, {c.SAMPLES} - coalesce((SELECT sum(freq) FROM {name}_hits h WHERE h.pattern = w.pattern), 0)::BIGINT FROM {words} w) WHERE freq > 0),
{name}_a AS (SELECT pattern, w.cov AS c, sum(freq) AS n, coalesce(sum(freq) FILTER (h.cov >= w.cov), 0) AS o, max_by(freq, h.cov) FILTER (h.cov < w.cov) AS bf, max(h.cov) FILTER (h.cov < w.cov) AS bc FROM {words} w JOIN {name}_hist h USING (pattern) GROUP BY ALL),
{name} AS (SELECT pattern, least((CASE WHEN o > 0 THEN o / n ELSE bf * pow(0.5, c - bc) / n END) * (SELECT count(*) FROM tested), 1) AS p FROM {name}_a)"""


_REPORT = f"""{_TESTED}, {c.POOL}, {c.DRAW}, {c.RK}, {_MIR}, {_MIRDRAW}, {c.km([c.K], "mir", "mk", "ref_id", "seq")}, {_p("tested", "drawn", "rk", "rna")},
again AS (SELECT * FROM tested WHERE pattern NOT IN (SELECT pattern FROM rna WHERE p > 0.05)), {_p("again", "mdrawn", "mk", "micro")},
rep AS (SELECT pattern, ic, cov, rna.p AS first_p, micro.p AS second_p FROM tested JOIN rna USING (pattern) LEFT JOIN micro USING (pattern) WHERE rna.p <= 0.05)"""


def _report(spark, d):
    tested = _tested(spark, d)
    tests, size = tested.count(), c.positives(spark, d).count()
    first = report.sampled_p(tested, c._draws(spark, d), tests)
    mir = save(fasta.hashed(c.table(spark, d, "customer"), "c_custkey", "mir").withColumnRenamed("seq_id", "ref_id"), "mir")
    second = report.sampled_p(save(report.worth_second(tested, first), "again"), Draws(mir, c.SAMPLES, size, "8"), tests)
    return save(report.report(tested, first, second), "report")


def _rounded(d):
    return d.select("pattern", F.round("ic", 9).alias("ic"), "cov", F.round("first_p", 9).alias("first_p"), F.round("second_p", 9).alias("second_p"))


@query(f"{_REPORT} SELECT pattern, round(ic, 9) AS ic, cov, round(first_p, 9) AS first_p, round(second_p, 9) AS second_p FROM rep")
def pattern_report(spark, d):
    return _rounded(_report(spark, d))


@query(f"""{_REPORT}, {c.NEG}, {c.km([c.K], "neg", "nm")}, nc AS (SELECT pattern, count(DISTINCT seq_id) AS c FROM expd JOIN nm USING (kmer) GROUP BY ALL),
t AS (SELECT pattern, cov AS a, (SELECT count(*) FROM pos) - cov AS b, coalesce(c, 0) AS c, (SELECT count(*) FROM neg) - coalesce(c, 0) AS d FROM rep LEFT JOIN nc USING (pattern)),
x AS (SELECT *, a + b AS r, a + c AS q, a + b + c + d AS n, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) AS x FROM t),
l AS (SELECT *, lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(q - x + 1) - lgamma(n - r - q + x + 1) - lgamma(n + 1) + lgamma(q + 1) + lgamma(n - q + 1) AS lp FROM x),
h AS (SELECT pattern, max(exp(lp)) FILTER (x = a) AS here FROM l GROUP BY ALL), f AS (SELECT pattern, a, c, least(sum(exp(lp)) FILTER (exp(lp) <= here * (1 + 1e-7)), 1) AS p FROM l JOIN h USING (pattern) GROUP BY ALL)
SELECT pattern, a AS pos_cov, c AS neg_cov, round(least(p * (SELECT count(*) FROM rep), 1), 6) AS p FROM f WHERE p * (SELECT count(*) FROM rep) < 0.05""")
def negative_filtered(spark, d):
    rep, neg = _report(spark, d), c.negatives(spark, d)
    hits = degenerate.coverage(rep.select("pattern"), kmers.index(neg, [c.K], fasta.RNA))
    return report.against_negatives(rep, hits, c.positives(spark, d).count(), neg.count()).withColumn("p", F.round("p", 6))


# alignments are the best offsets of a mean correlation over 0.5; other pairs stand as they are
_ALIGNED = f"""{c._PCC}, best AS (SELECT p1, p2, -x.n AS o, x.m AS m FROM (SELECT p1, p2, max({{'m': round(pcc / overlap, 9), 'a': -abs(shift), 'n': -shift}}) AS x FROM sims GROUP BY ALL)),
pairs AS (SELECT DISTINCT s.p1, s.p2, coalesce(o, 0) AS o FROM sims s LEFT JOIN (SELECT * FROM best WHERE m > 0.5) b USING (p1, p2)),
simi AS (SELECT pairs.p1, pairs.p2, o, coalesce(pcc, 0) / 4 AS similarity FROM pairs LEFT JOIN sims s ON s.p1 = pairs.p1 AND s.p2 = pairs.p2 AND s.shift = o)"""


def _aligned(sims):
    sims = save(sims, "sims")
    best = degenerate.best_offsets(sims).where("mean_pcc > 0.5")
    return sims, best


@query(f'{_ALIGNED} SELECT p1, p2, o::INTEGER AS "offset", round(similarity, 6) AS similarity FROM simi')
def pwm_similarity(spark, d):
    sims, best = _aligned(c._sims(spark, d))
    lengths = c.patterns(spark, d).select("pattern", P.length(F.col("pattern")).alias("n"))
    return report.aligned_similarity(sims, best, lengths).withColumn("similarity", F.round("similarity", 6))


_TWO = f"""{c.PBASE}, {c.NEG}, {", ".join(f"hit_{s} AS (SELECT pattern || '_{s}' AS pattern, regexp_extract_all(seq, pattern) AS m FROM pats, {s} WHERE regexp_matches(seq, pattern))" for s in ("pos", "neg"))},
hit AS (FROM hit_pos UNION ALL FROM hit_neg), one AS (SELECT pattern, 1.0::DOUBLE / length(m) AS w, unnest(m) AS m FROM hit), ppm AS (SELECT pattern, i::INTEGER AS pos, substr(m, i, 1) AS chr, sum(w) AS w FROM one, range(1, 5) r(i) GROUP BY ALL)"""


@query(f"""{c._PCC.replace(c._PPM, _TWO)} SELECT CASE WHEN right(p1, 3) = right(p2, 3) THEN 'in' ELSE 'trans' END AS kind, count(*) AS n, round(avg(pcc / 4), 6) AS mean FROM sims WHERE shift = 0 GROUP BY ALL""")
def cross_dataset_pwm(spark, d):
    """Matrices of the same patterns in two data sets, compared place by place."""
    pats = c.patterns(spark, d)
    both = None
    for side, seqs in (("pos", c.positives(spark, d)), ("neg", c.negatives(spark, d))):
        m = degenerate.ppm(pats, seqs).withColumn("pattern", F.concat("pattern", F.lit(f"_{side}")))
        both = m if both is None else both.unionByName(m)
    both = save(both, "ppm")
    sims = degenerate.offset_similarities(both).where("offset = 0").withColumn("similarity", F.col("pcc") / 4)
    side = both.select("pattern").distinct().withColumn("side", F.right("pattern", F.lit(3)))
    return report.across(sims, side).withColumn("mean", F.round("mean", 6))


@query(f"WITH {c.SEQ}, {c.km([2])}, {c.EDGES} SELECT seq_id, count(*) + 1 AS n FROM edges GROUP BY seq_id")
def dimer_lengths(spark, d):
    return kmers.dimer_lengths(kmers.edges(c.index(spark, d, [2])))


@query(f"{c._BOTH}, a AS (SELECT kmer, count(DISTINCT seq_id) AS cov FROM nm GROUP BY kmer), b AS (SELECT kmer, count(DISTINCT seq_id) AS cov FROM km GROUP BY kmer) FROM a UNION ALL SELECT * FROM b WHERE kmer NOT IN (SELECT kmer FROM a)")
def preferred_coverage(spark, d):
    """The negatives' coverage of a k-mer where they have it, else the positives'."""
    neg = kmers.counted(c.negatives(spark, d), [c.K], fasta.RNA).select("kmer", "cov")
    return report.preferred(neg, c.cov(spark, d).select("kmer", "cov"), "kmer")


_RANKED = """e AS (SELECT user_id AS g, event_type AS x, min(ts) AS o FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL),
ranked AS (SELECT a.g, a.x AS p1, b.x AS p2, row_number() OVER (PARTITION BY a.g ORDER BY greatest(a.o, b.o), a.x, b.x)::INTEGER AS rank FROM e a JOIN e b ON a.g = b.g AND a.x < b.x)"""


@query(f"WITH {_RANKED} SELECT g, p1, p2, rank FROM ranked")
def pair_ranks(spark, d):
    return report.ranked_pairs(c.table(spark, d, "events"), "user_id", "event_type", "ts")


@query(f"WITH {_RANKED} SELECT p1, p2, count(*) AS n, min(rank) AS best, max(rank) AS worst, sum(rank)::BIGINT AS total FROM ranked GROUP BY ALL HAVING count(*) > 1")
def coexisting_ranks(spark, d):
    return report.coexisting_ranks(pair_ranks(spark, d))


@query("""SELECT p_partkey, (p_size // 7 * 13 + p_size % 13)::BIGINT AS flat, (p_partkey // 13)::BIGINT AS row, (p_partkey % 13)::BIGINT AS col, lcm(lcm(p_size, p_partkey % 12 + 1), 10)::BIGINT AS lcm,
 (CASE WHEN p_retailprice >= 1000 THEN 1 ELSE 0 END + CASE WHEN p_retailprice >= 1250.5 THEN 1 ELSE 0 END + CASE WHEN p_retailprice >= 1900 THEN 1 ELSE 0 END)::BIGINT AS price_range FROM part""")
def index_helpers(spark, d):
    """Places in grids, multiples of lists and ranges of unequal width."""
    size, key = F.col("p_size"), F.col("p_partkey")
    at = N.grid_index(key, 13)
    return c.table(spark, d, "part").select(
        "p_partkey", N.flat_index(F.floor(size / 7), size % 13, 13).alias("flat"), at["row"].alias("row"), at["col"].alias("col"),
        N.lcm_of(F.array(size.cast("long"), key % 12 + 1, F.lit(10).cast("long"))).alias("lcm"), N.range_index(F.col("p_retailprice"), [1000, 1250.5, 1900]).alias("price_range"),
    )


@query("""WITH n AS (SELECT p_brand, [count(*) FILTER (p_size % 4 = 0), count(*) FILTER (p_size % 4 = 1), count(*) FILTER (p_size % 4 = 2), count(*) FILTER (p_size % 4 = 3)] AS c FROM part GROUP BY p_brand)
SELECT p_brand, round(list_sum(list_transform(c, lambda x: CASE WHEN x > 0 THEN x / list_sum(c) * log10(4 * x / list_sum(c)) ELSE 0 END)), 9) AS ic FROM n""")
def counts_ic(spark, d):
    n = c.table(spark, d, "part").groupBy("p_brand").agg(F.array(*[F.count_if(F.col("p_size") % 4 == i) for i in range(4)]).alias("c"))
    return n.select("p_brand", F.round(N.counts_ic(F.col("c")), 9).alias("ic"))


@query(f"{c.BASE} SELECT DISTINCT kmer, seq_id FROM km")
def bitmap_ids(spark, d):
    return kmers.decoded(kmers.layer_bitmaps(c.index(spark, d)))


@query("SELECT l_returnflag, min(l_quantity) AS min_quantity, max(l_quantity) AS max_quantity, min(l_discount) AS min_discount, max(l_discount) AS max_discount, min(l_linenumber) AS min_linenumber, max(l_linenumber) AS max_linenumber FROM lineitem GROUP BY ALL")
def field_ranges(spark, d):
    fields = ("quantity", "discount", "linenumber")
    return c.table(spark, d, "lineitem").groupBy("l_returnflag").agg(*[f(f"l_{x}").alias(f"{n}_{x}") for x in fields for n, f in (("min", F.min), ("max", F.max))])


@query(f"""{c.PBASE}, {_PATCOV} SELECT pattern, cov, CASE length(letters) WHEN 1 THEN 4 ELSE 3 END::BIGINT AS fixed_cnt, length(letters)::BIGINT AS var_cnt, 4::BIGINT AS length FROM pats JOIN pcov USING (pattern)""")
def pattern_analysis(spark, d):
    """The features of a pattern with its coverage."""
    f = P.features(F.col("pattern"))
    return degenerate.coverage(c.patterns(spark, d), c.index(spark, d)).select("pattern", "cov", *[f[n].alias(n) for n in ("fixed_cnt", "var_cnt", "length")])


@query(f"""{c.PBASE}, q AS (SELECT pattern, left(g, 1) AS c1, substr(g, 2, 1) AS c2, letters AS c3, right(g, 1) AS c4 FROM pats),
m AS (SELECT a.pattern AS p1, b.pattern AS p2, {", ".join(f"{c._UNION.format(x)} AS {x}" for x in ("c1", "c2", "c3", "c4"))}, {" + ".join(c._COST.format(x) for x in ("c1", "c2", "c3", "c4"))} AS cost FROM q a JOIN q b ON a.pattern > b.pattern),
n AS (SELECT p1, p2, {" || ".join(c._CLASS.format(x) for x in ("c1", "c2", "c3", "c4"))} AS merged FROM m WHERE cost > 0 AND cost <= 1 AND greatest(length(c1), length(c2), length(c3), length(c4)) < 4),
s AS (SELECT DISTINCT pattern, seq_id FROM expd JOIN km USING (kmer))
SELECT p1, p2, merged, count(DISTINCT seq_id) AS cov FROM n JOIN s ON s.pattern = p1 OR s.pattern = p2 GROUP BY ALL""")
def merged_coverage(spark, d):
    return report.merged_coverage(c.patterns(spark, d), c.index(spark, d))


def _p_of(spark, d):
    """Patterns of the clusters with an exact p-value: that of their coverage against the pool's."""
    pats = c.patterns(spark, d)
    n_pos, pool = c.positives(spark, d).count(), save(c._pool(spark, d), "pool")
    own = degenerate.coverage(pats, c.index(spark, d))
    refs = kmers.index(pool.select(F.col("ref_id").alias("seq_id"), F.col("seg").alias("seq")), [c.K])
    both = own.join(degenerate.coverage(pats, refs).withColumnRenamed("cov", "c"), "pattern", "left")
    number = lambda n: F.lit(n).cast("long")
    return both.select("pattern", background.exact_p(F.col("cov"), number(n_pos), F.coalesce("c", number(0)), number(pool.count())).alias("p"))


@query()
def cluster_cores_by_p(spark, d):
    return report.cores_by_p(c.louvain_clusters(spark, d), _p_of(spark, d)).withColumn("p", F.round("p", 9))


@query()
def cluster_cores_one_group(spark, d):
    """Clusters of one pattern put together (mode 2)."""
    return search.cores(report.regrouped(c._clustered(spark, d), 2), c.positives(spark, d).count())


@query()
def cluster_cores_two_groups(spark, d):
    """Clusters of one pattern put together, and all others too (mode 3)."""
    return search.cores(report.regrouped(c._clustered(spark, d), 3), c.positives(spark, d).count())


@query()
def motif_flow(spark, d):
    """Sequences to final motifs of two to six places, against both backgrounds."""
    pool = c._pool(spark, d).select("ref_id", F.col("seg").alias("seq"))
    mir = fasta.hashed(c.table(spark, d, "customer"), "c_custkey", "mir").withColumnRenamed("seq_id", "ref_id")
    found = flow.find(c.positives(spark, d), pool, mir, n_samples=c.SAMPLES)
    return found["motifs"].select("k", "pattern", "cov", F.round("ic", 8).alias("ic"), F.round("first_p", 9).alias("first_p"), F.round("second_p", 9).alias("second_p"))
