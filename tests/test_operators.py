import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from motifmill.operators import background, compare, degenerate, draws, graphs, kmers, report, search
from motifmill.plans import flow
from motifmill.sinks import text as sinks
from motifmill.sources import fasta
from motifmill.streaming import coverage as streaming


def sequences(n=40, seed=1, length=(10, 25)):
    r = random.Random(seed)
    return [(i, "".join(r.choice("ACGU") for _ in range(r.randint(*length)))) for i in range(n)]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(sequences(), "seq_id long, seq string")


def test_index_and_coverage(spark, seqs):
    rows = sequences()
    idx = kmers.index(seqs, [2, 3])
    assert idx.count() == sum(len(s) - k + 1 for _, s in rows for k in (2, 3))
    got = {(r.k, r.kmer): (r.visits, r.cov) for r in kmers.coverage(idx).collect()}
    for (k, w), (visits, cov) in got.items():
        assert visits == sum(s[i : i + k] == w for _, s in rows for i in range(len(s) - k + 1))
        assert cov == sum(w in s for _, s in rows)
    # a longer k-mer has no more coverage than its parts
    for (k, w), (_, cov) in got.items():
        if k == 3:
            assert cov <= min(got[2, w[:2]][1], got[2, w[1:]][1])


def test_foreign_letters_short_and_null_sequences(spark):
    d = spark.createDataFrame([(1, "ACN"), (2, "A"), (3, ""), (4, None)], "seq_id long, seq string")
    assert [(r.seq_id, r.kmer) for r in kmers.index(d, [2], "ACGU").collect()] == [(1, "AC")]
    assert kmers.index(d.limit(0), [2]).count() == 0


def test_visits(spark):
    d = spark.createDataFrame([(1, "AAAAA"), (2, "CAAC")], "seq_id long, seq string")
    w = spark.createDataFrame([("AA",)], "kmer string")
    assert tuple(kmers.visits(d, w).first())[1:] == (3, 2)
    assert sorted((r.seq_id, r.pos) for r in kmers.visits_from_right(d, w).collect()) == [(1, 1), (1, 3), (2, 1)]


def test_edges_paths_and_top(spark, seqs):
    idx = kmers.index(seqs, [2, 3])
    e = kmers.edges(idx)
    assert e.count() == idx.where("k = 3").count()
    two = idx.where("k = 2").select("seq_id", "pos", "kmer")
    assert sorted(map(tuple, kmers.extend(two, two, 1).collect())) == sorted((r.seq_id, r.pos, r.kmer) for r in idx.where("k = 3").collect())
    assert kmers.top(kmers.coverage(idx), 3).count() == 6


def test_tree(spark):
    layer = spark.createDataFrame([("AAA",), ("ACG",), ("UUG",)], "kmer string")
    parents = spark.createDataFrame([("AA",), ("CG",)], "kmer string")
    got = sorted((r.child, r.parent, r.side) for r in graphs.tree(layer, parents, 3).collect())
    assert got == [("AAA", "AA", 0), ("ACG", "CG", 1), ("UUG", "___", 0)]
    assert [r.child for r in graphs.orphans(layer, parents, 3).collect()] == ["UUG"]


def test_similarity_join_finds_what_comparing_all_finds(spark, seqs):
    words = kmers.coverage(kmers.index(seqs, [4])).select("kmer")
    got = {(r.u, r.v) for r in graphs.similarity(words, 4).collect()}
    every = [r.kmer for r in words.collect()]
    want = {(u, v) for u in every for v in every if u > v and sum(u[i : i + 2] == v[i : i + 2] for i in range(3)) >= 1}
    assert got == want


def test_pattern_coverage_by_expansion_and_by_search(spark, seqs):
    p = spark.createDataFrame([("A[CG]U",), ("GG[AU]",)], "pattern string")
    a = {r.pattern: r.cov for r in degenerate.coverage(p, kmers.index(seqs, [3])).collect()}
    b = {r.pattern: (r.cov, r.matches) for r in degenerate.regex_coverage(p, seqs).collect()}
    for pattern in a:
        hits = [re.findall(pattern, s) for _, s in sequences()]
        assert a[pattern] == b[pattern][0] == sum(map(bool, hits))
        assert b[pattern][1] == sum(map(len, hits))


def test_ppm_columns_sum_to_coverage(spark, seqs):
    p = spark.createDataFrame([("A[CG]U",)], "pattern string")
    m = degenerate.ppm(p, seqs)
    cov = degenerate.regex_coverage(p, seqs).first().cov
    sums = m.groupBy("pos").agg(F.sum("w").alias("w")).collect()
    assert len(sums) == 3 and all(r.w == pytest.approx(cov) for r in sums)
    wide = sinks.wide_ppm(m).orderBy("PO").collect()
    assert wide[0].A == pytest.approx(cov) and wide[0].C == 0
    assert sinks.matrix_text(m).first().text.startswith("A[CG]U\nA:")
    assert "w= 3" in sinks.meme_text(m).first().text


def test_column_ic(spark):
    d = spark.createDataFrame([("ACCG",), ("ACCU",)], "seq string")
    got = [r.ic for r in degenerate.column_ic(d).orderBy("pos").collect()]
    assert got == pytest.approx([0.6021, 0.6021, 0.6021, 0.3010], abs=1e-4)


def test_pearson_of_a_matrix_with_itself(spark, seqs):
    p = spark.createDataFrame([("A[CG]U",), ("ACU",)], "pattern string")
    best = degenerate.best_offsets(degenerate.offset_similarities(degenerate.ppm(p, seqs))).first()
    assert (best.p1, best.p2, best.offset) == ("A[CG]U", "ACU", 0)
    assert 0.5 < best.mean_pcc <= 1


def test_thresholds_and_p_values(spark):
    hist = spark.createDataFrame([("w", i, f) for i, f in enumerate([10, 20, 50, 10, 6, 4])], "kmer string, cov long, freq long")
    assert background.thresholds(hist, 0.95).first().threshold == 4
    p = background.p_values(spark.createDataFrame([("w", 4)], "kmer string, cov long"), hist).first()
    assert (p.p_basic, p.p_half, p.p_extrapolated) == (0.10, 0.15, 0.10)
    p = background.p_values(spark.createDataFrame([("w", 7)], "kmer string, cov long"), hist).first()
    assert p.p_basic == 0 and p.p_extrapolated == pytest.approx(0.04 * 0.25)


def test_exact_p_and_fisher(spark):
    def choose(n, k):
        return math.comb(n, k)

    want = sum(choose(30, x) * choose(170, 20 - x) for x in range(6, 21)) / choose(200, 20)
    got = spark.range(1).select(background.exact_p(*[F.lit(x).cast("long") for x in (6, 20, 30, 200)]).alias("p")).first().p
    assert got == pytest.approx(want, rel=1e-9)
    got = spark.range(1).select(background.fisher(*[F.lit(x).cast("long") for x in (12, 5, 3, 14)]).alias("p")).first().p
    assert got == pytest.approx(0.004895793, rel=1e-6)


def test_samples_are_draws_without_replacement(spark):
    refs = spark.range(50).select(F.col("id").alias("ref_id"))
    rows = background.samples(refs, 3, 10).collect()
    per = Counter(r.sample_id for r in rows)
    assert per == {0: 10, 1: 10, 2: 10} and len(set(rows)) == 30


def test_sampled_p_nears_exact_p(spark):
    refs = spark.range(200).select(F.col("id").alias("ref_id"))
    drawn = background.samples(refs, 400, 20)
    words = spark.range(30).select(F.lit("w").alias("kmer"), F.col("id").alias("ref_id"))
    hist = background.histograms(words.select("kmer").distinct(), background.sampled_coverage(words, drawn, "kmer"), 400, "kmer")
    assert hist.agg(F.sum("freq")).first()[0] == 400
    p = background.p_values(spark.createDataFrame([("w", 5)], "kmer string, cov long"), hist).first().p_basic
    exact = spark.range(1).select(background.exact_p(*[F.lit(x).cast("long") for x in (5, 20, 30, 200)]).alias("p")).first().p
    assert p == pytest.approx(exact, abs=0.06)


def test_pool_keeps_letters_and_lengths(spark):
    refs = spark.createDataFrame([(i, s * 3) for i, s in sequences(20)], "ref_id long, seq string")
    got = background.pool(refs, 8, 12).collect()
    by_id = {i: s * 3 for i, s in sequences(20)}
    assert len(got) == 20
    for r in got:
        assert 8 <= len(r.seg) <= 12 and not Counter(r.seg) - Counter(by_id[r.ref_id])
    assert got == background.pool(refs, 8, 12).collect()


def test_pattern_search_never_loses_coverage(spark, seqs):
    idx = kmers.index(seqs, [4])
    cov = kmers.coverage(idx)
    found = search.patterns(kmers.candidates(cov, 40, 0.1), idx, 4).collect()
    assert found
    words = {r.kmer: r.cov for r in cov.collect()}
    for r in found:
        assert r.cov == sum(bool(re.search(r.pattern, s)) for _, s in sequences())
        assert 0.33375 * 4 < r.ic < 0.61 * 4 or r.pattern in words


def test_communities(spark):
    two = [(f"{s}{i}", f"{s}{j}", 1.0) for s in "ab" for i in range(4) for j in range(i)] + [("a0", "b0", 0.1)]
    got = {r.pattern: r.cluster_id for r in search.communities(spark.createDataFrame(two, "a string, b string, w double")).collect()}
    assert {got[f"a{i}"] for i in range(4)} == {"a0"} and {got[f"b{i}"] for i in range(4)} == {"b0"}


def test_cores_and_final(spark):
    hits = {"p": range(0, 6), "q": range(4, 9), "r": range(0, 3), "s": range(9, 12)}
    rows = [("c" if p != "s" else "d", p, i, 1.0) for p, ids in hits.items() for i in ids]
    members = spark.createDataFrame(rows, "cluster_id string, pattern string, seq_id long, ic double")
    got = [(r.cluster_id, r.pattern, r.rank, r.gain) for r in search.cores(members, 12).orderBy("cluster_id", "rank").collect()]
    assert got == [("c", "p", 1, 6), ("c", "q", 2, 3), ("d", "s", 1, 3)]
    assert {r.pattern for r in search.final(search.cores(members, 12), members).collect()} == {"p", "q", "s"}


def test_fasta(spark, tmp_path):
    f = tmp_path / "x.fa"
    f.write_bytes(b">one\r\nACGU\r\nAC\r\n>two\r\nGGNA\r\n>three\r\nSequence unavailable\r\n")
    assert sorted(r.seq for r in fasta.single_line(spark, str(f)).collect()) == sorted(["ACGU", "AC", "GGA", "equence unavailable"])
    assert {r.title: r.seq for r in fasta.multi_line(spark, str(f)).collect()} == {"one": "ACGUAC", "two": "GGNA"}
    assert fasta.upper(spark, str(f)).count() == 3
    s = fasta.stats(fasta.multi_line(spark, str(f))).first()
    assert (s.n, s.min_len, s.max_len, s.letters) == (2, 4, 6, 10)
    c = tmp_path / "c.tsv"
    c.write_text("p\tq\nr\n")
    assert sorted(r.pattern for r in fasta.clusters(spark, str(c)).collect()) == ["p", "q", "r"]


def test_ppm_round_trip(spark, seqs, tmp_path):
    p = spark.createDataFrame([("ACU",)], "pattern string")
    sinks.tsv(sinks.wide_ppm(degenerate.ppm(p, seqs)).drop("pattern"), str(tmp_path / "m"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "m"))
    assert back.columns == ["PO", "A", "C", "G", "U"] and back.count() == 3


def test_histogram_has_end_bins(spark):
    d = spark.createDataFrame([(float(x),) for x in (0, 1, 5, 10, 11, 99)] + [(None,)], "v double")
    got = {r.bin: r.n for r in compare.histogram(d, "v", 1, 11, 2).collect()}
    assert sum(got.values()) == 6 and got[0] == 1 and got[3] == 2


def test_streaming_coverage(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    rows = sequences()
    spark.createDataFrame(rows[:20], "seq_id long, seq string").write.mode("append").parquet(str(src))
    spark.createDataFrame(rows[20:], "seq_id long, seq string").write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("seq_id long, seq string").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = streaming.start(stream, [2], str(out), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    want = kmers.coverage(kmers.index(spark.createDataFrame(rows, "seq_id long, seq string"), [2]))
    assert sorted(map(tuple, streaming.total(spark, str(out)).select("k", "kmer", "visits", "cov").collect())) == sorted(map(tuple, want.select("k", "kmer", "visits", "cov").collect()))


def test_number_helpers(spark):
    from motifmill.functions import numbers as N

    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    arr = lambda *x: F.array(*[F.lit(i) for i in x])
    assert one(N.gcd(F.lit(84), F.lit(36))) == 12 and one(N.lcm(F.lit(4), F.lit(6))) == 12 and one(N.lcm(F.lit(0), F.lit(6))) == 0
    assert one(N.least_offset(arr(1, 5), arr(4, 7))) == 2 and one(N.least_offset(arr(9), arr(1))) == -1
    assert one(N.ngrams(arr(1, 2, 3), 2)) == [[1, 2], [2, 3]] and one(N.ngrams(arr(1), 2)) == []
    assert len(one(N.all_ngrams(arr(1, 2, 3), 3))) == 5
    assert N.boundaries(0, 2, 1) == [(float("-inf"), 0), (0, 1), (1, 2), (2, float("inf"))]
    assert one(N.log_odds(F.lit(0.5), F.lit(0.25))) == 1.0
    d = spark.createDataFrame([(1, "AB"), (2, "C")], "id int, seq string")
    assert [tuple(r) for r in N.transposed(d).orderBy("pos").collect()] == [(0, "AC"), (1, "B")]


def test_queries_and_oracles_go_together():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 65


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 96


def arrays(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_exact_tests_leave_out_only_what_vanishes(spark):
    """Large tables, against sums of all their terms."""

    def log_choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    def terms(drawn, good, size):
        low, high = max(0, drawn + good - size), min(drawn, good)
        return {x: math.exp(log_choose(good, x) + log_choose(size - good, drawn - x) - log_choose(size, drawn)) for x in range(low, high + 1)}

    for cov, drawn, good, size in ((900, 3000, 8000, 30000), (0, 3000, 8000, 30000), (700, 3000, 8000, 30000), (2500, 3000, 8000, 30000)):
        want = sum(p for x, p in terms(drawn, good, size).items() if x >= cov)
        got = arrays(spark, background.exact_p(*[F.lit(x).cast("long") for x in (cov, drawn, good, size)]))[0]
        assert got == pytest.approx(want, rel=1e-6, abs=1e-12)
    for a, b, c, d in ((300, 2700, 420, 2600), (310, 2690, 300, 2700), (50, 950, 900, 100)):
        p = terms(a + b, a + c, a + b + c + d)
        want = sum(x for x in p.values() if x <= p[a] * (1 + 1e-7))
        got = arrays(spark, background.fisher(*[F.lit(x).cast("long") for x in (a, b, c, d)]))[0]
        assert got == pytest.approx(want, rel=1e-5, abs=1e-12)


def test_samples_are_the_references_of_least_hash(spark):
    refs = spark.range(3000).select(F.col("id").alias("ref_id"))
    few = background.samples(refs, 3, 40)

    def least(sample, n):
        a, b, c, d = (int(hashlib.md5(f"7/{sample}".encode()).hexdigest()[i : i + 8], 16) % draws.PRIME for i in (0, 8, 16, 24))
        hashed = []
        for ref in range(3000):
            m = hashlib.md5(f"7#{ref}".encode()).hexdigest()
            x, y = int(m[:8], 16) % draws.PRIME, int(m[8:16], 16) % draws.PRIME
            hashed.append((((a * x + b) * x + c * y + d) % draws.PRIME, ref))
        return {r for _, r in sorted(hashed)[:n]}

    for sample in range(3):
        assert {r.ref_id for r in few.where(F.col("sample_id") == sample).collect()} == least(sample, 40)
    many = background.samples(refs.repartition(7), 2, 2900)
    assert {r.ref_id for r in many.where("sample_id = 1").collect()} == least(1, 2900)
    assert background.samples(refs.limit(5), 2, 9).count() == 10  # fewer references than are asked for: all of them


def test_bitmaps_are_decoded(spark):
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 70000]
    idx = spark.createDataFrame([(2, "AC", i) for i in ids] + [(2, "GU", 5)], "k int, kmer string, seq_id long")
    got = kmers.decoded(kmers.layer_bitmaps(idx).drop("k"))
    assert sorted(r.seq_id for r in got.where("kmer = 'AC'").collect()) == ids and got.count() == len(ids) + 1


def test_places_ranges_and_counts(spark):
    from motifmill.functions import numbers as N

    assert N.float_range(0, 1, 0.1)[3] == pytest.approx(0.3) and len(N.float_range(0, 1, 0.1)) == 10 and N.float_range(1, 0, 0.5) == []
    row = arrays(spark, N.flat_index(F.lit(2), F.lit(3), 5), N.grid_index(F.lit(13), 5).alias("at"), N.lcm_of(F.array(F.lit(4), F.lit(6), F.lit(10))))
    assert row[0] == 13 and (row.at.row, row.at.col) == (2, 3) and row[2] == 60
    for v, want in ((-1, 0), (0, 1), (1.1, 2), (5, 3)):
        assert arrays(spark, N.range_index(F.lit(v), [0, 1, 2]))[0] == want
    for counts, want in (((1, 2, 1, 0), 0.1505), ((4, 0, 0, 0), 0.6021), ((1, 1, 1, 1), 0.0)):
        assert arrays(spark, N.counts_ic(F.array(*[F.lit(c).cast("long") for c in counts])))[0] == pytest.approx(want, abs=1e-4)
    d = spark.createDataFrame([("a", 1, True), ("a", 4, False), ("a", 5, True), ("a", 7, False), ("b", 9, True), ("b", 9, False), ("b", None, True)], "k string, v long, x boolean")
    assert {r.k: r.least for r in N.least_offsets(d, "k", "v", "x").collect()} == {"a": 2, "b": -1}


def test_report_filters(spark):
    p = spark.createDataFrame([("A[CG]A", 1.5, 30), ("CCC", 1.8, 9), ("A[ACGU]A", 1.2, 40), ("GGG", 0.5, 8)], "pattern string, ic double, cov long")
    assert sorted(r.pattern for r in report.testable(p, 1.0).collect()) == ["A[CG]A", "CCC"]
    assert sorted(r.pattern for r in report.frequent(p, 100).collect()) == ["A[ACGU]A", "A[CG]A"]
    raw = spark.createDataFrame([("A[CG]A", 0.01), ("CCC", 0.02), ("GGG", 0.6)], "pattern string, p double")
    first = report.adjusted(raw, 4)
    assert {r.pattern: r.p for r in first.collect()} == {"A[CG]A": 0.04, "CCC": 0.08, "GGG": 1.0}
    assert sorted(r.pattern for r in report.worth_second(p, first).collect()) == ["A[ACGU]A", "A[CG]A"]
    second = spark.createDataFrame([("CCC", 0.9)], "pattern string, p double")
    assert [(r.pattern, r.first_p, r.second_p) for r in report.report(p, first, second).collect()] == [("A[CG]A", 0.04, None)]
    assert report.report(p, first).columns == ["pattern", "ic", "cov", "first_p", "second_p"]


def test_patterns_that_negatives_have_as_often_go(spark):
    p = spark.createDataFrame([("AAA", 60), ("CCC", 50), ("GGG", 5)], "pattern string, cov long")
    neg = spark.createDataFrame([("AAA", 10), ("CCC", 48), ("GGG", 60)], "pattern string, cov long")
    got = {r.pattern: r.neg_cov for r in report.against_negatives(p, neg, 100, 100).collect()}
    assert got == {"AAA": 10, "GGG": 60}  # two-sided: one that negatives have more often stays
    assert report.against_negatives(p, neg.limit(0), 100, 100).where("pattern = 'AAA'").first().neg_cov == 0


def test_aligned_similarity_takes_the_offset_or_none(spark):
    sims = spark.createDataFrame([("q", "p", 0, 3, 1.5), ("q", "p", 1, 2, 2.0), ("r", "p", 0, 3, 0.9)], "p1 string, p2 string, offset int, overlap long, pcc double")
    lengths = spark.createDataFrame([("p", 3), ("q", 4), ("r", 3)], "pattern string, n int")
    one = spark.createDataFrame([("q", "p", 1)], "p1 string, p2 string, offset int")
    got = {(r.p1, r.offset): r.similarity for r in report.aligned_similarity(sims, one, lengths).collect()}
    assert got == {("q", 1): pytest.approx(0.5), ("r", 0): pytest.approx(0.3)}
    side = spark.createDataFrame([("p", "x"), ("q", "x"), ("r", "y")], "pattern string, side string")
    both = report.aligned_similarity(sims, one.limit(0), lengths)
    assert {(r.kind, r.n, round(r["mean"], 3)) for r in report.across(both, side).collect()} == {("in", 1, 0.5), ("trans", 1, 0.3)}


def test_core_modes(spark):
    hits = {"p": range(0, 6), "q": range(4, 9), "r": range(0, 3), "s": range(9, 12), "t": range(9, 11)}
    home = {"p": "c", "q": "c", "r": "c", "s": "d", "t": "e"}
    members = spark.createDataFrame([(home[p], p, i, 1.0) for p, ids in hits.items() for i in ids], "cluster_id string, pattern string, seq_id long, ic double")
    groups = lambda mode: {frozenset(r.p) for r in report.regrouped(members, mode).groupBy("cluster_id").agg(F.collect_set("pattern").alias("p")).collect()}
    assert groups(0) == {frozenset("pqr"), frozenset("s"), frozenset("t")}
    assert groups(2) == groups(3) == {frozenset("pqr"), frozenset("st")}
    with pytest.raises(ValueError):
        report.regrouped(members, 5)
    # greedy by hand: of the clusters of one pattern s covers more, and t adds nothing
    got = {(r.pattern, r["rank"], r.gain) for r in search.cores(report.regrouped(members, 2), 12).collect()}
    assert got == {("p", 1, 6), ("q", 2, 3), ("s", 1, 3)}
    p = spark.createDataFrame([("p", 0.3), ("q", 0.1), ("r", 0.1), ("s", 0.5)], "pattern string, p double")
    low = report.cores_by_p(members, p, 2)
    assert {(r.pattern, r["rank"]) for r in low.collect()} == {("q", 1), ("r", 2), ("s", 1)}


def test_preferred_and_ranked(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    b = spark.createDataFrame([("y", 9), ("z", 3)], "k string, v int")
    assert sorted(map(tuple, report.preferred(a, b, "k").collect())) == [("x", 1), ("y", 2), ("z", 3)]
    e = spark.createDataFrame([(1, "a", 1), (1, "b", 5), (1, "c", 3), (2, "b", 1), (2, "a", 2), (2, "a", 9), (None, "a", 1)], "g long, x string, o int")
    ranks = report.ranked_pairs(e, "g", "x", "o")
    assert sorted(map(tuple, ranks.collect())) == [(1, "a", "b", 2), (1, "a", "c", 1), (1, "b", "c", 3), (2, "a", "b", 1)]
    assert [tuple(r) for r in report.coexisting_ranks(ranks).collect()] == [("a", "b", 2, 1, 2, 3)]


def test_merged_coverage_is_of_either(spark, seqs):
    p = spark.createDataFrame([("A[CG]A",), ("ACA",), ("UUU",)], "pattern string")
    got = report.merged_coverage(p, kmers.index(seqs, [3])).collect()
    assert [(r.p1, r.p2, r.merged) for r in got] == [("A[CG]A", "ACA", "A[CG]A")] or [(r.p1, r.p2) for r in got] == [("ACA", "A[CG]A")]
    assert got[0]["cov"] == sum(bool(re.search("A[CG]A", s)) for _, s in sequences())


def grow(words, near, seqs, cov, low, high):
    """Every pattern that unions of neighbours reach within a window, by hand: {start: {pattern: coverage}}."""

    def text(sets):
        return "".join("".join(sorted(s)) if len(s) == 1 else "[" + "".join(sorted(s)) + "]" for s in sets)

    def ic(sets):
        own = [""]
        for s in sets:
            own = [o + c for o in own for c in s]
        total = 0.0
        for i in range(len(sets)):
            n = Counter()
            for w in own:
                n[w[i]] += cov.get(w, 1)
            every = sum(n.values())
            total += sum(x / every * math.log10(4 * x / every) for x in n.values())
        return total

    out = {}
    for start in words:
        found, stack, seen = {}, [tuple(frozenset(c) for c in start)], set()
        while stack:
            sets = stack.pop()
            own = {""}
            for s in sets:
                own = {o + c for o in own for c in s}
            for u in own & set(words):
                for v in near[u] - own:
                    more = tuple(s | {c} for s, c in zip(sets, v))
                    if more in seen or max(map(len, more)) == 4 or not low < ic(more) < high:
                        continue
                    seen.add(more)
                    stack.append(more)
                    found[text(more)] = (sum(bool(re.search(text(more), s)) for _, s in seqs), round(ic(more), 9))
        out[start] = found
    return out


def test_search_finds_the_best_of_all_patterns(spark):
    """Against all patterns that can be grown, of few words; and narrower windows, each by hand."""
    rows = sequences(30, 5, (6, 9))
    seqs = spark.createDataFrame(rows, "seq_id long, seq string")
    idx = kmers.index(seqs, [4])
    every = {r.kmer: r.cov for r in kmers.coverage(idx).collect()}
    words = sorted(sorted(every, key=lambda w: (-every[w], w))[:9])
    some = kmers.coverage(idx).where(F.col("kmer").isin(words))
    alike = lambda u, v: sum(u[i : i + 2] == v[i : i + 2] for i in range(3)) >= 1
    near = {u: {v for v in words if v != u and alike(u, v)} for u in words}
    cov = {w: every[w] for w in words}

    def best(low, high):
        out = set()
        for found in grow(words, near, rows, cov, low, high).values():
            if found:
                out.add(min(found, key=lambda p: (-found[p][0], -found[p][1], p)))
        return out

    low, high = search.LOW_IC * 4, search.HIGH_IC * 4
    got = search.patterns(some, idx, 4).collect()
    assert {r.pattern for r in got} == best(low, high) and any(r.pattern.count("[") > 1 for r in got)
    mid = (low + high) / 2
    two = search.window_patterns(some, idx, 4, [(low, mid), (mid, high)]).collect()
    assert {r.pattern for r in two if r.window == 0} == best(low, mid) and {r.pattern for r in two if r.window == 1} == best(mid, high)


    def cut(low, high, step):
        """The bisection, window by window."""
        found = best(low, high)
        out = set(found)
        if found:
            at = min(ics[p] for p in found)
            for x, y in ((low, min(at, high - step)), (max(at, low + step), high)):
                if y - x > step + 1e-9 and (x, y) != (low, high):
                    out |= cut(x, y, step)
        return out

    ics = {p: round(v[1], 8) for found in grow(words, near, rows, cov, low, high).values() for p, v in found.items()}
    for step in (0.05, 0.2):
        assert {r.pattern for r in search.bisected(some, idx, 4, step).collect()} == cut(low, high, step)
    assert len(cut(low, high, 0.05)) >= len(best(low, high))


def lines_of(spark, path):
    return [r.value for r in spark.read.text(str(path)).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()]


def test_report_files(spark, tmp_path):
    p = spark.createDataFrame([(2, "AC", 1.2, 5, 0.01, None), (2, "GU", 1.2, 9, 0.02, 0.5), (3, "ACU", 1.8, 4, 0.03, None)], "k int, pattern string, ic double, cov long, first_p double, second_p double")
    sinks.lines(sinks.pattern_info(p, 10), str(tmp_path / "info"))
    assert lines_of(spark, tmp_path / "info") == [
        "=====motif length: 2=====", "pattern\tIC\tcoverage(in 10)\tRNA_Pvalue\tmiR_Pvalue", "GU\t1.2\t9\t0.02\t0.5", "AC\t1.2\t5\t0.01\tN/A",
        "=====motif length: 3=====", "pattern\tIC\tcoverage(in 10)\tRNA_Pvalue\tmiR_Pvalue", "ACU\t1.8\t4\t0.03\tN/A",
    ]
    sinks.lines(sinks.final_result(p), str(tmp_path / "final"))
    assert lines_of(spark, tmp_path / "final")[:2] == ["pattern length: 2", "GU\t9\t1.2\t0.02\t0.5"]
    hits = {"p": range(0, 6), "q": range(4, 9)}
    members = spark.createDataFrame([("c", x, i, 1.0) for x, ids in hits.items() for i in ids], "cluster_id string, pattern string, seq_id long, ic double")
    clusters = members.select(F.lit(2).alias("k"), "cluster_id", "pattern").distinct()
    cores = search.cores(members, 10).withColumn("k", F.lit(2))
    sinks.lines(sinks.cluster_info(clusters, cores, members), str(tmp_path / "clusters"))
    assert lines_of(spark, tmp_path / "clusters") == [
        "==== clusters for motif with length: 2 ====", "p\tq", "== core pattern in each cluster ==", "p\t6\t9\t3", "q\t5\t3\t0", "==",
    ]


def test_graph_and_motif_files(spark, seqs, tmp_path):
    cov = spark.createDataFrame([("AC", 9), ("GU", 5), ("UU", 2), ("GG", 7)], "kmer string, cov long")
    t = lambda *rows: spark.createDataFrame(rows, "kmer string, threshold long")
    nodes = sinks.tree_nodes(cov, t(("AC", 3), ("GU", 4), ("UU", 5)), t(("AC", 8), ("GU", 5), ("GG", 1)))
    assert {(r.id, r.label, r.colour) for r in nodes.collect()} == {("AC", "AC_9,3,8", "red"), ("GU", "GU_5,4,5", "black"), ("GG", "GG_7,-,1", "green")}
    sinks.dot(nodes, spark.createDataFrame([("AC", "GU")], "u string, v string"), str(tmp_path / "g"), directed=False)
    text = lines_of(spark, tmp_path / "g")
    assert text[0] == "graph {" and text[-1] == "}" and '"AC" -- "GU";' in text and len(text) == 6
    m = degenerate.ppm(spark.createDataFrame([("AC",), ("G[CU]",)], "pattern string"), seqs)
    sinks.meme_file(sinks.meme_text(m), str(tmp_path / "m"))
    text = "\n".join(lines_of(spark, tmp_path / "m"))
    assert text.count("MEME version") == 1 and text.index("MEME") < text.index("MOTIF AC") < text.index("MOTIF G[CU]")


def test_sequences_are_numbered_by_their_place(spark, tmp_path):
    n = 4000
    for k in range(2):
        (tmp_path / f"{k}.fa").write_text("".join(f">t{k}.{i}\n{'ACGU'[i % 4]}{'ACGU'[i // 4 % 4]}ACGU\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = fasta.multi_line(spark, str(tmp_path)).orderBy("seq_id").collect()
        assert [r.title for r in got] == [f"t{k}.{i}" for k in range(2) for i in range(n)] and [r.seq_id for r in got] == list(range(2 * n))
        one = fasta.single_line(spark, str(tmp_path)).orderBy("seq_id").collect()
        assert [r.seq for r in one] == [r.seq for r in got] and [r.seq_id for r in one] == list(range(2 * n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_alignment_files(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("Query ID\tTarget ID\tOptimal offset\tp-value\tE-value\tq-value\n#Query\tx\n p\tq\t-1\t0.5\t1.0\t0.7\r\np\tr\t2\t1e-3\t0.1\t0.2\nshort\tline\n".replace(" p", "p"))
    assert [tuple(r) for r in fasta.alignments(spark, str(f)).orderBy("offset").collect()] == [("p", "q", -1, 0.5, 1.0, 0.7), ("p", "r", 2, 0.001, 0.1, 0.2)]


def test_flow_finds_a_planted_motif(spark):
    """Sequences that nearly all hold GG[CG]AC, against references that hold it by chance."""
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("ACGU") for _ in range(n))
    rows = [(i, letters(8) + f"GG{r.choice('CG')}AC" + letters(8)) for i in range(60)]
    refs = [(i, letters(21)) for i in range(200)]
    got = flow.find(
        spark.createDataFrame(rows, "seq_id long, seq string"), spark.createDataFrame(refs, "ref_id long, seq string"), negatives=spark.createDataFrame([(i, letters(21)) for i in range(60)], "seq_id long, seq string"),
        ks=(4,), n_samples=20, threshold=0.3,
    )
    motifs = [r.pattern for r in got["motifs"].collect()]
    assert any(re.fullmatch(m, "GGCA") and re.fullmatch(m, "GGGA") for m in motifs) or any(re.fullmatch(m, "GCAC") and re.fullmatch(m, "GGAC") for m in motifs), motifs
    assert set(motifs) <= {r.pattern for r in got["cores"].collect()} <= {r.pattern for r in got["patterns"].collect()}
    empty = flow.find(spark.createDataFrame(rows[:5], "seq_id long, seq string"), spark.createDataFrame(refs, "ref_id long, seq string"), ks=(4,), n_samples=3, threshold=2.0)
    assert all(t.count() == 0 for t in empty.values())


def test_merged_tops_by_hand(spark, seqs):
    """The tops of each number of merged letters, with merges, coverage and ties by hand."""
    rows, n = sequences(), 6

    def text(sets):
        return "".join(c if len(c) == 1 else f"[{c}]" for c in sets)

    def merged(p, q):
        cost = sum(0 if a == b else 0.6 if a in b or b in a else 1 for a, b in zip(p, q))
        out = tuple("".join(sorted(set(a + b))) for a, b in zip(p, q))
        return out if 0 < cost <= 1 and max(map(len, out)) < 4 else None

    def best(found):
        cov = {p: sum(bool(re.search(text(p), s)) for _, s in rows) for p in found}
        return sorted(found, key=lambda p: (-cov[p], text(p)))[:n], cov

    first, cov = best({tuple(s[i : i + 3]) for _, s in rows for i in range(len(s) - 2)})
    want, state = {(0, text(p), cov[p]) for p in first}, first
    for i in (1, 2):
        grown = {m for p in state for q in first if p != q and (m := merged(p, q)) and sum(len(c) - 1 for c in m) == i}
        state, cov = best(grown)
        want |= {(i, text(p), cov[p]) for p in state}
    idx = kmers.index(seqs, [3])
    assert {tuple(r) for r in search.merged_tops(kmers.coverage(idx), idx, n).select("merge_cnt", "pattern", "cov").collect()} == want


def test_sequences_are_never_sent_whole(spark, seqs, tmp_path):
    """Joins of occurrences are merged, however small the file of keys that they are made from is, and a word's sequences are not joined at all."""
    seqs.write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    two = kmers.index(stored, [2])

    def plan(d):
        return d._jdf.queryExecution().executedPlan().toString()

    assert "Broadcast" not in plan(kmers.extend(two, two, 1))
    d = graphs.jaccard(two.select("kmer", "seq_id"))
    held = {}
    for i, s in sequences():
        for p in range(len(s) - 1):
            held.setdefault(s[p : p + 2], set()).add(i)
    want = {(a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a in held for b in held if a > b and held[a] & held[b]}
    assert {(r.a, r.b): r.similarity for r in d.collect()} == pytest.approx(want)
    assert "Generate" not in plan(d)  # pairs are counted before anything is joined


def test_longer_runs_are_joined_without_sending_sequences(spark, seqs, tmp_path):
    seqs.write.parquet(str(tmp_path / "s"))
    d = kmers.frequent_paths(spark.read.parquet(str(tmp_path / "s")), 6, 2)
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()


def test_coverage_is_0_where_no_word_stands_out(spark, tmp_path):
    from motifmill.plans import catalog

    spark.createDataFrame([], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    assert [r.cov for r in catalog.QUERIES["coverage_bitmap"](spark, str(tmp_path)).collect()] == [0]


def test_kmers_are_made_in_tasks_of_bounded_size(spark, seqs, monkeypatch):
    monkeypatch.setattr(kmers, "TASK_SEQS", 2)
    one = seqs.unionByName(seqs.limit(3)).coalesce(1)
    idx = kmers.index(one, [3], "ACGU")
    assert idx.rdd.getNumPartitions() >= 21  # 43 rows
    # what is counted per sequence isn't moved, and counting in the rows gives the same
    want = {tuple(r) for r in kmers.coverage(idx).collect()}
    assert {tuple(r) for r in kmers.counted(one, [3], "ACGU").collect()} == want and want
    p = spark.createDataFrame([("A[CG]U",), ("GGA",)], "pattern string")
    text = dict(sequences())
    got = {(r.pattern, r.seq_id) for r in degenerate.held(p, idx).collect()}
    assert got == {(x, i) for x in ("A[CG]U", "GGA") for i, s in text.items() if re.search(x, s)}


def test_fisher_far_from_the_mean(spark):
    """Tables whose numbers lie millions from the mean, which the terms between them took minutes for, and exact sums of small ones on both sides of the mean."""
    tables = [(9_000_000, 16_000_000, 4_000_000, 21_000_000), (0, 0, 0, 0), (0, 5, 0, 3), (3, 0, 0, 3), (1, 9, 11, 3), (10, 10, 10, 10), (0, 1000, 500, 500), (300, 1700, 300, 100)]
    p = background.fisher(*[F.col(x) for x in "abcd"])
    got = {tuple(r[:4]): r.p for r in spark.createDataFrame(tables, "a long, b long, c long, d long").select("*", p.alias("p")).collect()}
    assert got[tables[0]] == 0
    for a, b, c, d in tables[1:]:
        row, col, n = a + b, a + c, a + b + c + d
        every = {x: math.comb(row, x) * math.comb(n - row, col - x) for x in range(max(0, col - (n - row)), min(row, col) + 1)}
        exact = sum(v for v in every.values() if v <= every[a]) / math.comb(n, col)
        assert got[a, b, c, d] == pytest.approx(exact, rel=1e-9)
